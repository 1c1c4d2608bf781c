"""Moving many tables, collections or indexes from one store to another."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.operators.names import name_expr, name_filter
from tablework.plans.skew import lookup_join
from tablework.sources.catalog import table_counts
from tablework.sources.sinks import latest_by_key, upsert_by_key

log = logging.getLogger(__name__)

REPORT = ("name string, target string, action string, copy string, n_rows bigint, "
          "status string, error string")


def migration_plan(src: DataFrame, tgt: DataFrame, force: bool = False, merge: bool = False,
                   meta_only: bool = False, skip_same: bool = False) -> DataFrame:
    """What happens to each source name: ``(name, target, action, copy)``.

    ``src`` has ``name`` and optionally ``target`` (else the name itself);
    ``tgt`` has ``name``. ``skip_same`` is for moves inside one store, where
    a name that maps to itself must be left alone.
    """
    named = src if "target" in src.columns else src.withColumn("target", F.col("name"))
    there = tgt.select(F.col("name").alias("target")).distinct().withColumn("_there", F.lit(True))
    joined = lookup_join(named.select("name", "target"), there, ["target"], "left")
    same = F.col("name") == F.col("target") if skip_same else F.lit(False)
    action = (F.when(F.col("target").isNull(), "skip_null_target")
              .when(same, "skip_same")
              .when(F.col("_there") & F.lit(force), "replace")
              .when(F.col("_there") & F.lit(not merge), "skip_exists")
              .when(F.col("_there"), "merge")
              .otherwise("create"))
    copies = "meta_only" if meta_only else "copy"
    return (joined.withColumn("action", action)
            .withColumn("copy", F.when(F.col("action").startswith("skip"), "none").otherwise(copies))
            .select("name", "target", "action", "copy"))


class PathStore:
    """Tables as folders (or files) below a path, in any installed format."""

    def __init__(self, spark: SparkSession, base: str, fmt: str = "parquet", suffix: str = "",
                 names: Sequence[str] | None = None):
        self.spark, self.base, self.fmt, self.suffix = spark, base.rstrip("/"), fmt, suffix
        self.known = names

    def path(self, name: str) -> str:
        return f"{self.base}/{name}{self.suffix}"

    def folder(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """The given names, or those of everything right below the path, whatever they begin with.

        One level of the file system is listed; none is there only where the path itself is absent.
        """
        if self.known is not None:
            return list(self.known)
        at, fs = self.folder(self.base)
        if not fs.exists(at):
            return []
        found = {f.getPath().getName() for f in fs.listStatus(at)}
        return sorted(n.removesuffix(self.suffix) for n in found if n.endswith(self.suffix))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.format(self.fmt).load(self.path(name))

    def write(self, name: str, df: DataFrame, mode: str, settings: dict[str, str]) -> None:
        df.write.format(self.fmt).options(**settings).mode(mode).save(self.path(name))

    def swap(self, name: str, df: DataFrame, settings: dict[str, str]) -> None:
        """Replace a table by rows computed from it: write aside, then change names.

        The old table is moved away and deleted last, so that a failure on the way loses neither; nothing of
        the change stays behind. A reader meets the old table, the new one, or for a moment none.
        """
        aside = f"{self.base}/.swap-{uuid.uuid4().hex}"
        df.write.format(self.fmt).options(**settings).save(f"{aside}/new")
        here, fs = self.folder(self.path(name))
        new, old = (self.folder(f"{aside}/{x}")[0] for x in ("new", "old"))
        if not fs.rename(here, old):
            raise OSError(f"{self.path(name)} can't be moved away")
        if not fs.rename(new, here):
            fs.rename(old, here)
            raise OSError(f"the new {self.path(name)} can't be moved in")
        fs.delete(self.folder(aside)[0], True)


class CatalogStore:
    """Tables of a catalog database."""

    def __init__(self, spark: SparkSession, db: str, fmt: str = "parquet"):
        self.spark, self.db, self.fmt = spark, db, fmt

    def names(self) -> list[str]:
        tables = self.spark.catalog.listTables(self.db)
        return sorted(t.name for t in tables if not t.isTemporary)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.db}.`{name}`")

    def write(self, name: str, df: DataFrame, mode: str, settings: dict[str, str]) -> None:
        df.write.format(self.fmt).mode(mode).saveAsTable(f"{self.db}.`{name}`")
        if settings:
            pairs = ", ".join(f"'{k}' = '{v}'" for k, v in settings.items())
            self.spark.sql(f"alter table {self.db}.`{name}` set tblproperties ({pairs})")

    def swap(self, name: str, df: DataFrame, settings: dict[str, str]) -> None:
        aside = f"{name}__{uuid.uuid4().hex[:8]}"
        self.write(aside, df, "errorifexists", settings)
        self.spark.sql(f"alter table {self.db}.`{name}` rename to {self.db}.`{aside}_old`")
        self.spark.sql(f"alter table {self.db}.`{aside}` rename to {self.db}.`{name}`")
        self.spark.sql(f"drop table {self.db}.`{aside}_old`")


#: A target that wasn't there when the plan was made must not be there when it is created.
MODES = {"create": "errorifexists", "replace": "overwrite", "merge": "append"}


def _apply(row, source, target, key: str | None, order: str | None, settings: dict[str, str], empty: bool) -> None:
    rows = source.read(row["name"])
    if row["copy"] == "meta_only" or empty:
        if row["action"] != "merge":
            target.write(row["target"], rows.limit(0), MODES[row["action"]], settings)
    elif row["action"] == "merge" and key:
        target.swap(row["target"], upsert_by_key(target.read(row["target"]), rows, key, order), settings)
    else:
        if key:
            rows = latest_by_key(rows, key, order)
        target.write(row["target"], rows, MODES[row["action"]], settings)


def migrate(source, target, include: Sequence[str] = (), exclude: Sequence[str] = (),
            rename: str | None = None, force: bool = False, merge: bool = False,
            meta_only: bool = False, effect: bool = False, abort: bool = False,
            skip_empty: bool = False, skip_same: bool = False, key: str | None = None,
            order: str | None = None, settings: dict[str, str] | None = None,
            on_table: Callable[[str], None] | None = None) -> DataFrame:
    """Migrate the tables of one store to another and report on each.

    Names are filtered, renamed by an expression over ``it`` and planned
    (:func:`migration_plan`). Nothing is written unless ``effect`` is on. Each
    table is one distributed write; an error is logged and reported and the
    next table follows, unless ``abort`` is on. A target is created only where there is none, replaced
    only with ``force``. With ``key`` documents are saved by key, so later ones by ``order`` (which must tell
    them apart) replace earlier ones. An empty source is created or replaced like any other; ``skip_empty`` leaves out
    only its copy.
    """
    if key and not order:
        raise ValueError("key needs an order that says which document of a key is the last")
    spark = source.spark
    names = spark.createDataFrame([(n,) for n in source.names()], "name string")
    there = spark.createDataFrame([(n,) for n in target.names()], "name string")
    wanted = name_expr(name_filter(names, "name", include, exclude), "name", rename)
    # One row per table: small by nature, so the driver may walk over it.
    plan = migration_plan(wanted, there, force, merge, meta_only, skip_same).orderBy("name").collect()
    active = [row["name"] for row in plan if row["copy"] != "none"]
    counts: dict[str, int] = {}
    readable, problems = {}, {}
    for name in active:
        try:
            readable[name] = source.read(name)
        except AnalysisException as error:
            problems[name] = str(error).splitlines()[0]
    if readable:
        counts = {r["name"]: r["n_rows"] for r in table_counts(readable).collect()}
    report = []
    for row in plan:
        name, n_rows = row["name"], None
        status, problem = "skipped", problems.get(name)
        if name in readable:
            n_rows = counts.get(name, 0)
            status = "planned"
            empty = skip_empty and n_rows == 0
            if empty:
                status = "skipped_empty"
            if effect:
                try:
                    if on_table:
                        on_table(name)
                    _apply(row, source, target, key, order, settings or {}, empty)
                    status = "skipped_empty" if empty else "done"
                except Exception as error:  # one table must not stop the others
                    problem = str(error).splitlines()[0]
        if problem:
            status = "failed"
            log.error("migrate %s to %s, error occurred: %s", name, row["target"], problem)
        report.append((name, row["target"], row["action"], row["copy"], n_rows, status, problem))
        if problem and abort:
            log.info("operation is aborted by exception")
            break
    return spark.createDataFrame(report, REPORT)


def collection_report(docs: DataFrame, collection: Column, existing: DataFrame,
                      rename: str | None = None, include: Sequence[str] = (),
                      exclude: Sequence[str] = (), force: bool = False, merge: bool = False,
                      meta_only: bool = False) -> DataFrame:
    """Dry-run report for documents that carry their collection's name in a column:
    the plan of each collection with its number of documents, as one plan for Spark."""
    counted = docs.groupBy(collection.alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = name_expr(name_filter(counted.select("name"), "name", include, exclude), "name", rename)
    plan = migration_plan(wanted, existing, force, merge, meta_only)
    return plan.join(counted, "name")
