"""Helpers that several of the operators share: scratch tables, texts, connected components, running sums."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablework.session import shared_path

#: White space of the contracts: the blank and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for the functions that run in Python there."""
    sc = spark.sparkContext
    if getattr(sc, "_tablework_sent", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "tablework.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "tablework")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    sc.addPyFile(path)
    sc._tablework_sent = True


#: Has Spark delete the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage.

    The folder is the one of ``spark.checkpoint.dir``, so the table outlives a lost executor. The shuffle files
    behind it are deleted once it is written, and the table itself by ``discard`` when nothing reads it any more.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table behind what ``scratch`` returned."""
    remove(df.sparkSession, df._scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, wherever Spark has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone in lower case; texts of ASCII only take the cheaper ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, UPPER.lower()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def boxed(df: DataFrame, **named: str) -> DataFrame:
    """All columns as the struct ``row``, and beside it the named ones under names that can't clash with others."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[F.col(f"`{c}`").alias(name) for name, c in named.items()])


def clear_names(df: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns only, so that no other column can clash with a name made here."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its ``by`` group up to and with it.

    The rows are range-sorted over all tasks by ``by`` and ``order`` and written down; each task's sums are
    added up over the tasks before it. So a group that holds a third of all rows is spread over as many tasks
    as its size asks for. What one task sees besides is one row per task and group. Rows that tie in ``order``
    share a task; the order must tell apart all rows whose place matters.
    """
    n = shuffle_partitions(df.sparkSession)
    keys = [F.col(c) for c in by + order]
    laid = scratch(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "running-sum")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if by \
        else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy(*by, "_part").agg(F.sum(value).alias("_sum")) \
        .withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = laid.withColumn(out, F.sum(value).over(within))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_part"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    kept = [F.col(f"l.{c}") for c in df.columns]
    return inside.alias("l").join(starts.alias("r"), cond) \
        .select(*kept, (F.col(f"l.{out}") + F.col("r._start")).alias(out))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: rows (node, component), the smallest node of each component.

    Alternating large-star and small-star steps: each round is two groupings whose edges never outnumber the
    links, in about log(nodes) rounds. Hot nodes are no trouble: only minima are aggregated, with partial
    sums, and the joins that follow are plain ones that adaptive execution may split. Every round is written
    to the shared folder. Nothing but one count per round reaches the driver.
    """
    edges = scratch(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), "cc-links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")) if large \
            else both.groupBy("u").agg(F.min("v").alias("m"))
        joined = both.join(low, "u")
        if large:  # larger neighbours move to the smallest of the neighbourhood
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # the node and its smaller neighbours move to the smallest
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v") \
                .unionByName(low.select("u", F.col("m").alias("v")))
        return moved.where("u != v").distinct()

    sign = None
    while True:
        before = edges
        edges = scratch(star(star(edges, True), False), "cc")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
