"""Keyed lists whose positions are kept as messages arrive: ordered segments with sizes, of which a batch rewrites the touched ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablework.plans.skew import ranked
from tablework.sources import folders
from tablework.streaming.levels import LevelledTable

#: A segment is as wide as 2^WIDEST order values at first; one with too many entries is split into 2^STEP narrower ones.
WIDEST, STEP = 30, 5
LEVELS = WIDEST // STEP

SEGMENT = ("key", "level", "segment")
#: Versions with living entries that may stand side by side, and what the tag of a run ends with that only moved entries.
VERSIONS, TIDIED = 32, "_tidied"


def _segment(level: int, order: str = "ord") -> Column:
    return F.shiftright(F.col(order), WIDEST - STEP * level)


def _same(left: str, right: str, columns: tuple[str, ...]) -> Column:
    """Equality of all columns; null keys are equal, the other columns are never null."""
    cond = F.col(f"{left}.{columns[0]}").eqNullSafe(F.col(f"{right}.{columns[0]}"))
    for c in columns[1:]:
        cond = cond & (F.col(f"{left}.{c}") == F.col(f"{right}.{c}"))
    return cond


class SegmentedList:
    """The list of each key, newest (largest ``ord``) first, below ``path``.

    Entries of neighbouring ``ord`` are a segment and are stored with their place in it. ``segments`` is a levelled table of
    each segment's size and the version (batch) that wrote it; ``data/version=v`` holds what batch v wrote. A batch
    finds its segments by joins on their numbers, one per level, writes these only, and splits those that have over
    ``limit`` entries. The position of an entry is the sizes of the key's segments above its own plus its place: reading
    sorts segments, a ``limit``-th of the entries or so, and ranks nothing else.

    ``ord`` is a whole number, and entries of equal ``ord`` go by value. Entries of one and the same ``ord`` are never split apart;
    so many as to be a task's share are ranked in slices like any heavy key. Once more entries are dead than alive, or batches have left
    many small versions, living entries are written anew together, which costs each a few more writes in all. What the newest
    two versions replaced stays for readers that are at it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, limit: int = 4096):
        self.spark, self.path, self.limit = spark, path.rstrip("/"), limit
        self.segments = LevelledTable(spark, f"{self.path}/segments", SEGMENT)

    def _data(self, version: int) -> str:
        return f"{self.path}/data/version={version}"

    def _live(self, segments: DataFrame) -> DataFrame:
        """The entries of ``segments`` (a part of the segment table), with their place."""
        return self._entries().alias("e").join(segments.where("n > 0").alias("s"), _same("e", "s", (*SEGMENT, "version"))) \
            .select("e.key", "e.level", "e.segment", "e.value", "e.ord", "e.place")

    def _leaves(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the level and number of the segment each belongs to: the first on its way down that isn't split."""
        out = rows.withColumns({"level": F.lit(0), "segment": _segment(0)})
        if self.segments.is_empty():
            return out
        split = self.segments.read().where("n < 0").select("key", "level", "segment")
        deepest = split.agg(F.max("level")).first()[0]
        for level in range(0 if deepest is None else deepest + 1):
            out = self._down(out, split.where(F.col("level") == level))
        return out

    @staticmethod
    def _down(rows: DataFrame, split: DataFrame) -> DataFrame:
        """``rows`` with those of the ``split`` segments a level further down."""
        narrower = F.lit(None).cast("long")
        for level in range(1, LEVELS + 1):
            narrower = F.when(F.col("r.level") == level - 1, _segment(level, "r.ord")).otherwise(narrower)
        here = split.withColumn("split", F.lit(True)).alias("s")
        down = F.coalesce(F.col("s.split"), F.lit(False))
        return rows.alias("r").join(here, _same("r", "s", SEGMENT), "left").select(
            "r.key", "r.value", "r.ord", (F.col("r.level") + down.cast("int")).alias("level"),
            F.when(down, narrower).otherwise(F.col("r.segment")).alias("segment"))

    def _stage(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/staged/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/staged/{name}")

    def add(self, batch: DataFrame, tag: str) -> None:
        """Put in entries (key, value, ord). A batch of the newest ``tag`` is there already and does nothing."""
        runs = self.segments.runs()
        if runs and runs[-1].tag in (tag, f"{tag}{TIDIED}"):
            return
        version = runs[-1].last + 1 if runs else 0
        folders.delete(self.spark, self._data(version))  # of a batch that failed
        rows = self._stage(self._leaves(batch.select("key", "value", F.col("ord").cast("long").alias("ord"))), "batch")
        merged = rows
        if runs:
            touched = rows.select(*SEGMENT).distinct()
            old = self.segments.read().alias("c").join(touched.alias("t"), _same("c", "t", SEGMENT), "left_semi")
            merged = self._stage(rows.unionByName(self._live(old).select(*rows.columns)), "merged")
        marks, rounds = None, 0
        while True:
            full = merged.where(F.col("level") < LEVELS).groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.limit)
            full = self._stage(full.select(*SEGMENT), f"full-{rounds}")
            if full.isEmpty():
                break
            marks = full if marks is None else marks.unionByName(full)
            merged = self._stage(self._down(merged, full), f"split-{rounds}")
            rounds += 1
        ranked(merged, list(SEGMENT), ["ord", "value"], "place").write.mode("overwrite").parquet(self._data(version))
        written = self.spark.read.parquet(self._data(version)).groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"))
        if marks is not None:
            written = written.unionByName(marks.withColumn("n", F.lit(-1).cast("long")))
        self.segments.add(written.withColumn("version", F.lit(version)), tag)
        folders.delete(self.spark, f"{self.path}/staged")
        self._tidy(tag)

    def _tidy(self, tag: str) -> None:
        """Delete versions without a living entry; write the living ones of some versions anew where it pays.

        That is all of them once fewer than half of the entries stored live, else the smaller half once there are over ``VERSIONS``.
        """
        living = {r["version"]: r["n"] for r in self.segments.read().where("n > 0").groupBy("version").agg(F.sum("n").alias("n")).collect()}
        stored = {r["version"]: r["count"] for r in self._entries().groupBy("version").count().collect()}
        newest = max(stored)
        for v in stored:
            if v not in living and v < newest - 1:
                folders.delete(self.spark, self._data(v))
        if sum(stored[v] for v in living) > 2 * sum(living.values()) and len(living) > 1:
            chosen = list(living)
        elif len(living) > VERSIONS:
            chosen = sorted(living, key=living.get)[:VERSIONS // 2 + 1]
        else:
            return
        version = self.segments.runs()[-1].last + 1
        folders.delete(self.spark, self._data(version))
        current = self.segments.read().where((F.col("n") > 0) & F.col("version").isin(chosen))
        self._live(current).select("key", "value", "ord", "level", "segment", "place").write.mode("overwrite").parquet(self._data(version))
        self.segments.add(current.withColumn("version", F.lit(version)), f"{tag}{TIDIED}")

    def _entries(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/version=*")

    def read(self) -> DataFrame:
        """(key, position, value), positions from 1 within each key, newest first."""
        above = Window.partitionBy("key").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, -1)
        width = F.element_at(F.array(*[F.lit(1 << (WIDEST - STEP * k)) for k in range(LEVELS + 1)]), F.col("level") + 1)
        segments = self.segments.read().where("n > 0").withColumn("low", F.col("segment") * width)
        segments = segments.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0)))
        return self._entries().alias("e").join(segments.alias("s"), _same("e", "s", (*SEGMENT, "version"))).select(
            "e.key", (F.col("s.before") + F.col("s.n") - F.col("e.place") + 1).alias("position"), "e.value")
