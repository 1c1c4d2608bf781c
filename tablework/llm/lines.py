"""Lines seen in earlier documents, by levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm.common import ascii_lower, boxed, clear_names, remove, scratch, shuffle_partitions
from tablework.session import shared_path

#: The characters of the contract's white space that can stand at the end of a line.
BLANKS = " \t\n\x0b\x0c\r"


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """128 bits over the key of a line (already in lower case)."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Sorted runs of (h1, h2, first_id), in levels; every key stands in one run only.

    A run is a table bucketed and sorted by the hash, so that a join of new keys with it moves the new
    keys alone. ``fanout`` runs of a level are merged into one of the next, so there are at most
    ``fanout`` runs in each of log(batches) levels. Runs lie in the shared folder.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_path(self.spark, name)
        keys.repartition(self.buckets, "h1", "h2").write.option("path", self.paths[name]) \
            .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> None:
        """Take in a batch of (h1, h2, id): keys that no run has yet become a new run.

        Batches come in ascending order of id, so the first run to have a key has its smallest id.
        """
        new = batch.groupBy("h1", "h2").agg(F.min("id").alias("first_id"))
        for run in self.tables():
            new = new.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self.write(new))
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self.spark.table(self.levels[level][0])
            for t in self.levels[level][1:]:
                merged = merged.unionByName(self.spark.table(t))
            name = self.write(merged)
            for t in self.levels[level]:
                self.drop(t)
            self.levels[level] = []
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE {table}")
        remove(self.spark, self.paths.pop(table))

    def all(self) -> DataFrame:
        """Every key once, with the smallest id that holds it."""
        first, *rest = self.tables()
        for t in rest:
            first = first.unionByName(t)
        return first

    def release(self) -> DataFrame:
        """The same, read from the files; the catalog has no entries of the runs any more."""
        schema, names = self.all().schema, [t for level in self.levels for t in level]
        for t in names:
            self.spark.sql(f"DROP TABLE {t}")  # the files stay, as the tables have paths of their own
        return self.spark.read.schema(schema).parquet(*[self.paths[t] for t in names])


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 10, batches: int = 4) -> DataFrame:
    """(id, text_hash, place) of the lines that an earlier document has: all holders of a key but the smallest id.

    ``place`` counts a text's lines from 0; ``text_hash`` tells texts of one id apart. Documents go in ``batches`` of ascending
    id through the runs; where the bounds between batches lie does not change the result. Ids are numbers.
    """
    spark = docs.sparkSession
    rows = clear_names(docs, id_col, text_col).toDF("id", "text")
    bounds = rows.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = sorted(set(bounds))
    batch = F.lit(len(bounds))
    for i, bound in reversed(list(enumerate(bounds))):
        batch = F.when(F.col("id") <= F.lit(bound), F.lit(i)).otherwise(batch)
    line = F.posexplode_outer(split_lines(ascii_lower(F.col("text"))))
    entries = scratch(
        rows.withColumn("text_hash", text_hash(F.col("text")))  # once a text, below the explode
        .select("id", "text_hash", line.alias("place", "_line"))
        .where(F.char_length(F.btrim("_line", F.lit(BLANKS))) >= min_chars)
        .select("id", "text_hash", "place", line_hash(F.col("_line")).alias("_h"), batch.alias("_batch"))
        .select("id", "text_hash", "place", "_h.h1", "_h.h2", "_batch"), "line-entries", "_batch")
    runs = LineRuns(spark)
    for i in range(len(bounds) + 1):
        runs.add(entries.where(F.col("_batch") == i))
    return entries.join(runs.release(), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first_id"))) \
        .select("id", "text_hash", "place")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
               batches: int = 4) -> DataFrame:
    """``docs`` with the struct ``_lines``: n_lines (before), n_dropped and kept (the text that stays).

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
    ``min_chars`` code points that several documents have lose all their lines but those of the smallest id;
    lines repeated inside that document stay. Null and empty texts have one empty line. Rows of equal id
    are one document; null ids come after all others and are one document too. A text whose lines
    all go becomes the empty text. Ids are numbers. Other columns pass through (``_lines`` is replaced). Keys are compared
    by 128 hash bits. The time goes with a text's lines, however many there are and go.
    """
    docs = docs.drop("_lines")
    cut = kept_lines(docs, id_col, text_col, min_chars, batches)
    return cut.select("row.*", F.struct("n_lines", "n_dropped", "kept").alias("_lines"))


def kept_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(row, n_lines, n_dropped, kept), ``row`` being the input row."""
    drops = dropped_lines(docs, id_col, text_col, min_chars, batches).groupBy(F.col("id").alias("drop_id"), "text_hash") \
        .agg(F.array_sort(F.collect_set("place")).alias("_places"))
    # one byte a line up to the last dropped one, so that each line finds its own at once
    before = F.concat(F.array(F.lit(-1)), F.slice("_places", 1, F.size("_places") - 1))
    marks = F.array_join(F.zip_with("_places", before, lambda at, last: F.concat(F.repeat(F.lit("0"), at - last - 1), F.lit("1"))), "")
    drops = drops.select("drop_id", "text_hash", F.encode(marks, "UTF-8").alias("marks"), F.size("_places").alias("n_drops"))
    text = F.coalesce("text", F.lit(""))
    stay = F.filter(split_lines(text), lambda _, i: F.substring(F.col("marks"), i + 1, 1) != F.lit(bytearray(b"1")))
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    has = F.col("marks").isNotNull()
    rows = boxed(docs, id=id_col, text=text_col).withColumn("own_hash", text_hash(F.col("text")))
    return rows.join(drops, F.expr("id <=> drop_id and own_hash = text_hash"), "left").select(
        "row", n.cast("long").alias("n_lines"), F.coalesce("n_drops", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(has, F.array_join(stay, "\n")).otherwise(text).alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                        batches: int = 4, chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated lines cut from their text, and ``chars_col`` brought up to date if there is one.

    Untouched rows, null texts too, stay as they are.
    """
    cut, changed = kept_lines(docs, id_col, text_col, min_chars, batches), F.col("n_dropped") > 0
    new = {text_col: F.col("kept")}
    if chars_col in docs.columns:
        new[chars_col] = F.char_length("kept").cast(docs.schema[chars_col].dataType)
    old = {c: F.col("row")[c] for c in docs.columns}
    return cut.select(*[(F.when(changed, new[c]).otherwise(old[c]) if c in new else old[c]).alias(c) for c in docs.columns])
