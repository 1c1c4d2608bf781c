"""Text, JSON and file-tree readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions.jsons import json_map
from tablework.operators.lines import read_marks

_TEXTS = T.ArrayType(T.StringType())

# Fixed formats: the two record layouts of poem collections.
LYRIC = T.StructType([T.StructField("author", T.StringType()), T.StructField("rhythmic", T.StringType()),
                      T.StructField("paragraphs", _TEXTS)])
VERSE = T.StructType([T.StructField("author", T.StringType()), T.StructField("title", T.StringType()),
                      T.StructField("paragraphs", _TEXTS), T.StructField("biography", T.StringType()),
                      T.StructField("notes", _TEXTS), T.StructField("volume", T.StringType()),
                      T.StructField("no#", T.StringType())])
RENAMES = {"rhythmic": "title", "no#": "no"}


def json_records(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.json",
                 multi_line: bool = True, renames: dict[str, str] | None = None) -> DataFrame:
    """Records from files that hold JSON arrays, with a fixed nested schema.

    ``multi_line`` reads one array per file, which takes a whole file per task; otherwise one array (or object)
    per line, which Spark can split.
    """
    records = (spark.read.schema(schema).option("multiLine", multi_line)
               .option("pathGlobFilter", glob).json(path))
    for old, new in (RENAMES if renames is None else renames).items():
        records = records.withColumnRenamed(old, new)
    return records


def lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """Lines of text files in order: ``(file, line_no, value)``.

    Files are read in splits, so no file has to fit into one task. A line
    number is the number inside the split plus the lines of the splits before
    it. With ``comments`` see :func:`tablework.operators.lines.read_marks`.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"))
    inside = raw.withColumn(
        "_no", F.row_number().over(Window.partitionBy("file", "_block").orderBy("_seq")))
    earlier = (Window.partitionBy("file").orderBy("_block")
               .rowsBetween(Window.unboundedPreceding, -1))
    before = (inside.groupBy("file", "_block").agg(F.max("_no").alias("_n"))
              .select("file", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    # Were the splits of a second scan others, lines would miss their number: that must be an error, not a loss.
    known = F.coalesce("_before", F.raise_error(F.lit("the splits of a file changed while it was read")).cast("bigint"))
    numbered = (inside.join(before, ["file", "_block"], "left")
                .select("file", (known + F.col("_no")).alias("line_no"), "value"))
    return read_marks(numbered) if comments else numbered


def json_lines(df: DataFrame, col: str = "value") -> DataFrame:
    """Add ``props``: the JSON object of each line as a map of strings."""
    return df.withColumn("props", json_map(F.col(col)))


def file_inventory(spark: SparkSession, root: str, recurse: bool = True, glob: str | None = None,
                   include_dirs: bool = False) -> DataFrame:
    """``(path, length, modificationTime, kind)`` of the files below a folder.

    File contents are not read. With ``include_dirs`` every directory that
    directly holds a listed file is added. Spark's listing leaves out empty
    files, names that start with ``_`` or ``.``, and empty directories.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recurse)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select("path", "length", "modificationTime", F.lit("file").alias("kind"))
    if not include_dirs:
        return files
    dirs = (files.groupBy(F.regexp_replace("path", r"/[^/]*\z", "").alias("path"))
            .agg(F.max("modificationTime").alias("modificationTime"))
            .select("path", F.lit(0).cast("bigint").alias("length"), "modificationTime",
                    F.lit("dir").alias("kind")))
    return files.unionByName(dirs)


def read_files(spark: SparkSession, root: str, recurse: bool = True,
               glob: str | None = None) -> DataFrame:
    """``(path, content)`` of the files below a folder, one row per file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recurse)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "content")


def map_files(files: DataFrame, func: Callable[[str, bytes], tuple], schema: str) -> DataFrame:
    """Apply a user function to each ``(path, content)``; it returns one result row."""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [func(path, content) for path, content in zip(batch["path"], batch["content"])]
            yield pd.DataFrame(results, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)
