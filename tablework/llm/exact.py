"""Exact duplicates by salted combining of digest groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import SPACE, boxed, clear_names


def normalised(text):
    """Each run of white space as one blank; null counts as empty.

    Only runs that differ from one blank are rewritten, which gives the same text for fewer replacements.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Three combining stages, each grouping by digest *and* full text: (1) inside each task, before any shuffle;
    (2) per digest and salt, so that a text that makes up a third of all rows meets in ``salts`` places; (3)
    the winners of the salts, at most ``salts`` rows a text. The rows then take their group's winner by
    digest, a second hash and length; that join has one row per group on its right side, and adaptive execution
    splits its left side where a group is hot.

    Null text counts as empty. A null id never wins over another one; rows of null ids alone stay, with a null
    keep_id. Rows of equal id and equal text are one document: all of them are marked alike. An empty
    table gives no rows. Further columns of the input are not read.
    """
    rows = clear_names(docs, id_col, text_col).toDF("_id", "_text") \
        .select("_id", normalised(F.col("_text")).alias("_content"))
    print_of = [F.sha2("_content", 256).alias("_sha"), F.xxhash64("_content").alias("_h"),
                F.octet_length("_content").alias("_len")]
    local = rows.select("_id", "_content", *print_of, F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"))
    salted = local.groupBy("_sha", "_content", "_h", "_len", "_salt") \
        .agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    winners = salted.groupBy("_sha", "_content", "_h", "_len") \
        .agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size")).drop("_content")
    return rows.select("_id", *print_of).join(winners, ["_sha", "_h", "_len"]) \
        .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts, those with the smallest id."""
    groups = exact_groups(docs, id_col, text_col, salts).where("kept") \
        .select(F.col(f"`{id_col}`").alias("keep"), F.col("text_sha256").alias("keep_sha")).distinct()
    mine = boxed(docs, id=id_col, text=text_col).withColumn("sha", F.sha2(normalised(F.col("text")), 256))
    return mine.join(groups, F.expr("id <=> keep and sha = keep_sha"), "left_semi").select("row.*")
