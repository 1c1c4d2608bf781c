"""A training corpus from ``documents``: language ID, line dedup, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of the table they are given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import bpe, langid, lines, mixing, ngram_join
from tablework.llm.common import remove, ship
from tablework.session import shared_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of rows that a Python worker is handed at a time, unless the session has a figure of its own. Spark's 64 MB, or 10,000
#: rows, are held by the JVM, by the worker and as its results, in each task of an executor at once, and longer than needed.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: A document goes if its language is less likely than this, or has no letters at all.
LEAST_SCORE = 0.5


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors and set the size of batches, for the session: stages are run after they return."""
    ship(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of ``LEAST_SCORE`` or more; ``und`` goes.

    The score compares the learned languages only and is near 1 for any text of more than a few words: besides ``und``, only
    short texts near even between languages go, and gibberish or a language not learned is kept.
    The model is fitted on the labelled rows of ``docs`` itself; the label has no say in a row's own fate.
    Without any labelled row there is no model, nothing can be told, and nothing is rejected.
    """
    prepare(spark)
    model = langid.train(docs.where(~langid.held_out()), PIECES)
    if not model:
        return docs
    told = langid.predict(docs, model, PIECES, lang_out="_told", score_out="_sure")
    return told.where((F.col("_told") != "und") & (F.col("_sure") >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of smaller id has; n_chars follows the text."""
    return lines.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in five-word shingles (Jaccard 0.75 or more), the one of the smallest id."""
    prepare(spark)
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources (weights 1, 2, 3 in turn) takes it; some not at all."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id, n_tokens, ids, and the digests of the ids and of the bytes they decode to."""
    prepare(spark)
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("mix", mix), ("token_ids", token_ids)]

#: Language ID and BPE are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole of ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
