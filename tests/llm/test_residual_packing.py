"""Hierarchical packing: ids, cuts and places against the tokenizer, and odd tables."""

import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablework.llm import queries
from tablework.llm import residual_packing as rp
from tests.llm.test_edges import docs_of

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, docs, ids_of, size):
    """Every document is there once per row, cut as it must be, and no places overlap or are left open; the number of sequences."""
    want = Counter()
    for doc, text in docs:
        ids = ids_of(text)
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        for piece, start in enumerate([0, *range(first, len(ids), size)]):
            part = ids[start:first if not piece else start + size]
            want[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return len(held)


def test_query(spark, ids_of):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rows = queries.QUERIES["op13_residual_packing"](spark, SF).collect()
    n = check(rows, docs, ids_of, 1024)
    assert n <= math.ceil(sum(len(ids_of(t)) for _, t in docs) / 1024) + 2


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b c", "\n x\n\n y", "it's  'we're'\t'll", "x \x1c y", "é ü　 x", "a\x85 b", "­ a­b", "ª²¼ÿ ĀɎ x²³",
                                  "<|endoftext|> a<|endoftext|>", "日本語 テキスト です", "🙂 🙂🙂", "a\r\n b \r\n", "x" + " " * 5000 + "\t y"])
def test_ids(text, ids_of):
    assert np.frombuffer(rp.piece_encoder(FILE).encode(text), "<u4").tolist() == ids_of(text)[:-1]


def test_ids_of_long_runs(ids_of):
    for text in (" " * 2_000_000 + "x", "\n" * 500_000, "a" * 300_000):
        ids = np.frombuffer(rp.piece_encoder(FILE).encode(text), "<u4")
        assert rp.piece_encoder(FILE).tokenizer.decode(ids[:1000].tolist()) == text[:len(rp.piece_encoder(FILE).tokenizer.decode(ids[:1000].tolist()))]
        assert len(rp.piece_encoder(FILE).tokenizer.decode(ids.tolist())) == len(text)


@pytest.mark.parametrize("sizes", [{}, {"partition_pieces": 20, "fan_in": 2, "carried": 2}, {"partition_pieces": 7, "fan_in": 3, "carried": 64}])
def test_odd_documents(spark, ids_of, sizes):
    rows = [(1, "a", None, None), (1, "a", None, None), (None, "b c", None, None), (2, None, None, None), (3, "", None, None), (4, " \n ", None, None),
            (5, "the quick brown fox " * 4000, None, None), (6, "word " * 1023, None, None), (7, "word " * 1022 + "word", None, None)]
    rows += [(10 + i, "some words of a text " * (i * 7 % 150), "en", "s") for i in range(150)]
    docs = docs_of(spark, rows).withColumnsRenamed({"_id": "row", "_text": "length", "text2": "up", "ids": "fill", "id": "node"})
    got = rp.pack_documents(docs, FILE, **sizes).collect()
    n = check(got, [(i, t) for i, t, *_ in rows], ids_of, 1024)
    least = math.ceil(sum(len(ids_of(t)) for _, t, *_ in rows) / 1024)
    assert n <= least * 1.1 + 2


def test_empty_table(spark):
    out = rp.pack_documents(docs_of(spark, []), FILE)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() == 0


def test_merging_up_the_tree_saves_sequences(spark):
    """Items that leave a rest in every partition: the rests share sequences at the end."""
    pieces = spark.range(4000).select(F.col("id").alias("row"), (F.lit(600) - F.col("id") % 500).alias("length"))
    one = rp.pack_pieces(pieces, partition_pieces=10_000).select("sequence_id").distinct().count()
    parts = rp.pack_pieces(pieces, partition_pieces=50, fan_in=4, carried=16)
    assert parts.count() == 4000 and parts.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    n, alone = parts.select("sequence_id").distinct().count(), rp.scratch(parts, "t").where("sequence_id < (1L << 56)").count()
    assert alone < 4000 and n <= 1.15 * one


def test_best_fit_is_tight():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 400, 5000)
    at, place, fill = rp.best_fit(lengths, 1024)
    assert fill.max() <= 1024 and len(fill) <= math.ceil(lengths.sum() / 1024) + 1
    for b in range(0, len(fill), 97):
        spans = sorted((int(p), int(n)) for p, n in zip(place[at == b], lengths[at == b]))
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
    assert (fill <= 512).sum() <= 1


def test_ids_come_along(spark, ids_of):
    got = rp.pack_documents(docs_of(spark, [(1, "one two", None, None), (2, None, None, None)]), FILE, with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {1: ids_of("one two"), 2: [2]}
