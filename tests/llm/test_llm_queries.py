"""Every query of the dealt operators: against its SQL, or against plain Python over the same whole table."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tablework.llm import packing, queries
from tests import oracle
from tests.llm import plain

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def encoding():
    return plain.encoding(queries.RANKS, public_tokenizers.PATTERN)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_against_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLES[name]) == []


def test_pack_tokens(spark, docs, encoding):
    rows = queries.QUERIES["op1_pack_tokens"](spark, SF).collect()
    got = {}
    for row in rows:
        assert len(row["input_ids"]) == len(row["position_ids"]) == 2 * 2048
        positions = np.frombuffer(row["position_ids"], "<u2")
        for start, end in zip(row["cu_seqlens"], row["cu_seqlens"][1:]):
            assert positions[start:end].tolist() == list(range(end - start))
        for doc, start, ids in packing.unpack(row):
            got.setdefault(doc, {})[start] = ids.tolist()
    joined = {doc: [i for _, ids in sorted(parts.items()) for i in ids] for doc, parts in got.items()}
    assert joined == {doc: encoding.encode_ordinary(text or "") + [50256] for doc, text, _, _ in docs}
    full = sum(r["n_tokens"] for r in rows)
    assert len(rows) <= math.ceil(full / 2048) + 2


def test_ngram_join(spark, docs):
    rows = queries.QUERIES["op3_ngram_join"](spark, SF).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == plain.jaccard_groups([(d, t) for d, t, _, _ in docs])


def test_language_id(spark, docs):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_language_id"](spark, SF).collect()}
    assert len(rows) == len(docs)
    right = total = 0
    for doc, text, lang, _ in docs:
        r = rows[doc]
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if r["held_out"] and r["lang_pred"] != "und":
            total += 1
            right += r["lang_pred"] == lang
    assert right >= 0.98 * total > 0


def test_embedding_dedup(spark):
    vectors = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    rows = queries.QUERIES["op5_embedding_dedup"](spark, SF).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in rows} == plain.vector_groups(vectors, 0.95)


def test_bpe_round_trip(spark, docs, encoding):
    rows = queries.QUERIES["op8_bpe_round_trip"](spark, SF).collect()
    want = {}
    for doc, text, _, _ in docs:
        ids = encoding.encode_ordinary(text or "")
        want[doc] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in rows} == want


def test_pipeline(spark, docs, encoding):
    """The stages after language ID, whose own choice is taken from its output, against plain Python."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    told = corpus_pipeline.language_id(spark, given, SF)
    assert told.columns == given.columns
    kept = [tuple(r) for r in told.select("doc_id", "text", "source").collect()]
    gone = {d for d, *_ in docs} - {d for d, *_ in kept}
    letterless = {d for d, text, *_ in docs if not any(c.isalpha() for c in text or "")}
    assert letterless <= gone and len(gone) <= len(letterless) + len(docs) // 100
    lines = plain.line_dedup([(d, t) for d, t, _ in kept])
    cut = [(d, lines[d][2] if lines[d][1] else t, s) for d, t, s in kept]
    groups = plain.jaccard_groups([(d, t) for d, t, _ in cut])
    single = [(d, t, s) for d, t, s in cut if groups[d][1] == d]
    copies = plain.mix(single)
    want = sorted((d, len(encoding.encode_ordinary(t or ""))) for d, t, _ in single for _ in range(copies[d]))
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == want
    assert all(hashlib.sha256(encoding.decode_bytes(r["ids"])).hexdigest() == r["decoded_sha256"] for r in out)
