"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import hashlib
import json
import os
import textwrap
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tablework.llm import (bpe, common, embedding_dedup, exact, langid, licenses, lines, mixing, ngram_join, packing,
                           queries, shingles, tool_calls)
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns of the names that the operators use inside.
CLASH = "_id string, _text string, id long, text2 string, rep long, size long, ids string, kept boolean, _lines string, n long, component long, h long, `a.b` string"
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(60_000))


def docs_of(spark, rows):
    """Documents with further columns, from (id, text, lang, source)."""
    wide = [(i, t, lang, s, None if t is None else len(t), "x", "y", 7, None, 1, 2, "z", True, "q", 3, 4, 5, "d") for i, t, lang, s in rows]
    return spark.createDataFrame(wide, f"{DOCS}, {CLASH}")


@pytest.fixture(scope="module")
def odd(spark):
    a, b = "the cat sat on the mat by the door", "one two three four five six seven eight nine ten"
    rows = [(1, a, "en", "s1"), (2, a + "\n", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"), (5, " \t\n ", None, "s2"),
            (6, b, "en", None), (7, b.upper(), "en", None), (8, LONG, "en", "s1"), (9, LONG + " end", "en", "s1"),
            (10, "12 34!", "en", "s3"), (11, "über die Brücke\nthe cat sat on the mat by the door", "de", "s3"), (12, "a", "en", "s3"),
            (13, "a\x00b  c\r\nd", "en", "s1"), (14, "the cat sat on the mat by the door", "en", "s1")]
    return rows, docs_of(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_exact(spark, odd, none):
    rows, docs = odd
    got = {r["doc_id"]: r for r in exact.exact_groups(docs).collect()}
    content = {i: plain.re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in rows}
    for i, c in content.items():
        same = sorted(j for j in content if content[j] == c)
        assert tuple(got[i])[1:] == (same[0], len(same), i == same[0], hashlib.sha256(c.encode()).hexdigest())
    assert exact.exact_groups(none).count() == 0
    assert sorted(r[0] for r in exact.exact_dedup(docs).select("doc_id").collect()) == sorted({min(j for j in content if content[j] == c) for c in content.values()})
    twice = docs_of(spark, [(1, "x", None, None), (1, "x", None, None), (None, "x", None, None), (None, "y", None, None)])
    assert sorted(map(str, (tuple(r)[:4] for r in exact.exact_groups(twice).collect()))) == sorted(map(str, [
        (1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)]))


def test_lines(spark, odd, none):
    rows, docs = odd
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.line_dedup(docs).select("doc_id", "_lines.*").collect()}
    assert got == plain.line_dedup([(i, t) for i, t, *_ in rows])
    assert lines.line_dedup(none).count() == 0
    cut = {r["doc_id"]: r for r in lines.drop_repeated_lines(docs).collect()}
    assert cut[3]["text"] is None and cut[11]["text"] == "über die Brücke" and cut[11]["n_chars"] == 15 and cut[11]["a.b"] == "d"
    nulls = docs_of(spark, [(None, "a shared line\nown", None, None), (5, "a shared line", None, None), (5, "a shared line", None, None)])
    assert sorted(str((r["doc_id"], r["text"])) for r in lines.drop_repeated_lines(nulls).collect()) == \
        ["(5, 'a shared line')", "(5, 'a shared line')", "(None, 'own')"]


def test_documents_of_very_many_lines(spark):
    """Two documents of 200,000 lines in common, and rows of one id whose texts differ."""
    many = "\n".join(f"this is line number {i}" for i in range(200_000))
    rows = [(1, many, None, None), (2, many + "\nonly here, at the end", None, None), (3, "own first line\n" + many[:4000], None, None),
            (3, "a line of its own\nthis is line number 7\nshort", None, None), (3, "this is line number 8", None, None)]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in
                 lines.line_dedup(docs_of(spark, rows)).select("doc_id", "_lines.*").where("doc_id > 1").collect())
    held = many[:4000].split("\n")
    rest = "own first line" if held[-1] in many.split("\n") else "own first line\n" + held[-1]
    assert got == sorted([(2, 200_001, 200_000, "only here, at the end"), (3, len(held) + 1, len(held) + 1 - len(rest.split("\n")), rest),
                          (3, 3, 1, "a line of its own\nshort"), (3, 1, 1, "")])


def test_line_runs_do_not_depend_on_batches(spark, odd):
    rows, docs = odd
    want = plain.line_dedup([(i, t) for i, t, *_ in rows])
    for batches in (1, 9):
        out = lines.line_dedup(docs, batches=batches).select("doc_id", "_lines.*").collect()
        assert {r[0]: tuple(r)[1:] for r in out} == want


def test_line_runs_are_merged(spark):
    runs = lines.LineRuns(spark, buckets=2, fanout=2)
    for i in range(5):
        batch = spark.createDataFrame([(k, 0, i) for k in range(i, i + 3)], "h1 long, h2 long, id long")
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(tuple(r) for r in runs.all().collect()) == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 1), (4, 0, 2), (5, 0, 3), (6, 0, 4)]


def test_ngram_join(spark, odd, none):
    rows, docs = odd
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_groups(docs).collect()}
    assert got == plain.jaccard_groups([(i, t) for i, t, *_ in rows])
    assert got[9][1] == 8 and got[7][1] == 6 and got[2][1] == 1
    assert ngram_join.jaccard_groups(none).count() == 0
    one = ngram_join.keep_one(docs)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, (_, c) in got.items() if i == c) and one.columns == docs.columns
    same = docs_of(spark, [(4, "a b", None, None), (4, "a b", None, None), (None, "a b", None, None), (9, "A  b", None, None)])
    assert sorted(map(str, map(tuple, ngram_join.jaccard_groups(same).collect()))) == ["(4, 1, 4)", "(4, 1, 4)", "(9, 1, 4)", "(None, 1, None)"]


def test_ngram_join_against_all_pairs(spark):
    """Chains of near copies at every distance from the threshold, many of them with a passage in common."""
    rng, rows = np.random.default_rng(5), []
    passage = [f"p{i}" for i in range(40)]
    for group in range(25):
        words = [f"g{group}w{i}" for i in range(int(rng.integers(1, 60)))] + passage * int(group % 2)
        for _ in range(int(rng.integers(1, 14))):
            words = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 3))):
                words[at] = f"n{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(words), None, None))
    got = {r[0]: (r[1], r[2]) for r in ngram_join.jaccard_groups(docs_of(spark, rows)).collect()}
    assert got == plain.jaccard_groups([(i, t) for i, t, *_ in rows])
    assert len({c for _, c in got.values()}) < len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAbé \t\n\x0b\x1c", max_size=60) | st.none(), max_size=6))
def test_shingle_sets(texts):
    sets = list(shingles.shingle_sets([None if t is None else t.encode() for t in texts]))
    known = [plain.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in known]
    for i, a in enumerate(known):
        for j, b in enumerate(known):
            assert len(np.intersect1d(sets[i], sets[j])) == len(a & b)


def test_shingles_of_long_texts(monkeypatch):
    text = (LONG + " " + "x" * 9000 + " tail " + LONG[:5000]).encode()
    whole = list(shingles.shingle_sets([text]))[0]
    monkeypatch.setattr(shingles, "CHUNK", 5000)
    assert (list(shingles.shingle_sets([b"a", text, None]))[1] == whole).all()


def test_words_that_a_plain_polynomial_confuses(spark):
    rows = []
    for size in (32, 64, 65, 512, 1024, 2048, 4096):
        word = "".join("ab"[i.bit_count() % 2] for i in range(size))
        rows += [(len(rows), word, None, None), (len(rows) + 1, word.translate(str.maketrans("ab", "ba")), None, None)]
    found = ngram_join.jaccard_groups(docs_of(spark, rows)).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == {i: (1, i) for i, *_ in rows}


def test_mixing(spark, odd, none):
    rows, docs = odd
    got = {r["doc_id"]: r for r in mixing.mix_report(docs).collect()}
    copies = plain.mix([(i, t, s) for i, t, _, s in rows])
    size = {i: len(plain.WORDS.findall(t or "")) for i, t, *_ in rows}
    per = Counter()
    for i, _, _, s in rows:
        per[s] += size[i]
    target = plain.targets(per)
    for i, _, _, s in rows:
        assert (got[i]["size"], got[i]["source_size"], got[i]["taken"]) == (size[i], per[s], copies[i] * size[i])
        assert got[i]["target"] == pytest.approx(target[s]) and got[i]["taken"] <= 3 * size[i]
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0
    out = mixing.mix(docs)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in copies.items() if n}) and out.columns == docs.columns
    empty = docs_of(spark, [(1, None, None, None), (2, "", None, "s")])
    assert [tuple(r)[2:] for r in mixing.mix_report(empty).collect()] == [(0, 0, 0.0, 0)] * 2
    twice = mixing.mix_report(docs_of(spark, [(1, "a b", None, "s")] * 3 + [(2, "c", None, "t"), (None, "d e f", None, "t")])).collect()
    assert len(twice) == 5 and len({tuple(r) for r in twice}) == 3


def test_targets_stop_at_three_times_their_size(spark):
    sizes = {"a": 5, "b": 1000, "c": 10, "d": 40, None: 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain.targets(sizes)) and got["c"] == 30.0


def test_mix_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 50 + 1)), None, f"s{i % 7 * (i % 3)}") for i in range(3000)]
    out = mixing.mix_report(docs_of(spark, rows)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 60 for r in out)


def test_language_id(spark, odd, none):
    rows, docs = odd
    out = {r["doc_id"]: r for r in langid.identify(docs, queries.PIECES).select("doc_id", "lang_pred", "score", "`a.b`").collect()}
    assert {i for i, r in out.items() if r["lang_pred"] == "und"} == {3, 4, 5, 10}
    assert all(r["score"] == 0 for r in out.values() if r["lang_pred"] == "und") and out[8]["lang_pred"] == "en"
    assert langid.identify(none, queries.PIECES).count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), queries.PIECES)
    assert {r["lang_pred"] for r in unlabelled.select("lang_pred").collect()} == {"und"}


def test_forward_sums_all_segmentations(tmp_path):
    pieces = langid.Pieces(queries.PIECES)
    rng = np.random.default_rng(1)
    p = rng.random(pieces.count)
    p /= p.sum()
    number = {piece: i for i, piece in enumerate(pieces.pieces)}

    def total(word):
        return 1.0 if not word else sum(p[number[word[:m]]] * total(word[m:]) for m in range(1, len(word) + 1) if word[:m] in number)

    words = [b" the", b" abend", "ñandú".encode(), b"x"]
    got = langid.score_words(pieces, words, np.append(p, 0)[:, None])[:, 0]
    assert got == pytest.approx([np.log(total(w)) for w in words])


def test_long_words_sum_all_segmentations():
    # pieces across any place count: against sums in logs, over many blocks and several words at a time
    pieces = langid.Pieces(queries.PIECES)
    rng = np.random.default_rng(2)
    p = rng.random(pieces.count) ** 8 + 1e-9
    p /= p.sum()
    by_piece = dict(zip(pieces.pieces, p))
    some = [x for x in pieces.pieces if len(x) > 3]
    words = [b"".join(some[i] for i in rng.integers(0, len(some), 300))[:size] for size in (1, 47, 48, 49, 81, 82, 96, 97, 700, 700)]
    words.append(" \u6f22\u5b57\u304b\u306a".encode() * 40)
    got = langid.score_words(pieces, words, np.append(p, 0)[:, None])[:, 0]
    assert got == pytest.approx([plain.segment_sums(w, by_piece)[0][-1] for w in words], rel=1e-9)
    x = np.frombuffer(words[-2], np.uint8)[None]
    mass = langid.expected_pieces(pieces, x, np.ones(1), np.append(p, 0)[:, None])
    assert sum(mass[i] * len(piece) for i, piece in enumerate(pieces.pieces)) == pytest.approx(700)  # each byte is in one piece


def test_language_id_against_plain(spark):
    # every row and score, words of 60 letters and texts without blanks among them; copies teach once, ids nothing
    base = {"en": "the house and the garden are behind these trees", "de": "das haus und der garten sind hinter diesen baeumen",
            "ja": "\u6f22\u5b57\u3068\u4eee\u540d\u306e\u6587\u7ae0\u3092\u8aad\u3080\u4eba\u304c\u3044\u308b\u3060\u308d\u3046\u304b" * 3}
    rows = []
    for lang, text in base.items():
        parts = text.split(" ")
        rows += [(len(rows) + i, " ".join(parts[i % len(parts):]) + f" {i}", lang) for i in range(9)]
        rows += [(len(rows), text.replace(" ", "") * 2, lang), (len(rows) + 1, text, lang), (len(rows) + 2, text, lang)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 _", "en"), (103, "haus", None), (None, "garden", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = langid.Pieces(queries.PIECES)
    want = plain.languages(rows, pieces.pieces, langid.FLOOR)
    out = langid.identify(df.withColumn("held_out", langid.held_out()), queries.PIECES).collect()
    assert {r["doc_id"]: (r["held_out"], r["lang_pred"]) for r in out} == {i: w[:2] for i, w in want.items()}
    assert [r["score"] for r in out] == pytest.approx([want[r["doc_id"]][2] for r in out], rel=1e-3)
    moved = [(None if i is None else 7 * i + 4, t, x) for i, t, x in rows]
    models = [langid.train(spark.createDataFrame(x, df.schema), queries.PIECES, sample_chars=200) for x in (rows, moved, rows + rows)]
    assert all(np.array_equal(models[0][x], m[x]) for m in models for x in base)


def test_packing(spark, odd, none):
    rows, docs = odd
    enc = plain.encoding(queries.RANKS, public_tokenizers.PATTERN)
    packed = packing.pack_texts(docs.repartition(3), queries.RANKS, public_tokenizers.PATTERN, seq_len=64, eos_id=50256, hold_tokens=900)
    parts = {}
    for row in packed.collect():
        assert len(row["input_ids"]) == 128 and row["n_tokens"] == row["cu_seqlens"][-1] <= 64
        for doc, start, ids in packing.unpack(row):
            assert start not in parts.setdefault(doc, {})
            parts[doc][start] = ids.tolist()
    assert {d: [x for _, ids in sorted(p.items()) for x in ids] for d, p in parts.items()} == \
        {i: enc.encode_ordinary(t or "") + [50256] for i, t, *_ in rows}
    assert packing.pack_texts(none, queries.RANKS, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (None, None), (1, [1, 2, 3]), (4, list(range(70)))], "k long, ids array<int>")
    rows = packing.pack_ids(ids.coalesce(1), "k", "ids", seq_len=10, pad_id=0, max_id=100_000).collect()
    got = Counter((doc, start, tuple(x.tolist())) for row in rows for doc, start, x in packing.unpack(row, "<u4"))
    assert got == Counter({(1, 0, (1, 2, 3)): 2, (2, 0, ()): 1, (None, 0, ()): 1} | {(4, s, tuple(range(s, s + 10))): 1 for s in range(0, 70, 10)})


def test_packed_files(spark, odd, tmp_path):
    packed = packing.pack_texts(odd[1], queries.RANKS, public_tokenizers.PATTERN, seq_len=256)
    packing.write_packed(packed, str(tmp_path / "packed"), rows_per_file=100)
    assert spark.read.parquet(str(tmp_path / "packed")).count() == packed.count()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60))
def test_best_fit_decreasing(lengths):
    rows = packing.best_fit_decreasing(lengths, 40)
    assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
    space = []  # the plain form
    for n in sorted(lengths, reverse=True):
        fit = [i for i, room in enumerate(space) if room >= n]
        if fit:
            space[min(fit, key=lambda i: space[i])] -= n
        else:
            space.append(40 - n)
    assert sorted(40 - sum(lengths[i] for i in row) for row in rows) == sorted(space)


ENCODER = bpe.Encoder(queries.RANKS, public_tokenizers.PATTERN)
PLAIN = plain.encoding(queries.RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text("ab'sS 1,\n\t \x1cé中\x85 ", max_size=80) | st.text(max_size=60))
def test_encoding_by_pieces(text):
    ids = PLAIN.encode_ordinary(text)
    assert ENCODER.encode(text) == ids
    assert np.frombuffer(ENCODER.encode_bytes(text, "<i4"), "<i4").tolist() == ids
    assert ENCODER.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text("ab \n\t1 ", min_size=30, max_size=200))
def test_encoding_in_parts(text):
    was, bpe.PART_CHARS = bpe.PART_CHARS, 16
    try:
        parts = list(ENCODER.parts(text))
    finally:
        bpe.PART_CHARS = was
    assert "".join(parts) == text
    assert [i for p in parts for i in PLAIN.encode_ordinary(p)] == PLAIN.encode_ordinary(text)


def test_texts_go_to_the_library_whole(monkeypatch):
    """Words never met before cost no call each, and none is kept: a worker's memory stays the same over any number of them."""
    enc, calls = bpe.Encoder(queries.RANKS, public_tokenizers.PATTERN), []

    class Counted:
        @staticmethod
        def encode_ordinary(text):
            calls.append(len(text))
            return PLAIN.encode_ordinary(text)

    monkeypatch.setattr(enc, "tiktoken", Counted)
    texts = [" ".join(f"w{i:x}q" for i in range(n, n + 500)) for n in range(0, 20_000, 500)]
    tracemalloc.start()
    try:
        for text in texts:
            assert np.frombuffer(enc.encode_bytes(text, "<u4"), "<u4").tolist() == PLAIN.encode_ordinary(text)
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert calls == [len(text) for text in texts] and kept < 200_000


def test_bpe_columns(spark, odd, none):
    rows, docs = odd
    coded = bpe.decode(bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN), queries.RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in coded.collect()}
    assert all(bytes(got[i]["bytes"]) == (t or "").encode() and got[i]["ids"] == PLAIN.encode_ordinary(t or "") for i, t, *_ in rows)
    assert got[1]["a.b"] == "d" and bpe.encode(none, queries.RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.round_trip(none, queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_embeddings(spark, monkeypatch):
    rng, rows = np.random.default_rng(3), []
    for i in range(400):
        base = rng.normal(size=8)
        rows += [(len(rows) + j, (base + rng.normal(size=8) * 0.25 * j / 6).tolist()) for j in range(i % 4 + 1)]
    rows += [(len(rows) + j, v) for j, v in enumerate([None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8,
                                                      rows[0][1], [2 * x for x in rows[0][1]], rows[0][1][:4], [1e300] * 8, [1e-300] * 8])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, raw string, home int")
    want = plain.vector_groups(rows, 0.95)
    for cell, block, visitors in ((1024, 1024, 4096), (60, 20, 50)):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        monkeypatch.setattr(embedding_dedup, "VISITORS", visitors)
        out = embedding_dedup.similar_groups(df, margin=0.3122499, cell_rows=cell)
        assert {r[0]: tuple(r)[1:] for r in out.collect()} == want
    assert embedding_dedup.similar_groups(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.01])], "vec_id long, embedding array<float>")
    assert sorted(str(tuple(r)) for r in embedding_dedup.similar_groups(twice).collect()) == \
        ["(1, 2, 1, True)", "(1, 2, 1, True)", "(7, 2, 1, False)", "(None, 0, None, True)"]


def test_language_sample_of_few_long_texts(spark):
    # most characters of a language in one text; a null id and texts without letters among them
    texts = {"aa": ["wort haus baum " * 20] * 3 + ["wort haus baum " * 20_000], "bb": ["tree house word " * 30_000], "cc": ["12 34"] * 9 + ["mot arbre"]}
    for lang in [f"d{i}" for i in range(12)]:
        texts[lang] = [f"x{lang[1:]} foo " * 10_000] * 2
    rows = [(None if lang == "bb" else i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    for chars in (1, 1_000, 10 ** 9):
        assert set(langid.train(df, queries.PIECES, sample_chars=chars, rounds=1)) == set(texts)


def test_embeddings_across_cells(spark):
    # few dimensions, so that partners straddle two cells along the step between the centroids
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 + i % 2).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for least in (0.95, 0.5, -0.2):
        out = embedding_dedup.similar_groups(df, least=least, cell_rows=12).collect()
        assert {r[0]: tuple(r)[1:] for r in out} == plain.vector_groups(rows, least)


def test_licenses(spark, none):
    mit = licenses.LICENSES["MIT"]
    rows = [(1, "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(" ", "\n"), None, None),
            (2, mit + " and more", None, None), (3, None, None, None), (4, "", None, None), (5, "Licensed under CC BY-NC 4.0\nfoo\n released under the MIT licence!", None, None),
            (5, "Licensed under CC BY-NC 4.0\nfoo\n released under the MIT licence!", None, None), (None, "Released under the MIT License.", None, None),
            (6, licenses.LICENSES["BSD-3-Clause"].replace('"', "”"), None, None), (7, LONG, None, None)]
    known = licenses.known_licenses(spark)
    got = sorted(str((r["doc_id"], r["license_id"], r["notices"])) for r in licenses.license_scan(docs_of(spark, rows), known).collect())
    assert got == sorted(map(str, [(1, "MIT", ""), (2, None, ""), (3, None, ""), (4, None, ""), (5, None, "CC-BY-NC-4.0,MIT"), (5, None, "CC-BY-NC-4.0,MIT"),
                                   (None, "MIT", "MIT"), (6, "BSD-3-Clause", ""), (7, None, "")]))
    assert licenses.license_scan(none, known).count() == 0
    assert licenses.license_scan(docs_of(spark, rows), known.limit(0)).where("license_id is not null").count() == 0


def test_notices_stay_in_their_row(spark):
    """Rows of one id, or of none, whose canonical forms are the same though their lines aren't."""
    rows = [(i, t, None, None) for i in (7, None) for t in ("Released under the MIT License.\nbar", "Released under the MIT License. bar")]
    got = licenses.license_scan(docs_of(spark, rows + rows), licenses.known_licenses(spark)).collect()
    assert sorted(str((r["doc_id"], r["notices"])) for r in got) == sorted(["(7, 'MIT')", "(7, '')", "(None, 'MIT')", "(None, '')"] * 2)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence files here")
def test_licence_files(spark):
    """Entire files, also in capitals and wrapped otherwise; one with a word changed isn't found."""
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0",
             "LGPL-3": "LGPL-3.0", "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl"}
    rows, want = [], {}
    for i, (name, known) in enumerate(names.items()):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8", errors="replace") as f:
            text = f.read()
        rows += [(3 * i, text, None, None), (3 * i + 1, text.replace("\n", "\n   ").replace(". ", ".  "), None, None), (3 * i + 2, text.replace(" the ", " teh ", 1), None, None)]
        want |= {3 * i: known, 3 * i + 1: known, 3 * i + 2: None}
    out = licenses.license_scan(docs_of(spark, rows), licenses.known_licenses(spark), digests=licenses.known_digests(spark)).collect()
    assert {r["doc_id"]: r["license_id"] for r in out} == want


def test_licenses_as_shipped(spark):
    texts, wrapped = licenses.LICENSES, {k: "\n".join(textwrap.fill(x, 60) for x in t.split("\n")) for k, t in licenses.LICENSES.items()}
    owners = ["Copyright (c) 2020 A", "Copyright The X Authors", "Copyright: Acme Inc.", "copyright  holderness Ltd", "Copyright No", "Copyright <YEAR> <OWNER>",
              "Copyright Ýmir"]
    titles = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License",
              "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}
    want = [(k, f"{title}\n\n{owner}\n\n{wrapped[k]}\n") for k, title in titles.items() for owner in owners]
    # every width, so that each "copyright" of a body begins a line
    want += [(k, textwrap.fill(t, width)) for k, t in texts.items() for width in range(40, 90)]
    want += [(None, f"{line}\n{texts['MIT']}") for line in ("Copyright notice of A", "copyright  law", "Copyright holders: A", "Copyright, A", "GPL License")]
    docs = docs_of(spark, [(i, t, None, None) for i, (_, t) in enumerate(want)])
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs, licenses.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(want))] == [k for k, _ in want]
    sql = queries.ORACLES["op7_license_scan"]
    docs.select("doc_id", "text").toPandas().pipe(lambda documents: duckdb.from_df(documents).create_view("documents"))
    assert dict(duckdb.sql(f"select doc_id, license_id from ({sql})").fetchall()) == got


def test_tool_calls(spark):
    calls = [(1, "a", 5, "f", '{"y": 1, "x": "s"}', []), (1, "b", 1, "f", '{"x": 3, "z": null}', ["a"]), (1, "c", 0, "f", "{bad", ["a", "b", "q"]),
             (1, "d", 9, "g", None, None), (2, "a", 1, "f", '{"x": "é\\n", "y": 2.5}', ["b"]), (2, "b", 2, "f", '[1]', ["a"]),
             (3, "r", 2, None, '{"x": "later"}', None), (3, "r", 1, "f", '{"x": "first"}', None), (None, "n", 1, "f", "{}", None)]
    results = [(1, "a", 6, 'say "hi"'), (1, "b", 7, None), (4, "lost", 1, "x"), (3, "r", 4, "z"), (3, "r", 3, "a"), (1, None, 1, "x")]
    schemas = [("f", [("x", "string", True), ("y", "number", False)])]
    made = [spark.createDataFrame(*a) for a in (
        ([(*c, "more") for c in calls], "conv_id long, call_id string, seq long, name string, arguments string, needs array<string>, level string"),
        ([(*r, 1) for r in results], "conv_id long, call_id string, seq long, content string, status int"),
        (schemas, "name string, params array<struct<name:string,type:string,required:boolean>>"))]
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_tool_calls(*made).collect()}
    assert {k: (r["level"], r["status"], r["errors"]) for k, r in got.items()} == {
        (1, "a"): (0, "linked", []), (1, "b"): (1, "linked", ["x is integer, not string", "unknown z"]),
        (1, "c"): (2, "no result", ["arguments are no JSON object", "needs unknown call q"]), (1, "d"): (0, "no result", ["unknown tool"]),
        (2, "a"): (None, "cycle", []), (2, "b"): (None, "cycle", ["arguments are no JSON object"]),
        (3, "r"): (0, "linked", ["repeated call", "repeated result"]), (4, "lost"): (None, "no call", [])}
    assert got[1, "a"]["call_json"] == '{"arguments":{"x":"s","y":1},"id":"a","name":"f","type":"tool_call"}'
    assert got[1, "a"]["result_json"] == '{"content":"say \\"hi\\"","id":"a","type":"tool_result"}'
    assert json.loads(got[1, "c"]["call_json"])["arguments"] == "{bad" and json.loads(got[1, "b"]["result_json"])["content"] == ""
    assert json.loads(got[3, "r"]["call_json"])["arguments"] == {"x": "first"}
    assert tool_calls.link_tool_calls(*[d.limit(0) for d in made]).count() == 0


def test_levels_of_long_chains_and_wide_graphs(spark):
    rng, edges = np.random.default_rng(2), {}
    for n in range(120):
        edges[n] = [n - 1] if 0 < n < 100 else sorted({int(x) for x in rng.integers(0, max(n, 1), 3)}) if n >= 100 else []
    level = {}
    for n, needs in edges.items():
        level[n] = 1 + max(level[x] for x in needs) if needs else 0
    nodes = spark.createDataFrame([(1, str(n)) for n in edges], "conv_id long, call_id string")
    needs = spark.createDataFrame([(1, str(n), str(x)) for n, xs in edges.items() for x in xs], "conv_id long, call_id string, need string")
    assert {int(r["call_id"]): r["level"] for r in tool_calls.levels(nodes, needs).collect()} == level


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain.components({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if any(n in p and p[0] != p[1] for p in links)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    for name, given in (("odd", odd[1]), ("none", none)):
        docs = given.select("doc_id", "text", "lang", "source", "n_chars")
        for stage, run in corpus_pipeline.STAGES:
            out, path = run(spark, docs, None), str(tmp_path / name / stage)
            assert stage == "token_ids" or out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (name == "odd")


def test_shared_path_is_not_local_on_a_cluster():
    from tablework.session import shared_path

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_path(Session(), "x")


@pytest.mark.parametrize("space", [" ", "\n", "\t", " \n\t ", "\u3000"])
def test_white_space_of_any_length(space):
    """Up to where the library itself can go the ids are its own; beyond, they are those of the same matches joined."""
    enc = bpe.encoder(queries.RANKS, public_tokenizers.PATTERN)
    run = (space * 200_000)[:200_000]
    for text in (run, "ab" + run, run + "ab", run + " ab", "x y" + run + "cd e" + run, run + "\x1c" + run + "é "):
        assert enc.encode(text) == enc.tiktoken.encode_ordinary(text)
    run = (space * 2_000_000)[:2_000_000]
    alone = enc.tiktoken._encode_single_piece
    for text, want in ((run, [run]), ("ab" + run, ["ab", run]), (run + "cd", [run[:-1], run[-1] + "cd"]), ("ab" + run + "cd", ["ab", run[:-1], run[-1] + "cd"])):
        ids = [i for piece in want for i in (alone(piece) if len(piece) > 99 else enc.tiktoken.encode_ordinary(piece))]
        assert enc.encode(text) == ids and enc.decode(ids) == text.encode()


def test_white_space_of_any_length_in_queries(spark):
    docs = docs_of(spark, [(1, "ab" + " " * 1_000_000 + "cd", None, None), (2, "\n" * 1_000_000, None, None), (3, "a b", None, None)])
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs, queries.RANKS, public_tokenizers.PATTERN).collect()}
    for doc, text in ((1, "ab" + " " * 1_000_000 + "cd"), (2, "\n" * 1_000_000), (3, "a b")):
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    packed = packing.pack_texts(docs, queries.RANKS, public_tokenizers.PATTERN).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(r["n_tokens"] + 1 for r in rows.values())


@pytest.mark.parametrize("stage", ["language_id", "near_duplicates", "token_ids"])
def test_pipeline_hands_workers_a_few_megabytes_at_a_time(spark, stage):
    """Batches of any table are bounded by their bytes; a figure that the session has already stays."""
    def largest():
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])
        wide = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("ab "), 20_000).alias("text"))  # 18 MB in all
        return max(r["n"] for r in wide.mapInArrow(run, "n long").collect())

    docs, key = docs_of(spark, [(1, "a b c d e f", "en", "s"), (2, "a b c", "en", "s")]), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
        assert largest() <= (4 << 20) + 100_000
        spark.conf.set(key, "1m")
        dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
        assert largest() <= (1 << 20) + 100_000
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
