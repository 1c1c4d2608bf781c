"""Spelling variants: the automata against enumeration, and odd tables."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablework.llm import spelling
from tests.llm import plain
from tests.llm.test_edges import docs_of


def near_pairs(words):
    """Pairs one edit apart, by every edit of every word."""
    known, letters, out = set(words), sorted(set("".join(words))), set()
    for w in known:
        for i in range(len(w)):
            made = [w[:i] + w[i + 1:]] + [w[:i] + c + w[i + 1:] for c in letters]
            out |= {tuple(sorted((w, v))) for v in made if v in known and v != w}
    return out


def forms_of(counts, ratio=10):
    """{word: (n, form, root, n_near, form_n)}."""
    near = {w: [] for w in counts}
    for a, b in near_pairs(list(counts)):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], form[w], root, len(near[w]), counts.get(form[w]))
    return out


def plain_counts(docs, least=7, times=2):
    import re

    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(plain.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=9), min_size=1, max_size=40))
def test_pairs_are_met_once(words):
    words = sorted(words)
    got = [tuple(sorted((words[i], words[j]))) for i, j in zip(*spelling.Acceptor(words).pairs())]
    assert len(got) == len(set(got)) and set(got) == near_pairs(words)


def test_states_do_not_grow_with_word_length():
    a = "x" * 1_000_000
    words = sorted([a, a[1:], a[:500_000] + "y" + a[500_001:]])
    machine = spelling.Acceptor(words)
    assert len(machine.count) <= 2 * len(words) + 1
    pairs = [{int(i), int(j)} for i, j in zip(*machine.pairs())]
    assert len(pairs) == 3 and all(p in pairs for p in ({0, 1}, {1, 2}, {0, 2}))


@pytest.mark.parametrize("state_words", [2, 7, 50_000])
def test_split_states_find_the_same(spark, state_words):
    rng = random.Random(3)
    counts = {}
    for stem in ("abcdefg", "abcdxyz", "internationa", "zzzzzzzzzz"):
        for _ in range(40):
            w = list(stem)
            for _ in range(rng.randint(0, 2)):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at:at + (kind > 0)] = [rng.choice("abzé")] if kind < 2 else []
            if len(w) >= 7:
                counts["".join(w)] = rng.choice((2, 3, 30, 400, 5000))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"])
           for r in spelling.usual_forms(words, state_words=state_words).collect()}
    assert got == forms_of(counts) and any(v[1] and v[1] != v[2] for v in got.values())


def test_odd_documents(spark):
    text = "Letters LETTERS lettters Ünïcode ünïcode naïveté\nnaïveté naivete short Short"
    rows = [(1, text, None, None), (1, text, None, None), (None, "letters " * 40, None, None), (3, None, None, None), (4, "", None, None),
            (5, "x" * 300_000 + " " + "x" * 300_000 + " " + "x" * 299_999 + " 12letters34letters", "en", "s")]
    docs = docs_of(spark, rows).withColumnsRenamed({"_text": "word", "n": "n_near"})
    counted = spelling.count_words(docs, change=spelling.drop_one_letter)
    want = plain_counts([(i, t) for i, t, *_ in rows])
    assert {r[0]: r[1] for r in counted.collect()} == want and len(want) > 4
    got = {r["word"]: (r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in spelling.usual_forms(counted).collect()}
    unlettered = {w: n for w, n in want.items() if len(w) < 1000}
    assert {w: v for w, v in got.items() if len(w) < 1000} == forms_of(unlettered)
    long = [w for w in want if len(w) >= 1000]
    assert {len(w): v[3] for w, v in got.items() if len(w) >= 1000} == {len(w): len(long) - 1 for w in long}


def test_no_words(spark):
    none = docs_of(spark, [])
    assert spelling.count_words(none).count() == 0
    out = spelling.usual_forms(spelling.count_words(none))
    assert out.count() == 0 and out.columns == ["word", "n", "form", "root", "n_near", "form_n"]


def test_changed_runs(spark):
    """Every word of a table, against plain Python with the same CRC."""
    rows = [(i, " ".join(f"{'abcdefgh'[: 4 + i % 5]}{'xyz' * (i % 4)}{c}" for c in "abcdefghij"), None, None) for i in range(200)]
    counted = spelling.count_words(docs_of(spark, rows), change=spelling.drop_one_letter)
    assert {r[0]: r[1] for r in counted.collect()} == plain_counts([(i, t) for i, t, *_ in rows])
    assert counted.agg(F.sum("n")).first()[0] > 0
