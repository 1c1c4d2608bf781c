"""Hard negatives: exact products against Python integers, and the whole selection against sorting."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tablework.llm import negatives


@pytest.mark.parametrize("size", [0, 1, 160, 5_000, 1 << 20, 1 << 31, 1 << 45, 10 ** 30])
@pytest.mark.parametrize("length", [0, 1, 64, 130])
def test_products_are_exact(size, length):
    rng = np.random.default_rng(length)
    a, b = (np.floor(rng.uniform(-1, 1, (n, length)) * size) for n in (5, 7))
    b[0] = size
    a[0] = -size
    got = negatives.exact_scores(negatives.Block(a), slice(0, 5), negatives.Block(b))
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


def test_moduli_are_enough():
    for bound in (0, 1, 500, 10 ** 6, 10 ** 18):
        assert math.prod(negatives.moduli(bound)) > 2 * bound
    assert all(64 * ((p - 1) // 2) ** 2 < 1 << 24 for p in negatives.primes())


def selected(rows, is_anchor, scale=256, count=5):
    """Result rows by sorting everything, with Python integers."""
    good = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    seen, out = set(), []
    for i, label, v in good:
        if not is_anchor(i) or (i, label, tuple(v)) in seen:
            continue
        seen.add((i, label, tuple(v)))
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in good if len(w) == len(v))
        for minus, j, _ in [s for s in scored if s[2] == label and s[1] != i][:count]:
            fit = [(n, -m) for m, n, other in scored if other != label and 80 * -minus <= 100 * -m <= 100 * -minus][:count]
            out += [(i, j, rank, n, -minus, s) for rank, (n, s) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 0, None) for r in rows], "vec_id long, embedding array<float>, label int, "
                                 "anchor string, id long, score long, no int, `a.b` string")


@pytest.mark.parametrize("block_values", [64, 700, 1 << 20])
def test_against_sorting(spark, block_values):
    rng = np.random.default_rng(1)
    centres = rng.uniform(-1, 1, (4, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] + rng.uniform(-.4, .4, 8)], int(rng.integers(0, 3))) for i in range(240)]
    rows += [(300 + i, rows[0][1], i % 2) for i in range(40)]  # a hot vector, all ties
    rows += [(400, None, 1), (401, [1.0] * 8, None), (402, [float("nan")] + [1.0] * 7, 1), (403, [None] + [1.0] * 7, 1),
             (404, [float("inf")] + [1.0] * 7, 1), (None, [1.0] * 8, 1), (405, [], 1), (410, [], 1), (406, [0.5, 0.5], 2), (407, [0.5, 0.4], 1),
             (420, [0.0] * 8, 1), (421, [0.0] * 8, 2), (10, rows[10][1], rows[10][2]), (440, [1e30] * 8, 0)]
    got = negatives.hard_negatives(table(spark, rows), "vec_id % 10 = 0", block_values=block_values).collect()
    want = [tuple(None if abs(x) >= 1 << 63 else x for x in r) for r in selected(rows, lambda i: i % 10 == 0)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 500


def test_windows(spark):
    """A negative at 80 % of the positive counts, one below or above doesn't; a positive of zero or less finds its equals or none."""
    one = lambda x: [x / 256]
    rows = [(100, one(10), 1), (1, one(10), 1), (2, one(8), 2), (3, one(10), 3), (4, one(7), 2), (5, one(11), 2), (6, one(-5), 1), (7, one(0), 1), (8, one(0), 2)]
    got = defaultdict(list)
    for r in negatives.hard_negatives(table(spark, rows), "vec_id = 100").collect():
        got[r["positive_id"]].append((r["rank"], r["negative_id"], r["negative_score"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 3, 100), (2, 2, 80)], 7: [(1, 8, 0)]}


def test_no_anchors(spark):
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 2)]):
        assert negatives.hard_negatives(table(spark, rows), "vec_id % 100 = 0").count() == 0
