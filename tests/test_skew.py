"""Sliced ranks, previous rows and lookups against brute force on skewed keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablework.plans import skew


def rows(n=3000):
    rng = random.Random(5)
    ids = rng.sample(range(-10 * n, 10 * n), n)
    return [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 40}", pk, f"v{pk % 97}")
            for i, pk in enumerate(ids)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "k string, pk bigint, v string").repartition(6)


@pytest.mark.parametrize("slices", [None, 50, 7])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_ranked(table, slices, descending, keys):
    got = skew.ranked(table, keys, ["pk"], "r", descending, slices).collect()
    groups = defaultdict(list)
    for k, pk, v in rows():
        groups[k if keys else 0].append(pk)
    want = {pk: i + 1 for g in groups.values() for i, pk in enumerate(sorted(g, reverse=descending))}
    assert {r.pk: r.r for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("slices", [50, 7])
def test_ranked_by_text_and_number(table, slices):
    got = skew.ranked(table, ["k"], ["v", "pk"], "r", False, slices).collect()
    groups = defaultdict(list)
    for k, pk, v in rows():
        groups[k].append((v, pk))
    want = {pk: i + 1 for g in groups.values() for i, (_, pk) in enumerate(sorted(g))}
    assert {r.pk: r.r for r in got} == want


def test_slices_are_really_cut(table):
    cut = skew.Slices(table, ["k"], ["pk"], 50)
    sliced = cut.mark(table)
    sizes = sliced.where("k = 'hot'").groupBy("_slice").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) <= 250
    light = sliced.where("not _heavy").groupBy("k").agg(F.count_distinct("_slice").alias("n")).collect()
    assert light and all(r["n"] == 1 for r in light)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_rank_needs_no_single_task_and_no_nested_loop(table):
    plan = plan_of(skew.ranked(table, [], ["pk"], "r"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("SinglePartition") <= 1  # one row per slice, for the sizes before each


def test_text_bounds_are_short(spark):
    df = spark.range(400).select(F.concat(F.lit("x" * 500), "id").alias("t"), "id")
    cut = skew.Slices(df, [], ["t", "id"], 8)
    assert cut.bounds and max(map(len, cut.bounds)) < 200
    got = skew.ranked(df, [], ["t", "id"], "r", slices=8).orderBy("t").collect()
    assert [r["r"] for r in got] == list(range(1, 401))


def test_rank_of_an_empty_table(table):
    assert skew.ranked(table.limit(0), [], ["pk"], "r").count() == 0


@pytest.mark.parametrize("slices", [None, 50])
@pytest.mark.parametrize("keys", [["k"], []])
def test_with_previous(table, slices, keys):
    got = skew.with_previous(table, {"before": "v"}, keys, ["pk"], slices).collect()
    groups = defaultdict(list)
    for k, pk, v in rows():
        groups[k if keys else 0].append((pk, v))
    want = {}
    for g in groups.values():
        g.sort()
        for i, (pk, _) in enumerate(g):
            want[pk] = (g[i - 1][1], True) if i else (None, False)
    assert {r.pk: (r.before, r.has_previous) for r in got} == want


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join(spark, table, how):
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k999", 3)], "k string, w int")
    if how in ("left_semi", "left_anti"):
        right = right.select("k")
    cut = skew.lookup_join(table, right, ["k"], how)
    plain = table.join(right, ["k"], how)
    assert cut.columns == plain.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_lookup_join_refuses_mixed_types(spark, table):
    right = spark.range(3).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        skew.lookup_join(table, right, ["k"], "inner")


def test_partition_count_does_not_matter(spark, table):
    first = skew.ranked(table, ["k"], ["pk"], "r", True, 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(tuple, first.select("pk", "r").collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        again = skew.ranked(table.repartition(13, F.rand(1)), ["k"], ["pk"], "r", True, 50)
        assert sorted(map(tuple, again.select("pk", "r").collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
