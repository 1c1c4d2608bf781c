"""Ranks, previous rows and lookups that hold when one key owns a third of the rows.

A window ``partitionBy(key)`` puts all rows of a key into one task. The functions here cut a heavy key into
*slices*: consecutive ranges of the order columns, each of about one task's share of the rows. Ranks are put together from the
rank inside the slice plus the sizes of the slices before it, so the result is exact for any bounds between
slices; they decide only how even the slices are.

The plan is the same at every size. Bounds come from a sample and stand in the plan as one constant array, so a
row finds its slice without a join, and a task that is run again finds the same. There are at most as
many bounds as shuffle partitions, cut to ``BOUND_CHARS`` characters a text. A key is heavy if it has more than a
partition's share; the one global group of an empty key list always is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES_PER_SLICE = 16
BOUND_CHARS = 64


def key_hash(keys: Sequence[str]) -> Column:
    """64-bit hash of the key columns; a constant for the single global group."""
    return F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")


def _group(keys: Sequence[str]) -> Column:
    # A struct compares NULL fields as equal, which plain join columns do not.
    return F.struct(*keys) if keys else F.lit(0)


def _directed(cols: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def _place(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Hash of the key and the order values, by which rows and bounds are compared."""
    return F.struct(key_hash(keys).alias("h"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


class Slices:
    """Bounds between the slices of all heavy keys of a table, in one sorted array."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None):
        self.keys, self.order = keys, order
        slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        place = _place(df, keys, order)
        rows = df.select(key_hash(keys).alias("h")).count()
        self.schema = df.select(place.alias("p")).schema["p"].dataType
        cut = [F.col(f"p.{f.name}").substr(1, BOUND_CHARS).alias(f.name) if f.dataType.simpleString() == "string"
               else F.col(f"p.{f.name}").alias(f.name) for f in self.schema]
        sample = df.select(place.alias("p")).sample(min(1.0, SAMPLES_PER_SLICE * slices / max(rows, 1)), seed=17).select(*cut)
        nth = F.row_number().over(Window.partitionBy("h").orderBy(*[c for c in sample.columns if c != "h"] or ["h"]))
        picked = sample.withColumn("_nth", nth).where(F.col("_nth") % SAMPLES_PER_SLICE == 0).drop("_nth") \
            .orderBy(*sample.columns).select(F.to_json(F.struct(*sample.columns)).alias("b")).collect()
        self.bounds = [r["b"] for r in picked]
        self.heavy = sorted({json.loads(b)["h"] for b in self.bounds})

    def number(self) -> Column:
        """How many bounds lie below the row: the number of its slice, the same for all rows of a key that isn't heavy."""
        if not self.bounds:
            return F.lit(0)
        bounds = F.from_json(F.lit(f"[{','.join(self.bounds)}]"), f"array<{self.schema.simpleString()}>")
        value, n = _place(None, self.keys, self.order), len(self.bounds)
        return F.reduce(
            F.array(*[F.lit(1 << bit) for bit in range(n.bit_length() - 1, -1, -1)]), F.lit(0),
            lambda found, step: F.when((found + step <= n) & (F.get(bounds, found + step - 1) < value), found + step).otherwise(found))

    def mark(self, df: DataFrame) -> DataFrame:
        """Add the group ``_g``, the slice ``_slice`` and whether the key is ``_heavy``."""
        return df.withColumns({"_g": _group(self.keys), "_slice": self.number(),
                               "_heavy": key_hash(self.keys).isin(self.heavy) if self.heavy else F.lit(False)})


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rank",
           descending: bool = False, slices: int | None = None) -> DataFrame:
    """Add ``name`` = 1, 2, ... within the key in the given order.

    ``keys`` may be empty for one numbering over the whole table. ``order`` must be total within the key (end
    it with the primary key). The sizes of slices come from the ranks inside them, over the same shuffle.
    """
    cut = Slices(df, keys, order, slices)
    window = Window.partitionBy("_g", "_slice").orderBy(*_directed(order, descending))
    inside = cut.mark(df).withColumn(name, F.row_number().over(window).cast("bigint"))
    if not cut.bounds:
        return inside.select(*df.columns, name)
    earlier = (Window.partitionBy("_g").orderBy(*_directed(["_slice"], descending))
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (inside.where("_heavy").groupBy("_g", "_slice").agg(F.max(name).alias("_n"))
               .select("_g", "_slice", F.sum("_n").over(earlier).alias("_before")))
    return (inside.join(offsets, ["_g", "_slice"], "left")
            .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0).cast("bigint")))
            .select(*df.columns, name))


def with_previous(df: DataFrame, values: dict[str, str], keys: Sequence[str],
                  order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Add the value each column had in the preceding row (``{new name: column}``).

    The extra boolean ``has_previous`` is false for the first row of a key.
    """
    cut = Slices(df, keys, order, slices)
    carried = F.struct(*[F.col(c).alias(new) for new, c in values.items()])
    sliced = cut.mark(df).withColumn("_row", carried)
    inside = sliced.withColumn(
        "_prev", F.lag("_row").over(Window.partitionBy("_g", "_slice").orderBy(*_directed(order, False))))
    if cut.bounds:
        last_rows = (sliced.where("_heavy").groupBy("_g", "_slice")
                     .agg(F.max_by("_row", F.struct(*order)).alias("_last")))
        handed = last_rows.select(
            "_g", "_slice", F.lag("_last").over(Window.partitionBy("_g").orderBy("_slice")).alias("_handed"))
        inside = inside.join(handed, ["_g", "_slice"], "left").withColumn("_prev", F.coalesce("_prev", "_handed"))
    return inside.select(*df.columns, *[F.col(f"_prev.{new}").alias(new) for new in values],
                         F.col("_prev").isNotNull().alias("has_previous"))


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join to a side that has **one row per key**.

    A plain join with both sides evaluated once. A heavy left key is no trouble: adaptive execution splits the left side's large
    partitions for all four kinds (inner, left, semi, anti), and the one right row goes to each part.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how is inner, left, left_semi or left_anti")
    for c in on:
        if left.schema[c].dataType != right.schema[c].dataType:
            raise ValueError(f"join column {c} differs in type; cast one side first")
    return left.join(right, list(on), how)
