"""Duplicated keys: finding them, listing their rows and renaming them apart."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.functions.text import quoted, trim_right
from tablework.plans.skew import lookup_join, ranked


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once, with their count; NULL never counts."""
    return df.groupBy(key).agg(F.count(key).alias("c")).where("c > 1")


def duplicate_rows(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key value occurs more than once."""
    return lookup_join(df, duplicate_keys(df, key).select(key), [key], "left_semi")


def uniqueness(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: exists, non-null rows, distinct values, unique.

    A column the table does not have is reported with NULL counts.
    """
    present = [c for c in cols if c in df.columns]
    names = df.sparkSession.createDataFrame([(c, c in present) for c in cols], "column_name string, present boolean")
    if not present:
        return names.select("*", F.lit(None).cast("bigint").alias("n_values"),
                            F.lit(None).cast("bigint").alias("n_distinct"),
                            F.lit(None).cast("boolean").alias("is_unique"))
    rows = None
    for c in present:  # each column by itself: partial counts, and no row is expanded once per column
        value = F.col(f"`{c}`")
        counts = df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))
        one = counts.select(F.lit(c).alias("column_name"), "*", (F.col("n_values") == F.col("n_distinct")).alias("is_unique"))
        rows = one if rows is None else rows.unionByName(one)
    return names.join(rows, "column_name", "left")


def group_members(df: DataFrame, key: str, pk: str, ts: str | None = None) -> DataFrame:
    """The rows of each duplicated value, primary key descending.

    One row per member ``(key, position, pk, ts)`` rather than one list per
    value, so a value that fills a third of the table needs no giant row.
    """
    keyed = _trimmed(df, key).select("_base", F.col(pk), *([F.col(ts)] if ts else []))
    counts = keyed.groupBy("_base").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_base")
    members = lookup_join(keyed, counts, ["_base"], "left_semi")
    placed = ranked(members, ["_base"], [pk], "position", descending=True)
    return placed.select(F.col("_base").alias(key), "position", pk, *([ts] if ts else []))


class Strategy(NamedTuple):
    """How duplicates are told apart.

    ``descending`` is the order of the primary key; ``suffix`` gets the rank
    from 0 and the primary key and returns the text after the underscore.
    """

    descending: bool
    suffix: Callable[[Column, Column], Column]


def seq_strategy() -> Strategy:
    return Strategy(True, lambda rank, pk: rank.cast("string"))


def uuid_strategy(width: int = 6) -> Strategy:
    """Random suffix out of a version-4 UUID (characters ``32 - width`` to 31)."""
    return Strategy(True, lambda rank, pk: F.substring(F.uuid(), 33 - width, width))


def hash_strategy(width: int = 6, seed: int = 0) -> Strategy:
    """Suffix from an MD5 of the primary key: looks random, survives a retried task."""
    return Strategy(True, lambda rank, pk: F.substring(
        F.md5(F.concat_ws(":", pk.cast("string"), F.lit(str(seed)))), 1, width))


STRATEGIES: dict[str, Callable[..., Strategy]] = {
    "seq": seq_strategy, "uuid": uuid_strategy, "hash": hash_strategy}


def _trimmed(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).withColumn("_base", trim_right(F.col(key)))


def rename_duplicates(df: DataFrame, key: str, pk: str, strategy: str | Strategy = "seq",
                      skip_first: bool = True) -> DataFrame:
    """New names for the rows that must change: ``(pk, old_value, new_value)``.

    Values are compared without trailing white space. The row with the largest
    primary key keeps its name unless ``skip_first`` is off.
    """
    how = STRATEGIES[strategy]() if isinstance(strategy, str) else strategy
    rows = _trimmed(df, key).select(F.col(pk), F.col(key).alias("old_value"), "_base")
    if not skip_first:
        repeated = (rows.groupBy("_base").agg(F.count(F.lit(1)).alias("_n"))
                    .where("_n > 1").select("_base"))
        rows = lookup_join(rows, repeated, ["_base"], "left_semi")
    placed = ranked(rows, ["_base"], [pk], "_rank", descending=how.descending)
    if skip_first:
        placed = placed.where("_rank > 1")
    suffix = how.suffix(F.col("_rank") - 1, F.col(pk))
    return placed.select(pk, "old_value", F.concat("_base", F.lit("_"), suffix).alias("new_value"))


def rename_duplicates_seq(df: DataFrame, key: str, pk: str, skip_first: bool = True) -> DataFrame:
    """``x_1``, ``x_2``, ... (from ``x_0`` when the first row is renamed too)."""
    return rename_duplicates(df, key, pk, "seq", skip_first)


def rename_duplicates_uuid(df: DataFrame, key: str, pk: str, width: int = 6,
                           seed: int | None = None, skip_first: bool = True) -> DataFrame:
    """Random suffix; with a seed the suffix is hash-derived and repeatable."""
    how = uuid_strategy(width) if seed is None else hash_strategy(width, seed)
    return rename_duplicates(df, key, pk, how, skip_first)


def rename_conflicts(df: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Changes whose new value already stands in the table or is given out twice."""
    taken = df.where(F.col(key).isNotNull()).select(trim_right(F.col(key)).alias("new_value"))
    twice = changes.groupBy("new_value").count().where("count > 1").select("new_value")
    bad = taken.distinct().unionByName(twice).distinct()
    return lookup_join(changes, bad, ["new_value"], "left_semi")


def update_sql(changes: DataFrame, table: str, col: str, pk: str) -> DataFrame:
    """``update`` text per changed row; strings quoted and escaped, numbers bare."""
    pk_type = changes.schema[pk].dataType.typeName()
    pk_text = quoted(F.col(pk)) if pk_type == "string" else F.col(pk).cast("string")
    return changes.select(pk, F.concat(
        F.lit(f"update {table} set {col} = "), quoted(F.col("new_value")),
        F.lit(f" where {pk} = "), pk_text, F.lit(";")).alias("statement"))


def resolve_duplicates(df: DataFrame, key: str, pk: str, strategy: str | Strategy = "seq",
                       skip_first: bool = True) -> DataFrame:
    """The whole table with duplicated values renamed; other rows as they are.

    A table without the column is returned unchanged. The changes are ranked
    on the two key columns only and joined back by the unique primary key.
    """
    if key not in df.columns:
        return df
    changes = rename_duplicates(df, key, pk, strategy, skip_first).select(pk, "new_value")
    return (df.join(changes, pk, "left")
            .withColumn(key, F.coalesce("new_value", key)).select(*df.columns))
