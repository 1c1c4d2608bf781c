"""JSON expressions on VARIANT: canonical text, maps and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_sort(col: Column) -> Column:
    """The JSON text with object keys sorted at every level; NULL where it is malformed."""
    return F.to_json(F.try_parse_json(col))


def json_map(col: Column) -> Column:
    """One JSON object as a map of strings; nested values stay JSON text."""
    return F.from_json(col, "map<string,string>")


def _canonical_values(col: Column) -> Column:
    """Map of each top-level key to its value as canonical JSON text."""
    return F.transform_values(F.from_json(col, "map<string,variant>"),
                              lambda _, value: F.coalesce(F.to_json(value), F.lit("null")))


def _json_key(key: Column) -> Column:
    in_brackets = F.to_json(F.array(key))
    escaped = F.substring(in_brackets, F.lit(2), F.length(in_brackets) - 2)
    plain = F.concat(F.lit('"'), key, F.lit('"'))
    return F.when(key.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(plain)


def _differing(own: str, other: str) -> Column:
    there = F.col(other)
    # One look-up: no value is null, so a null there is a key that the other side lacks.
    kept = F.map_filter(own, lambda key, text: ~there[key].eqNullSafe(text))
    members = F.transform(F.sort_array(F.map_entries(kept)),
                          lambda e: F.concat(_json_key(e["key"]), F.lit(":"), e["value"]))
    text = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    return F.when(there.isNotNull(), text)


def with_json_diff(df: DataFrame, left: str, right: str, left_name: str = "left_diff",
                   right_name: str = "right_diff") -> DataFrame:
    """Add what each of two JSON objects holds that the other lacks or holds differently.

    Only top-level keys are told apart; nested values compare by canonical
    text, so their key order does not count (and ``1.0`` equals ``1``). Both
    results have sorted keys; both are NULL where one side is no object.
    """
    parsed = df.withColumns({"_lmap": _canonical_values(F.col(left)), "_rmap": _canonical_values(F.col(right))})
    return (parsed.withColumns({left_name: _differing("_lmap", "_rmap"),
                                right_name: _differing("_rmap", "_lmap")})
            .drop("_lmap", "_rmap"))
