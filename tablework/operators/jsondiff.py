"""Differences between neighbouring JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablework.functions.jsons import with_json_diff
from tablework.plans.skew import with_previous


def adjacent_json_diff(df: DataFrame, json: str, order: Sequence[str],
                       partition: Sequence[str] = ()) -> DataFrame:
    """Each record against the one before it: ``left_diff`` is what the earlier
    record holds differently, ``right_diff`` the later one. The first record
    has nothing before it and is left out.
    """
    paired = with_previous(df, {"_before": json}, list(partition), list(order))
    compared = with_json_diff(paired.where("has_previous"), "_before", json)
    return compared.drop("_before", "has_previous")
