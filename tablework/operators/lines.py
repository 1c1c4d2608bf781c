"""Lines of texts and membership between two sets of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.plans.skew import lookup_join


def text_lines(df: DataFrame, col: str, comments: bool = False) -> DataFrame:
    """One row per line of a text column, as ``line_no`` (from 1) and ``value``.

    With ``comments`` the lines are trimmed, blank lines and lines that start
    with ``#`` are dropped, and ``marked`` holds the rest of a line that
    starts with ``@`` (``value`` is then NULL). Line numbers count all lines.
    """
    kept = [c for c in df.columns if c != col]
    # The outer form spares a second split: for the plain one Spark adds a filter on its size.
    lines = df.select(*kept, F.posexplode_outer(F.split(col, "\n", -1)).alias("_pos", "value"))
    lines = lines.where("_pos is not null")
    lines = lines.withColumn("line_no", F.col("_pos").cast("bigint") + 1)
    if not comments:
        return lines.select(*kept, "line_no", "value")
    return read_marks(lines).select(*kept, "line_no", "value", "marked")


def read_marks(lines: DataFrame) -> DataFrame:
    """Trim lines, drop blank and ``#`` lines, divert ``@`` lines to ``marked``."""
    trimmed = lines.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", ""))
    kept = trimmed.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    diverted = F.col("value").startswith("@")
    return (kept.withColumn("marked", F.when(diverted, F.expr("substring(value, 2)")))
            .withColumn("value", F.when(~diverted, F.col("value"))))


def lines_in(source: DataFrame, superset: DataFrame, col: str = "value") -> DataFrame:
    """Rows of ``source`` whose line occurs in ``superset``; repeats are kept.

    ``superset`` is cut down to its distinct lines before the shuffle; a line
    that fills much of ``source`` is not gathered in one task.
    """
    return lookup_join(source, superset.select(col).distinct(), [col], "left_semi")


def lines_not_in(superset: DataFrame, source: DataFrame, col: str = "value") -> DataFrame:
    """Rows of ``superset`` whose line does not occur in ``source``; repeats are kept."""
    return lookup_join(superset, source.select(col).distinct(), [col], "left_anti")
