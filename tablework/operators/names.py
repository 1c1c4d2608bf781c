"""Filters and rewrites on names, paths, lines and whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import regex
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.functions import text as tx


def _any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def name_filter(df: DataFrame, col: str, include: Sequence[str] = (),
                exclude: Sequence[str] = ()) -> DataFrame:
    """Keep names that contain a match of any include pattern; without include
    patterns drop those that match any exclude pattern; without both keep all."""
    if include:
        return df.where(_any_of([F.col(col).rlike(p) for p in include]))
    if exclude:
        return df.where(~_any_of([F.col(col).rlike(p) for p in exclude]))
    return df


def prefix_match(df: DataFrame, col: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose value matches any pattern at its start."""
    return df.where(_any_of([tx.starts_with_match(F.col(col), p) for p in patterns]))


def _retargeted(df: DataFrame, path: str, name: Column) -> DataFrame:
    parent = tx.parent_dir(F.col(path))
    absolute = F.when(F.col(path).startswith("/"), F.lit("/")).otherwise(F.lit(""))
    target = F.when(parent == "", F.concat(absolute, name)).otherwise(
        F.concat(parent, F.lit("/"), name))
    return df.withColumn("target", target)


def rename_full(df: DataFrame, path: str, regex: str, repl: str) -> DataFrame:
    """Add ``target`` for paths whose whole base name matches; ``$1`` groups.

    Names that do not match are left out. The parent directory stays.
    """
    name = tx.base_name(F.col(path))
    kept = df.where(tx.whole_match(name, regex))
    return _retargeted(kept, path, F.regexp_replace(name, regex, repl))


def rename_prefix(df: DataFrame, path: str, pattern: str, repl: str) -> DataFrame:
    r"""Add ``target`` for paths whose base name starts with a match; every
    occurrence in the name is replaced; ``\1`` groups."""
    name = tx.base_name(F.col(path))
    kept = df.where(tx.starts_with_match(name, pattern))
    return _retargeted(kept, path, F.regexp_replace(name, pattern, tx.java_replacement(repl)))


def rewrite_lines(df: DataFrame, pattern: str, repl: str, matched_only: bool = False,
                  col: str = "value") -> DataFrame:
    """Replace in lines that start with a match; other lines stay or are dropped."""
    matched = tx.starts_with_match(F.col(col), pattern)
    changed = F.regexp_replace(col, pattern, tx.java_replacement(repl))
    if matched_only:
        return df.where(matched).withColumn(col, changed)
    return df.withColumn(col, F.when(matched, changed).otherwise(F.col(col)))


def replace_first_n(df: DataFrame, col: str, pattern: str, repl: str, n: int = 1) -> DataFrame:
    """Replace the first ``n`` matches in each text; all of them when ``n <= 0``.

    Patterns are Java's. All and the first match are replaced on the JVM, and so are several matches by a
    text without groups where the pattern can't match nothing. The rest, several matches with groups or
    of a pattern that may be empty, takes the ``regex`` library, which knows Java's classes such as ``\\p{L}``.
    """
    if n <= 0:
        return df.withColumn(col, F.regexp_replace(col, pattern, tx.java_replacement(repl)))
    if n == 1:  # what stands before the first match is matched with it, so it can only match once
        front = rf"\A(?<front>[\s\S]*?)(?:{_groups_up(pattern)})"
        return df.withColumn(col, F.regexp_replace(col, front, "${front}" + tx.java_replacement(_groups_up(repl))))
    if "\\" not in repl and _never_empty(pattern):
        # Cut at the first n matches and join the pieces with the new text.
        return df.withColumn(col, F.array_join(F.split(col, pattern, n + 1), repl))

    @F.pandas_udf(T.StringType())
    def substitute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = regex.compile(pattern, regex.VERSION0)
        for texts in batches:
            yield texts.map(lambda s: compiled.sub(repl, s, count=n), na_action="ignore")

    return df.withColumn(col, substitute(col))


def _groups_up(text: str) -> str:
    r"""Every ``\1`` one higher, in a pattern or a replacement."""
    return re.sub(r"(\\\\)|\\(\d)", lambda m: m[1] or f"\\{int(m[2]) + 1}", text)


def _never_empty(pattern: str) -> bool:
    """Does every match of the pattern have a character? False where that can't be told."""
    try:
        return re._parser.parse(re.sub(r"\\[pP]\{\w+\}", "x", pattern)).getwidth()[0] > 0
    except re.error:
        return False


def strip_marker(df: DataFrame, col: str, marker: str) -> DataFrame:
    """Cut a marker off the front of the names that start with it."""
    return df.withColumn(col, tx.strip_marker(F.col(col), marker))


def drop_columns(df: DataFrame, ignored: Sequence[str]) -> DataFrame:
    """The table without the ignored columns; unknown names are no error."""
    return df.drop(*ignored)


def name_expr(df: DataFrame, col: str, expr: str | None, out: str = "target") -> DataFrame:
    """Target name by a SQL expression over ``it``; a blank expression keeps the name."""
    if expr is None or not expr.strip():
        return df.withColumn(out, F.col(col))
    if "it" in df.columns:
        raise ValueError("the table has a column named it; rename it first")
    try:
        return df.withColumn("it", F.col(col)).withColumn(out, F.expr(expr)).drop("it")
    except AnalysisException as error:
        raise ValueError(f"failed to format {col} with `{expr}`: {error}") from error


def render(df: DataFrame, template: str, out: str = "rendered") -> DataFrame:
    """A text line per row: ``{column}`` marks in the template are filled in.

    Arrays are joined by line breaks, NULL is written as ``null``.
    """
    pieces = []
    for literal, column in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if literal:
            pieces.append(F.lit(literal))
        if column:
            value = F.col(column)
            is_list = isinstance(df.schema[column].dataType, T.ArrayType)
            text = F.array_join(value, "\n", "null") if is_list else value.cast("string")
            pieces.append(F.coalesce(text, F.lit("null")))
    return df.withColumn(out, F.concat(*pieces))
