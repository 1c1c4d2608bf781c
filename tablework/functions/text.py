"""Text, size, URL and SQL-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trim_right(col: Column) -> Column:
    """Strip white space of every kind from the right end (``rtrim`` strips blanks only)."""
    return F.regexp_replace(col, r"\s+$", "")


def java_replacement(repl: str) -> str:
    r"""Turn a ``\1`` style replacement into the ``$1`` style Spark takes."""
    out, i = [], 0
    while i < len(repl):
        ch = repl[i]
        following = repl[i + 1] if i + 1 < len(repl) else ""
        if ch == "\\" and following.isdigit():
            out.append("$" + following)
            i += 2
        elif ch == "\\" and following == "\\":
            out.append("\\\\")
            i += 2
        else:
            out.append("\\$" if ch == "$" else "\\\\" if ch == "\\" else ch)
            i += 1
    return "".join(out)


def starts_with_match(col: Column, pattern: str) -> Column:
    """The pattern matches at the start of the value."""
    return col.rlike(f"^(?:{pattern})")


def whole_match(col: Column, pattern: str) -> Column:
    """The pattern matches the whole value."""
    return col.rlike(f"^(?:{pattern})\\z")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Everything before the last slash; empty for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def strip_marker(col: Column, marker: str) -> Column:
    """Cut the marker off the front of values that start with it."""
    return F.when(col.startswith(marker), F.substring(col, len(marker) + 1, 2147483647)).otherwise(col)


def fmt_size(n: Column) -> Column:
    """Bytes as ``512B``, ``1.50K``, ``2.00M``, ``3.25G``; two decimals, ties to even."""
    n = n.cast("bigint")

    def scaled(bits: int, unit: str) -> Column:
        rest = F.pmod(n, F.lit(1 << bits)) * 100
        floor = F.shiftright(n, bits) * 100 + F.shiftright(rest, bits)
        left = F.pmod(rest, F.lit(1 << bits))
        half = F.lit(1 << (bits - 1))
        up = (left > half) | ((left == half) & (F.pmod(floor, F.lit(2)) == 1))
        cents = floor + F.when(up, 1).otherwise(0)
        return F.concat(F.floor(cents / 100).cast("string"), F.lit("."),
                        F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"), F.lit(unit))

    return (F.when(n < (1 << 10), F.concat(n.cast("string"), F.lit("B")))
            .when(n < (1 << 20), scaled(10, "K"))
            .when(n < (1 << 30), scaled(20, "M"))
            .otherwise(scaled(30, "G")))


def url_filename(url: Column) -> Column:
    """Text after the last slash, cut at its last question mark."""
    return F.regexp_replace(F.substring_index(url, "/", -1), r"\?[^?]*\z", "")


def quoted(text: Column) -> Column:
    """Single-quoted SQL string, embedded quotes doubled."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_literal(col: Column, dtype: T.DataType) -> Column:
    """The value as SQL literal text; NULL stays the bare word."""
    if isinstance(dtype, T.DecimalType):  # not by way of double, which has 15 digits
        text = F.round(col, 2).cast("decimal(38,2)").cast("string")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = F.format_string("%.2f", col.cast("double"))
    elif isinstance(dtype, T.IntegralType):
        text = col.cast("string")
    elif isinstance(dtype, T.BooleanType):
        text = col.cast("string")
    elif isinstance(dtype, T.DateType):
        text = quoted(F.date_format(col, "yyyy-MM-dd"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = quoted(F.date_format(col, "yyyy-MM-dd HH:mm:ss"))
    elif isinstance(dtype, T.BinaryType):
        text = quoted(F.make_valid_utf8(col.cast("string")))
    elif isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        text = quoted(col)
    else:
        text = quoted(F.to_json(col))
    return F.when(col.isNull(), F.lit("NULL")).otherwise(text)


def quote_ident(name: Column, style: str | None) -> Column:
    """Identifier as is (None), wrapped in a quote mark, or put into a ``%s`` template."""
    if not style:
        return name
    if "%s" in style:
        head, tail = style.split("%s", 1)
        return F.concat(F.lit(head), name, F.lit(tail))
    return F.concat(F.lit(style), F.replace(name, F.lit(style), F.lit(style * 2)), F.lit(style))


def interpolate(template: str, **values: Column) -> Column:
    """Replace ``$name`` marks by column values (longest name first)."""
    out = F.lit(template)
    for key in sorted(values, key=len, reverse=True):
        out = F.replace(out, F.lit(f"${key}"), values[key])
    return out


def payload_text(payload: Column) -> Column:
    """Message bytes as UTF-8 text; bytes that aren't UTF-8 become U+FFFD, so that no message can stop a stream."""
    return F.make_valid_utf8(payload.cast("string"))
