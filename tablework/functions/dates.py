"""Date arithmetic and epoch expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed grammar of a duration: one leading sign for all parts, months spelled "mo".
DURATION = (r"^-?(?:\d{1,9}y)?(?:\d{1,9}mo)?(?:\d{1,9}d)?"
            r"(?:\d{1,9}h)?(?:\d{1,9}m)?(?:\d{1,9}s)?$")


def date_add_duration(date: Column, duration: Column) -> Column:
    """Date plus a duration such as ``-1y3d``; NULL where the text is no duration, a part of ten digits or more included."""
    sign = F.when(duration.startswith("-"), -1).otherwise(1)

    def part(unit: str) -> Column:
        digits = F.regexp_extract(duration, rf"(\d{{1,9}}){unit}", 1)
        return sign * F.when(digits == "", 0).otherwise(digits.cast("int"))

    moved = date.cast("timestamp_ntz") + F.make_interval(
        years=part("y"), months=part("mo"), days=part("d"),
        hours=part("h"), mins=part("m(?!o)"), secs=part("s").cast("decimal(18,6)"))
    return F.when(duration.rlike(DURATION), moved.cast("date"))


def date_diff_units(first: Column, second: Column) -> Column:
    """Struct of ``first - second`` in days, hours, minutes and seconds (signed)."""
    days = F.datediff(first, second).cast("bigint")
    return F.struct(days.alias("days"), (days * 24).alias("hours"),
                    (days * 1440).alias("minutes"), (days * 86400).alias("seconds"))


def date_to_millis(text: Column | None = None) -> Column:
    """Epoch milliseconds of midnight of ``yyyy-MM-dd`` text in the session zone; now if absent."""
    if text is None:
        return F.unix_millis(F.current_timestamp())
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def epoch_columns(ts: Column | None = None) -> list[Column]:
    """``now_text``, ``epoch_ms``, ``epoch_s`` and the second-resolution ``time_id``."""
    ts = F.current_timestamp() if ts is None else ts.cast("timestamp")
    return [F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS").alias("now_text"),
            F.unix_millis(ts).alias("epoch_ms"),
            F.unix_seconds(ts).alias("epoch_s"),
            F.date_format(ts, "yyyyMMddHHmmss").alias("time_id")]
