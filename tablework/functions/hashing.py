"""Pseudo-random values derived from an MD5 of the row's identity.

Unlike ``rand()`` they do not depend on the partitioning, so a row that is
computed again gets the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str | int) -> Column:
    """MD5 (32 hex digits) of ``part:part:part``."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                                    for p in parts]))


def piece(digest: Column, index: int) -> Column:
    """The ``index``-th (0..3) 32-bit number of an MD5, as a bigint."""
    return F.conv(F.substring(digest, 8 * index + 1, 8), 16, 10).cast("bigint")


def base36(digest: Column, at: int, length: int) -> Column:
    """Up to 10 base-36 digits: the last ones of the 56-bit number at hex digit ``at``."""
    number = F.lower(F.conv(F.substring(digest, at + 1, 14), 16, 36))
    return F.substring(F.lpad(number, 11, "0"), 12 - length, length)
