"""Checksum of 18-character identity numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the checksum: weights of the first 17 digits, and the check
# character for each remainder 0..10.
WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
CHECK_CHARACTERS = "10X98765432"


def id_checksum(col: Column) -> Column:
    """Struct ``(status, corrected)``.

    Status is ``valid``, ``wrong_check_digit`` (``corrected`` holds the right
    number), ``wrong_length`` or ``not_numeric``.
    """
    no = F.trim(col)
    # Code points instead of casts: a cast of a non-digit costs an exception per row.
    total = sum(((F.ascii(F.substring(no, i + 1, 1)) - 48) * w for i, w in enumerate(WEIGHTS)),
                start=F.lit(0))
    check = F.substring(F.lit(CHECK_CHARACTERS), F.pmod(total, F.lit(11)) + 1, F.lit(1))
    right = F.concat(F.substring(no, 1, 17), check)
    well_formed = (F.length(no) == 18) & F.substring(no, 1, 17).rlike(r"^\d{17}$")
    status = (F.when(F.length(no) != 18, "wrong_length")
              .when(~F.substring(no, 1, 17).rlike(r"^\d{17}$"), "not_numeric")
              .when(right == no, "valid")
              .otherwise("wrong_check_digit"))
    return F.struct(status.alias("status"), F.when(well_formed, right).alias("corrected"))
