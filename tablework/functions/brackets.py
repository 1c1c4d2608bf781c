"""Tax bracket lookup."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound of the taxable income, rate, quick deduction.
# The first bound is inclusive, the others are exclusive.
BRACKETS = [
    (36000, "0.03", 0),
    (144000, "0.10", 2520),
    (300000, "0.20", 16920),
    (420000, "0.25", 31920),
    (660000, "0.30", 52920),
    (960000, "0.35", 85920),
    (None, "0.45", 181920),
]


def tax_bracket(taxable: Column) -> Column:
    """Struct ``(rate, quick)`` of the bracket the income falls into."""
    def entry(rate: str, quick: int) -> Column:
        return F.struct(F.lit(Decimal(rate)).cast("decimal(3,2)").alias("rate"),
                        F.lit(quick).cast("decimal(18,2)").alias("quick"))

    bound, rate, quick = BRACKETS[0]
    found = F.when(taxable <= bound, entry(rate, quick))
    for bound, rate, quick in BRACKETS[1:-1]:
        found = found.when(taxable < bound, entry(rate, quick))
    return found.otherwise(entry(*BRACKETS[-1][1:]))
