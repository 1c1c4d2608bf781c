"""Cumulative withholding tax per person and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablework.functions.brackets import tax_bracket


def withholding(df: DataFrame, person: str = "person", year: str = "year", month: str = "month",
                income: str = "income", base: str = "base", deduction: str = "deduction",
                extra: str = "extra", as_published: bool = False) -> DataFrame:
    """Tax due each month from the running totals of the year.

    Rows of one month are summed first, so the window holds at most twelve
    rows per person and year. By default the tax of a month is the cumulative
    tax minus that of the month before. ``as_published`` subtracts the
    preceding ``taxable * rate`` without its quick deduction instead.
    """
    amounts = [income, base, deduction, extra]
    monthly = df.groupBy(person, year, month).agg(
        *[F.sum(F.col(c).cast("decimal(18,2)")).alias(c) for c in amounts])
    months = Window.partitionBy(person, year).orderBy(month)
    running = months.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = {c: F.sum(c).over(running) for c in amounts}
    taxable = monthly.select(
        person, year, month,
        (total[income] - total[base] - total[deduction] - total[extra])
        .cast("decimal(24,2)").alias("taxable"))
    rated = taxable.withColumn("_b", tax_bracket(F.col("taxable"))).select(
        person, year, month, "taxable", "_b.rate", "_b.quick")
    gross = (F.col("taxable") * F.col("rate")).cast("decimal(28,4)")
    paid = gross if as_published else gross - F.col("quick")
    before = F.coalesce(F.lag(paid).over(months), F.lit(0))
    return rated.withColumn("tax", (gross - F.col("quick") - before).cast("decimal(28,4)"))


def tax_summary(df: DataFrame, person: str = "person", year: str = "year") -> DataFrame:
    """Yearly total and monthly average of the tax."""
    return df.groupBy(person, year).agg(
        F.sum("tax").cast("decimal(28,4)").alias("total"),
        F.avg("tax").cast("decimal(28,4)").alias("average"))
