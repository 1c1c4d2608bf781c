"""Tables and collections: names, columns, counts, reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_columns(spark: SparkSession, name: str) -> DataFrame:
    """``(column_name, type)`` of a table; ``db.table`` is split at the first dot."""
    return columns_of(spark.table(name))


def columns_of(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, type string")


def column_counts(df: DataFrame) -> DataFrame:
    """``(column_name, n_values)``: non-null values per column, in one pass."""
    counted = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "n_values")


def catalog_tables(spark: SparkSession, db: str | None = None) -> DataFrame:
    """Names of the tables and views of a database."""
    rows = [(t.name,) for t in spark.catalog.listTables(db)]
    return spark.createDataFrame(rows, "name string")


def read_docs(spark: SparkSession, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Every document of a collection; ``fmt`` is any installed source format."""
    return spark.read.format(fmt).options(**options).load(name)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, n_rows)`` of the tables that are not empty, counted in one job."""
    counted = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
               for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counted).where("n_rows > 0")
