"""JDBC reading and batched insertion. Driver jars come by ``spark.jars``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str, driver: str, user: str | None = None,
                 password: str | None = None, properties: dict[str, str] | None = None,
                 **extra: object) -> dict[str, str]:
    """Options of a JDBC connection; url, table and driver class are required.

    User and password are passed only when both are given.
    """
    for name, value in (("url", url), ("table", table), ("driver", driver)):
        if not value:
            raise ValueError(f"required argument {name} is absent")
    options = dict(properties or {})
    if user and password:
        options |= {"user": user, "password": password}
    return options | {k: str(v) for k, v in extra.items()} | {
        "url": url, "dbtable": table, "driver": driver}


def jdbc_source(spark: SparkSession, url: str, table: str, driver: str,
                partition_column: str | None = None, bounds: tuple[object, object] | None = None,
                num_partitions: int | None = None, fetch_size: int = 1024, single: bool = False,
                **options: object) -> DataFrame:
    """A table reached by JDBC, read in parallel ranges of ``partition_column``.

    A read through one connection, that is one task, must be asked for by ``single``. Filters, column
    selection and plain aggregates are pushed to the database.
    """
    if not single:
        if partition_column is None or bounds is None or not num_partitions:
            raise ValueError("a parallel read needs partition_column, bounds and num_partitions; or say single=True")
        options |= {"partitionColumn": partition_column, "lowerBound": bounds[0],
                    "upperBound": bounds[1], "numPartitions": num_partitions}
    options |= {"fetchsize": fetch_size, "pushDownAggregate": "true"}
    return spark.read.format("jdbc").options(**jdbc_options(url, table, driver, **options)).load()


def batched_insert(df: DataFrame, url: str, table: str, driver: str, batch_size: int = 100,
                   num_partitions: int | None = None, **options: object) -> None:
    """Append the rows by inserts of ``batch_size`` rows; the last one may be shorter.

    ``num_partitions`` limits how many connections write at a time. A task
    that is run again inserts its rows again: give the target a key.
    """
    options |= {"batchsize": batch_size}
    if num_partitions:
        options |= {"numPartitions": num_partitions}
    (df.write.format("jdbc").options(**jdbc_options(url, table, driver, **options))
     .mode("append").save())
