"""Folders on whatever file system Spark has them: listing, renaming, deleting."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names right below a folder; none if it isn't there."""
    at, fs = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers n of the folders ``<prefix>n`` right below the path, ascending; unfinished ones end otherwise."""
    found = [n.removeprefix(prefix) for n in names(spark, path) if n.startswith(prefix)]
    return sorted(int(n) for n in found if n.isdigit())


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder to a name that isn't taken."""
    at, fs = _at(spark, old)
    to = _at(spark, new)[0]
    if fs.exists(to) or not fs.rename(at, to):
        raise OSError(f"{old} can't be renamed to {new}")


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)
