"""A keyed table in hash buckets, where an upsert rewrites only the buckets it touches."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.plans.skew import lookup_join
from tablework.sources import folders
from tablework.sources.sinks import latest_by_key

#: The bucket of rows without a key: they are never replaced, so it only grows.
NO_KEY = -1


class BucketedTable:
    """Rows below ``path``: ``data/version=v/_b=n`` holds bucket n as upsert v wrote it, ``manifest=v`` which version of each is valid.

    A reader takes the newest manifest and finds all its files; an upsert writes its buckets beside the old ones and
    then the next manifest, whose renaming is the moment it takes effect. One that fails before leaves the table as it
    was, and what it wrote is overwritten by the next. One writer at a time. The number of buckets is fixed when the table is created: a bucket
    must fit a task, so it is rows over a task's share. The driver holds one line a bucket.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        text = "".join(r["value"] for r in spark.read.text(f"{self.path}/table").collect())
        about = json.loads(text)
        self.key, self.buckets, self.schema = about["key"], about["buckets"], T.StructType.fromJson(about["schema"])

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64, order: str | None = None) -> BucketedTable:
        """A new table; with ``order`` the last row of each key, else keys must be distinct. It must not be there yet."""
        spark, path = rows.sparkSession, path.rstrip("/")
        if folders.exists(spark, f"{path}/table"):
            raise FileExistsError(f"{path} is a table already")
        if buckets < 1:
            raise ValueError("buckets must be 1 or more")
        chosen = latest_by_key(rows, key, order) if order else rows
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        about = json.dumps({"key": key, "buckets": buckets, "schema": json.loads(schema.json())})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/table")
        table = cls(spark, path)
        table._write(chosen.withColumn("_b", table._bucket()), 0)
        table._publish(table._counts(0), 0)
        return table

    def _bucket(self) -> Column:
        key = F.col(f"`{self.key}`")
        return F.when(key.isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, version: int) -> None:
        """Each bucket comes from one task, but for rows without a key, which are dealt out."""
        deal = F.when(F.col("_b") == NO_KEY, F.rand(seed=version) * 64).otherwise(0).cast("int")
        rows.repartition("_b", deal).write.partitionBy("_b").mode("overwrite").parquet(f"{self.path}/data/version={version}")

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.path}/data/version={version}/_b={bucket}"

    def _counts(self, version: int) -> list[tuple[int, int, int]]:
        """(bucket, version, rows) of what a version wrote; nothing of an empty one."""
        schema = T.StructType([*self.schema.fields, T.StructField("_b", T.IntegerType())])
        found = self.spark.read.schema(schema).parquet(f"{self.path}/data/version={version}").groupBy("_b").count().collect()
        return [(r["_b"], version, r["count"]) for r in found]

    def _publish(self, lines: list[tuple[int, int, int]], version: int) -> None:
        part = f"{self.path}/manifest.part"
        self.spark.createDataFrame(lines, "bucket int, version int, n_rows long").coalesce(1).write.mode("overwrite").parquet(part)
        folders.rename(self.spark, part, f"{self.path}/manifest={version}")

    def _manifest(self, version: int) -> list[tuple[int, int, int]]:
        return [tuple(r) for r in self.spark.read.parquet(f"{self.path}/manifest={version}").collect()]

    def version(self) -> int:
        return folders.numbered(self.spark, self.path, "manifest=")[-1]

    def manifest(self) -> list[tuple[int, int, int]]:
        """(bucket, version, rows) of the valid buckets; ``NO_KEY`` has a line for each version that added to it."""
        return self._manifest(self.version())

    def _rows(self, lines: list[tuple[int, int, int]]) -> DataFrame:
        if not lines:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(v, b) for b, v, _ in lines])

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in the column of the key's name, from their buckets only."""
        wanted = keys.select(F.col(f"`{self.key}`")).where(F.col(f"`{self.key}`").isNotNull()).distinct()
        touched = {r["_b"] for r in wanted.select(self._bucket().alias("_b")).distinct().collect()}
        return lookup_join(self._rows([x for x in self.manifest() if x[0] in touched]), wanted, [self.key], "left_semi")

    def upsert(self, updates: DataFrame, order: str, keep: str = "last") -> int:
        """Replace or add rows by key; how many buckets were written. Of several updates of a key the last by ``order`` counts.

        Columns of the updates that the table hasn't got are left out. Updates without a key are added as they are. No
        updates change nothing.
        """
        before = self.version()
        now, lines = before + 1, self._manifest(before)
        staged = f"{self.path}/updates.part"
        chosen = latest_by_key(updates, self.key, order, keep)
        chosen.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]).withColumn("_b", self._bucket()) \
            .write.mode("overwrite").parquet(staged)
        new = self.spark.read.parquet(staged)
        touched = {r["_b"] for r in new.select("_b").distinct().collect()}
        if not touched:
            folders.delete(self.spark, staged)
            return 0
        old = self._rows([x for x in lines if x[0] in touched - {NO_KEY}])
        stays = lookup_join(old, new.where(F.col("_b") != NO_KEY).select(self.key), [self.key], "left_anti") \
            .select(*[F.col(f"`{c}`") for c in self.schema.names]).withColumn("_b", self._bucket())
        self._write(stays.unionByName(new), now)
        kept = [x for x in lines if x[0] not in touched or x[0] == NO_KEY]
        self._publish(kept + self._counts(now), now)
        folders.delete(self.spark, staged)
        return len(touched)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what none of the ``keep`` newest manifests names; how many bucket folders went."""
        versions = folders.numbered(self.spark, self.path, "manifest=")
        valid = {(b, v) for m in versions[-keep:] for b, v, _ in self._manifest(m)}
        gone = 0
        for v in folders.numbered(self.spark, f"{self.path}/data", "version="):
            found = [int(n.removeprefix("_b=")) for n in folders.names(self.spark, f"{self.path}/data/version={v}") if n.startswith("_b=")]
            if v > versions[-1]:
                continue  # being written
            for b in found:
                if (b, v) not in valid:
                    folders.delete(self.spark, self._folder(v, b))
                    gone += 1
        for m in versions[:-keep]:
            folders.delete(self.spark, f"{self.path}/manifest={m}")
        return gone
