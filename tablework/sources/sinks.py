"""Upserts, keyed collections, message envelopes and statement files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.plans.skew import lookup_join, ranked
from tablework.sources.shards import shard_numbers


def latest_by_key(rows: DataFrame, key: str, order: str, keep: str = "last") -> DataFrame:
    """One row per key: the one with the largest (or smallest) order value, which must tell a key's rows apart.

    Rows without a key stay as they are: they have nothing in common.
    """
    if keep not in ("last", "first"):
        raise ValueError("keep is last or first")
    pick = F.max_by if keep == "last" else F.min_by
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    keyed = rows.where(F.col(key).isNotNull()).groupBy(key).agg(pick(row, F.col(order)).alias("_row")).select("_row.*")
    return keyed.unionByName(rows.where(F.col(key).isNull()))


def upsert_by_key(target: DataFrame, updates: DataFrame, key: str, order: str,
                  keep: str = "last") -> DataFrame:
    """The target with rows replaced or added by key.

    Several updates of one key are cut down to one before the join.
    """
    chosen = latest_by_key(updates, key, order, keep)
    new_keys = chosen.select(key).where(F.col(key).isNotNull())
    fresh = chosen.select(*target.columns)
    return lookup_join(target, new_keys, [key], "left_anti").select(*target.columns).unionByName(fresh)


def collect_by_key(df: DataFrame, key: str, value: str, kind: str = "list",
                   order: str | None = None) -> DataFrame:
    """Values pushed under a key, as a key-value table of entries.

    ``list``: ``(key, position, value)``, newest (largest ``order``) first.
    ``set``: ``(key, value)``, each value once.
    ``zset``: ``(key, position, value, score)``, each value once with its
    largest score (``order``), smallest score first.

    Entries stay rows, so a key with a third of all values needs no giant
    array; :func:`in_segments` packs them into arrays of bounded length.
    """
    if kind == "set":
        return df.select(key, value).distinct()
    if order is None:
        raise ValueError(f"kind {kind} needs an order column")
    if kind == "list":
        return (ranked(df.select(key, value, order), [key], [order, value], "position", descending=True)
                .select(key, "position", value))
    if kind == "zset":
        scored = df.groupBy(key, value).agg(F.max(order).alias("score"))
        return ranked(scored, [key], ["score", value], "position").select(key, "position", value, "score")
    raise ValueError("kind is list, set or zset")


def in_segments(entries: DataFrame, key: str, value: str, size: int = 1024) -> DataFrame:
    """Positioned entries packed as ``(key, segment, values)``, at most ``size`` per array."""
    segment = F.floor((F.col("position") - 1) / size).alias("segment")
    packed = F.array_sort(F.collect_list(F.struct("position", value)))
    return (entries.groupBy(key, segment).agg(packed.alias("_e"))
            .select(key, "segment", F.col(f"_e.{value}").alias("values")))


def publish(df: DataFrame, topic: str, payload: str, qos: int = 0, retain: bool = False,
            content_type: str = "text/plain") -> DataFrame:
    """Message envelopes ``(topic, payload, qos, retain, content_type)``; payload as bytes."""
    if qos not in (0, 1, 2):
        raise ValueError("qos is 0, 1 or 2")
    return df.select(F.col(topic).cast("string").alias("topic"),
                     F.encode(F.col(payload).cast("string"), "UTF-8").alias("payload"),
                     F.lit(qos).alias("qos"), F.lit(retain).alias("retain"),
                     F.lit(content_type).alias("content_type"))


def send(messages: DataFrame, fmt: str = "parquet", **options: str) -> None:
    """Append message envelopes to a sink of any installed format."""
    messages.write.format(fmt).options(**options).mode("append").save()


def sharded_text(df: DataFrame, block: str, block_order: str, ord: str, text: str,
                 max_count: int, path: str) -> DataFrame:
    """Write statement text into shards and return the shard of each block.

    Shard ``k`` is the folder ``shard=k``; its part files, in name order, are
    the statements in order. A block of any size keeps to one shard without
    having to pass through one task.
    """
    sizes = df.groupBy(block).agg(F.count(F.lit(1)).alias("statements"),
                                  F.min(block_order).alias(block_order))
    shards = shard_numbers(sizes, block_order, "statements", max_count)
    rows = lookup_join(df, shards.select(block, "shard"), [block], "left")
    (rows.repartitionByRange("shard", block_order, block, ord)
     .sortWithinPartitions("shard", block_order, block, ord)
     .select("shard", F.col(text).alias("value"))
     .write.partitionBy("shard").mode("overwrite").text(path))
    return shards
