"""Blocks packed into shards one after the other, numbered in parallel by a scan over what chunks of them do."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablework.plans.skew import ranked
from tablework.session import shared_path

#: Blocks numbered by one task at a time, and reports that one task puts together.
CHUNK_BLOCKS, FAN_IN = 10_000, 16


class Report(NamedTuple):
    """What some blocks in a row make of the rows ``held`` by the shard that is open before them.

    Up to ``free`` rows the blocks all fit, and the open shard holds ``total`` more. From each of the ascending ``starts``
    on a new shard begins somewhere: the last one then holds ``held`` rows, however many there were before, after
    ``begun`` new shards.
    """

    free: int
    total: int
    starts: np.ndarray
    held: np.ndarray
    begun: np.ndarray


def _tidy(free: int, total: int, starts: np.ndarray, held: np.ndarray, begun: np.ndarray) -> Report:
    """One piece for each start, the last one of it, and none that goes on as the one before."""
    last = np.append(starts[1:] != starts[:-1], True) if len(starts) else np.zeros(0, bool)
    starts, held, begun = starts[last], held[last], begun[last]
    new = np.insert((held[1:] != held[:-1]) | (begun[1:] != begun[:-1]), 0, True) if len(starts) else np.zeros(0, bool)
    return Report(int(free), int(total), starts[new], held[new], begun[new])


def report(sizes: np.ndarray, max_count: int) -> Report:
    """The report of blocks of these sizes, in order."""
    upto = np.cumsum(sizes)
    n, total = len(sizes), int(upto[-1])
    before = upto - sizes
    following = np.maximum(np.searchsorted(upto, before + max_count, side="right"), np.arange(n) + 1)
    held, begun = total - before, np.ones(n, np.int64)  # if a shard begins with block i
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            held[i] = held[following[i]]
            begun[i] += begun[following[i]]
    # With h rows held the first new shard begins with the first block i for which h + upto[i] is above the limit.
    starts = np.maximum(max_count - upto + 1, 0)[::-1]
    return _tidy(max_count - total, total, starts, held[::-1], begun[::-1])


def apply(f: Report, held: int, shard: int) -> tuple[int, int]:
    """Rows held and number of the shard that is open after the blocks."""
    if held <= f.free:
        return held + f.total, shard
    at = int(np.searchsorted(f.starts, held, side="right")) - 1
    return int(f.held[at]), shard + int(f.begun[at])


def then(f: Report, g: Report) -> Report:
    """The report of the blocks of ``f`` and after them those of ``g``."""
    # where f begins no shard, g sees what was held and f's total
    low = np.maximum(g.starts - f.total, 0)
    fits = low <= f.free
    # where it does, g sees what f's last shard holds
    at = np.maximum(np.searchsorted(g.starts, f.held, side="right") - 1, 0)
    goes_on = f.held <= g.free
    held = np.where(goes_on, f.held + g.total, g.held[at] if len(g.held) else 0)
    begun = f.begun + np.where(goes_on, 0, g.begun[at] if len(g.begun) else 0)
    free = min(f.free, g.free - f.total)
    return _tidy(free, f.total + g.total, np.concatenate([low[fits], f.starts]), np.concatenate([g.held[fits], held]),
                 np.concatenate([g.begun[fits], begun]))


_REPORT = "node bigint, free bigint, total bigint, starts array<bigint>, held array<bigint>, begun array<bigint>"


def _row(node: int, f: Report) -> pd.DataFrame:
    return pd.DataFrame({"node": [node], "free": [f.free], "total": [f.total], "starts": [f.starts], "held": [f.held], "begun": [f.begun]})


def _reports(pdf: pd.DataFrame) -> list[Report]:
    return [Report(r.free, r.total, np.asarray(r.starts), np.asarray(r.held), np.asarray(r.begun)) for r in pdf.sort_values("node").itertuples()]


def _put_together(pdf: pd.DataFrame) -> pd.DataFrame:
    whole, *rest = _reports(pdf)
    for g in rest:
        whole = then(whole, g)
    return _row(pdf["parent"].iloc[0], whole)


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Before each of a parent's nodes: the rows held and the shard, from those before the parent."""
    held, shard, out = int(pdf["before_held"].iloc[0]), int(pdf["before_shard"].iloc[0]), []
    for node, f in zip(sorted(pdf["node"]), _reports(pdf)):
        out.append((node, held, shard))
        held, shard = apply(f, held, shard)
    return pd.DataFrame(out, columns=["node", "before_held", "before_shard"])


def shard_numbers(blocks: DataFrame, order: str, size: str, max_count: int,
                  chunk_blocks: int = CHUNK_BLOCKS, fan_in: int = FAN_IN) -> DataFrame:
    """Add ``shard``: blocks in order are packed into shards of at most ``max_count``.

    A block is never split: when it does not fit, the next shard begins with it (so a first block above the limit
    stands in shard 2). Blocks of equal ``order`` go by their other columns.

    The packing is sequential, but a chunk of blocks depends on what went before only through the rows already in the open
    shard. Each chunk reports what it does for every such number (``min(chunk_blocks, max_count + 1)`` cases at
    most), ``fan_in`` neighbours' reports are put together into one, and so on up a tree; then the true numbers go down
    it, and the chunks number their blocks. All of it runs in tasks; the driver gets the number of chunks.
    """
    spark, columns = blocks.sparkSession, list(blocks.columns)
    ordered = ranked(blocks, [], [order, *[c for c in columns if c not in (order, size)]], "_no").withColumn(
        "_chunk", F.floor((F.col("_no") - 1) / chunk_blocks))

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    numbered = stored(ordered, "numbered-blocks")

    def of_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        return _row(pdf["node"].iloc[0], report(pdf.sort_values("_no")["_size"].to_numpy(np.int64), max_count))

    thin = numbered.select(F.col("_chunk").alias("node"), "_no", F.col(size).cast("bigint").alias("_size"))
    levels = [stored(thin.groupBy("node").applyInPandas(of_chunk, _REPORT), "shard-reports")]
    nodes = levels[0].agg(F.count(F.lit(1))).first()[0]
    parent = F.floor(F.col("node") / fan_in).alias("parent")
    while nodes > fan_in:
        levels.append(stored(levels[-1].select("*", parent).groupBy("parent").applyInPandas(_put_together, _REPORT), "shard-reports"))
        nodes = -(-nodes // fan_in)
    known = spark.range(1).select(F.col("id").alias("parent"), F.lit(0).cast("long").alias("before_held"), F.lit(1).cast("long").alias("before_shard"))
    for level in reversed(levels):
        known = level.select("*", parent).join(known, "parent").groupBy("parent") \
            .applyInPandas(_walk, "node bigint, before_held bigint, before_shard bigint") \
            .withColumnRenamed("node", "parent")
    known = known.withColumnRenamed("parent", "_chunk")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_no")
        held, shard = int(pdf["before_held"].iloc[0]), int(pdf["before_shard"].iloc[0])
        shards = np.empty(len(pdf), dtype=np.int64)
        for i, n in enumerate(pdf[size].tolist()):
            held += n
            if held > max_count:
                held, shard = n, shard + 1
            shards[i] = shard
        return pdf[columns].assign(shard=shards)

    out = T.StructType([*blocks.schema.fields, T.StructField("shard", T.LongType())])
    return numbered.join(known, "_chunk").groupBy("_chunk").applyInPandas(number, out)
