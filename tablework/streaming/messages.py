"""Message streams: subscribe, consume, relay, retain, deliver, collect.

A message stream is any streaming DataFrame ``(topic, payload BINARY, ...)``,
whatever source it comes from. Sinks are files in the shared folder here; the
writers take the format and options of any installed connector.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablework.functions.text import payload_text
from tablework.sources.sinks import collect_by_key
from tablework.streaming.collected import SegmentedList
from tablework.streaming.levels import LevelledTable
from tablework.streaming.seen import deliver_once


def subscribe(stream: DataFrame, topic: str) -> DataFrame:
    """Messages of one topic, with the line ``[topic] payload`` as ``line``."""
    text = payload_text(F.col("payload"))
    line = F.concat(F.lit("["), F.col("topic"), F.lit("] "), text)
    return stream.where(F.col("topic") == topic).withColumn("line", line)


def consume(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
            continuous: bool = False, **options: str) -> StreamingQuery:
    """Write a stream to a sink, each message once per checkpoint.

    Takes what is available and stops, or goes on for ever with ``continuous``.
    """
    writer = (stream.writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", path).options(**options))
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def _run_id(checkpoint: str, spark) -> str:
    """A name that belongs to the checkpoint: folders of a new checkpoint never meet those of an old one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    home = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    marker = f"{checkpoint.rstrip('/')}/run-name"
    try:
        return spark.read.text(marker).first()["value"]
    except AnalysisException:
        name = f"{hashlib.md5(home.encode()).hexdigest()[:8]}{uuid.uuid4().hex[:8]}"
        spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(marker)
        return name


def _each_batch(stream: DataFrame, checkpoint: str, save, continuous: bool, mode: str = "append") -> StreamingQuery:
    """Call ``save(batch, folder)`` per micro-batch; the folder name is the same when a batch is run again."""
    run = _run_id(checkpoint, stream.sparkSession)
    writer = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
              .foreachBatch(lambda batch, number: save(batch, f"run={run}/batch={number}")))
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def relay(stream: DataFrame, to: str, path: str, printed: str, checkpoint: str,
          continuous: bool = False, fmt: str = "parquet", **options: str) -> StreamingQuery:
    """Pass messages on to topic ``to`` with their properties, and print each body.

    Both outputs are written per micro-batch, in the given format, into a folder of the checkpoint's name and the
    batch's number, so a batch that is run again replaces what it wrote. The batch is read once.
    """
    def forward(batch: DataFrame, folder: str) -> None:
        batch.persist()
        try:
            (batch.withColumn("topic", F.lit(to))
             .write.format(fmt).options(**options).mode("overwrite").save(f"{path}/{folder}"))
            (batch.select(payload_text(F.col("payload")).alias("value"))
             .write.format(fmt).options(**options).mode("overwrite").save(f"{printed}/{folder}"))
        finally:
            batch.unpersist()

    return _each_batch(stream, checkpoint, forward, continuous)


def retained(stream: DataFrame, ts: str = "ts", id: str = "id") -> DataFrame:
    """The last message of each topic: state of one row per topic."""
    last = F.max_by(F.struct("payload", F.col(ts), F.col(id)), F.struct(ts, id))
    return (stream.where("retain").groupBy("topic").agg(last.alias("_m"))
            .select("topic", "_m.payload", f"_m.{ts}", f"_m.{id}"))


def deliver(stream: DataFrame, qos: int, id: str = "id", ts: str = "ts",
            watermark: str | None = None, compact: bool = False) -> DataFrame:
    """Delivery level: 2 passes each message id once; 0 and 1 pass everything (1 is kept by the sink's checkpoint).

    Nothing is lost, however late or out of order it comes: the ids seen are kept as state, which the
    RocksDB store holds on disk. Where that state may not grow without end, a ``watermark`` bounds it, and only
    then are messages that come later than it dropped: the caller's choice, never the default. Ids that are whole
    numbers take far less with ``compact`` (:func:`deliver_once`), which drops nothing either.
    """
    if qos not in (0, 1, 2):
        raise ValueError("qos is 0, 1 or 2")
    if qos < 2:
        return stream
    if compact:
        if watermark is not None:
            raise ValueError("compact keeps all ids and takes no watermark")
        return deliver_once(stream, id)
    if watermark is None:
        return stream.dropDuplicates([id])
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id])


def keep_latest(result: DataFrame, path: str, checkpoint: str, continuous: bool = False, keys: tuple[str, ...] = ("topic",),
                fmt: str = "parquet", fanout: int = 4, **options: str) -> StreamingQuery:
    """Fold what each batch changed into a keyed table, read by :func:`latest_state`.

    ``result`` is an aggregate by ``keys``, run in update mode, so a batch has the changed keys only. They are written as a
    sorted delta and merged with others in levels (:class:`LevelledTable`), so a batch costs what it changes, not what the
    table holds. A batch that is run again is known by its checkpoint and number.
    """
    table = LevelledTable(result.sparkSession, path, keys, fanout, fmt, options)
    return _each_batch(result, checkpoint, lambda batch, folder: table.add(batch, re.sub(r"\W", "_", folder)), continuous, "update")


def latest_state(spark, path: str, fmt: str = "parquet", keys: tuple[str, ...] = ("topic",), **options: str) -> DataFrame:
    """The table that :func:`keep_latest` keeps, as it stands: the newest row of each key."""
    return LevelledTable(spark, path, keys, fmt=fmt, options=options).read()


def push(stream: DataFrame, key: str, value: str, order: str, path: str, checkpoint: str,
         continuous: bool = False, fmt: str = "parquet", **options: str) -> StreamingQuery:
    """Append a stream of lines to keyed collections (read by :func:`pushed`)."""
    def save(batch: DataFrame, folder: str) -> None:
        (batch.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(order).alias("ord"))
         .write.format(fmt).options(**options).mode("overwrite").save(f"{path}/{folder}"))

    return _each_batch(stream, checkpoint, save, continuous)


def pushed(spark, path: str, kind: str = "list", fmt: str = "parquet", **options: str) -> DataFrame:
    """The keyed collections as they stand after the batches written so far."""
    return collect_by_key(spark.read.format(fmt).options(**options).load(path), "key", "value", kind, "ord")


def push_list(stream: DataFrame, key: str, value: str, order: str, path: str, checkpoint: str, continuous: bool = False,
              limit: int = 4096) -> StreamingQuery:
    """Put a stream of lines into keyed lists whose positions are kept up to date (read by :func:`pushed_list`).

    ``order`` is a column of whole numbers; the largest stands first.
    """
    lists = SegmentedList(stream.sparkSession, path, limit)

    def save(batch: DataFrame, folder: str) -> None:
        lists.add(batch.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(order).alias("ord")), re.sub(r"\W", "_", folder))

    return _each_batch(stream, checkpoint, save, continuous)


def pushed_list(spark, path: str) -> DataFrame:
    """The keyed lists as they stand after the batches written so far: (key, position, value)."""
    return SegmentedList(spark, path).read()
