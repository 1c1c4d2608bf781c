"""Packing token ids into rows of one length, best fit decreasing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm import bpe


class Capacities:
    """How many open rows have each number of free places, as a segment tree over that number."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        at = free + self.leaves
        while at:
            self.tree[at] += n
            at >>= 1

    def at_least(self, need: int) -> int:
        """The smallest number of free places from ``need`` on that an open row has, or -1."""
        tree, at = self.tree, need + self.leaves
        if tree[at]:
            return need
        while at > 1:
            if not at & 1 and tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if tree[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Positions in ``lengths`` by row: longest first, each to the fullest row that still has room for it."""
    open_rows: list[list[int]] = [[] for _ in range(size + 1)]  # by free places
    free, rows = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = free.at_least(lengths[i])
        if room < 0:
            rows.append([])
            row, room = len(rows) - 1, size
        else:
            row = open_rows[room].pop()
            free.add(room, -1)
        rows[row].append(i)
        open_rows[room - lengths[i]].append(row)
        free.add(room - lengths[i], 1)
    return rows


class Packer:
    """Rows of ``size`` ids from documents that come one by one; holds ``hold`` ids at most besides one document."""

    def __init__(self, size: int, pad: int, dtype: str, hold: int):
        self.size, self.pad, self.dtype, self.hold = size, pad, dtype, hold
        self.parts: list[tuple[object, int, np.ndarray]] = []
        self.held = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[dict]:
        """Take a document; full rows cut from a long one come out at once, its rest waits with the others."""
        whole = len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            yield self.row([(doc, start, ids[start:start + self.size])])
        if whole < len(ids) or not len(ids):
            self.parts.append((doc, whole, ids[whole:].copy()))
            self.held += len(ids) - whole + 16
        if self.held >= self.hold:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        parts, self.parts, self.held = self.parts, [], 0
        for row in best_fit_decreasing([len(p[2]) for p in parts], self.size):
            yield self.row([parts[i] for i in row])

    def row(self, parts: list[tuple[object, int, np.ndarray]]) -> dict:
        ids, positions = np.full(self.size, self.pad, self.dtype), np.zeros(self.size, self.dtype)
        ends, at = [0], 0
        for _, _, part in parts:
            ids[at:at + len(part)] = part
            positions[at:at + len(part)] = np.arange(len(part))
            at += len(part)
            ends.append(at)
        return {"n_tokens": at, "input_ids": ids.tobytes(), "position_ids": positions.tobytes(), "cu_seqlens": ends,
                "doc_ids": [p[0] for p in parts], "starts": [p[1] for p in parts]}


def _packed(given: DataFrame, ids_of: Callable[[], Callable[[pa.Scalar], np.ndarray]], size: int, pad: int, dtype: str, hold: int) -> DataFrame:
    """``given`` has the id and what ``ids_of()`` turns into ids."""
    schema = given.limit(0).select(F.lit(0).cast("long").alias("pack_id"), F.lit(0).alias("n_tokens"), F.lit(b"").alias("input_ids"),
                                   F.lit(b"").alias("position_ids"), F.array(F.lit(0)).alias("cu_seqlens"),
                                   F.array(given.columns[0]).alias("doc_ids"), F.array(F.lit(0).cast("long")).alias("starts")).schema
    types = {"pack_id": pa.int64(), "n_tokens": pa.int32(), "input_ids": pa.binary(), "position_ids": pa.binary(),
             "cu_seqlens": pa.list_(pa.int32()), "starts": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, decode, base, n = Packer(size, pad, dtype, hold), ids_of(), TaskContext.get().partitionId() << 33, 0
        rows: list[dict] = []
        doc_type = pa.int64()

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            nonlocal n
            columns = [pa.array(range(base + n, base + n + len(rows)), pa.int64())]
            columns += [pa.array([r[c] for r in rows], types.get(c) or pa.list_(doc_type)) for c in schema.names[1:]]
            n += len(rows)
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in packer.add(doc, decode(x)):
                    rows.append(row)
                    if len(rows) >= 512:
                        yield batch_of(rows)
                        rows = []
        for row in packer.flush():
            rows.append(row)
            if len(rows) >= 512:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return given.mapInArrow(run, schema)


def pack_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               seq_len: int = 2048, eos_id: int = 50256, hold_tokens: int = 4 << 20) -> DataFrame:
    """Encode each whole text, end it with ``eos_id``, and pack the documents into rows of ``seq_len`` ids.

    A row has: pack_id; n_tokens (the rest of the row is filled up with ``eos_id``); ``input_ids``, the row
    of the id matrix, and ``position_ids``, which restart at 0 with each segment, both as little-endian
    uint16 (uint32 if an id or position needs it); ``cu_seqlens``, the ends of the segments so far, from 0; and per
    segment its document (``doc_ids``) and the token at which it starts there (``starts``). Documents longer
    than a row give full rows and a rest, so nothing is cut off: the segments of a document in the order of
    ``starts`` are its ids (see ``unpack``).

    Each task packs what it reads, best fit decreasing over up to ``hold_tokens`` ids at a time, so there is
    no shuffle and memory is bounded; only the last row or so of each such set is less than full. Which
    documents share a row follows the table's splits; that every id is there once doesn't. Null and empty
    texts are one ``eos_id``. Repeated rows are packed each. Other columns are not read.
    """
    given = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_bytes"))
    dtype = id_dtype(eos_id, seq_len)

    def ids_of():
        enc = bpe.encoder(rank_file, pattern)
        end = np.array([eos_id], dtype).tobytes()

        def ids(x: pa.Scalar) -> np.ndarray:
            return np.frombuffer(enc.encode_bytes(bpe.text_of(x), dtype) + end, dtype)
        return ids

    return _packed(given, ids_of, seq_len, eos_id, dtype, hold_tokens)


def pack_ids(docs: DataFrame, id_col: str, ids_col: str, seq_len: int, pad_id: int, max_id: int, hold_tokens: int = 4 << 20) -> DataFrame:
    """The same for a column of ids (array<int>, at most ``max_id``); null counts as no ids.

    A document without ids is a segment of length 0 in some row.
    """
    given = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids_col}`").alias("_ids"))
    dtype = id_dtype(max(max_id, pad_id), seq_len)
    ids_of = lambda: lambda x: np.asarray(x.values, dtype) if x.is_valid else np.zeros(0, dtype)
    return _packed(given, ids_of, seq_len, pad_id, dtype, hold_tokens)


def id_dtype(max_id: int, seq_len: int) -> str:
    return "<u2" if max(max_id, seq_len) < 1 << 16 else "<u4"


def unpack(row, dtype: str = "<u2") -> list[tuple[object, int, np.ndarray]]:
    """(document, start, ids) of each segment of a packed row."""
    ids = np.frombuffer(row["input_ids"], dtype)
    ends = row["cu_seqlens"]
    return [(doc, start, ids[a:b]) for doc, start, a, b in zip(row["doc_ids"], row["starts"], ends, ends[1:])]


def write_packed(packed: DataFrame, path: str, rows_per_file: int = 65_536) -> None:
    """Write packed rows as Parquet files of at most ``rows_per_file`` rows, that is id matrices of that height."""
    packed.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
