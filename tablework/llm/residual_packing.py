"""Packing documents into sequences, best fit in each partition and then up a tree of what is underfull."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablework.llm.bpe import id_lists, text_of
from tablework.llm.common import discard, scratch

#: Distinct pieces, and matches in them, whose ids a worker keeps; as many older ones stay until these are full.
CACHE_PIECES = 400_000
#: Pieces longer than this are not kept.
LONG_PIECE = 64
#: A blank after white space: only there is a cut before a blank not a boundary of the pattern.
UNSAFE = re.compile(r"\s ")
#: Pieces of documents that one partition packs, and partitions or bins' groups that one merge takes.
PARTITION_PIECES, FAN_IN = 1 << 16, 16
#: Bins of a group that may go up a level.
CARRIED_BINS = 64

PIECE = "piece int, start long, length long, ids_crc32 long"


#: The byte-level split, for texts of characters that every library sorts into letters, digits and white space alike.
SPLIT = regex.compile(public_tokenizers.PATTERN)
PLAIN = re.compile("[\n\x20-\x7e\xa1-\u024f]*")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class PieceEncoder:
    """Ids by the ``tokenizers`` library, as little-endian unsigned 32-bit integers.

    A blank after a character that isn't white space starts a new match of the byte-level split, so texts are cut there, the
    pieces encoded on their own and looked up when they come again. A new piece of plain characters is split further, and
    the library's model merges each of its matches; anything else goes through the whole library. Texts where a blank follows
    white space are not cut before. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def learn(self, text: str) -> bytes:
        """Ids of a text that isn't cut before."""
        if not PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, out = self.matches, []
        for match in SPLIT.findall(text):
            ids = known.get(match)
            if ids is None:
                tokens = self.model.tokenize(match.encode().decode("latin-1").translate(self.letters))
                ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
                if len(match) < 64:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[match] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self.learn(text)
        if len(self.known) >= CACHE_PIECES:
            self.known, self.older = {}, self.known
        known, pieces = self.known, _pieces(text)
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            new = set(pieces).difference(known)
            for piece in new:
                known[piece] = self.older.get(piece) or self.learn(piece)
            out = b"".join(map(known.__getitem__, pieces))
            for piece in new:
                if len(piece) > LONG_PIECE:
                    del known[piece]
            return out


def _pieces(text: str) -> list[str]:
    """The text cut before each blank; the first piece may be empty."""
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


@lru_cache(maxsize=2)
def piece_encoder(tokenizer_file: str) -> PieceEncoder:
    """One encoder per worker process."""
    return PieceEncoder(tokenizer_file)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: whole if it fits, else of ``size`` ids, the first one maybe shorter."""
    first = n if n <= size else n % size or size
    return [(0, first), *[(at, size) for at in range(first, n, size)]]


def document_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024,
                    end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc, row, piece, start, length, ids_crc32, ids if asked for) of the pieces of each whole text and its end mark ``end_id``.

    ``row`` numbers the pieces; null text counts as empty. No shuffle; a task holds a batch of rows and the ids of one text
    at a time. Bytes that aren't UTF-8 are read as U+FFFD. Other columns are not read.
    """
    given = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    made = {"row": F.lit(0).cast("long"), "piece": F.lit(0), "start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"),
            "ids_crc32": F.lit(0).cast("long")}
    if with_ids:
        made["ids"] = F.array(F.lit(0))
    schema = given.select("doc").withColumns(made).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, base, row = piece_encoder(tokenizer_file), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40, 0

        def record(batch: pa.RecordBatch, at: list[int], columns: list[list[int]], kept: list[bytes]) -> pa.RecordBatch:
            arrays = [batch.column(0).take(pa.array(at, pa.int64()))]
            arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*arrays, id_lists(kept)] if with_ids else arrays, schema.names)

        for batch in batches:
            at, columns, kept = [], [[], [], [], [], []], []
            for k, x in enumerate(batch.column(1)):
                ids = enc.encode(text_of(x)) + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    part = ids[4 * start:4 * (start + length)]
                    at.append(k)
                    for column, value in zip(columns, (base + row, piece, start, length, zlib.crc32(part))):
                        column.append(value)
                    row += 1
                    if with_ids:
                        kept.append(part)
                    if len(at) >= 8192:
                        yield record(batch, at, columns, kept)
                        at, columns, kept = [], [[], [], [], [], []], []
            if at:
                yield record(batch, at, columns, kept)

    return given.mapInArrow(run, schema)


class OpenBins:
    """Bins by free places; a bit of ``free`` says that there is a bin with so many."""

    def __init__(self, size: int):
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.free, self.size, self.n = 0, size, 0

    def put(self, length: int) -> tuple[int, int]:
        """The number of the fullest bin that has room for ``length``, or of a new one, and the place in it."""
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = self.by_free[room].pop()
            if not self.by_free[room]:
                self.free ^= 1 << room
        else:
            room, at, self.n = self.size, self.n, self.n + 1
        left = room - length
        self.by_free[left].append(at)
        self.free |= 1 << left
        return at, self.size - room


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, longest first and each to the fullest bin with room, and what each bin holds in all."""
    bins, at, place = OpenBins(size), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        at[i], place[i] = bins.put(int(lengths[i]))
    fill = np.bincount(at, weights=lengths, minlength=bins.n).astype(np.int64)
    return at, place, fill


def going_up(fill: np.ndarray, size: int, slack: int, most: int) -> np.ndarray:
    """Which bins go up a level: of those with more than ``slack`` free places the ``most`` emptiest.

    Best fit leaves at most one bin half full or less. Whole bins that two groups could still share are that one of each,
    put into others; with ``most`` no less than the number of groups that meet, none of those chances is lost.
    """
    up = np.zeros(len(fill), bool)
    under = np.flatnonzero(fill < size - slack)
    up[under[np.argsort(fill[under], kind="stable")[:most]]] = True
    return up


def _pack_partition(size: int, slack: int, most: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        node = TaskContext.get().partitionId()
        at, place, fill = best_fit(np.concatenate([b.column(b.schema.get_field_index("length")).to_numpy() for b in given]), size)
        up, done = going_up(fill, size, slack, most), 0
        for b in given:
            part = slice(done, done + b.num_rows)
            done += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(base + (node << 20) + at[part]), pa.array(place[part]), pa.array(up[at[part]]),
                 pa.array(fill[at[part]]), pa.array(np.full(b.num_rows, node))],
                [*b.schema.names, "sequence_id", "offset", "up", "fill", "node"])
    return run


def _merge(size: int, slack: int, most: int, base: int):
    def run(key: tuple[pa.Scalar, ...], pieces: pa.Table) -> pa.Table:
        """Underfull bins of some groups as items of a best fit of their own; their pieces keep their places in them."""
        node = key[0].as_py()
        old = pieces.column("sequence_id").to_numpy()
        bins, first, item = np.unique(old, return_index=True, return_inverse=True)
        at, place, fill = best_fit(pieces.column("fill").to_numpy()[first], size)
        up, mine = going_up(fill, size, slack, most), at[item]
        new = {"sequence_id": base + (node << 20) + mine, "offset": pieces.column("offset").to_numpy() + place[item],
               "up": up[mine], "fill": fill[mine], "node": np.full(len(mine), node)}
        for name, values in new.items():
            pieces = pieces.set_column(pieces.schema.get_field_index(name), name, pa.array(values))
        return pieces
    return run


def pack_pieces(pieces: DataFrame, size: int = 1024, partition_pieces: int = PARTITION_PIECES, fan_in: int = FAN_IN,
                carried: int = CARRIED_BINS, slack: int | None = None) -> DataFrame:
    """``pieces`` (with row, length) and for each its sequence_id and offset there; a sequence has ``size`` places at most.

    Pieces of full length are sequences of their own. The others are dealt evenly into partitions of about
    ``partition_pieces``, whatever document or source they come from, and packed best fit there, longest first. Bins with at most ``slack``
    places free (default: 1/64 of the size) are done; of the others the ``carried`` emptiest go up a tree: those of
    ``fan_in`` partitions are the items of one best fit, and so on to the root. So a task holds so many pieces of one
    partition, or ``fan_in`` times ``carried`` bins, at any size of the input; and every piece keeps its place. No pieces give no rows.
    """
    if carried < fan_in:
        raise ValueError("carried must be at least fan_in")
    slack = size // 64 if slack is None else slack
    whole = pieces.where(F.col("length") >= size).withColumns({"sequence_id": F.lit(1 << 62) + F.col("row"), "offset": F.lit(0).cast("long")})
    short = pieces.where(F.col("length") < size)
    nodes = max(1, -(-short.count() // partition_pieces))
    kinds = {"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "up": F.lit(False), "fill": F.lit(0).cast("long"),
             "node": F.lit(0).cast("long")}
    schema = short.withColumns(kinds).schema
    dealt = short.repartition(nodes, F.xxhash64("row", F.lit("deal")))
    level = scratch(dealt.mapInArrow(_pack_partition(size, slack, carried, 0), schema), "packed")
    done, height = [level], 1
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        rising = level.where("up").withColumn("node", F.floor(F.col("node") / fan_in))
        level = scratch(rising.groupBy("node").applyInArrow(_merge(size, slack, carried, height << 56), schema), "packed")
        done.append(level)
        height += 1
    out = whole
    for k, level in enumerate(done):
        ended = level if k == len(done) - 1 else level.where("not up")
        out = out.unionByName(ended.drop("up", "fill", "node"))
    return out


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024,
                   end_id: int = 2, with_ids: bool = False, **sizes: int) -> DataFrame:
    """Every document's pieces and their places: (id, piece, start, length, ids_crc32, sequence_id, offset, ids if asked for).

    A document is the ids of its whole text by the ``tokenizers`` file, without special tokens, and then ``end_id``; null text
    counts as empty. One longer than ``size`` is cut into pieces of that length, the first of which may be shorter. The
    sequences are filled by ``pack_pieces``, to which ``sizes`` go: no two pieces overlap, and there is no gap from 0 on.
    Repeated rows and null ids are packed like any others. Other columns are not read. An empty table gives no rows.
    """
    pieces = scratch(document_pieces(docs, tokenizer_file, id_col, text_col, size, end_id, with_ids), "pieces")
    out = scratch(pack_pieces(pieces, size, **sizes).drop("row").withColumnRenamed("doc", id_col), "sequences")
    discard(pieces)
    return out
