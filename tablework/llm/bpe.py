"""Byte-level BPE ids of texts, and the bytes they stand for."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this are encoded in parts.
PART_CHARS = 1 << 16

#: White space as the pattern has it, in runs too long for the pattern's look-ahead.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % PART_CHARS)


class Encoder:
    """Ids as ``tiktoken.Encoding.encode_ordinary`` gives them, for texts of any length.

    No alternative of the split pattern runs from a character that isn't white space into white space, and
    none looks back. So a cut before a blank that follows such a character is always a boundary: the ids
    of a text are those of its parts, one after the other. Texts go to the library whole, long ones in parts that end
    at such boundaries; nothing is kept from one text to the next.

    A run of white space of two or more is one match up to its last character, which goes with what follows, and the whole
    run at the end of a text. Runs of ``PART_CHARS`` and more are cut out by that rule and their bytes merged without the
    pattern, so they may be of any length.
    """

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tiktoken = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.n_vocab = max(ranks.values()) + 1

    def parts(self, text: str) -> Iterator[str]:
        """Consecutive parts of a long text, cut at boundaries of the pattern where there are any."""
        start, size = 0, len(text)
        while size - start > PART_CHARS:
            cut = text.rfind(" ", start + 1, start + PART_CHARS)
            while cut > start and text[cut - 1].isspace():
                cut = text.rfind(" ", start + 1, cut)
            if cut <= start:  # none behind: the next one ahead
                cut = start + PART_CHARS
                while (cut := text.find(" ", cut)) >= 0 and text[cut - 1].isspace():
                    cut += 1
                if cut < 0:
                    break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text, "<u4"), "<u4").tolist()

    def encode_bytes(self, text: str, dtype: str) -> bytes:
        """The ids as little-endian integers, one after the other."""
        if len(text) < PART_CHARS or not LONG_SPACE.search(text):
            return self._without_long_space(text, dtype)
        out, start = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            out.append(self._without_long_space(text[start:run.start()], dtype))
            out.append(np.array(self.tiktoken._encode_single_piece(text[run.start():end]), dtype).tobytes())
            start = end
        return b"".join([*out, self._without_long_space(text[start:], dtype)])

    def _without_long_space(self, text: str, dtype: str) -> bytes:
        return b"".join([np.array(self.tiktoken.encode_ordinary(part), dtype).tobytes() for part in self.parts(text)])

    def decode(self, ids: list[int]) -> bytes:
        return self.tiktoken.decode_bytes(ids)


def text_of(x: pa.Scalar) -> str:
    """A text from its bytes; null is empty, and bytes that aren't UTF-8 are U+FFFD."""
    return x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else ""


def id_lists(raw: list[bytes]) -> pa.Array:
    """An array of lists of int32 from the ids of each row as bytes."""
    ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the column ``out``, the ids of the whole text as array<int>; null text counts as empty.

    The rank file is read from a path that exists on every executor. No shuffle, and one batch of rows
    in memory at a time. Bytes that aren't UTF-8 are read as U+FFFD. Runs of white space may be of any length. Other columns
    pass through untouched, except one named ``out``, which is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    schema = given.select("row").withColumn("new", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for batch in batches:
            ids = id_lists([enc.encode_bytes(text_of(x), "<i4") for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["row", "new"])

    return given.mapInArrow(run, schema).select("row.*", F.col("new").alias(out))


def decode(docs: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """``docs`` with ``out``, the raw bytes that ``ids_col`` stands for; null ids give null."""
    kept = [c for c in docs.columns if c != out]
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{ids_col}`").alias("ids"))
    schema = given.select("row").withColumn("new", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for batch in batches:
            raw = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["row", "new"])

    return given.mapInArrow(run, schema).select("row.*", F.col("new").alias(out))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids again: id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    ``ids_sha256`` is the digest of the decimal ids joined by one blank, ``decoded_sha256`` that of the decoded
    bytes; both in lower-case hex. Null text counts as empty. One row out for each row in, repeated ones too.
    Other columns are not read. No shuffle; a worker holds one batch of rows.
    """
    given = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("binary").alias("_bytes"))
    made = {"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}
    if with_ids:
        made["ids"] = F.lit(None).cast("array<int>")
    schema = given.select(id_col).withColumns(made).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for x in batch.column(1):
                raw = enc.encode_bytes(text_of(x), "<i4")
                ids = np.frombuffer(raw, "<i4").tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(raw)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, id_lists(kept)] if with_ids else columns, schema.names)

    return given.mapInArrow(run, schema)
