"""Language ID by unigrams over the pieces of a public vocabulary, summed over all segmentations of a word of any length."""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Runs of letters; digits that \w has besides are told apart below.
LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes after which the sums are scaled anew, so that none underflows.
BLOCK = 48
#: Bytes of words, times languages, handled at a time; one word at least.
CELLS = 1 << 20
#: Text handled at a time in a worker.
CHUNK_CHARS = 1_000_000
#: Share of the bytes' uniform distribution in each language's pieces, so that every word has a probability.
FLOOR = 0.02
BASE = np.uint64(0x100000001B3)


class Pieces:
    """The pieces of a rank file that can stand in a word, and their look-up for many byte strings at once."""

    def __init__(self, rank_file: str):
        with open(rank_file, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f]
        self.pieces = [p for p in pieces if len(p) == 1 or self.in_word(p)]
        self.count, self.longest = len(self.pieces), max(map(len, self.pieces))
        self.hashes = np.zeros(self.count + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i, p in enumerate(self.pieces):
                h = np.uint64(0)
                for b in p:
                    h = h * BASE + np.uint64(b + 1)
                self.hashes[i] = h ^ np.uint64(len(p))
        self.powers = np.array([pow(int(BASE), m, 1 << 64) for m in range(self.longest + 1)], np.uint64)
        self.tables = []
        left = np.arange(self.count)
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            slots = self.slot(self.hashes[left], factor)
            _, first = np.unique(slots, return_index=True)
            table = np.full(1 << 20, self.count, np.int32)
            table[slots[first]] = left[first]
            self.tables.append((factor, table))
            left = np.delete(left, first)
            if not len(left):
                break
        assert not len(left), "pieces collide in every table"
        single = [i for i, p in enumerate(self.pieces) if len(p) == 1]
        self.uniform = np.zeros(self.count)
        self.uniform[single] = 1 / len(single)

    @staticmethod
    def in_word(piece: bytes) -> bool:
        try:
            text = piece.decode()
        except UnicodeDecodeError:  # part of a letter
            return True
        return text.removeprefix(" ").isalpha() and text == text.lower()

    @staticmethod
    def slot(hashes: np.ndarray, factor: int) -> np.ndarray:
        return (hashes * np.uint64(factor) >> np.uint64(44)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash; ``count`` where there is none."""
        found = None
        for factor, table in self.tables:
            at = table[self.slot(hashes, factor)]
            at[self.hashes[at] != hashes] = self.count
            found = at if found is None else np.minimum(found, at)
        return found

    def lattice(self, words: np.ndarray) -> list[np.ndarray]:
        """For words of one length as bytes [word, place]: by piece length m from 1, the pieces [word, start]."""
        n, size = words.shape
        x = words.astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n, size + 1), np.uint64)
        for t in range(size):
            prefix[:, t + 1] = prefix[:, t] * BASE + x[:, t]
        return [self.find((prefix[:, m:] - prefix[:, :size - m + 1] * self.powers[m]) ^ np.uint64(m))
                for m in range(1, min(size, self.longest) + 1)]


def forward(lattice: list[np.ndarray], p: np.ndarray, given: np.ndarray) -> np.ndarray:
    """alpha[t, word, language]: probability of the first t bytes over all their segmentations, from the ``given`` first ones on."""
    n, size = lattice[0].shape
    alpha = np.concatenate([given, np.zeros((size + 1 - len(given), n, p.shape[1]))])
    found = [(at < len(p) - 1).any(0) for at in lattice]
    for t in range(len(given), size + 1):
        for m in range(1, min(t, len(lattice)) + 1):
            if found[m - 1][t - m]:
                alpha[t] += alpha[t - m] * p[lattice[m - 1][:, t - m]]
    return alpha


def forward_blocks(pieces: Pieces, words: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of bytes its start, ``alpha`` after each of its bytes, and the log of what these are to be multiplied by.

    What goes from one block to the next is alpha after as many bytes as the longest piece has, so pieces across blocks count.
    """
    n, size = words.shape
    given, log = np.ones((1, n, p.shape[1])), np.zeros((n, p.shape[1]))
    for t in range(0, size, BLOCK):
        alpha = forward(pieces.lattice(words[:, t + 1 - len(given):t + BLOCK]), p, given)
        yield t, alpha[len(given):], log
        log = log + np.log(alpha[-1])
        given = alpha[-pieces.longest:] / alpha[-1]


def by_length(words: list[bytes], langs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the words and the words as bytes [word, place], by length, at most 4,000 at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
        size = int(sizes[same[0]])
        n = max(1, min(4_000, CELLS // (size * langs)))
        for i in range(0, len(same), n):
            at = same[i:i + n]
            yield at, np.frombuffer(b"".join([words[j] for j in at]), np.uint8).reshape(len(at), size)


def score_words(pieces: Pieces, words: list[bytes], p: np.ndarray) -> np.ndarray:
    """log probability [word, language]; ``p`` has a last row of 0 for no piece."""
    out = np.zeros((len(words), p.shape[1]))
    for at, group in by_length(words, p.shape[1]):
        for _, alpha, log in forward_blocks(pieces, group, p):
            last = log + np.log(alpha[-1])
        out[at] = last
    return out


def spelt(word: str) -> bytes:
    """A word as the vocabulary has it, with a blank before it."""
    return b" " + word.encode("utf-8", "replace")


def letter_runs(text: str) -> list[str]:
    """The runs of letters of the text, lower-cased."""
    runs = LETTERS.findall(text.lower())
    return runs if text.isascii() else [r for r in runs if r.isalpha() or any(map(str.isalpha, r))]


def fit(pieces: Pieces, counts: Counter, rounds: int) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over its word counts."""
    p = np.full(pieces.count, 1 / pieces.count)
    words, weight = [spelt(word) for word in counts], np.array(list(counts.values()), float)
    for _ in range(rounds):
        q = np.append((1 - FLOOR) * p + FLOOR * pieces.uniform, 0)[:, None]
        expected = np.zeros(pieces.count + 1)
        for at, group in by_length(words, 1):
            expected += expected_pieces(pieces, group, weight[at], q)
        p = expected[:-1] / max(expected[:-1].sum(), 1e-300)
    return (1 - FLOOR) * p + FLOOR * pieces.uniform


def expected_pieces(pieces: Pieces, words: np.ndarray, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words of one length that occur ``weight`` times, over all their segmentations."""
    n, size = words.shape
    expected, ahead = np.zeros(pieces.count + 1), np.zeros((size + 1, n))
    for t, alpha, log in forward_blocks(pieces, words, q):
        ahead[t + 1:t + 1 + len(alpha)] = np.log(alpha[:, :, 0]) + log[:, 0]
    given, log = np.ones((1, n)), np.zeros(n)
    for t in range((size - 1) // BLOCK * BLOCK, -1, -BLOCK):  # from the last block to the first
        width = min(BLOCK, size - t)
        lattice = pieces.lattice(words[:, t:t + width + len(given) - 1])
        found = [at < pieces.count for at in lattice]
        beta = np.concatenate([np.zeros((width, n)), given])
        for i in range(width - 1, -1, -1):
            for m in range(1, min(len(beta) - 1 - i, len(lattice)) + 1):
                if found[m - 1][:, i].any():
                    beta[i] += beta[i + m] * q[lattice[m - 1][:, i], 0]
        after = np.log(beta) + log - ahead[size]
        for m, at in enumerate(lattice, 1):
            word, i = np.nonzero(found[m - 1][:, :width])
            piece = at[word, i]
            mass = np.exp(ahead[t + i, word] + after[i + m, word]) * q[piece, 0] * weight[word]
            expected += np.bincount(piece, mass, pieces.count + 1)
        log = log + np.log(beta[0])
        given = beta[:pieces.longest] / beta[0]
    return expected


@lru_cache(maxsize=2)
def vocabulary(rank_file: str) -> Pieces:
    return Pieces(rank_file)


def train(docs: DataFrame, rank_file: str, text_col: str = "text", lang_col: str = "lang",
          sample_chars: int = 3_000_000, rounds: int = 4, max_langs: int = 200) -> dict[str, np.ndarray]:
    """Piece probabilities by language, from the labelled rows of ``docs``.

    Each language is fitted on its different whole texts in the order of a hash of the text, at least one, until they have
    ``sample_chars`` characters or more; copies count once, and ids have no part in it. So the fit is one task per language over that many characters and at most the rest of one text. The model
    has one float per piece and language, at most ``max_langs`` of them. Rows with null label, or with a text that is null or has no
    letters, teach nothing.
    """
    labelled = docs.select(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col(f"`{text_col}`")), 1).alias("h"),
                           F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")) \
        .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # bands of hashes, each as wide as all before it together, tell roughly where the sample ends
    band, size = F.length(F.bin("h")), F.char_length("text").cast("long")
    texts = labelled.groupBy("lang", "h").agg(F.max(size).alias("n"))  # copies once, as a hash and a length
    chars = texts.groupBy("lang", band.alias("band")).agg(F.sum("n").alias("n")) \
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("band", "n"))).alias("bands")).limit(max_langs + 1).collect()
    if len(chars) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not chars:
        return {}
    end, before = F.lit(None).cast("int"), F.lit(0).cast("long")
    for row in chars:
        so_far = 0
        for b, n in row["bands"]:
            if so_far + n >= sample_chars:
                end = F.when(F.col("lang") == row["lang"], F.lit(b)).otherwise(end)
                before = F.when(F.col("lang") == row["lang"], F.lit(so_far).cast("long")).otherwise(before)
                break
            so_far += n
    # in the band of the end, hashes and lengths only
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    ends = texts.where(band == end).select("lang", "h", "n", before.alias("before")) \
        .withColumn("before", F.col("before") + F.coalesce(upto, F.lit(0))) \
        .where((F.col("before") < sample_chars) | (F.col("before") == 0)).groupBy("lang").agg(F.max("h").alias("h")).collect()
    last = F.lit((1 << 63) - 1)
    for row in ends:
        last = F.when(F.col("lang") == row["lang"], F.lit(row["h"]).cast("long")).otherwise(last)
    drawn = F.col("h") <= last

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for text in frame["text"]:
            counts.update(letter_runs(text))
        p = fit(vocabulary(rank_file), counts, rounds)
        return pd.DataFrame({"lang": [key[0]], "p": [p.astype("<f4").tobytes()], "words": [len(counts)]})

    fitted = labelled.where(drawn).dropDuplicates(["lang", "h"]).select("lang", "text").groupBy("lang").applyInPandas(one, "lang string, p binary, words long").collect()
    model = {r["lang"]: np.frombuffer(r["p"], "<f4").astype(float) for r in sorted(fitted) if r["words"]}
    if missing := sorted({r["lang"] for r in chars} - set(model)):
        raise ValueError(f"languages without a model: {missing}")
    return model


def predict(docs: DataFrame, model: dict[str, np.ndarray], rank_file: str, text_col: str = "text",
            lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with ``lang_out`` and ``score_out`` for each whole text; the text is the only input.

    The score is the probability of the language given the text among those learned, all equally likely
    before. A text that is null or has no letters, and any text under an empty model, is ``und`` with score 0. Equal
    scores go to the first language by code point. No shuffle; other columns pass through, but for columns of the
    two new names, which are replaced.
    """
    kept = [c for c in docs.columns if c not in (lang_out, score_out)]
    rest = F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col] or [F.lit(0).alias("none")])
    given = docs.select(rest.alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text"))  # the text goes there and back once
    schema = given.withColumns({"lang": F.lit(""), "score": F.lit(0.0)}).schema
    langs = sorted(model)
    table = np.append(np.stack([model[x] for x in langs], 1), np.zeros((1, len(langs))), 0) if langs else None
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        sizes, flat = [], []
        for text in texts:
            runs = letter_runs(text) if text else []
            sizes.append(len(runs))
            flat.append(np.fromiter(map(index.__getitem__, runs), np.int64, len(runs)))
        if shared.value is None or not index:
            return ["und"] * len(texts), [0.0] * len(texts)
        of_word = score_words(vocabulary(rank_file), [spelt(word) for word in index], shared.value)
        names, scores = [], []
        for n, at in zip(sizes, flat):
            if not n:
                names.append("und")
                scores.append(0.0)
                continue
            total = of_word[at].sum(0)
            best = int(total.argmax())
            names.append(langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, chunk, chars = [], [], [], 0
            for x in batch.column(1):
                text = x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else None
                chunk.append(text)
                chars += len(text or "")
                if chars >= CHUNK_CHARS:
                    for out, new in zip((names, scores), judge(chunk)):
                        out += new
                    chunk, chars = [], 0
            for out, new in zip((names, scores), judge(chunk)):
                out += new
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    told = given.mapInArrow(run, schema)
    columns = [F.col("text").cast("string").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept]
    return told.select(*columns, F.col("lang").alias(lang_out), F.col("score").alias(score_out))


def held_out(id_col: str = "doc_id"):
    """The documents that teach nothing: those where crc32 of the id as text leaves 2 by 4; a null id does teach."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with lang_pred and score, by a model of its own labelled rows that aren't held out."""
    model = train(docs.where(~held_out(id_col)), rank_file, text_col, lang_col)
    return predict(docs, model, rank_file, text_col)
