"""Hard negatives of anchor vectors by exact integer scores, multiplied in residues modulo small primes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablework.llm.common import clear_names, discard, scratch, shuffle_partitions

#: Components multiplied at a time. With residues up to half a prime p, a sum of so many products is at most 64 ((p - 1) / 2)^2,
#: which is below 2^24, where single precision is exact, for every prime below 1024.
COMPONENTS = 64
LARGEST = 1023
#: Components beyond this count as not finite.
LARGEST_COMPONENT = 1e200
#: Vector components that a task holds of one block of rows and of one block of anchors.
BLOCK_VALUES = 1 << 20
#: Anchors whose scores with a block are held at a time.
TILE = 64


@lru_cache(maxsize=1)
def primes() -> list[int]:
    """The primes up to ``LARGEST``, largest first, without 2."""
    return [p for p in range(LARGEST, 2, -1) if all(p % d for d in range(2, int(p ** 0.5) + 1))]


def moduli(bound: int) -> list[int]:
    """The fewest of the largest primes whose product tells all integers from -bound to bound apart."""
    product = 1
    for k, p in enumerate(primes()):
        if product > 2 * bound:
            return primes()[:k]
        product *= p
    raise ValueError("scores are too large for the primes below 1024")


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Integers in double precision modulo ``p``, nearest to zero, in single precision."""
    r = np.fmod(x, p)
    half = (p - 1) // 2
    r[r > half] -= p
    r[r < -half] += p
    return r.astype(np.float32)


def _nearest(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` (integers below 2^24 in single precision) modulo ``p``, nearest to zero; in place."""
    x -= np.float32(p) * np.rint(x * np.float32(1 / p))
    half = np.float32((p - 1) // 2)
    np.subtract(x, np.float32(p), out=x, where=x > half)
    np.add(x, np.float32(p), out=x, where=x < -half)
    return x


class Block:
    """Vectors of integers and their residues modulo each prime asked for so far."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.most = int(np.abs(values).max()) if values.size else 0
        self.by_prime: dict[int, np.ndarray] = {}

    def modulo(self, p: int) -> np.ndarray:
        if p not in self.by_prime:
            self.by_prime[p] = residues(self.values, p)
        return self.by_prime[p]


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p``, nearest to zero. Each partial product is exact in single precision."""
    total = None
    for at in range(0, a.shape[1], COMPONENTS):
        part = _nearest(a[:, at:at + COMPONENTS] @ b[:, at:at + COMPONENTS].T, p)
        total = part if total is None else _nearest(total + part, p)
    return np.zeros((len(a), len(b)), np.float32) if total is None else total


def exact_scores(a: Block, rows: slice, b: Block, columns: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Inner products of rows of ``a`` with those of ``b``: exact, as int64, or as Python integers where they may not fit.

    One product in single precision for each prime, put together by mixed radix: the digit of each prime is what is left of
    its residue after the digits before, divided by their primes, all modulo the prime and nearest to zero. So the digits
    are those of the one integer within half the product of the primes around zero, sign included.
    """
    bound = a.values.shape[1] * a.most * b.most
    used = moduli(bound)
    wide = bound >= 1 << 62
    digits: list[np.ndarray] = []
    for k, p in enumerate(used):
        digit = product_modulo(a.modulo(p)[rows], b.modulo(p)[columns], p)
        for before, q in zip(digits, used[:k]):
            inverse = pow(q, -1, p)
            inverse -= p if inverse > p // 2 else 0
            digit = _nearest((digit - before) * np.float32(inverse), p)
        digits.append(digit)
    n = b.values[columns].shape[0]
    if not digits:
        return np.zeros((len(range(*rows.indices(len(a.values)))), n), np.int64)
    kind = object if wide else np.int64
    total = digits[-1].astype(np.int64).astype(kind)
    for digit, p in zip(digits[-2::-1], used[-2::-1]):
        total = total * p + digit.astype(np.int64).astype(kind)
    return total


def _columns(table: pa.Table) -> tuple[Block, np.ndarray, np.ndarray]:
    """Scaled whole-number vectors, ids and labels; all vectors of one call have one length."""
    vectors = table.column("vector").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = np.asarray(vectors.flatten(), np.float64)
    scaled = np.floor(table.column("scale")[0].as_py() * flat).reshape(len(table), -1)
    return Block(scaled), table.column("id").to_numpy(), table.column("label").to_numpy()


def _by_id(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable")))


def _keys(scores: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of the scores of rows sorted by id: a smaller key is a higher score or, at the same, a smaller id."""
    if scores.dtype != object and (not scores.size or int(np.abs(scores).max()) < (1 << 61) // max(n, 1)):
        return -scores * n + np.arange(n)
    return -scores.astype(object) * n + np.arange(n).astype(object)


def _positives(count: int):
    def run(key: tuple[pa.Scalar, ...], anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """The ``count`` best rows of each anchor's label, by label, in this block."""
        out: list[tuple] = []
        if len(anchors) and len(rows):
            rows = _by_id(rows)
            a, a_ids, a_labels = _columns(anchors)
            b, b_ids, b_labels = _columns(rows)
            names = anchors.column("anchor").to_pylist()
            order = np.argsort(a_labels, kind="stable")
            a = Block(a.values[order])
            by_label = np.argsort(b_labels, kind="stable")
            sorted_labels = b_labels[by_label]
            values, starts = np.unique(a_labels[order], return_index=True)
            for label, start, end in zip(values, starts, [*starts[1:], len(order)]):
                same = by_label[np.searchsorted(sorted_labels, label):np.searchsorted(sorted_labels, label, "right")]
                if not len(same):
                    continue
                ids = b_ids[same]
                for at in range(start, end, TILE):
                    tile = slice(at, min(at + TILE, end))
                    scores = exact_scores(a, tile, b, same)
                    keys = _keys(scores, len(same))
                    for k, anchor in enumerate(order[tile]):
                        own = np.flatnonzero(ids != a_ids[anchor])
                        mine = keys[k][own]
                        if mine.dtype != object and len(mine) > 4 * count:
                            best = own[np.argpartition(mine, count)[:count]]
                        else:
                            best = own[np.argsort(mine)[:count]]
                        out += [(names[anchor], int(scores[k, i]), int(ids[i])) for i in best]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.string()), pa.array([str(s) for s in columns[1]], pa.string()), pa.array(columns[2], pa.int64())],
                        ["anchor", "score", "positive_id"])
    return run


def _negatives(count: int, low: int, high: int):
    def run(key: tuple[pa.Scalar, ...], anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """For each anchor and positive, the ``count`` best rows of other labels within the positive's window, in this block."""
        out: list[tuple] = []
        if len(anchors) and len(rows):
            rows = _by_id(rows)
            a, _, a_labels = _columns(anchors)
            b, ids, labels = _columns(rows)
            names, windows = anchors.column("anchor").to_pylist(), anchors.column("windows").to_pylist()
            for at in range(0, len(anchors), TILE):
                tile = slice(at, min(at + TILE, len(anchors)))
                scores = exact_scores(a, tile, b)
                for k, anchor in enumerate(range(at, tile.stop)):
                    tops = [int(w["score"]) for w in windows[anchor]]
                    lows = [-(-low * top // high) for top in tops]  # the least whole score with low * top <= high * score
                    mine = scores[k]
                    some = np.flatnonzero((labels != a_labels[anchor]) & (mine >= min(lows)) & (mine <= max(tops)))
                    if not len(some):
                        continue
                    some = some[np.argsort(-mine[some], kind="stable")]  # by score, then by id, as the rows are sorted
                    falling = -mine[some]
                    for w, top, least in zip(windows[anchor], tops, lows):
                        first = int(np.searchsorted(falling, -top))
                        for i in some[first:first + count]:
                            if mine[i] < least:
                                break
                            out.append((names[anchor], w["no"], str(int(mine[i])), int(ids[i])))
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()),
                         pa.array(columns[3], pa.int64())], ["anchor", "no", "score", "negative_id"])
    return run


def hard_negatives(rows: DataFrame, anchors: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: float = 256.0, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
                   block_values: int = BLOCK_VALUES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): negatives nearly as near as a positive.

    A vector is taken as the whole numbers floor(scale * x) of its components; a row's score is its inner product with the
    anchor, exactly. ``anchors`` is a condition on the columns of ``rows``. Higher scores come first, ties by smaller id. An anchor's
    positives are its first ``n_positives`` other rows of its label; for each, the first ``n_negatives`` rows of other
    labels with low * positive_score <= high * negative_score <= high * positive_score, ranked from 1.

    Anchors and rows are dealt into blocks of at most about ``block_values`` components, and each block of anchors meets each block
    of rows in one task, once for the positives and once for the negatives, whose windows the positives set. A task multiplies
    the residues modulo a few primes below 1024 in single precision and puts the scores together from them; only the best of each
    block are shuffled. How blocks are dealt doesn't depend on labels, so a hot label is no hot task.

    Rows without an id or label, without a vector, or with a null or non-finite component (or one beyond 1e200) take no part. Vectors of different
    lengths have no score with each other. Repeated rows count each as rows; a row of the anchor's own id is never its
    positive; anchors alike in id, label and vector are one anchor. A table without anchors gives no rows. A score beyond a
    long is found and ordered exactly and comes out as null. Other columns are not read but in the condition.
    """
    spark = rows.sparkSession
    is_anchor = F.expr(anchors) if isinstance(anchors, str) else anchors
    finite = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST_COMPONENT))
    taken = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull() & finite)
    given = taken.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                         F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("chosen"),
                         F.lit(float(scale)).alias("scale")).withColumn("length", F.size("vector"))
    size = given.agg(F.count(F.lit(1)), F.sum(F.col("chosen").cast("long")), F.max("length")).first()
    n, n_anchors, longest = size[0], size[1] or 0, max(size[2] or 1, 1)
    height = max(block_values // longest, 1)
    a_blocks = -(-max(n_anchors, 1) // height)
    r_blocks = max(-(-max(n, 1) // height), min(-(-shuffle_partitions(spark) // a_blocks), -(-max(n, 1) // 512)))
    where = ["length", "a_block", "r_block"]

    picked = clear_names(given.where("chosen"), "id", "label", "vector", "scale", "length").dropDuplicates(["id", "label", "vector"])
    picked = picked.withColumn("anchor", F.concat_ws(":", F.col("id").cast("string"), F.col("label").cast("string"),
                                                     F.xxhash64("vector").cast("string"), F.hash("vector").cast("string")))
    a_side = picked.withColumn("a_block", F.pmod(F.xxhash64("anchor"), F.lit(a_blocks)).cast("int"))
    r_side = given.drop("chosen").withColumn("r_block", F.pmod(F.xxhash64("id", F.lit("row"), "vector"), F.lit(r_blocks)).cast("int")) \
        .withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1))))

    r_side = r_side.toDF(*r_side.columns)  # columns of its own: both sides come from one table

    def over_blocks(df: DataFrame) -> DataFrame:
        return df.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))))

    # scores of any size as decimal text: the longer positive one is the larger, and the other way round below zero
    below = F.col("score").startswith("-")
    best_first = [F.desc(F.when(below, -F.char_length("score")).otherwise(F.char_length("score"))),
                  F.desc(F.when(below, F.translate("score", "0123456789", "9876543210")).otherwise(F.col("score"))), F.asc("id")]
    found = over_blocks(a_side).groupBy(*where).cogroup(r_side.groupBy(*where)) \
        .applyInArrow(_positives(n_positives), "anchor string, score string, positive_id long")
    positives = scratch(found.select("anchor", "score", F.col("positive_id").alias("id")).withColumn(
        "no", F.row_number().over(Window.partitionBy("anchor").orderBy(*best_first))).where(F.col("no") <= n_positives), "positives")
    windows = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(
        F.struct("no", "score"))).alias("windows"))
    found = over_blocks(a_side.join(windows, "anchor")).groupBy(*where).cogroup(r_side.groupBy(*where)) \
        .applyInArrow(_negatives(n_negatives, low, high), "anchor string, no int, score string, negative_id long")
    negatives = scratch(found.select("anchor", "no", "score", F.col("negative_id").alias("id")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("anchor", "no").orderBy(*best_first))).where(F.col("rank") <= n_negatives), "negatives")
    out = scratch(negatives.alias("n").join(positives.alias("p"), ["anchor", "no"]).select(
        F.split("anchor", ":")[0].cast("long").alias("anchor_id"), F.col("p.id").alias("positive_id"), "rank",
        F.col("n.id").alias("negative_id"), F.expr("try_cast(p.score as long)").alias("positive_score"),
        F.expr("try_cast(n.score as long)").alias("negative_score")), "hard-negatives")
    discard(positives)
    discard(negatives)
    return out
