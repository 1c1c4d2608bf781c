"""Documents whose sets of word n-grams are alike by Jaccard, and the groups they form.

The join is exact for any input: rarity is only used to order the n-grams, and any order shared by all documents is right.

1. One pass takes each document's set, its size and a digest of the set, and counts how many documents have
   each n-gram, in a table of fixed size indexed by hash (``SKETCH_BITS``). Documents of one digest are one node.
2. A second pass orders each set by (count, hash), rare first, and emits its prefix. Two sets of sizes a <= b
   can only reach the threshold if one of the first a - ceil(6a/7) + 1 of the smaller is among the first
   b - ceil(3b/4) + 1 of the larger (figures for 3/4).
3. N-grams that one prefix alone has are dropped. In ``ROUNDS`` rounds every node is compared with one node of another
   component, the one that it meets at most n-grams of those drawn there, and the links found make components.
   Then all pairs that share a prefix n-gram, pass the length and positional filters and are still in different
   components are compared, each once. Only components are asked for, so pairs inside one need no comparison;
   that keeps a group of a million near copies from a million million of them.
4. A pair is compared with whole sets: a bound from the sizes of the parts of both sets (suffix filter), then the exact count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import boxed, components, discard, scratch, shuffle_partitions
from tablework.llm.shingles import shingle_sets

#: The table of n-gram counts has 2**SKETCH_BITS numbers, 4 MB, whatever the input. At N n-grams in all, those of
#: more than about 6 * sqrt(N / 2**SKETCH_BITS) documents stand out from the noise and are ordered last.
SKETCH_BITS = 20
BLOCK = 4096
#: Rounds of one comparison a node before the rest is compared pair by pair.
ROUNDS = 2


class Threshold:
    """Jaccard of ``num / den`` or more, in whole numbers."""

    def __init__(self, num: int = 3, den: int = 4):
        self.num, self.den = num, den

    def overlap(self, both):
        """Least intersection of two sets of ``both`` elements together: ceil(num * both / (num + den))."""
        return (both * self.num + self.num + self.den - 1) // (self.num + self.den)

    def probe(self, n: int) -> int:
        return n - -(-n * self.num // self.den) + 1

    def overlap_sql(self, both: str) -> str:
        return f"(({both}) * {self.num} + {self.num + self.den - 1}) div {self.num + self.den}"

    def indexed_sql(self, n: str, pos: str) -> str:
        """Is the position within the prefix that suffices where the other set is as large or larger?"""
        return f"{pos} <= {n} - ({2 * self.num}L * {n} + {self.num + self.den - 1}) div {self.num + self.den}"


def with_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def sets_of(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    return shingle_sets((x.as_buffer().to_pybytes() if x.is_valid else None for x in batch.column(1)), words)


def digest(items: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(items.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def profiles(texts: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """A table with (id, n, d1, d2) of each row where ``block`` is null, and the table of counts."""
    schema = texts.select("id").withColumns({c: F.lit(None).cast(t) for c, t in (
        ("n", "long"), ("d1", "long"), ("d2", "long"), ("block", "int"), ("counts", "binary"))}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(1 << SKETCH_BITS, np.uint32), None
        for batch in batches:
            kind = batch.schema.field(0).type
            n, d1, d2, waiting, size = [], [], [], [], 0
            for items in sets_of(batch, words):
                a, b = digest(items)
                n.append(len(items))
                d1.append(a)
                d2.append(b)
                waiting.append(items)
                size += len(items)
                if size > 1 << 20:
                    tally(counts, waiting)
                    waiting, size = [], 0
            tally(counts, waiting)
            rows = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                                              pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], schema.names)
        if kind is not None:
            full = [i for i in range(0, len(counts), BLOCK) if counts[i:i + BLOCK].any()]
            none = [pa.nulls(len(full), t) for t in (kind, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([i // BLOCK for i in full], pa.int32()),
                                              pa.array([counts[i:i + BLOCK].astype("<u4").tobytes() for i in full], pa.binary())], schema.names)

    both = scratch(texts.mapInArrow(run, schema), "shingle-profiles")
    table = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in summed(both.where("block is not null").select("block", "counts")).collect():
        table[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], "<u4")
    return both, table


def tally(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64),
                              minlength=len(counts)).astype(np.uint32)


def summed(blocks: DataFrame) -> DataFrame:
    """One row per block with the sums; a task holds the blocks of its partition only, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(block, np.zeros(BLOCK, np.uint64))
                own += np.frombuffer(raw.as_buffer(), "<u4")
        top = np.uint64((1 << 32) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(
            [np.minimum(x, top).astype("<u4").tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    return blocks.repartition(shuffle_partitions(blocks.sparkSession), "block").mapInArrow(run, "block int, counts binary")


def prefixes(texts: DataFrame, table: np.ndarray, words: int, at: Threshold) -> DataFrame:
    """(h, id, n, pos): the prefix of each set, rare first; a set met again in the task is left out."""
    schema = texts.select(F.lit(0).cast("long").alias("h"), "id", F.lit(0).alias("n"), F.lit(0).alias("pos")).schema
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            rows, hashes, sizes, places = [], [], [], []
            for i, items in enumerate(sets_of(batch, words)):
                n = len(items)
                if not n or (key := digest(items)) in seen:
                    continue
                seen.add(key)
                count = counts[(items >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.lexsort((items, count))[:at.probe(n)]
                pos = np.flatnonzero(count[first] > 1)  # what one document alone has meets nothing
                hashes.append(items[first[pos]])
                rows.append(np.full(len(pos), i))
                sizes.append(np.full(len(pos), n, np.int32))
                places.append(pos.astype(np.int32))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(rows))),
                     pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], schema.names)

    return texts.where("id is not null").mapInArrow(run, schema)


def similar(pairs: DataFrame, sets: DataFrame, at: Threshold) -> DataFrame:
    """Those of ``pairs(a, b)`` that reach the threshold, by the whole sets."""
    kind = dict(pairs.dtypes)["a"]

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        least = at.overlap(len(x) + len(y))
        if min(len(x), len(y)) < least:
            return False
        # suffix filter: what two sets share lies in equal parts of the range of hashes
        parts = np.arange(1, 64, dtype=np.uint64) << np.uint64(58)
        sizes = [np.diff(np.searchsorted(s, parts), prepend=0, append=len(s)) for s in (x, y)]
        if np.minimum(*sizes).sum() < least:
            return False
        return len(np.intersect1d(x, y, assume_unique=True)) >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            same = [alike(np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")) for p, q in zip(x, y)]
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    left, right = (sets.select(F.col("id").alias(c), F.col("items").alias(f"{c}_items")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_items", "b_items").mapInArrow(run, f"a {kind}, b {kind}")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    A document's set has its distinct runs of ``words`` words (A-Z in lower case, see ``shingle_set``). Two documents link
    when the intersection is ``num / den`` of the union or more; ``component_id`` is the smallest id that links
    reach, the own included. Documents without words, null texts among them, link with nothing. Rows of
    equal id are one document. Rows of null id link with nothing and have a null component. Other columns are not read.
    """
    at = Threshold(num, den)
    texts = with_text(docs, id_col, text_col)
    both, table = profiles(texts, words)
    rows = both.where("block is null").select("id", "n", "d1", "d2")
    groups = scratch(rows.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "shingle-groups")
    rep = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")
    nodes = scratch(rows.join(groups, ["d1", "d2", "n"], "left").select("id", "n", rep), "shingle-nodes")
    discard(both)
    discard(groups)

    entries = scratch_shared(prefixes(texts, table, words, at), nodes)
    sets = set_table(texts, entries, words)
    mixed, links, tried = scratch(entries.withColumn("component", F.col("id")), "shingle-mixed"), None, None
    discard(entries)
    for turn in range(ROUNDS):
        pairs = drawn_pairs(mixed, turn, den / num)
        new = scratch(similar(pairs, sets, at), "shingle-links")
        links, tried = (new, pairs) if links is None else (links.unionByName(new), tried.unionByName(pairs))
        mixed = still_mixed(mixed, components(links))
    more = scratch(similar(all_pairs(mixed, at).join(tried, ["a", "b"], "left_anti"), sets, at), "shingle-links")
    discard(mixed)
    discard(sets)
    every = components(links.unionByName(more))

    return nodes.join(every.select(F.col("node").alias("rep"), "component"), "rep", "left") \
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def drawn_pairs(mixed: DataFrame, turn: int, band: float) -> DataFrame:
    """(a, b), a < b: for each node one node of another component, of those drawn the one met at most prefix n-grams.

    For each n-gram and band of sizes one node is drawn, so the pairs are as many as the nodes at most. In the first
    turn it is the node that has the n-gram earliest, that is with the fewest rarer ones: among near copies the one
    with the fewest changes of its own, to which most others are close. Later turns draw at random among such.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / math.log(band)).cast("int")
    banded = mixed.select("h", "id", "component", size.alias("band"), "pos")
    early = F.struct(F.col("pos").cast("double").alias("at"), F.lit(0).cast("long").alias("draw")) if turn == 0 else \
        F.struct(F.floor(F.log2(F.col("pos") + 1.0)).cast("double").alias("at"), F.xxhash64("id", F.lit(turn)).alias("draw"))
    draw = F.struct(early.alias("early"), F.col("id").alias("a"), F.col("component").alias("other"))
    leads = scratch(banded.groupBy("h", "band").agg(F.min(draw).alias("lead")).select("h", "band", "lead.a", "lead.other"), "shingle-leads")
    met = banded.join(leads, ["h", "band"]).where("component != other").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    best = met.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("best")).select("best.a", "b")
    out = scratch(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "shingle-drawn")
    discard(leads)
    return out


def still_mixed(mixed: DataFrame, found: DataFrame) -> DataFrame:
    """The entries under their new components, but for n-grams that only one component has now."""
    label = scratch(mixed.drop("component").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
                    .withColumn("component", F.coalesce("component", "id")), "shingle-labels")
    discard(mixed)
    several = scratch(label.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                      .where("low != high").select("h"), "shingle-several")
    out = scratch(label.join(several, "h"), "shingle-mixed")
    discard(label)
    discard(several)
    return out


def all_pairs(mixed: DataFrame, at: Threshold) -> DataFrame:
    """(a, b), a < b: nodes of different components that share a prefix n-gram and pass the length and positional filters.

    Nodes of the largest component of an n-gram aren't paired with each other, so none of them is looked at twice.
    """
    sizes = mixed.groupBy("h", "component").agg(F.count("*").alias("c")).groupBy("h") \
        .agg(F.max(F.struct("c", "component")).alias("most")).select("h", F.col("most.component").alias("major"))
    marked = scratch(mixed.join(sizes, "h"), "shingle-marked")
    one, two = marked.where("component != major").alias("x"), marked.alias("y")
    smaller = "(x.n < y.n or (x.n = y.n and x.id < y.id))"
    out = one.join(two, F.expr(
        f"x.h = y.h and x.component != y.component and (y.component = y.major or {smaller}) "
        f"and least(x.n, y.n) * {at.den}L >= greatest(x.n, y.n) * {at.num}L "
        f"and ({smaller} and {at.indexed_sql('x.n', 'x.pos')} or not {smaller} and {at.indexed_sql('y.n', 'y.pos')}) "
        f"and least(x.n - x.pos, y.n - y.pos) >= {at.overlap_sql('x.n + y.n')}")) \
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    out = scratch(out, "shingle-pairs")
    discard(marked)
    return out


def scratch_shared(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The entries whose n-gram two nodes at least have, by node; written down."""
    entries = entries.withColumn("place", F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).drop("n", "pos")
    laid = scratch(entries, "shingle-prefixes")
    twice = laid.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    by_node = laid.join(twice, "h").join(nodes.groupBy("id").agg(F.min("rep").alias("rep")), "id") \
        .select("h", F.col("rep").alias("id"), "place").distinct()
    by_node = scratch(by_node, "shingle-repeated")
    discard(laid)
    still = by_node.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    out = scratch(by_node.join(still, "h").select("h", "id", F.shiftright("place", 32).cast("int").alias("n"),
                                                 F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos")), "shingle-entries")
    discard(by_node)
    return out


def set_table(texts: DataFrame, entries: DataFrame, words: int) -> DataFrame:
    """(id, items) of the nodes that have an entry; written down."""
    schema = texts.select("id", F.lit(b"").alias("items")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([s.astype("<u8").tobytes() for s in sets_of(batch, words)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), items], ["id", "items"])

    wanted = texts.join(entries.select("id").distinct(), "id", "left_semi")
    return scratch(wanted.mapInArrow(run, schema), "shingle-sets")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is their group's smallest; rows of null id stay."""
    gone = jaccard_groups(docs, id_col, text_col, words, num, den).where(F.col(f"`{id_col}`") != F.col("component_id")) \
        .select(F.col(f"`{id_col}`").alias("gone"))
    return boxed(docs, id=id_col).join(gone, F.expr("id = gone"), "left_anti").select("row.*")
