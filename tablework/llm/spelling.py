"""Words one edit apart, by composing a vocabulary acceptor with a one-edit transducer and itself, and their usual forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablework.llm.common import ascii_lower, discard, scratch

#: Letters of a run: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of one initial state that a task composes at most; where there are more, the state is split.
STATE_WORDS = 50_000
#: Letters by which a state with too many words is split at a time.
SPLIT_LETTERS = 4


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2,
                change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): maximal runs of letters of whole texts, A-Z in lower case, and how often each occurs.

    ``change(id, run)`` may turn a run into another word; the id is passed as text, null as the empty text. Words of fewer
    than ``least_length`` code points or ``least_count`` occurrences go. A change must not lengthen a run. Null and empty
    texts have no runs, and repeated rows count each. Other columns are not read.
    """
    given = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                        ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"))
    runs = given.select("id", F.explode_outer(F.regexp_extract_all("text", F.lit(rf"[{LETTERS}]{{{least_length},}}+"), F.lit(0))).alias("run")) \
        .where("run is not null")
    word = change(F.col("id"), F.col("run")) if change else F.col("run")
    return runs.select(word.alias("word")).where(F.char_length("word") >= least_length) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def shared_length(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    n = min(len(a), len(b))
    for i in range(min(n, 32)):
        if a[i] != b[i]:
            return i
    low, high = min(n, 32), n
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words, with the states that neither branch nor accept merged into edges.

    States are numbered children first. A state is (accepts, edges by first letter); an edge is (label, state, offset), the
    offset being the place of its first word among the sorted words accepted from the edge's source. So each path adds up to
    its word's number, and there are at most two states a word however long the words are.
    """

    def __init__(self, words: list[str]):
        self.accepts: list[bool] = []
        self.edges: list[dict[str, tuple[str, int, int]]] = []
        self.count: list[int] = []
        self.nearest_end: list[int] = []  # letters of the shortest word that goes on from here, none left out
        known: dict[tuple, int] = {}

        def state(accepts: bool, out: list[tuple[str, int]]) -> int:
            key = (accepts, *out)
            at = known.get(key)
            if at is None:
                at = known[key] = len(self.count)
                edges, offset, near = {}, int(accepts), 1 << 60
                for label, to in out:
                    edges[label[0]] = (label, to, offset)
                    offset += self.count[to]
                    near = min(near, len(label) + (0 if self.accepts[to] else self.nearest_end[to]))
                self.accepts.append(accepts)
                self.edges.append(edges)
                self.count.append(offset)
                self.nearest_end.append(near)
            return at

        open_states: list[tuple[int, bool, list[tuple[str, int]]]] = [(0, False, [])]
        before = ""

        def close(down_to: int) -> None:
            while open_states[-1][0] > down_to:
                depth, accepts, out = open_states.pop()
                to = state(accepts, out)
                if open_states[-1][0] < down_to:
                    open_states.append((down_to, False, []))
                open_states[-1][2].append((before[open_states[-1][0]:depth], to))

        for word in words:
            close(shared_length(before, word))
            open_states.append((len(word), True, []))
            before = word
        close(0)
        self.first = state(*open_states[0][1:])

    def common(self, rest_a: str, a: int, i: int, rest_b: str, b: int, j: int, out: list[tuple[int, int, int]]) -> None:
        """Intersect ``rest_a`` and what ``a`` accepts with ``rest_b`` and what ``b`` accepts.

        Adds (i, j, n) to ``out``: the words numbered i, i+1, ... n in all on the one side are those from j on the other.
        """
        accepts, edges, todo = self.accepts, self.edges, [(rest_a, a, i, rest_b, b, j)]
        while todo:
            rest_a, a, i, rest_b, b, j = todo.pop()
            if rest_a and rest_b:
                if rest_a == rest_b:
                    rest_a = rest_b = ""
                elif rest_a.startswith(rest_b):
                    rest_a, rest_b = rest_a[len(rest_b):], ""
                elif rest_b.startswith(rest_a):
                    rest_a, rest_b = "", rest_b[len(rest_a):]
                else:
                    continue
            if rest_a:
                edge = edges[b].get(rest_a[0])
                if edge:
                    todo.append((rest_a, a, i, edge[0], edge[1], j + edge[2]))
            elif rest_b:
                edge = edges[a].get(rest_b[0])
                if edge:
                    todo.append((edge[0], edge[1], i + edge[2], rest_b, b, j))
            elif a == b:
                out.append((i, j, self.count[a]))
            else:
                if accepts[a] and accepts[b]:
                    out.append((i, j, 1))
                ea, eb = edges[a], edges[b]
                for c in ea.keys() & eb.keys():
                    (la, to_a, at_a), (lb, to_b, at_b) = ea[c], eb[c]
                    todo.append((la, to_a, i + at_a, lb, to_b, j + at_b))

    def edited_at(self, q: int, most_left: int | None) -> list[tuple[int, int, int]]:
        """Pairs of words from state ``q`` that the transducer takes to each other with its one edit right at ``q``.

        With ``most_left``, only edges over which a word ends within so many letters are looked at.
        """
        edges, out = self.edges[q], []
        given = [e for e in edges.values()
                 if most_left is None or len(e[0]) + (0 if self.accepts[e[1]] else self.nearest_end[e[1]]) <= most_left]
        # one letter for another: both ways go on alike; edges of longer labels can only meet if their second letters do
        by_second: dict[str, list[tuple[str, int, int]]] = {}
        short = []
        for e in given:
            if len(e[0]) > 1:
                by_second.setdefault(e[0][1], []).append(e)
            else:
                short.append(e)
        for k, (_, a, i) in enumerate(short):
            for _, b, j in short[k + 1:]:
                self.common("", a, i, "", b, j, out)
            for second, others in by_second.items():
                edge = self.edges[a].get(second)
                if edge:
                    for label, b, j in others:
                        self.common(edge[0], edge[1], i + edge[2], label[1:], b, j, out)
        for alike in by_second.values():
            for k, (la, a, i) in enumerate(alike):
                for lb, b, j in alike[k + 1:]:
                    self.common(la[1:], a, i, lb[1:], b, j, out)
        # a letter more on one side, the last of its run, so that each pair is met once
        for label, a, i in given:
            rest = label[1:]
            if rest:
                edge = edges.get(rest[0]) if rest[0] != label else None
                if edge and rest[0] != label[0]:
                    self.common(rest, a, i, *edge, out)
            else:
                if self.accepts[a] and self.accepts[q]:
                    out.append((i, 0, 1))
                for c, (la, to_a, at_a) in self.edges[a].items():
                    edge = edges.get(c) if c != label else None
                    if edge:
                        self.common(la, to_a, i + at_a, *edge, out)
        return out

    def pairs(self, most_left: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of each pair one edit apart, each pair once in one order or the other.

        With ``most_left`` at least those pairs whose edit is that many letters or fewer before the end.
        """
        none = np.zeros(0, np.int64)
        left, right = [none], [none]
        ways: list[list[np.ndarray] | None] = [None] * len(self.count)
        ways[self.first] = [np.zeros(1, np.int64)]
        for q in range(self.first, -1, -1):
            edges = self.edges[q]
            if not edges:
                ways[q] = None
                continue
            parts = ways[q]
            starts = parts[0] if len(parts) == 1 else np.concatenate(parts)
            ways[q] = None
            for _, to, offset in edges.values():
                if self.edges[to]:
                    if ways[to] is None:
                        ways[to] = []
                    ways[to].append(starts + offset)
            if (len(edges) == 1 and not self.accepts[q]) or (most_left is not None and self.nearest_end[q] > most_left):
                continue
            found = self.edited_at(q, most_left)
            if found:
                i, j, n = np.array(found, np.int64).T
                if (n > 1).any():
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    i, j = np.repeat(i, n) + step, np.repeat(j, n) + step
                left.append(np.add.outer(starts, i).ravel())
                right.append(np.add.outer(starts, j).ravel())
        return np.concatenate(left), np.concatenate(right)


def neighbours(words: list[str], n: np.ndarray, backward: bool, first_letters: int) -> tuple[np.ndarray, np.ndarray]:
    """How many near words each of the sorted ``words`` has, and which of them is the most frequent (-1: none).

    Backward words are spelt from their ends; there only pairs that differ in the ``first_letters`` of their proper spelling count.
    """
    i, j = Acceptor(words).pairs(first_letters if backward else None)
    proper = [w[::-1] for w in words] if backward else words
    if backward:
        beginnings: dict[str, int] = {}
        code = np.array([beginnings.setdefault(w[:first_letters], len(beginnings)) for w in proper])
        apart = code[i] != code[j]
        i, j = i[apart], j[apart]
        order = np.array(sorted(range(len(words)), key=proper.__getitem__))
    else:
        order = np.arange(len(words))
    order = order[np.argsort(-n[order], kind="stable")]
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words), np.int64)
    np.minimum.at(best, i, rank[j])
    np.minimum.at(best, j, rank[i])
    count = np.bincount(i, minlength=len(words)) + np.bincount(j, minlength=len(words))
    return count, np.where(count > 0, order[np.minimum(best, len(words) - 1)], -1)


def _compose(first_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by direction, state and spelling; one state's words are held at a time."""
        at, words, counts = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(words) < 2:
                return
            near, best = neighbours(words, np.array(counts, np.int64), at[0], first_letters)
            some = np.flatnonzero(near)
            if len(some):
                spelt = [w[::-1] for w in words] if at[0] else words
                yield pa.RecordBatch.from_arrays(
                    [pa.array([spelt[k] for k in some]), pa.array(near[some]), pa.array([-counts[k] for k in best[some]], pa.int64()),
                     pa.array([spelt[k] for k in best[some]])], ["word", "near", "minus_n", "best"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(4)]
            for back, key, word, n in zip(*columns):
                if (back, key) != at:
                    yield from done()
                    at, words, counts = (back, key), [], []
                words.append(word)
                counts.append(n)
        yield from done()
    return run


def _split_at(crowded: DataFrame, depth: int, first_letters: int) -> DataFrame:
    """Partial results for the words of crowded states that part at ``depth``, the edit being right there.

    They are the words that are alike once the letter there is left out: as many as there are letters at most, and the word
    without one. So these groups are small whatever the state holds.
    """
    w = F.col("w")
    rest = F.substring("w", depth + 1, 1 << 30)
    own = crowded.select("back", "key", F.substring("w", 1, depth).alias("x"), rest.alias("s"), F.lit("").alias("c"), "w", "n")
    less = crowded.where(F.char_length(w) > depth).select(
        "back", "key", F.substring("w", 1, depth).alias("x"), F.substring("w", depth + 2, 1 << 30).alias("s"),
        F.substring("w", depth + 1, 1).alias("c"), "w", "n")
    groups = own.where(F.char_length(w) >= depth).unionByName(less).groupBy("back", "key", "x", "s") \
        .agg(F.collect_list(F.struct("w", "n", "c")).alias("all")).where("size(all) > 1")
    member = groups.select("back", F.substring("s", 1, 1).alias("next"), F.explode("all").alias("m"), "all")
    spelt = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(c)
    start = lambda c: F.substring(spelt(c), 1, first_letters)
    near = member.withColumn("near", F.filter("all", lambda o: (o["w"] != F.col("m.w"))
                                              & ((o["c"] != "") | (F.col("m.c") != F.col("next")))
                                              & ((F.col("m.c") != "") | (o["c"] != F.col("next")))
                                              & (~F.col("back") | (start(o["w"]) != start(F.col("m.w"))))))
    best = F.array_min(F.transform("near", lambda o: F.struct((-o["n"]).alias("minus_n"), spelt(o["w"]).alias("best"))))
    return near.where("size(near) > 0").select(spelt(F.col("m.w")).alias("word"), F.size("near").cast("long").alias("near"),
                                               best["minus_n"].alias("minus_n"), best["best"].alias("best"))


def near_counts(words: DataFrame, least_length: int = 7, state_words: int = STATE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a near word: how many, and the most frequent (ties: the smallest).

    ``words`` has distinct (word, n), of ``least_length`` code points or more. Two words are near if one inserted, deleted or
    replaced code point takes the one to the other.

    The acceptor of all words is taken apart by the state it is in after the first letters (3, fewer if words are short): each such state is an
    acceptor of its own, minimised and composed with the transducer and itself in one task. Pairs whose edit is among the
    first letters have their last ones in common and are found alike among the words spelt backward. Each pair is accepted once.
    A state with over ``state_words`` words is split at its next letters; what is edited between is put together by
    grouping. So a task holds a bounded number of words, and no two words are compared that share neither beginning nor end.
    """
    letters = max(1, min(3, least_length // 2))
    both = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("back")) \
        .select("back", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("w"), "n")
    rest, settled, parts, depth = both.withColumn("key", F.substring("w", 1, letters)), [], [], letters
    used = []
    while True:
        crowded = rest.groupBy("back", "key").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > state_words).select("back", "key")
        crowded = scratch(crowded, "crowded-states")
        used.append(crowded)
        if crowded.isEmpty():
            settled.append(rest)
            break
        settled.append(rest.join(crowded, ["back", "key"], "left_anti"))
        rest = scratch(rest.join(crowded, ["back", "key"], "left_semi"), "crowded-words")
        used.append(rest)
        parts += [_split_at(rest, d, letters) for d in range(depth, depth + SPLIT_LETTERS)]
        depth += SPLIT_LETTERS
        rest = rest.where(F.char_length("w") >= depth).withColumn("key", F.substring("w", 1, depth))
    schema = "word string, near long, minus_n long, best string"
    laid = settled[0].select("back", "key", "w", "n")
    for more in settled[1:]:
        laid = laid.unionByName(more.select("back", "key", "w", "n"))
    found = laid.repartition("back", "key").sortWithinPartitions("back", "key", "w").mapInArrow(_compose(letters), schema)
    for part in parts:
        found = found.unionByName(part)
    out = scratch(found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus_n", "best")).alias("b"))
                  .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus_n")).alias("best_n")), "near-words")
    for table in used:
        discard(table)
    return out


def usual_forms(words: DataFrame, ratio: int = 10, least_length: int = 7, state_words: int = STATE_WORDS) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of distinct (word, n).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that n is ``ratio`` times the word's or
    more, else null; ``root`` is where the forms lead, the word itself without one; ``n_near`` counts the near words. No words
    give no rows. Other columns are not read. Forms are followed by doubling, so a chain of m forms takes log2(m) rounds.
    """
    words = scratch(words.select("word", "n"), "words")
    near = near_counts(words, least_length, state_words)
    usual = F.col("best_n") >= ratio * F.col("n")
    known = scratch(words.join(near, "word", "left").select(
        "word", "n", F.when(usual, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(usual, F.col("best_n")).alias("form_n")), "word-forms")
    discard(near)
    discard(words)
    roots = scratch(known.where("form is not null").select("word", F.col("form").alias("root")), "word-roots")
    while True:
        further = scratch(roots.alias("a").join(roots.select(F.col("word").alias("root"), F.col("root").alias("on")), "root", "left")
                          .select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "word-roots")
        discard(roots)
        roots = further
        if roots.where("moved").isEmpty():
            break
    return known.join(roots.select("word", "root"), "word", "left") \
        .select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def drop_one_letter(doc_id: Column, run: Column) -> Column:
    """``run`` without a letter where 31 divides the CRC-32 of ``<id>:<run>``, which says the place too; ``run`` itself elsewhere."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(31)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)
