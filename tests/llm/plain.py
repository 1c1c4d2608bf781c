"""The contracts in plain Python, for small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import tiktoken

LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def encoding(rank_file, pattern):
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k=5):
    words = WORDS.findall((text or "").translate(LOWER))
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard_groups(docs):
    """{id: (n_shingles, component)} of (id, text) rows."""
    sets = {d: shingles(t) for d, t in docs}
    holders, common = defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for ids in holders.values():
        common.update(combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), i in common.items() if 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i)]
    group = components(sets, links)
    return {d: (len(s), group[d]) for d, s in sets.items()}


def vector_groups(rows, least):
    """{id: (n_links, component, kept)} of (id, vector) rows."""
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, float)
            x = x / np.abs(x).max()
            good[i] = x / np.sqrt((x * x).sum())
    links = [(a, b) for a, b in combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    n = Counter(x for pair in links for x in pair)
    group = components([i for i, _ in rows], links)
    return {i: (n[i], group[i], group[i] == i) for i, _ in rows}


def line_dedup(docs, least=10):
    """{id: (n_lines, n_dropped, kept text)} of (id, text) rows."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def targets(sizes, weights=(1, 2, 3), epochs=3):
    """{source: target}; reshares what is above the limit until nothing is."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest, free = total - sum(stopped.values()), [s for s in order if s not in stopped]
        share = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > epochs * sizes[s]]
        if not above:
            return share | stopped
        stopped |= {s: float(epochs * sizes[s]) for s in above}


def mix(docs, seed="mix", epochs=3):
    """{id: copies} of (id, text, source) rows."""
    size = {d: len(WORDS.findall(t or "")) for d, t, _ in docs}
    sizes = Counter()
    for d, _, s in docs:
        sizes[s] += size[d]
    target, queue = targets(sizes), defaultdict(list)
    for d, _, s in docs:
        if size[d]:
            queue[s].append((hashlib.md5(f"{seed}{d}".encode()).hexdigest(), d))
    copies = []
    for s, docs_of in queue.items():
        upto = 0
        for epoch in range(epochs):
            for key, d in sorted(docs_of):
                upto += size[d]
                copies.append((upto / target[s], (s is not None, s or ""), key, d, epoch))
    taken, spent = Counter(), 0
    for _, _, _, d, _ in sorted(copies):
        if spent + size[d] > sum(sizes.values()):
            break
        spent += size[d]
        taken[d] += 1
    return {d: taken[d] for d, _, _ in docs}


def segment_sums(word, p):
    """log of the sums over all segmentations of each beginning and each end of a word; ``p`` by piece."""
    size, longest = len(word), max(map(len, p))
    ahead, behind = [0.0] + [-math.inf] * size, [-math.inf] * size + [0.0]
    for t in range(1, size + 1):
        parts = [ahead[s] + math.log(p[word[s:t]]) for s in range(max(0, t - longest), t) if p.get(word[s:t])]
        ahead[t] = max(parts) + math.log(sum(math.exp(x - max(parts)) for x in parts))
    for s in range(size - 1, -1, -1):
        parts = [behind[t] + math.log(p[word[s:t]]) for t in range(s + 1, min(size, s + longest) + 1) if p.get(word[s:t])]
        behind[s] = max(parts) + math.log(sum(math.exp(x - max(parts)) for x in parts))
    return ahead, behind


def languages(rows, pieces, floor, rounds=4):
    """doc_id: (held_out, language, score) of rows (doc_id, text, lang), where the sample takes all texts."""
    def words(text):
        return [b" " + w.encode() for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(map(str.isalpha, w))]

    def held(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2

    single = [x for x in pieces if len(x) == 1]

    def floored(p):
        return {x: (1 - floor) * p.get(x, 0.0) + (floor / len(single) if len(x) == 1 else 0.0) for x in pieces}

    model = {}
    for lang in sorted({lang for doc, text, lang in rows if lang is not None and words(text) and not held(doc)}):
        counts = Counter(w for text in {text for doc, text, x in rows if x == lang and not held(doc)} for w in words(text))
        p = dict.fromkeys(pieces, 1 / len(pieces))
        for _ in range(rounds):
            q, expected = floored(p), Counter()
            for word, n in counts.items():
                ahead, behind = segment_sums(word, q)
                for s in range(len(word)):
                    for t in range(s + 1, len(word) + 1):
                        if q.get(word[s:t]):
                            expected[word[s:t]] += n * q[word[s:t]] * math.exp(ahead[s] + behind[t] - ahead[-1])
            total = sum(expected.values())
            p = {x: n / total for x, n in expected.items()}
        model[lang] = floored(p)
    out = {}
    for doc, text, _ in rows:
        logs = {lang: sum(segment_sums(w, p)[0][-1] for w in words(text)) for lang, p in model.items()}
        if not model or not words(text):
            out[doc] = (held(doc), "und", 0.0)
            continue
        best = max(logs, key=logs.get)  # the first of equals, in order of code points
        out[doc] = (held(doc), best, 1 / sum(math.exp(x - logs[best]) for x in logs.values()))
    return out
