"""Sets of word n-grams as sorted 64-bit hashes, made for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes handled at a time; a longer text goes in parts that end at white space.
CHUNK = 1 << 20
#: Longer words are hashed byte by byte with a mixing hash, one at a time: numbers modulo 2**64 as used below are the same for
#: some pairs of words from about a thousand bytes on (Thue-Morse words), which 64 bytes are far from.
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    known, factor = 1, base  # the first ``known`` powers are there; ``factor`` is the next
    while known < n:
        out[known:2 * known] = out[:min(known, n - known)] * np.uint64(factor)
        known, factor = 2 * known, factor * factor % (1 << 64)
    return out


_UP, _DOWN = (_powers(b, CHUNK + 1) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of at most ``CHUNK`` bytes: the word's bytes as digits of a number, scrambled."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[:len(raw)], out=upto[1:])
    h = mixed((upto[end] - upto[start]) * _DOWN[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]])
    return start, h


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text of any length, in order."""
    out, at = [], 0
    while len(data) - at > CHUNK:
        gaps = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, CHUNK, at)])
        if len(gaps):
            cut = at + int(gaps[-1]) + 1
            out.append(_words(data[at:cut])[1])
        else:  # one word
            cut = at + CHUNK
            while cut < len(data) and not _SPACE[data[cut]]:
                cut += 1
            out.append(np.array([xxhash.xxh3_64_intdigest(data[at:cut])], np.uint64))
        at = cut
    out.append(_words(data[at:])[1])
    return np.concatenate(out)


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        total = total * _STEP + h[i:i + len(total)]
    return mixed(total + np.uint64(size))


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def _sets(words: list[np.ndarray], flat: np.ndarray, size: int) -> Iterator[np.ndarray]:
    runs = _runs(flat, size) if len(flat) >= size else flat[:0]
    at = 0
    for h in words:
        n = len(h)
        yield distinct(runs[at:at + n - size + 1]) if n >= size else _runs(h, n) if n else h
        at += n


def shingle_sets(texts: Iterable[bytes | None], size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct runs of ``size`` words, A-Z in lower case.

    A text of fewer words has its whole sequence as the one run; a text without words, or null, has none. Words
    are what white space (the blank, U+0009 to U+000D) separates. Two different runs share a hash with
    odds of about one to 2**64; words made to collide are not ruled out.
    """
    waiting: list[bytes] = []
    length = 0

    def done() -> Iterator[np.ndarray]:
        start, h = _words(b"\n".join(waiting))
        cuts = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in waiting)]))
        yield from _sets([h[a:b] for a, b in zip(cuts, cuts[1:])], h, size)

    for text in texts:
        text = (text or b"").translate(LOWER)
        if length + len(text) + 1 > CHUNK and waiting:
            yield from done()
            waiting, length = [], 0
        if len(text) >= CHUNK:
            h = word_hashes(text)
            yield from _sets([h], h, size)
            continue
        waiting.append(text)
        length += len(text) + 1
    if waiting:
        yield from done()
