"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at a time.

Words are runs without ASCII white space, A-Z in lower case. A word's hash is a sum over its bytes,
a shingle's a sum over its words, so both are array operations on the bytes of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tickloom.llm.common import mix, payload

U = np.uint64
FACTOR = U(0x9E3779B97F4A7C15)
STEP = 1 << 19  # bytes hashed at a time
VALUES = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=U)
VALUES[65:91] = VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """Powers of an odd number, as many as the longest word so far has bytes."""

    def __init__(self):
        self.known = np.ones(1, U)

    def up_to(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, 256), U(0xD6E8FEB86659FD93))
            steps[0] = 1
            self.known = np.cumprod(steps)
        return self.known


POWERS = Powers()


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and where in them each text starts and the last one ends."""
    begins = np.zeros(len(raw) + 1, bool)
    begins[at] = True
    parts, starts, c = [], [], 0
    while c < len(raw):
        end = min(len(raw), c + STEP)
        while end < len(raw) and not SPACE[raw[end]] and not begins[end]:
            # a part ends at white space or where a text does
            more = np.flatnonzero(SPACE[raw[end : end + STEP]] | begins[end : min(end + STEP, len(raw))])
            end += int(more[0]) if len(more) else min(STEP, len(raw) - end)
        part = raw[c:end]
        black = ~SPACE[part]
        first = black.copy()
        first[1:] &= ~black[:-1] | begins[c + 1 : end]
        heads = np.flatnonzero(first)
        if len(heads):
            spots = np.flatnonzero(black)
            own = np.searchsorted(spots, heads)
            sizes = np.diff(np.append(own, len(spots)))
            places = np.arange(len(spots)) - np.repeat(own, sizes)
            terms = VALUES[part[spots]] * POWERS.up_to(int(sizes.max()))[places]
            parts.append(mix(np.add.reduceat(terms, own) + sizes.astype(U)))
            starts.append(heads + c)
        c = end
    if not parts:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    return np.concatenate(parts), np.searchsorted(np.concatenate(starts), at)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text; one of all its words if it has fewer than a shingle."""
    raw, at = payload(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + 4 * STEP, side="right")) - 1)
        hashes, edges = word_hashes(raw[at[first] : at[last]], at[first : last + 1] - at[first])
        whole = np.zeros(max(0, len(hashes) - words + 1), U)
        for j in range(words):
            whole = whole * FACTOR + hashes[j : j + len(whole)]
        whole = mix(whole + U(words))
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                total = U(0)
                with np.errstate(over="ignore"):
                    for h in hashes[a:b]:
                        total = total * FACTOR + h
                    yield mix(np.array([total + U(b - a)]))
            else:
                yield hashes[:0]
        first = last


def signature(shingles: np.ndarray) -> int:
    """64 bits that stand for the whole set, as a signed number."""
    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def same_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
