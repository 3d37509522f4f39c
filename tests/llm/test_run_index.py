import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tickloom.llm.run_index import RunIndex, cut_repeats, repeat_digest


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if counts[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(x) else 0
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(30)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]
    passage = " ".join(rng.choices(words, k=30))
    for _ in range(n):
        t = rng.choice(base)
        k = rng.randrange(len(t) + 1)
        base.append(rng.choice([t, t[:k] + "X" + t[k:], t[:k] + passage + t[k:], passage[3:] + t, t + t]))
    return [*base, None, "", "a" * 500, "ab" * 300, "é" * 41]


@pytest.mark.parametrize(("seed", "length", "anchor", "variants"), [(1, 24, 8, 4096), (2, 40, 16, 4096), (3, 24, 8, 2)])
def test_against_brute_force(docs_of, seed, length, anchor, variants):
    texts = corpus(seed)
    found = {r.doc_id: tuple(r)[1:] for r in repeat_digest(docs_of(texts), length, anchor, variants).collect()}
    assert found == dict(enumerate(brute(texts, length)))


def test_index_is_run_compressed_and_gives_longest_matches():
    parts = [b"abracadabra" * 20, b"xabracadabray", b"abracadabra" * 19 + b"q"]
    index = RunIndex(parts)
    assert len(index.runs) < sum(map(len, parts)) / 5 and index.runs.sum() == sum(map(len, parts)) + 3
    best = index.matches()
    for a, (start, part) in enumerate(zip(index.starts, parts)):
        for i in range(len(part)):
            longest = 0
            for b, other in enumerate(parts):
                for j in range(len(other)):
                    if (a, i) != (b, j):
                        k = 0
                        while i + k < len(part) and j + k < len(other) and part[i + k] == other[j + k]:
                            k += 1
                        longest = max(longest, k)
            assert best[start + i] == longest


def test_repeated_rows_missing_numbers_and_other_columns(docs_of):
    long = "one two three four five six seven"
    rows = [(1, long), (1, long), (None, "unlike the rest of all these"), (None, "x" + long), (3, "short"), (4, None)]
    docs = docs_of(rows, ["1 as d", "2 as rest", "'q' as key", "lang as seg"])
    out = cut_repeats(docs, 20, 8)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, ""), (1, ""), (None, "unlike the rest of all these"), (None, "x"), (3, "short"), (4, "")], key=str)


def test_empty_table(docs_of):
    assert repeat_digest(docs_of([]), 20, 8).count() == 0
