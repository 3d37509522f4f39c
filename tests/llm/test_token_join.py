import random
import re

import numpy as np
import pytest

from tickloom import session
from tickloom.llm import token_join
from tickloom.llm.components import connected
from tickloom.llm.token_join import keys_of, linked_components


def brute(rows, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(5, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return sorted([(name, len(sets[i]), least.get(root(i)) if sets[i] else name) for i, (name, _) in enumerate(rows)], key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    passage = rng.choices(words, k=40)
    out = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([0, 1, 3, 6, 10, 20, 40, 120]))
        for _ in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 1))
            if rng.random() < 0.3:
                text += passage
            out.append(rng.choice([" ", "\n", "\t "]).join(text))
    group = rng.choices(words, k=60)
    for _ in range(40):
        text = list(group)
        text[rng.randrange(60)] = "odd"
        text[rng.randrange(60)] = "even"
        out.append(" ".join(text).upper())
    return [*enumerate(out), (900, None), (901, ""), (None, out[-1]), (None, "nobody else"), (5, out[5])]


@pytest.mark.parametrize(("seed", "least", "most", "tile"), [(1, 32, 1 << 20, 256), (2, 3, 1 << 20, 8), (3, 2, 50, 13)])
def test_against_brute_force(docs_of, seed, least, most, tile):
    rows = corpus(seed)
    docs = docs_of(rows, ["1 as key", "2 as node", "3 as component_id"])
    found = sorted((tuple(r) for r in linked_components(docs, least=least, most=most, tile=tile).collect()), key=str)
    assert found == brute(rows, 80)


def test_similar_sets_share_a_key_whatever_is_frequent():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(2, 90))
        a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
        b = a.copy()
        k = int(rng.integers(1, max(2, n // 8 + 1)))
        b[:k] = rng.choice(1 << 40, k).astype(np.uint64)
        b = b[: n - int(rng.integers(0, 2))]
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if a.tolist() == b.tolist() or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        either = np.union1d(a, b)
        frequent = np.sort(rng.choice(either, int(rng.integers(0, len(either) + 1)), replace=False))
        assert set(keys_of(a, frequent, 80).tolist()) & set(keys_of(b, frequent, 80).tolist())


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (1, 3), (3, 2), (2, 1)]
    found = dict(connected(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 3: 1}


def test_empty_table(docs_of):
    assert linked_components(docs_of([])).count() == 0


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 3, 4, 15, 16, 200, 300, 2000):
        base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        sets += [base, np.unique(np.append(base[n // 12 :], rng.integers(0, 1 << 64, n // 12 + 1, dtype=np.uint64)))]
    sets.append(np.arange(5000, dtype=np.uint64))  # all in one count, which is cut off
    sets.append(np.arange(4900, dtype=np.uint64))
    near = [{i for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 100 * len(np.intersect1d(x, y)) >= p * len(np.union1d(x, y))} for p in (80, 30)]
    for percent, expect in zip((80, 30), near):
        sketches = [token_join.sketch(x) for x in sets]
        assert all(token_join.most_shared(a, b) >= len(np.intersect1d(x, y)) for a, x in zip(sketches, sets) for b, y in zip(sketches, sets))
        hit = set(np.flatnonzero(token_join.may_link(sketches, [len(x) for x in sets], list(range(len(sets))), percent)).tolist())
        assert expect <= hit
    far = [np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64)) for _ in range(60)]
    assert not token_join.may_link([token_join.sketch(x) for x in far], [400] * 60, list(range(60)), 80).any()
    assert not token_join.may_link([token_join.sketch(sets[-4])] * 2, [2000] * 2, [7, 7], 80).any()


def test_only_texts_that_may_be_similar_travel(docs_of, tmp_path, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(rng.choices(words, k=12))
    texts = [" ".join([*rng.choices(words, k=30), passage, *rng.choices(words, k=30)]) for _ in range(150)]
    texts.append(texts[7] + " more")
    monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{rng.random()}")
    carried = []
    dropped = token_join.drop_written

    def drop(*tables):
        carried.extend(t.count() for t in tables if t.columns == ["node", "z"])
        dropped(*tables)

    monkeypatch.setattr(token_join, "drop_written", drop)
    rows = linked_components(docs_of(texts), 5, 80)
    assert sorted(map(tuple, rows.collect())) == sorted(brute([*enumerate(texts)], 80))
    assert len(carried) == 2 and sum(carried) <= 8
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} <= {"nodes", "edges", "links"}
