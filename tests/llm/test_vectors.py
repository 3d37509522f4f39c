import numpy as np
import pytest
from pyspark.sql import types as T

from tickloom.llm.multi_index import nearest, recall, visits
from tickloom.llm.pivot_join import top_products

SHAPE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("h1", T.IntegerType()), T.StructField("place", T.IntegerType())])
ODD = [(10_000, None), (10_100, [float("nan")] * 8), (10_200, [float("inf")] + [0.0] * 7), (10_300, [None] + [1.0] * 7), (None, [1.0] * 8)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    x = (centres[rng.integers(0, 6, 900)] + 0.4 * rng.normal(size=(900, 8))).astype(np.float32)
    x[300:600] = x[0]  # a third of all rows are one vector
    x[700] = 0
    return [(i, v.tolist()) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SHAPE)


def truth(rows, every, k, score, use):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and use(v)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, q in good:
        if i % every == 0:
            s = score(q, x)
            order = sorted((float(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != i)[:k]
            out[i] = [(r, v, d) for r, (d, v) in enumerate(order, 1)]
    return out


def gathered(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize(("pivots", "block"), [(64, 4096), (5, 40)])
def test_products_against_brute_force(spark, rows, pivots, block):
    found = gathered(top_products(frame(spark, rows + ODD), 5, 50, pivots, block))
    expect = truth(rows, 50, 5, lambda q, x: -(np.floor(256 * x) @ np.floor(256 * q)), lambda v: True)
    assert found == {q: [(r, v, -int(s)) for r, v, s in best] for q, best in expect.items()}


@pytest.mark.parametrize(("share", "block"), [(0.2, 2048), (0.2, 50), (1.0, 50)])
def test_nearest_against_brute_force(spark, rows, share, block):
    found = gathered(nearest(frame(spark, rows + ODD), 10, 25, share, 60, block=block))
    expect = truth(rows, 25, 10, lambda q, x: np.sqrt(((x - q) ** 2).sum(1)), any)
    assert found.keys() == expect.keys()
    hits = sum(len({v for _, v, _ in found[q]} & {v for _, v, _ in best}) for q, best in expect.items())
    assert hits >= (1 if share == 1 else 0.9) * 10 * len(expect)
    for q, best in found.items():
        assert [r for r, _, _ in best] == list(range(1, 11)) and [(s, v) for _, v, s in best] == sorted((s, v) for _, v, s in best)
        x, y = dict(rows)[q], dict(rows)
        assert all(abs(s - np.linalg.norm(np.array(y[v]) - np.array(x))) < 1e-9 for _, v, s in best)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "query_id long, vec_id long")
    assert recall(pairs.where("vec_id = 2"), pairs) == 0.5


def test_cells_are_visited_by_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(5)
    every = list(visits(a, b, np.ones((7, 5), int), 35))
    sums = [a[i] + b[j] for i, j in every]
    assert len(set(every)) == 35 and sums == sorted(sums) and len(list(visits(a, b, np.full((7, 5), 3), 10))) == 4


def test_few_rows(spark):
    for search in (nearest, top_products):
        assert search(frame(spark, [])).count() == 0
        assert search(frame(spark, [(0, [1.0, 2.0])])).count() == 0
        two = search(frame(spark, [(0, [1.0, 2.0]), (7, [1.0, 3.0, 1.0])])).collect()
        assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(0, 1, 7)]


@pytest.mark.parametrize(("distinct", "pivots"), [(5, 64), (5, 2), (1, 64)])
def test_few_distinct_vectors_with_many_copies(spark, distinct, pivots):
    x = np.random.default_rng(4).normal(size=(distinct, 8)).astype(np.float32)
    rows = [(i, x[i % distinct].tolist()) for i in range(40 * distinct)]
    found = gathered(top_products(frame(spark, rows), 5, 20, pivots))
    expect = truth(rows, 20, 5, lambda q, x: -(np.floor(256 * x) @ np.floor(256 * q)), lambda v: True)
    assert found == {q: [(r, v, -int(s)) for r, v, s in best] for q, best in expect.items()}
    found = gathered(nearest(frame(spark, rows), 10, 20))
    expect = truth(rows, 20, 10, lambda q, x: np.sqrt(((x - q) ** 2).sum(1)), any)
    assert found == expect
