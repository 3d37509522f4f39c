import numpy as np
import pytest
from pyspark.sql import types as T

from tickloom.llm.whitening import deviations, whitened

SHAPE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.IntegerType()), T.StructField("component", T.StringType()), T.StructField("h1", T.IntegerType())])
ODD = [(9_000, None), (9_001, [float("nan")] * 6), (9_002, [float("inf"), *[0.0] * 5]), (9_003, [None, *[1.0] * 5])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SHAPE)


def some_rows():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(400, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.2]) + 1).astype(np.float32)
    x[100:250] = x[0]
    x[5] = -0.0
    return [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.5] * 6), (7, x[7].tolist()), (8, [1.5, -2.5])]


def truth(rows, counts):
    whole = [(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in [*v, *[0.0] * (6 - len(v))])) for i, v in rows]
    kinds = sorted({x for _, x in whole})
    w = np.array([sum(x == k for _, x in whole) if counts else 1 for k in kinds])
    m = np.array(kinds, np.int64)
    n, sums = int(w.sum()), (m * w[:, None]).sum(0)
    centred = m - sums / n
    cov = (centred * w[:, None]).T @ centred / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    return whole, n, sums, e, axes, np.trace(cov)


@pytest.mark.parametrize("counts", [False, True])
def test_against_plain_numpy(spark, counts):
    rows = some_rows()
    got = whitened(frame(spark, [*rows, *ODD]).repartition(5), counts=counts)
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    got = got.collect()
    whole, n, sums, e, axes, trace = truth(rows, counts)
    assert len(got) == 4 * len(rows)
    key = lambda i: -1 if i is None else i
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c in range(4):
        mine = sorted(by[c + 1], key=lambda r: (key(r.vec_id), r.deviation))
        expect = sorted(((key(i), sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)), (np.array(x) - sums / n) @ axes[:, c] / np.sqrt(e[c])) for i, x in whole), key=lambda t: t[:2])
        assert [(key(r.vec_id), r.deviation) for r in mine] == [t[:2] for t in expect]
        z = np.array([r.whitened for r in mine])
        t = np.array([t[2] for t in expect])
        assert min(abs(z - t).max(), abs(z + t).max()) < 1e-8
        assert all(r.n == n and abs(r.explained - e[c] / trace) < 1e-9 and r.identity_error < 1e-9 for r in mine)


def test_components_without_variance(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(10)]
    got = whitened(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1} and len(got) == 10 and got[0].explained == pytest.approx(1.0)
    assert whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitened(frame(spark, ODD)).count() == 0
    assert whitened(frame(spark, [])).count() == 0
    assert whitened(frame(spark, [(1, [])])).count() == 0


def test_deviations_are_exact():
    x = np.array([[3_000_000, -5], [0, 7]], np.int64)
    assert deviations(x, 500, [3, -4]) == [(500 * a - 3) ** 2 + (500 * b + 4) ** 2 for a, b in x.tolist()]
    wide = np.array([[2_900_000, 1]], np.int64)
    assert deviations(wide, 1000, [1, 2]) == [(1000 * 2_900_000 - 1) ** 2 + 998**2]
