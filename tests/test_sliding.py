"""Trailing statistics and ranks against brute force, with slices and blocks narrow enough to be crossed."""

import math
import random
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from tickloom.operators.sliding import RowRank, Trailing, _Windows, row_frames_and_ranks, trailing_frames
from tickloom.operators.slices import RowFrame

DDL = "k string, t long, seq long, v double, up boolean"


def rows():
    rng = random.Random(11)
    out = []
    for seq in range(700):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        t = None if rng.random() < 0.02 else rng.randrange(-200, 400)
        out.append((key, t, seq, None if rng.random() < 0.2 else rng.choice([0.1, 2.0, 3.5, 1e6]), rng.choice([True, False, None])))
    return out


@pytest.mark.parametrize("width", [7, 30, 100_000])
def test_trailing_frames(spark, width):
    data = rows()
    frames = [
        Trailing("n", "count", 9), Trailing("ups", "count", 40, "up"), Trailing("s", "sum", 9, "v"), Trailing("far", "sum", 40, "v"),
        Trailing("d", "stddev", 25, "v"),
    ]
    df = trailing_frames(spark.createDataFrame(data, DDL), ["k"], "t", frames, width)
    got = {r["seq"]: r for r in df.collect()}
    assert len(got) == df.count() == len(data)

    def window(row, w):
        return [x for x in data if x[0] == row[0] and (x[1] is None if row[1] is None else x[1] is not None and row[1] - w < x[1] <= row[1])]

    def known(row, w):
        return [x[3] for x in window(row, w) if x[3] is not None]

    for row in data:
        r = got[row[2]]
        assert r["n"] == len(window(row, 9)) and r["ups"] == sum(x[4] is True for x in window(row, 40))
        for name, w in (("s", 9), ("far", 40)):
            v = known(row, w)
            assert r[name] is None if not v else math.isclose(r[name], sum(v), rel_tol=1e-12)
        v = known(row, 25)
        assert r["d"] is None if len(v) < 2 else math.isclose(r["d"], np.std(v, ddof=1), rel_tol=1e-9, abs_tol=1e-9)


def test_values_that_are_not_finite_stay_in_their_windows(spark):
    data = [("a", t, t, float("nan") if t == 5 else 1e300 if t == 20 else 1e-300, True) for t in range(60)]
    got = {r["t"]: r for r in trailing_frames(spark.createDataFrame(data, DDL), ["k"], "t", [Trailing("s", "sum", 4, "v"), Trailing("d", "stddev", 4, "v")]).collect()}
    for t in range(60):
        assert math.isnan(got[t]["s"]) == (5 <= t < 9)
        if t > 23:
            assert math.isclose(got[t]["s"], 4e-300) and got[t]["d"] < 1e-300


def test_groups_far_apart_and_no_rows(spark):
    data = [(k, t, i, 1.0, True) for i, (k, t) in enumerate((k, t) for k in "abcdef" for t in (-(1 << 60), 1 << 60))]
    got = trailing_frames(spark.createDataFrame(data, DDL), ["k"], "t", [Trailing("n", "count", 10)], 1 << 61).collect()
    assert [r["n"] for r in got] == [1] * 12
    assert trailing_frames(spark.createDataFrame([], DDL), ["k"], "t", [Trailing("n", "count", 10)]).count() == 0
    with pytest.raises(ValueError):
        trailing_frames(spark.createDataFrame([], DDL), ["k"], "t", [Trailing("n", "median", 10, "v")])


@pytest.mark.parametrize("block", [8, 50, 1 << 18])
def test_ranks_among_the_last_rows(spark, block):
    data = [x for x in rows() if x[1] is not None]
    out = row_frames_and_ranks(
        spark.createDataFrame(data, DDL), ["k"], ["t", "seq"], [RowFrame("ups", F.count_if("up"), 3)],
        [RowRank("smaller", "known", "v", 20)], 50, block,
    )
    got = {r["seq"]: (r["ups"], r["smaller"], r["known"]) for r in out.collect()}
    assert len(got) == len(data)
    for key in {x[0] for x in data}:
        mine = sorted((x for x in data if x[0] == key), key=lambda x: (x[1], x[2]))
        for i, x in enumerate(mine):
            ups = sum(y[4] is True for y in mine[i - 2 : i + 1]) if i >= 2 else None
            last = [y[3] for y in mine[i - 19 : i + 1] if y[3] is not None] if i >= 19 else None
            smaller = None if last is None or x[3] is None else sum(v < x[3] for v in last)
            assert got[x[2]] == (ups, smaller, None if last is None else len(last))


def test_cost_does_not_grow_with_the_window():
    t = np.arange(400_000)
    v = np.ones(len(t))

    def seconds(width):
        best = math.inf
        for _ in range(3):
            start = time.perf_counter()
            total = _Windows(t, width).total(v)
            best = min(best, time.perf_counter() - start)
        assert total[-1] == width
        return best

    assert seconds(10_000) < 3 * seconds(1_000) + 0.05
