"""Operators against brute force in pandas, with narrow slices so that borders are crossed."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators.asof import Lookup, asof_adaptive, asof_join
from tickloom.operators.combine import enrich, union_relaxed
from tickloom.operators.ewma import ewma
from tickloom.operators.gating import greedy_spaced
from tickloom.operators.intervals import forward_interval_min
from tickloom.operators.ranks import exact_quantiles, order_statistics, ordinal_rank, rank_bucket
from tickloom.operators.sampling import balanced_sample, change_events, uniform_cap
from tickloom.operators.slices import Frame, RowFrame, previous_values, range_frames, row_frames, with_position
from tickloom.operators.splits import chronological_split, walk_forward


@pytest.fixture(scope="module")
def ticks():
    rng = random.Random(7)
    rows = []
    for seq in range(600):
        # one hot key with half of all rows, ties in time, missing values, a null key
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        rows.append((key, rng.randrange(0, 400), seq, None if rng.random() < 0.2 else float(rng.randrange(50))))
    return pd.DataFrame(rows, columns=["k", "t", "seq", "v"])


def frame(spark, pdf):
    return spark.createDataFrame([tuple(None if x != x or x is None else x for x in r) for r in pdf.itertuples(index=False)], "k string, t long, seq long, v double")


def by_key(pdf):
    for _, g in pdf.groupby("k", dropna=False):
        yield g.sort_values(["t", "seq"])


def collected(df, *cols):
    return {r["seq"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_previous_values(spark, ticks):
    got = collected(previous_values(frame(spark, ticks), ["k"], ["t", "seq"], {"pt": "t"}, 25, flag="seen"), "pt", "seen")
    for g in by_key(ticks):
        before = [None, *g["t"].tolist()[:-1]]
        for seq, p in zip(g["seq"], before):
            assert got[seq] == (p, p is not None)


def test_range_frames(spark, ticks):
    df = range_frames(frame(spark, ticks), ["k"], "t", [Frame("n", F.count(F.lit(1)), -9, 0), Frame("ahead", F.max("v"), 5, 20)], 30)
    got = collected(df, "n", "ahead")
    for g in by_key(ticks):
        for r in g.itertuples():
            n = ((g["t"] >= r.t - 9) & (g["t"] <= r.t)).sum()
            ahead = g[(g["t"] >= r.t + 5) & (g["t"] <= r.t + 20)]["v"].max()
            assert got[r.seq] == (n, None if math.isnan(ahead) else ahead)


def test_positions_and_row_frames(spark, ticks):
    df = frame(spark, ticks)
    got = collected(with_position(df, ["k"], ["t", "seq"], "p", 20), "p")
    sums = collected(row_frames(df, ["k"], ["t", "seq"], [RowFrame("s", F.sum("v"), 7)], 20, block_rows=16), "s")
    for g in by_key(ticks):
        want = g["v"].fillna(0).rolling(7).sum()
        for i, (seq, w) in enumerate(zip(g["seq"], want)):
            assert got[seq] == (i + 1,)
            s = sums[seq][0]
            assert (s is None) == math.isnan(w) or (s is None and w == 0)
            if s is not None:
                assert math.isclose(s, w)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("by", [["k"], []])
def test_asof(spark, ticks, direction, by):
    left, right = ticks[ticks.seq % 3 != 0], ticks[ticks.seq % 3 == 0]
    out = asof_join(frame(spark, left), frame(spark, right), "t", "t", {"m": "seq"}, 6, by, direction, seq="seq", bucket_width=10)
    assert out.count() == len(left)
    got = collected(out, "m")
    for r in left.itertuples():
        pool = right if not by else right[right.k == r.k] if isinstance(r.k, str) else right[:0]
        if direction == "backward":
            near = pool[(pool.t <= r.t) & (pool.t >= r.t - 6)].sort_values(["t", "seq"])
            want = near["seq"].iloc[-1] if len(near) else None
        else:
            near = pool[(pool.t >= r.t) & (pool.t <= r.t + 6)].sort_values(["t", "seq"])
            want = near["seq"].iloc[0] if len(near) else None
        assert got[r.seq] == (want,)


def test_asof_rejects_other_directions(spark, ticks):
    df = frame(spark, ticks)
    with pytest.raises(ValueError):
        asof_join(df, df, "t", "t", ["v"], 1, direction="nearest")


def test_interval_min(spark, ticks):
    left, right = ticks[ticks.seq % 2 == 0], ticks[ticks.seq % 2 == 1]
    out = forward_interval_min(frame(spark, left), frame(spark, right), "k", "k", "t", "t", ["seq"], "v", 4, 30, "low", "at")
    got = collected(out, "low", "at")
    for r in left.itertuples():
        pool = right[(right.k == r.k) & (right.t >= r.t + 4) & (right.t <= r.t + 30)].dropna(subset=["v"]) if isinstance(r.k, str) else right[:0]
        if len(pool):
            low = pool["v"].min()
            assert got[r.seq] == (low, pool[pool.v == low]["t"].max())
        else:
            assert got[r.seq] == (None, None)


def test_ewma_equals_pandas_over_many_chunks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    x[rng.random(3000) < 0.3] = np.nan
    df = spark.createDataFrame([("a", i, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "k string, t long, seq long, v double")
    got = collected(ewma(df, ["k"], ["t", "seq"], ["v"], {"fast": 5, "slow": 20}, 100), "v_ewma_fast", "v_ewma_slow")
    s = pd.Series(x)
    fast, slow = s.ewm(span=5, ignore_na=True).mean(), s.ewm(span=20, ignore_na=True).mean()
    for i in range(3000):
        if np.isnan(x[i]):
            assert got[i] == (None, None)
        else:
            assert math.isclose(got[i][0], fast[i], rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(got[i][1], slow[i], rel_tol=1e-9, abs_tol=1e-12)


def test_order_statistics_and_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=500), np.full(300, 0.25), rng.exponential(size=200) * 1e6])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = np.sort(values)
    total, stats = order_statistics(df, "v", [0, 10, 499, 500, 700, 999, 1000])
    assert total == 1000 and [s.rank for s in stats] == [0, 10, 499, 500, 700, 999]
    for s in stats:
        assert s.value == ordered[s.rank] and s.less == (values < s.value).sum() and s.equal == (values == s.value).sum()
    want = np.quantile(values, [0.0, 0.1, 0.5, 0.995, 1.0])
    assert np.allclose(exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.995, 1.0]), want)


def test_rank_bucket_is_average_rank(spark):
    values = [1.0] * 7 + [2.0] * 3 + [3.0, 4.0, 5.0] + [6.0] * 10 + [None] * 2
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq long, v double")
    ranks = pd.Series(values).rank(method="average")
    got = collected(rank_bucket(df, "v", "b"), "b")
    for i, v in enumerate(values):
        want = 0 if v is None else min(9, int((ranks[i] - 1) * 10 // 23))
        assert got[i] == (f"q{want}",)


def test_ordinal_rank_splits_one_hot_value(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 3 else float(i)) for i in range(300)], "seq long, v double")
    got = collected(ordinal_rank(df, ["v", "seq"], "r", 5), "r")
    order = sorted(range(300), key=lambda i: (1.0 if i % 3 else float(i), i))
    assert got == {i: (r,) for r, i in enumerate(order)}


@pytest.mark.parametrize("limit", [0, 2])
def test_greedy_spaced(spark, ticks, limit):
    df = frame(spark, ticks).where("k is not null")
    got = {r["seq"] for r in greedy_spaced(df, ["k"], ["t", "seq"], 13, limit, slice_width=40).collect()}
    want = set()
    for g in by_key(ticks[ticks.k.notna()]):
        last, n = None, 0
        for r in g.itertuples():
            if (last is None or r.t - last >= 13) and (limit == 0 or n < limit):
                want.add(r.seq)
                last, n = r.t, n + 1
    assert got == want


def test_change_events_keep_first_row_and_null_transitions(spark):
    rows = [("a", 0, 0, None), ("a", 1, 1, None), ("a", 2, 2, 1.0), ("a", 50, 3, 1.0), ("a", 51, 4, None), ("a", 90, 5, 2.0)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, v double")
    kept = [r["seq"] for r in change_events(df, ["k"], ["t", "seq"], ["v"], {}, slice_width=10).orderBy("seq").collect()]
    assert kept == [0, 2, 4, 5]
    spaced = change_events(df, ["k"], ["t", "seq"], ["v"], {}, min_gap_ns=10, slice_width=10)
    assert [r["seq"] for r in spaced.orderBy("seq").collect()] == [0, 4, 5]


def test_balanced_sample_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i, i % 2, int(i % 10 == 0)) for i in range(2000)], "seq long, part long, y int")
    a = balanced_sample(df, ["part"], "y", ["seq"], 42)
    counts = {(r["part"], r["y"]): r["count"] for r in a.groupBy("part", "y").count().collect()}
    assert counts[(0, 1)] == counts[(0, 0)] == 200 and counts[(1, 0)] == 1000
    again = balanced_sample(df.repartition(7), ["part"], "y", ["seq"], 42)
    assert {r["seq"] for r in a.collect()} == {r["seq"] for r in again.collect()}
    assert uniform_cap(df, 333, ["seq"], 1).count() == 333


def test_split_counts_and_purge(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(1000)], "recv_ns long, seq long")
    counts = {r["split"]: r["count"] for r in chronological_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 700, "validation": 150, "test": 150}
    ms = df.withColumn("recv_ns", F.col("recv_ns") * 1_000_000)
    purged = chronological_split(ms, purge_ms=10, embargo_ms=5)
    edge = purged.groupBy("split").agg(F.min("recv_ns").alias("lo"), F.max("recv_ns").alias("hi"))
    rows = {r["split"]: (r["lo"] // 1_000_000, r["hi"] // 1_000_000) for r in edge.collect()}
    assert rows == {"train": (0, 222), "validation": (238, 272), "test": (288, 333)}
    with pytest.raises(ValueError):
        chronological_split(df, 0.5, 0.1, 0.1)
    assert {r["window_id"] for r in walk_forward(df).select("window_id").distinct().collect()} == {0, 1, 2}


def test_enrich_and_relaxed_union(spark):
    facts = spark.createDataFrame([("a", "", None), ("b", "kept", 1.0), ("z", None, None)], "k string, s string, x double")
    dim = spark.createDataFrame([("a", "old", 5.0, 1), ("a", "new", 6.0, 2), ("b", "other", 7.0, 1)], "k string, s string, x double, v int")
    got = {r["k"]: (r["s"], r["x"]) for r in enrich(facts, dim, "k", ["s", "x"], ["v"]).collect()}
    assert got == {"a": ("new", 6.0), "b": ("kept", 1.0), "z": (None, None)}
    both = union_relaxed([spark.createDataFrame([(1,)], "a int"), None, spark.createDataFrame([(2.5, "x")], "a double, b string")])
    assert sorted(tuple(r) for r in both.collect()) == [(1.0, None), (2.5, "x")]
    assert union_relaxed([None]) is None


def test_order_statistics_end_on_any_doubles(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1.7e308, -1.7e308, 0.0, 5e-324, 1.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    total, stats = order_statistics(df, "v", range(6))
    assert total == 5 and [s.value for s in stats] == [-1.7e308, 0.0, 5e-324, 1.0, 1.7e308]


def test_ewma_keeps_an_outlier_many_chunks_back(spark):
    n, w = 3000, 1 - 2 / 6.0
    df = spark.createDataFrame([(1, i, i, 1e200 if i == 100 else 1.0) for i in range(n)], "k int, t long, seq long, v double")
    got = {r.seq: r.v_ewma_fast for r in ewma(df, ["k"], ["t", "seq"], ["v"], {"fast": 5}, 1000).collect()}
    num = den = 0.0
    for i in range(n):
        num, den = num * w + (1e200 if i == 100 else 1.0), den * w + 1
        assert abs(got[i] - num / den) <= 1e-9 * abs(num / den)


def test_feed_of_one_symbol_is_spread_over_tasks(spark):
    """40 tolerances of one dense feed: no task gets half of the rows, and matches stay those of the wide buckets."""
    left = spark.range(4000).select(F.lit("BTC").alias("symbol"), F.col("id").alias("t"))
    right = spark.range(0, 4000, 7).select(F.lit("BTC").alias("symbol"), F.col("id").alias("t"), F.col("id").alias("v"))
    lookup = Lookup(right, "t", {"v": "v"}, 100)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for keyed in (True, False):
            out = asof_adaptive(left, "t", [lookup], "symbol", "symbol", keyed)
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 4000 and max(sizes) < 2000
            wide = asof_adaptive(left, "t", [lookup], "symbol", "symbol", keyed, bucket_width=1 << 40)
            assert sorted(out.collect()) == sorted(wide.collect())
            assert {r.t - r.v for r in out.collect()} == set(range(7))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("most_rows", [0, 20, 100_000])
def test_greedy_spaced_of_small_and_large_keys(spark, most_rows):
    rows = [(k, t * 7 % 50 + n, n, f"x{n}") for k, size in (("a", 60), ("b", 5), (None, 18)) for n, t in enumerate(range(size))]
    got = greedy_spaced(spark.createDataFrame(rows, "k string, t long, seq long, note string"), ["k"], ["t", "seq"], 9, 4, 40, most_rows).collect()
    expect, last = [], {}
    for k, t, n, note in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        picks = last.setdefault(k, [])
        if len(picks) < 4 and (not picks or t >= picks[-1] + 9):
            picks.append(t)
            expect.append((k, t, n, note))
    assert sorted(map(tuple, got), key=str) == sorted(expect, key=str)


def test_small_keys_are_spaced_without_slices(spark, monkeypatch):
    from tickloom.operators import gating

    monkeypatch.setattr(gating, "_chain", None)
    df = spark.createDataFrame([(float("nan"), t, t) for t in range(30)] + [(1.0, 5, 1)], "k double, t long, seq long")
    assert gating.greedy_spaced(df, ["k"], ["t", "seq"], 10).count() == 4
