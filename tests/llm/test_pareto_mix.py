import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.pareto_mix import mixed, running, shared

SHAPE = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("rest", T.StringType()), ("wish", T.DoubleType()))])


def targets(sizes, cycle, percent, most):
    """Water levels, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), sum(sizes.values()) * percent / 100
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= most * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in free}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= above
    return out


def rows_of(n=600):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else [None, "", "b", "é", "\U0001f916", "a"][i % 6]
        words = (i * 7919) % 90 if source != "b" else 1 + i % 5
        rows.append((i, " ".join(["w"] * words), source, "x", float(i % 4)))
    rows += [(5, "one two", "a", "x", 1.0)] * 40 + [(None, "one two three", None, "x", None), (9, None, "hot", "x", 2.0), (10, "", "empty", "x", 1.0), (11, "v " * 20_000, "long", "x", 1.0)]
    return rows


@pytest.mark.parametrize("weight", [None, "wish"])
def test_targets_and_totals(spark, weight):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SHAPE).repartition(7)
    got = mixed(docs, weight=weight).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, len((t or "").split(" ")) - (t or "").endswith(" ") if t else 0, s) for i, t, s, *_ in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    expect = targets(sizes, (5, 2, 1), 150, 2)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, expect[r.source], rel_tol=1e-9, abs_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - expect[s]) <= 1
    # at most one document of a source is taken in part
    parts = Counter(r.source for r in got if r.size and r.taken % r.size)
    assert not parts or max(parts.values()) == 1
    again = mixed(docs.repartition(3), weight=weight).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_preferred_documents_are_drawn_more_often(spark):
    docs = spark.createDataFrame([(i, "a b c", "s" if i % 2 else "t", "", 3.0 if i % 4 < 2 else 1.0) for i in range(4000)], SHAPE)
    got = mixed(docs, cycle=(1, 3), percent=80, most=1, weight="wish").where("source = 's'").join(docs.select("doc_id", "wish"), "doc_id")
    shares = {r.wish: r.share for r in got.groupBy("wish").agg((F.sum("taken") / F.sum("size")).alias("share")).collect()}
    inclusion = {r.wish: r.p for r in got.groupBy("wish").agg(F.avg("inclusion").alias("p")).collect()}
    assert inclusion[3.0] == pytest.approx(3 * inclusion[1.0]) and all(abs(shares[w] - inclusion[w]) < 0.05 for w in shares)


def test_running_sums_across_ranges(spark):
    rows = spark.createDataFrame([(i % 3 == 0, (i * 37) % 101, i % 7) for i in range(500)], "g boolean, o int, v long")
    got = running(rows, ["g"], [F.col("o"), F.col("v")], "v", "before").orderBy("g", "o", "v").collect()
    at = {True: 0, False: 0}
    for r in sorted(got, key=lambda r: (r.g, r.o, r.v, r.before)):
        assert r.before == at[r.g]
        at[r.g] += r.v


def test_levels_with_caps_and_without_weight(spark):
    rows = spark.createDataFrame([("a", 10, 1.0, 2), ("a", 10, 1.0, 100), ("b", 10, 0.0, 5), ("c", 50, 1.0, 3), ("c", 50, 2.0, 4)], "g string, total long, w double, cap long")
    got = sorted((r.g, r.cap, r.got) for r in shared(rows, "g", "total", "w", "cap", "got").collect())
    assert got == [("a", 2, 2.0), ("a", 100, 8.0), ("b", 5, 0.0), ("c", 3, 3.0), ("c", 4, 4.0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SHAPE)
    assert mixed(docs).count() == 0
    nothing = mixed(spark.createDataFrame([(1, "", "a", "", 1.0), (2, None, None, "", 1.0)], SHAPE)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in nothing) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
