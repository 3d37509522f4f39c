import itertools
import random

import pytest

from pyspark.sql import functions as F

from tickloom.operators.policy_walk import walk_policies


def brute(rows, levels, gap, most):
    out = {}
    for policy in itertools.product(*levels):
        free, taken, picks = {}, {}, []
        for k, t, _, e, f, profit, won in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
            if e is None or e < policy[0] or f < policy[1] or t < free.get(k, t) or (most and taken.get(k, 0) >= most):
                continue
            free[k], taken[k] = t + gap, taken.get(k, 0) + 1
            picks.append((profit, won))
        known = [p for p, _ in picks if p is not None]
        out[policy] = (len(picks), len(known), sum(w for _, w in picks), pytest.approx(sum(known)) if picks else None)
    return out


@pytest.mark.parametrize("gap,most", [(10, 1), (10, 0), (7, 3), (0, 2)])
def test_against_one_policy_at_a_time(spark, gap, most):
    rng = random.Random(gap)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(300), i, rng.choice([None, 0.1, 0.2, 0.5, 0.9]), rng.random(), rng.choice([None, 1.0, -2.0]), rng.random() < 0.5) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, e double, f double, profit double, won boolean").repartition(5)
    levels = [[0.2, 0.1, 0.95], [0.0, 0.5, 0.75]]
    got = walk_policies(df, "k", ["t", "seq"], {"e_least": ("e", levels[0]), "f_least": ("f", levels[1])}, "profit", F.col("won"), gap, most).collect()
    assert {(r.e_least, r.f_least): (r.entries, r.profits, r.successes, r.total_profit) for r in got} == brute(rows, levels, gap, most)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t long, seq long, e double, profit double, won boolean")
    got = walk_policies(df, "k", ["t", "seq"], {"least": ("e", [0.1, 0.2])}, "profit", F.col("won"), 5).collect()
    assert sorted((r.least, r.entries, r.total_profit) for r in got) == [(0.1, 0, None), (0.2, 0, None)]
