import random
import statistics

import pytest

from tickloom.plans.evaluation import grid_statistics


@pytest.mark.parametrize("ticks", [False, True])
def test_medians_of_all_points(spark, ticks):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.random(), rng.random(), rng.choice([-1.0, 0.0, 2.0]) if ticks else rng.gauss(0, 1) ** 3) for _ in range(1500)]
    df = spark.createDataFrame(rows, "g string, p double, q double, profit double")
    dims = {"least_p": ("p", [0.5, 0.1, 0.999]), "least_q": ("q", [0.0, 0.7])}
    got = grid_statistics(df, dims, "profit", by=["g"], continuous=True).collect()
    expect = {}
    for g, p, q, profit in rows:
        for x in dims["least_p"][1]:
            for y in dims["least_q"][1]:
                if p >= x and q >= y:
                    expect.setdefault((g, x, y), []).append(profit)
    assert {(r.g, r.least_p, r.least_q): (r.entries, r.median_profit) for r in got} == {k: (len(v), pytest.approx(statistics.median(v))) for k, v in expect.items()}
