"""Queries over scored rows: splits, sampling, metrics, policies, gating, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import buckets, prices
from tickloom.operators import splits
from tickloom.operators.gating import greedy_spaced, threshold_signals
from tickloom.operators.ranks import exact_quantiles, quantile_summary, rank_correlation
from tickloom.operators.sampling import balanced_sample, uniform_cap
from tickloom.plans import calibration, evaluation, policy
from tickloom.plans.dataset import dataset_quality, label_export, null_fractions, prune_features, training_rows
from tickloom.workload import mapping as m
from tickloom.workload.base_sql import BOOK, HOUR, SCORED, TICKS, with_ctes
from tickloom.workload.mapping import DAY
from tickloom.workload.registry import query

SLICE = 2 * DAY


def rounded(df, digits, *columns):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- splits ---------------------------------------------------------------------------

ORDERED = BOOK + ", o AS (SELECT *, row_number() OVER (ORDER BY recv_ns, seq) - 1 AS r, count(*) OVER () AS n FROM book)"
SPLIT = """CASE WHEN r < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
  WHEN r < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) + CAST(floor(n * 0.15::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END"""


@query("chronological_split", with_ctes(ORDERED, f"SELECT seq, {SPLIT} AS split FROM o"))
def split_query(spark, sf):
    return splits.chronological_split(m.book(spark, sf).select("recv_ns", "seq")).select("seq", "split")


PURGED = (
    ORDERED
    + f""", s AS (SELECT *, {SPLIT} AS split FROM o), b AS (SELECT min(recv_ns) FILTER (WHERE split = 'validation') AS vs, min(recv_ns) FILTER (WHERE split = 'test') AS ts FROM s),
    kept AS (SELECT s.* FROM s, b WHERE CASE split WHEN 'train' THEN recv_ns < vs - {HOUR} WHEN 'test' THEN recv_ns >= ts + {HOUR // 2}
             ELSE recv_ns >= vs + {HOUR // 2} AND recv_ns < ts - {HOUR} END)"""
)


@query(
    "split_ranges_purged",
    with_ctes(PURGED, "SELECT split, count(*) AS rows, min(recv_ns) AS start_ns, max(recv_ns) AS end_ns FROM kept GROUP BY 1"),
)
def ranges_query(spark, sf):
    rows = splits.chronological_split(m.book(spark, sf).select("recv_ns", "seq"), purge_ms=3_600_000, embargo_ms=1_800_000)
    return splits.split_ranges(rows)


@query(
    "walk_forward_windows",
    with_ctes(
        ORDERED
        + """, w AS (SELECT *, CAST(i AS INTEGER) AS window_id, i * CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS s, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS t,
             CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS v FROM o, range(3) g(i))""",
        """SELECT window_id, CASE WHEN r < s + t THEN 'train' ELSE 'validation' END AS part, count(*) AS rows, min(recv_ns) AS lo, max(recv_ns) AS hi
           FROM w WHERE r >= s AND r < s + t + v AND s + t + v <= n GROUP BY ALL""",
    ),
)
def walk_query(spark, sf):
    w = splits.walk_forward(m.book(spark, sf).select("recv_ns", "seq"))
    return w.groupBy("window_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("recv_ns").alias("lo"), F.max("recv_ns").alias("hi"))


@query(
    "date_trims",
    with_ctes(
        BOOK + ", d AS (SELECT *, recv_ns // 86400000000000 AS date FROM book), b AS (SELECT date, min(recv_ns) AS lo, max(recv_ns) AS hi FROM d GROUP BY 1)",
        f"SELECT seq FROM d JOIN b USING (date) WHERE recv_ns >= lo + {HOUR} AND recv_ns < hi - {HOUR}",
    ),
)
def trim_query(spark, sf):
    df = m.book(spark, sf).select("seq", "recv_ns", F.floor(F.col("recv_ns") / 86400e9).alias("date"))
    return splits.trim_dates(df, purge_ns=HOUR, head=True, tail=True).select("seq")


@query(
    "balanced_sample",
    with_ctes(
        TICKS + """, l AS (SELECT recv_ns // 86400000000000 AS date, CAST(event_type = 'view' AS INTEGER) AS y FROM ticks),
        c AS (SELECT date, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM l GROUP BY 1)""",
        "SELECT date, 1 AS y, p AS rows FROM c WHERE p > 0 UNION ALL SELECT date, 0, least(p, q) FROM c",
    ),
)
def balanced_query(spark, sf):
    t = m.ticks(spark, sf)
    df = t.select("seq", F.floor(F.col("recv_ns") / 86400e9).alias("date"), (F.col("event_type") == "view").cast("int").alias("y"))
    return balanced_sample(df, ["date"], "y", ["seq"], seed=42).groupBy("date", "y").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "balanced_sample_filtered",
    with_ctes(
        TICKS + """, l AS (SELECT recv_ns // 604800000000000 AS date, CAST(event_type = 'view' AS INTEGER) AS y FROM ticks WHERE k > 50),
        c AS (SELECT date, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM l GROUP BY 1)""",
        "SELECT date, least(p + least(p, q), 100) AS rows FROM c",
    ),
)
def filtered_query(spark, sf):
    t = m.ticks(spark, sf)
    df = t.select("seq", "k", F.floor(F.col("recv_ns") / 604800e9).alias("date"), (F.col("event_type") == "view").cast("int").alias("y"))
    out = balanced_sample(df, ["date"], "y", ["seq"], seed=7, where=F.col("k") > 50, cap=100)
    return out.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


@query("uniform_cap", with_ctes(TICKS, "SELECT least(count(*), 1234) AS rows, least(count(*), 1234) AS distinct_rows FROM ticks"))
def cap_query(spark, sf):
    return uniform_cap(m.ticks(spark, sf).select("seq"), 1234, ["seq"], 42).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("seq").alias("distinct_rows")
    )


# ---- metrics --------------------------------------------------------------------------

STATS = """count(*) AS entries, round(avg(profit), 9) AS avg_profit, round(quantile_cont(profit, 0.5), 9) AS median_profit, round(sum(profit), 6) AS total_profit,
           round(avg(CASE WHEN fill_cls = 'enter' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS success_rate,
           round(avg(-profit) FILTER (WHERE profit < 0), 9) AS avg_loss"""
STAT_COLUMNS = ["avg_profit", "median_profit", "success_rate", "avg_loss"]


def levels_sql(name: str, values) -> str:
    return f"(SELECT unnest([{', '.join(f'{float(v)!r}::DOUBLE' for v in values)}]) AS {name})"


@query(
    "threshold_table",
    with_ctes(
        SCORED,
        f"""SELECT threshold, count(profit_ticks) AS candidate_entries, round(avg(profit_ticks), 6) AS avg_realized_target,
            round(quantile_cont(profit_ticks, 0.5), 6) AS median_realized_target, round(avg(CASE WHEN profit_ticks > 0 THEN 1.0::DOUBLE WHEN profit_ticks IS NOT NULL THEN 0.0::DOUBLE END), 6) AS success_rate,
            round(avg(profit_ticks) - 2, 6) AS ev_after_cost FROM {levels_sql('threshold', [0.4, 0.5, 0.6, 0.7, 0.8, 2.0])} LEFT JOIN scored ON p_fill >= threshold GROUP BY 1""",
    ),
)
def threshold_query(spark, sf):
    out = evaluation.threshold_table(m.scored(spark, sf), "profit_ticks", "p_fill", [0.4, 0.5, 0.6, 0.7, 0.8, 2.0], 2.0)
    return rounded(out, 6, *[c for c in out.columns if c not in ("threshold", "candidate_entries")])


@query(
    "cutoff_grid",
    with_ctes(SCORED, f"SELECT threshold, {STATS} FROM scored JOIN {levels_sql('threshold', policy.grid_levels(0.5, 0.95, 0.05))} ON p_fill >= threshold GROUP BY 1"),
)
def cutoff_query(spark, sf):
    grid = policy.cutoff_grid(m.scored(spark, sf), "profit", "fill_cls", policy.grid_levels(0.5, 0.95, 0.05), "p_fill")
    return rounded(rounded(grid, 9, *STAT_COLUMNS), 6, "total_profit").drop("avg_p_fill")


@query(
    "cutoff_selected_on_derived_thresholds",
    with_ctes(
        SCORED
        + f""", t AS (SELECT threshold FROM {levels_sql('threshold', policy.grid_levels(0.5, 0.95, 0.05))} UNION
             SELECT round(p_fill, 6) FROM (SELECT p_fill, row_number() OVER (ORDER BY p_fill DESC) AS r FROM scored) WHERE r IN (10, 50, 100, 500)),
        g AS (SELECT threshold, {STATS} FROM scored JOIN t ON p_fill >= threshold GROUP BY 1)""",
        "SELECT threshold, entries, avg_profit, total_profit FROM g WHERE entries >= 10 ORDER BY avg_profit DESC, total_profit DESC, entries DESC, threshold DESC LIMIT 1",
    ),
)
def derived_query(spark, sf):
    s = m.scored(spark, sf)
    levels = policy.candidate_thresholds(s, "p_fill", 0.5, 0.95, 0.05, [10, 50, 100, 500])
    grid = policy.cutoff_grid(s, "profit", "fill_cls", levels, "p_fill")
    best = policy.select_cutoff(rounded(rounded(grid, 9, "avg_profit"), 6, "total_profit"), 10)
    return best.select("threshold", "entries", "avg_profit", "total_profit")


EXPECTED = "p_fill * ({s} - ((best_ask + 0.01) + {s} * (0.96 - best_ask))) + (1 - p_fill) * pred_unwind_profit".format(
    s="(1 - 0.072::DOUBLE * (best_ask + 0.01) * (1 - (best_ask + 0.01)))"
)
LEVELS = ([-0.02, 0.0, 0.02], [0.3, 0.6], [-0.03, 0.01])
POLICY_GRID = (
    SCORED
    + f""", e AS (SELECT *, {EXPECTED} AS ep FROM scored), g AS (SELECT expected_profit_threshold, min_p_fill, min_pred_unwind_profit, {STATS},
      round(avg(ep), 7) AS avg_pred_expected_profit FROM e JOIN {levels_sql('expected_profit_threshold', LEVELS[0])} ON ep >= expected_profit_threshold
      JOIN {levels_sql('min_p_fill', LEVELS[1])} ON p_fill >= min_p_fill JOIN {levels_sql('min_pred_unwind_profit', LEVELS[2])} ON pred_unwind_profit >= min_pred_unwind_profit GROUP BY ALL)"""
)


def _policy_grid(spark, sf):
    rows = policy.with_expected_profit(m.scored(spark, sf))
    grid = policy.policy_grid(rows, "profit", "fill_cls", *LEVELS)
    return rows, rounded(rounded(grid, 9, *STAT_COLUMNS), 6, "total_profit")


@query("policy_grid", with_ctes(POLICY_GRID, "SELECT * FROM g"))
def policy_query(spark, sf):
    grid = _policy_grid(spark, sf)[1]
    return rounded(grid, 7, "avg_pred_expected_profit").drop("avg_p_fill", "avg_pred_unwind_profit")


FINE_PROFIT = "CAST((seq * 48271) % 1000003 AS DOUBLE) / 1000003 - 0.5"


@query(
    "policy_grid_continuous",
    with_ctes(
        SCORED + f", e AS (SELECT *, {EXPECTED} AS ep, {FINE_PROFIT} AS fine FROM scored)",
        f"""SELECT outcome, expected_profit_threshold, min_p_fill, min_pred_unwind_profit, count(*) AS entries, round(median(fine), 8) + 0.0 AS median_profit FROM e
            JOIN {levels_sql('expected_profit_threshold', LEVELS[0])} ON ep >= expected_profit_threshold JOIN {levels_sql('min_p_fill', LEVELS[1])} ON p_fill >= min_p_fill
            JOIN {levels_sql('min_pred_unwind_profit', LEVELS[2])} ON pred_unwind_profit >= min_pred_unwind_profit GROUP BY ALL""",
    ),
)
def continuous_query(spark, sf):
    """Medians of all grid points of a profit that hardly repeats."""
    fine = F.pmod(F.col("seq") * 48271, F.lit(1000003)).cast("double") / 1000003.0 - 0.5
    rows = policy.with_expected_profit(m.scored(spark, sf)).withColumn("fine", fine)
    grid = policy.policy_grid(rows, "fine", "fill_cls", *LEVELS, by=["outcome"], continuous=True)
    return grid.select("outcome", *policy.POLICY_DIMS, "entries", (F.round("median_profit", 8) + F.lit(0.0)).alias("median_profit"))


@query(
    "policy_selected_and_applied",
    with_ctes(
        POLICY_GRID
        + ", b AS (SELECT * FROM g WHERE entries >= 20 ORDER BY avg_profit DESC, total_profit DESC, entries DESC, expected_profit_threshold DESC, min_p_fill DESC, min_pred_unwind_profit DESC LIMIT 1)",
        """SELECT e.seq FROM e, b WHERE ep >= expected_profit_threshold AND p_fill >= min_p_fill AND pred_unwind_profit >= min_pred_unwind_profit""",
    ),
)
def applied_query(spark, sf):
    rows, grid = _policy_grid(spark, sf)
    return policy.apply_policy(rows, policy.select_policy(grid, 20)).select("seq")


COMBO = (
    SCORED
    + f""", md AS (SELECT *, 'a' AS p_fill_model, p_fill AS p FROM scored UNION ALL SELECT *, 'b', 1 - p_fill FROM scored),
    e AS (SELECT *, p * 0.04::DOUBLE + (1.0::DOUBLE - p) * pred_unwind_profit AS ep, CASE WHEN seq % 2 = 0 THEN 'val' ELSE 'test' END AS part FROM md),
    th AS {levels_sql('threshold', policy.EXPECTED_PROFIT_LEVELS)}, mp AS {levels_sql('min_p_fill', policy.FILL_LEVELS)}, mu AS {levels_sql('min_unwind', policy.UNWIND_LEVELS)},
    mf AS {levels_sql('min_p_first_fill', policy.FIRST_FILL_LEVELS)}"""
)


def combo_sql(first: bool) -> str:
    f_join = "JOIN mf ON time_to_expiry_seconds / 400 >= min_p_first_fill" if first else ""
    f_col = "min_p_first_fill," if first else ""
    f_cond = "AND e.time_to_expiry_seconds / 400 >= best.min_p_first_fill" if first else ""
    order = "threshold, min_p_first_fill, min_p_fill, min_unwind" if first else "threshold, min_p_fill, min_unwind"
    return with_ctes(
        COMBO
        + f""", g AS (SELECT p_fill_model, threshold, {f_col} min_p_fill, min_unwind, count(*) AS val_entries, avg(profit) AS val_avg_profit
          FROM e JOIN th ON ep >= threshold {f_join} JOIN mp ON p >= min_p_fill JOIN mu ON pred_unwind_profit >= min_unwind WHERE part = 'val' GROUP BY ALL HAVING count(*) >= 10),
        best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY p_fill_model ORDER BY round(val_avg_profit, 12) DESC, {order}) = 1),
        t AS (SELECT best.p_fill_model, count(*) AS n, avg(profit) AS a FROM e JOIN best ON e.p_fill_model = best.p_fill_model AND ep >= threshold AND p >= min_p_fill
              AND pred_unwind_profit >= min_unwind {f_cond} WHERE part = 'test' GROUP BY 1)""",
        f"""SELECT best.p_fill_model, threshold, {f_col} min_p_fill, min_unwind, val_entries, round(val_avg_profit, 9) AS val_avg_profit,
            CASE WHEN n >= 5 THEN n ELSE 0 END AS test_entries, round(CASE WHEN n >= 5 THEN a ELSE 0 END, 9) AS test_avg_profit
            FROM best LEFT JOIN t ON t.p_fill_model = best.p_fill_model""",
    )


def _combos(spark, sf, first: bool):
    s = m.scored(spark, sf).withColumn("p_alt", 1 - F.col("p_fill")).withColumn("win", (F.col("fill_cls") == "enter").cast("int"))
    s = s.withColumn("p_one", F.col("time_to_expiry_seconds") / 400)
    stages = {"p_fill": {"a": "p_fill", "b": "p_alt"}, "pred_unwind_profit": {"u": "pred_unwind_profit"}}
    if first:
        stages = {"p_first": {"f": "p_one"}, **stages}
    out = policy.staged_policy_search(s.where("seq % 2 = 0"), s.where("seq % 2 = 1"), stages, "profit", "win")
    dims = ["threshold", *(["min_p_first_fill"] if first else []), "min_p_fill", "min_unwind"]
    out = out.select("p_fill_model", *dims, "val_entries", "val_avg_profit", "test_entries", "test_avg_profit")
    return rounded(out, 9, "val_avg_profit", "test_avg_profit")


@query("two_stage_policy_search", combo_sql(False))
def two_stage_query(spark, sf):
    return _combos(spark, sf, False)


@query("three_stage_policy_search", combo_sql(True))
def three_stage_query(spark, sf):
    return _combos(spark, sf, True)


@query(
    "pass_rates",
    with_ctes(
        SCORED,
        f"""SELECT threshold, count(*) AS entries, round(avg(CASE WHEN fill_cls = 'enter' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS actual_rate FROM scored
            JOIN {levels_sql('threshold', policy.FIRST_FILL_LEVELS)} ON p_fill >= threshold GROUP BY 1 HAVING count(*) >= 10""",
    ),
)
def pass_query(spark, sf):
    s = m.scored(spark, sf).withColumn("filled", (F.col("fill_cls") == "enter").cast("int"))
    return rounded(evaluation.pass_rate_table(s, "p_fill", "filled", policy.FIRST_FILL_LEVELS), 9, "actual_rate")


PREDICTED = SCORED + ", pr AS (SELECT *, CASE WHEN p_fill > 0.4 THEN 'enter' WHEN p_fill > 0.1 THEN 'skip' ELSE 'hold' END AS pred FROM scored)"


def predicted(spark, sf):
    pred = F.when(F.col("p_fill") > 0.4, "enter").when(F.col("p_fill") > 0.1, "skip").otherwise("hold")
    return m.scored(spark, sf).withColumn("pred", pred)


@query(
    "confusion_matrix",
    with_ctes(
        PREDICTED + ", l AS (SELECT unnest(['skip', 'enter', 'hold']) AS label), pairs AS (SELECT a.label AS actual, b.label AS predicted FROM l a, l b)",
        "SELECT actual, predicted, count(seq) AS n FROM pairs LEFT JOIN pr ON fill_cls = actual AND pred = predicted GROUP BY ALL",
    ),
)
def confusion_query(spark, sf):
    return evaluation.confusion(predicted(spark, sf), "fill_cls", "pred").select("actual", "predicted", "n")


@query(
    "macro_scores",
    with_ctes(
        PREDICTED
        + """, c AS (SELECT l AS label, count(*) FILTER (WHERE fill_cls = l) AS a, count(*) FILTER (WHERE pred = l) AS p, count(*) FILTER (WHERE fill_cls = l AND pred = l) AS h
             FROM pr, (SELECT unnest(['skip', 'enter', 'hold']) AS l) GROUP BY 1),
        s AS (SELECT CASE WHEN p > 0 THEN h / p ELSE 0 END AS pc, CASE WHEN a > 0 THEN h / a ELSE 0 END AS rc FROM c)""",
        """SELECT round(avg(pc), 9) AS precision_macro, round(avg(rc), 9) AS recall_macro,
           round(avg(CASE WHEN pc + rc > 0 THEN 2 * pc * rc / (pc + rc) ELSE 0 END), 9) AS f1_macro FROM s""",
    ),
)
def macro_query(spark, sf):
    return rounded(evaluation.macro_scores(predicted(spark, sf), "fill_cls", "pred"), 9, "precision_macro", "recall_macro", "f1_macro")


@query(
    "regression_metrics",
    with_ctes(
        SCORED,
        """SELECT count(*) AS rows, round(avg(abs(pred_unwind_profit - profit)), 9) AS mae, round(sqrt(avg((pred_unwind_profit - profit) * (pred_unwind_profit - profit))), 9) AS rmse
           FROM scored""",
    ),
)
def regression_query(spark, sf):
    return rounded(evaluation.regression_metrics(m.scored(spark, sf), "profit", "pred_unwind_profit"), 9, "mae", "rmse")


@query(
    "rank_correlation",
    with_ctes(
        SCORED + ", r AS (SELECT row_number() OVER (ORDER BY profit, seq) AS a, row_number() OVER (ORDER BY pred_unwind_profit, seq) AS b FROM scored)",
        "SELECT round(corr(a, b), 9) AS rank_correlation FROM r",
    ),
)
def correlation_query(spark, sf):
    return rounded(rank_correlation(m.scored(spark, sf), "profit", "pred_unwind_profit", ["seq"]), 9, "rank_correlation")


@query(
    "quantile_summary",
    with_ctes(
        SCORED + ", u AS (SELECT 'p_fill' AS c, p_fill AS v FROM scored UNION ALL SELECT 'profit', profit FROM scored), "
        "q AS (SELECT c, quantile_cont(v, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) AS q FROM u GROUP BY 1)",
        """SELECT c AS "column", round(q[1], 9) AS "min", round(q[2], 9) AS p10, round(q[3], 9) AS p25, round(q[4], 9) AS p50, round(q[5], 9) AS p75,
           round(q[6], 9) AS p90, round(q[7], 9) AS "max" FROM q""",
    ),
)
def summary_query(spark, sf):
    out = quantile_summary(m.scored(spark, sf), ["p_fill", "profit"])
    return rounded(out, 9, *out.columns[1:])


@query(
    "winsorized_values",
    with_ctes(
        SCORED + ", q AS (SELECT quantile_cont(profit, 0.05) AS lo, quantile_cont(profit, 0.95) AS hi FROM scored)",
        "SELECT seq, round(least(greatest(profit, lo), hi), 9) AS profit FROM scored, q",
    ),
)
def winsor_query(spark, sf):
    s = m.scored(spark, sf)
    lo, hi = exact_quantiles(s, "profit", [0.05, 0.95])
    return s.select("seq", F.round(F.least(F.greatest("profit", F.lit(lo)), F.lit(hi)), 9).alias("profit"))


@query(
    "overlap_of_selections",
    with_ctes(
        SCORED
        + """, a AS (SELECT seq FROM scored WHERE p_fill >= 0.6), b AS (SELECT seq FROM scored ORDER BY pred_unwind_profit DESC, seq LIMIT 500),
        u AS (SELECT s.*, s.seq IN (SELECT seq FROM a) AS ia, s.seq IN (SELECT seq FROM b) AS ib FROM scored s)""",
        """SELECT CASE WHEN ia AND ib THEN 'common' WHEN ia THEN 'only_a' ELSE 'only_b' END AS part, count(*) AS n, round(avg(profit), 9) AS avg_profit,
           round(avg(CASE WHEN fill_cls = 'enter' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS win_rate FROM u WHERE ia OR ib GROUP BY 1""",
    ),
)
def overlap_query(spark, sf):
    s = m.scored(spark, sf).withColumn("win", (F.col("fill_cls") == "enter").cast("int"))
    top = evaluation.top_rows(s, "pred_unwind_profit", 500, ["seq"])
    return rounded(evaluation.overlap_report(s.where("p_fill >= 0.6"), top, ["seq"], "profit", "win"), 9, "avg_profit", "win_rate")


@query(
    "probability_bins",
    with_ctes(
        SCORED,
        """SELECT CASE WHEN p_fill < 0.90 THEN '< 0.90' WHEN p_fill < 0.93 THEN '0.90-0.93' WHEN p_fill < 0.95 THEN '0.93-0.95' WHEN p_fill < 0.97 THEN '0.95-0.97'
           WHEN p_fill < 0.99 THEN '0.97-0.99' ELSE '0.99+' END AS bucket, count(*) AS n, round(avg(profit), 9) AS avg_profit, round(quantile_cont(profit, 0.5), 9) AS median_profit
           FROM scored GROUP BY 1 HAVING count(*) >= 3""",
    ),
)
def bins_query(spark, sf):
    s = m.scored(spark, sf)
    rows = s.groupBy(buckets.labelled_bin(F.col("p_fill"), buckets.FIRST_FILL_BINS).alias("bucket"), "profit").agg(F.count(F.lit(1)).alias("c"))
    out = rows.groupBy("bucket").agg(
        F.sum("c").alias("n"), (F.sum(F.col("profit") * F.col("c")) / F.sum("c")).alias("avg_profit"), F.percentile("profit", F.lit(0.5), F.col("c")).alias("median_profit")
    )
    return rounded(out.where("n >= 3"), 9, "avg_profit", "median_profit")


@query(
    "null_fractions",
    with_ctes(
        BOOK,
        """SELECT 'depth_top10_imbalance' AS feature, round(avg(CASE WHEN depth_top10_imbalance IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS null_fraction FROM book
           UNION ALL SELECT 'current_mid', 0.0 FROM book LIMIT 2""".replace(" FROM book LIMIT 2", ""),
    ),
)
def nulls_query(spark, sf):
    return rounded(null_fractions(m.book(spark, sf), ["depth_top10_imbalance", "current_mid"]), 9, "null_fraction")


@query("pruned_features", with_ctes(BOOK, "SELECT seq, current_mid FROM book"))
def prune_query(spark, sf):
    """A column that is null in a quarter of the rows falls to a limit of 20 %."""
    return prune_features(m.book(spark, sf).select("seq", "current_mid", "depth_top10_imbalance"), 0.2)


@query(
    "training_rows_and_quality",
    with_ctes(
        BOOK
        + f""", f AS (SELECT s.seq, s.recv_ns FROM book s WHERE EXISTS (SELECT 1 FROM book f WHERE f.asset_id = s.asset_id AND f.recv_ns BETWEEN s.recv_ns + {10 * HOUR} AND s.recv_ns + {22 * HOUR})
             AND (s.recv_ns + {10 * HOUR} <= 1705000000000000000))""",
        "SELECT CAST(recv_ns // 86400000000000 AS VARCHAR) AS date, count(*) AS rows, 'ok' AS status FROM f GROUP BY 1",
    ),
)
def rows_query(spark, sf):
    from tickloom.plans import features, labels

    book = m.book(spark, sf).withColumn("expiry_ns", F.lit(1705000000000000000))
    df = labels.alpha_labels(features.future_book(book, book, [10], 12 * HOUR, m.SCALE))
    kept = training_rows(df, 10, m.SCALE).withColumn("date", F.floor(F.col("recv_ns") / 86400e9).cast("string"))
    return dataset_quality(label_export(kept))


# ---- calibration ----------------------------------------------------------------------


def flat(spark, sf):
    s = policy.with_expected_profit(m.scored(spark, sf))
    slug = F.when(F.col("seq") % 3 == 0, "btc-updown-5m-1").when(F.col("seq") % 3 == 1, "eth-updown-15m-1")
    return s.select(
        F.col("recv_ns").alias("timestamp_ns"), slug.alias("slug"), F.when(F.col("seq") % 11 != 0, F.col("p_fill")).alias("p_fill"), "pred_expected_profit",
        "best_ask", "time_to_expiry_seconds", F.col("profit").alias("final_profit"), F.col("fill_cls").alias("two_leg"),
        F.when(F.col("profit") > 0, "enter").otherwise("skip").alias("final_entry"),
    )


FLAT = SCORED + ", fl AS (SELECT *, CASE WHEN seq % 11 <> 0 THEN p_fill END AS pf FROM scored)"


@query(
    "calibration_tables",
    with_ctes(
        FLAT
        + """, g AS (SELECT 'p_fill' AS grouping, CASE WHEN pf IS NULL THEN 'missing' WHEN pf < 0.5 THEN '<0.50' WHEN pf < 0.6 THEN '0.50-0.60' WHEN pf < 0.7 THEN '0.60-0.70'
               WHEN pf < 0.8 THEN '0.70-0.80' ELSE '0.80+' END AS bucket, * FROM fl
             UNION ALL SELECT 'period', CASE WHEN seq % 3 = 0 THEN '5m' WHEN seq % 3 = 1 THEN '15m' ELSE 'unknown' END, * FROM fl
             UNION ALL SELECT 'time_to_expiry', CASE WHEN time_to_expiry_seconds < 30 THEN '<30s' WHEN time_to_expiry_seconds < 60 THEN '30-60s'
               WHEN time_to_expiry_seconds < 180 THEN '60-180s' ELSE '>=180s' END, * FROM fl)""",
        """SELECT grouping, bucket, count(*) AS n, round(avg(CASE WHEN fill_cls = 'enter' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS fill_rate,
           round(avg(CASE WHEN profit > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS final_profit_positive_rate, round(avg(profit), 9) AS avg_final_profit,
           round(sum(profit), 6) AS total_final_profit, round(avg(pf), 9) AS avg_p_fill FROM g GROUP BY ALL""",
    ),
)
def calibration_query(spark, sf):
    out = calibration.calibration_tables(flat(spark, sf)).where(F.col("grouping").isin("p_fill", "period", "time_to_expiry"))
    return rounded(rounded(out, 9, "fill_rate", "final_profit_positive_rate", "avg_final_profit", "avg_p_fill"), 6, "total_final_profit")


@query(
    "calibration_summary",
    with_ctes(
        FLAT,
        """SELECT count(*) AS resolved_count, round(avg(CASE WHEN fill_cls = 'enter' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS two_leg_success_rate,
           round(avg((pf - CASE WHEN fill_cls = 'enter' THEN 1 ELSE 0 END) * (pf - CASE WHEN fill_cls = 'enter' THEN 1 ELSE 0 END)), 9) AS brier_score FROM fl""",
    ),
)
def calibration_summary_query(spark, sf):
    out = calibration.calibration_summary(flat(spark, sf)).select("resolved_count", "two_leg_success_rate", "brier_score")
    return rounded(out, 9, "two_leg_success_rate", "brier_score")


@query(
    "outcome_label_counts",
    with_ctes(
        FLAT,
        """SELECT 'two_leg' AS label, fill_cls AS value, count(*) AS n FROM fl GROUP BY ALL
           UNION ALL SELECT 'final_entry', CASE WHEN profit > 0 THEN 'enter' ELSE 'skip' END, count(*) FROM fl GROUP BY ALL""",
    ),
)
def counts_query(spark, sf):
    return calibration.label_counts(flat(spark, sf))


# ---- gating ---------------------------------------------------------------------------

CHAIN = """, first AS (SELECT {key}, min(recv_ns) AS recv_ns FROM cand GROUP BY ALL),
picks AS (SELECT {key}, recv_ns, 1 AS n FROM first
          UNION ALL
          SELECT {pkey}, (SELECT min(c.recv_ns) FROM cand c WHERE {match} AND c.recv_ns >= p.recv_ns + {gap}), p.n + 1
          FROM picks p WHERE EXISTS (SELECT 1 FROM cand c WHERE {match} AND c.recv_ns >= p.recv_ns + {gap}))"""


def chain(keys, gap):
    return CHAIN.format(
        key=", ".join(keys), pkey=", ".join(f"p.{k}" for k in keys), match=" AND ".join(f"c.{k} = p.{k}" for k in keys), gap=gap
    )


@query(
    "greedy_spaced",
    with_ctes(TICKS + ", cand AS (SELECT event_type, recv_ns FROM ticks)" + chain(["event_type"], 2 * HOUR), "SELECT event_type, recv_ns FROM picks"),
)
def greedy_query(spark, sf):
    """Five hot keys, each cut into many slices."""
    t = m.ticks(spark, sf).select("event_type", "recv_ns", "seq")
    return greedy_spaced(t, ["event_type"], ["recv_ns", "seq"], 2 * HOUR, slice_width=20 * HOUR).select("event_type", "recv_ns")


ENTRY = "best_bid > 0 AND best_ask BETWEEN 0.2 AND 0.8 AND current_spread <= 0.04 AND time_to_expiry_seconds >= 20"


@query(
    "live_threshold_signals",
    with_ctes(
        SCORED
        + """, lagged AS (SELECT *, lag(p_fill) OVER (PARTITION BY asset_id ORDER BY recv_ns, seq) AS prev FROM scored),
        opp AS (SELECT DISTINCT asset_id FROM scored),"""
        + f""" cand AS (SELECT threshold, market_id || ':' || outcome AS signal_key, recv_ns FROM lagged JOIN (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE]) AS threshold) ON p_fill >= threshold
              WHERE (prev IS NULL OR prev < threshold) AND {ENTRY})"""
        + chain(["threshold", "signal_key"], 10 * HOUR),
        "SELECT threshold, signal_key, recv_ns FROM picks WHERE n <= 3",
    ),
)
def signals_query(spark, sf):
    from tickloom.operators.gating import entry_allowed

    out = threshold_signals(
        m.scored(spark, sf), "p_fill", [0.5, 0.8], SLICE, cooldown_seconds=10 * 3600, max_entries=3, entry=entry_allowed(0.2, 0.8, 0.04, 20.0)
    )
    return out.select("threshold", "signal_key", "recv_ns")


@query(
    "live_policy_selection",
    with_ctes(
        SCORED
        + f""", cand AS (SELECT market_id || ':' || outcome AS signal_key, recv_ns, seq FROM scored WHERE {EXPECTED} >= 0.0 AND p_fill >= 0.3 AND pred_unwind_profit >= -0.03
             AND best_bid > 0 AND best_ask BETWEEN 0.0 AND 1.0 AND current_spread <= 0.05)""",
        "SELECT signal_key, recv_ns FROM cand QUALIFY row_number() OVER (PARTITION BY signal_key ORDER BY recv_ns, seq) = 1",
    ),
)
def live_policy_query(spark, sf):
    rows = policy.with_expected_profit(m.scored(spark, sf))
    policies = spark.createDataFrame([(0.0, 0.3, -0.03)], "expected_profit_threshold double, min_p_fill double, min_pred_unwind_profit double")
    return policy.live_policy_rows(rows, policies).select("signal_key", "recv_ns")


EXPECTED_STEPS, FILL_STEPS, UNWIND_STEPS = [i / 100 for i in range(-2, 4)], [i / 10 for i in range(3, 10)], [i / 400 - 0.045 for i in range(30)]


def step_list(steps):
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in steps) + "]"


@query(
    "live_policy_grid",
    with_ctes(
        SCORED
        + f""", cand AS (SELECT market_id || ':' || outcome AS signal_key, recv_ns, seq, {EXPECTED} AS e, p_fill AS f, pred_unwind_profit AS u, profit, fill_cls FROM scored
             WHERE best_bid > 0 AND best_ask BETWEEN 0.0 AND 1.0 AND current_spread <= 0.05),
        g AS (SELECT * FROM (SELECT unnest({step_list(EXPECTED_STEPS)}) AS expected_profit_threshold), (SELECT unnest({step_list(FILL_STEPS)}) AS min_p_fill), (SELECT unnest({step_list(UNWIND_STEPS)}) AS min_pred_unwind_profit)),
        firsts AS (SELECT expected_profit_threshold, min_p_fill, min_pred_unwind_profit, signal_key, arg_min((profit, fill_cls), (recv_ns, seq)) AS x
             FROM cand JOIN g ON e >= expected_profit_threshold AND f >= min_p_fill AND u >= min_pred_unwind_profit GROUP BY ALL),
        s AS (SELECT expected_profit_threshold, min_p_fill, min_pred_unwind_profit, count(*) AS entries, sum(x[1]) AS total, count(*) FILTER (WHERE x[2] = 'enter') AS good FROM firsts GROUP BY ALL)""",
        """SELECT expected_profit_threshold, min_p_fill, min_pred_unwind_profit, coalesce(entries, 0) AS entries, round(total, 6) + 0.0 AS total_profit, round(total / entries, 6) + 0.0 AS avg_profit,
           round(good::DOUBLE / entries, 6) AS success_rate FROM g LEFT JOIN s USING (expected_profit_threshold, min_p_fill, min_pred_unwind_profit)""",
    ),
)
def live_grid_query(spark, sf):
    """1,260 policies side by side; every row is in the shuffle once at most."""
    rows = policy.with_expected_profit(m.scored(spark, sf))
    grid = policy.live_policy_grid(rows, "profit", "fill_cls", EXPECTED_STEPS, FILL_STEPS, UNWIND_STEPS)
    return grid.select(*policy.POLICY_DIMS, "entries", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("total_profit", "avg_profit")], F.round("success_rate", 6).alias("success_rate"))


@query(
    "success_and_unwind_profit",
    with_ctes(
        SCORED,
        """SELECT seq, round({s} - ((best_ask + 0.01) + {s} * (0.96 - best_ask)), 7) AS success_profit, round({s} * best_bid - (best_ask + 0.01), 7) AS unwind_profit FROM scored""".format(
            s="(1 - 0.072::DOUBLE * (best_ask + 0.01) * (1 - (best_ask + 0.01)))"
        ),
    ),
)
def profit_query(spark, sf):
    s = m.scored(spark, sf)
    ask, bid = F.col("best_ask"), F.col("best_bid")
    return s.select("seq", F.round(prices.success_profit(ask), 7).alias("success_profit"), F.round(prices.unwind_profit(ask, bid), 7).alias("unwind_profit"))
