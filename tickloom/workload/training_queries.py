"""The whole training table, and models fitted on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.splits import chronological_split
from tickloom.plans import features, labels, models, policy
from tickloom.plans.canonical import canonical_book, reference_book
from tickloom.plans.dataset import Sampling, TablePlan, Targets, build_feature_table, dataset_metadata, training_rows
from tickloom.session import cut_lineage
from tickloom.workload import mapping as m
from tickloom.workload.base_sql import BOOK, HOUR, REFERENCE, TRADES, with_ctes
from tickloom.workload.mapping import DAY
from tickloom.workload.registry import query

PLAN = TablePlan(Sampling(every_ms=1000), Targets(horizons=(5, 10)), reach_ms=6000, scale=m.SCALE, slice_ns=2 * DAY)


def feature_table(spark, sf):
    """Ticks through the whole assembly: book, trades and the reference feed."""
    t = m.book(spark, sf)
    raw = t.withColumnsRenamed({"current_mid": "midpoint", "current_spread": "spread", "top1_imbalance": "imbalance"})
    feed = m.ticks(spark, sf).where("event_type = 'view'").select(
        "recv_ns", "seq", F.lit("BTC").alias("symbol"), F.lit("btcusdt").alias("asset_id"),
        (F.col("mid") - 0.01).alias("best_bid"), (F.col("mid") + 0.01).alias("best_ask"), F.col("mid").alias("midpoint"),
    )
    ref_trades = m.trades(spark, sf).select("recv_ns", "seq", "size", "signed_side", F.lit("BTC").alias("symbol"))
    return build_feature_table(canonical_book(raw), m.trades(spark, sf), reference_book(None, feed), ref_trades, None, PLAN)


SAMPLED = BOOK + TRADES + REFERENCE + f""", s AS (
  SELECT * FROM book QUALIFY row_number() OVER (PARTITION BY asset_id, recv_ns // {HOUR} ORDER BY recv_ns DESC, seq DESC) = 1)"""


@query(
    "training_table",
    with_ctes(
        SAMPLED,
        f"""SELECT s.asset_id, s.seq, s.current_mid,
              (SELECT arg_max(r.ref_mid, r.recv_ns) FROM ref r WHERE r.recv_ns <= s.recv_ns AND r.recv_ns >= s.recv_ns - {6 * HOUR}) AS ref_mid,
              (SELECT arg_min(f.current_mid, f.recv_ns) FROM book f WHERE f.asset_id = s.asset_id AND f.recv_ns BETWEEN s.recv_ns + {10 * HOUR} AND s.recv_ns + {16 * HOUR}) AS future_mid_10s,
              (SELECT CAST(count(*) AS DOUBLE) FROM trades t2 WHERE t2.asset_id = s.asset_id AND t2.recv_ns > x.tt - {HOUR} AND t2.recv_ns <= x.tt AND x.tt IS NOT NULL) AS n1,
              (SELECT arg_max(o.current_mid, o.recv_ns) FROM s o WHERE o.asset_id = s.asset_id AND o.recv_ns BETWEEN s.recv_ns - {6 * HOUR} AND s.recv_ns - {3 * HOUR}) AS past_3s
            FROM s LEFT JOIN (SELECT s.seq, max(t.recv_ns) AS tt FROM s JOIN trades t ON t.asset_id = s.asset_id AND t.recv_ns <= s.recv_ns AND t.recv_ns >= s.recv_ns - {HOUR} GROUP BY 1) x
              ON x.seq = s.seq""".replace("AS n1,", "AS trade_count_1s_or_zero,").replace("AS past_3s", "AS past_3s"),
    ),
)
def table_query(spark, sf):
    out = feature_table(spark, sf)
    return out.select(
        "asset_id", "seq", "current_mid", "ref_mid", "future_mid_10s",
        F.coalesce("trade_count_1s", F.lit(0.0)).alias("trade_count_1s_or_zero"),
        F.round(F.col("current_mid") / (F.col("return_3s") + 1), 6).alias("past_3s"),
    )


@query(
    "training_table_extent",
    with_ctes(SAMPLED, f"SELECT count(*) AS rows, min(recv_ns) AS start_ns, max(recv_ns) AS end_ns FROM s WHERE EXISTS (SELECT 1 FROM book f WHERE f.asset_id = s.asset_id AND f.recv_ns BETWEEN s.recv_ns + {10 * HOUR} AND s.recv_ns + {16 * HOUR})"),
)
def extent_query(spark, sf):
    rows = training_rows(feature_table(spark, sf), 10, m.SCALE)
    return dataset_metadata(rows, PLAN).select("rows", "start_ns", "end_ns")


FEATURES = ["current_mid", "current_spread", "top1_imbalance", "depth_top10_imbalance", "total_bid_levels", "total_ask_levels", "price_bucket"]


def model_rows(spark, sf):
    """Labelled rows with book features, written once: fitting reads them many times."""
    book = m.book(spark, sf)
    df = features.future_book(book, book, [10], 6 * HOUR, m.SCALE).withColumn("realized_vol_short", F.lit(0.0))
    df = labels.alpha_labels(features.add_buckets(df))
    df = labels.final_profit(labels.two_leg_fill(df, m.trades(spark, sf), scale=m.SCALE))
    return cut_lineage(training_rows(df, 10, m.SCALE), "model-rows")


@query("model_metrics")
def metrics_query(spark, sf):
    """Three baselines fitted on the training split and judged on the test split."""
    rows = chronological_split(model_rows(spark, sf), purge_ms=3_600_000, embargo_ms=3_600_000)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    fitted = {}
    for name in ["ridge_regression", "logistic_regression", "random_forest_classifier"]:
        spec = models.BASELINES[name]
        target = "y_reg_10s" if spec.task == "regression" else "y_cls_10s"
        fitted[name] = models.fit_model(train, target, spec, name, FEATURES, winsor=(0.005, 0.995))
    return models.evaluate_models(test, fitted)


@query("model_policy")
def model_policy_query(spark, sf):
    """Fill and unwind models scored on validation, policy chosen there, result on test."""
    rows = chronological_split(model_rows(spark, sf))
    train = rows.where("split = 'train'")
    fill = models.fit_model(train, "y_two_leg_entry_10s", models.BASELINES["random_forest_classifier"], "fill", FEATURES)
    unwind = models.fit_model(train, "first_unwind_profit_proxy_10s", models.BASELINES["random_forest_regressor"], "unwind", FEATURES)
    scored = models.score(models.score(rows.where("split <> 'train'"), fill, "p_fill"), unwind, "pred_unwind_profit")
    scored = cut_lineage(policy.with_expected_profit(scored))
    levels = policy.candidate_thresholds(scored.where("split = 'validation'"), "pred_expected_profit", -0.05, 0.05, 0.01, [10, 50, 100])
    grid = policy.policy_grid(scored.where("split = 'validation'"), "final_profit_10s", "y_two_leg_entry_10s", levels, [0.0, 0.3, 0.5], [-1.0, -0.05, 0.0])
    chosen = policy.select_policy(grid, 10)
    taken = policy.apply_policy(scored.where("split = 'test'"), chosen)
    return taken.agg(F.count(F.lit(1)).alias("entries"), F.avg("final_profit_10s").alias("avg_profit"))


@query("model_importance")
def importance_query(spark, sf):
    rows = model_rows(spark, sf)
    spec = models.BASELINES["random_forest_classifier"]
    return models.feature_importance(models.fit_model(rows, "y_cls_10s", spec, "forest", FEATURES), rows)
