"""Calibration of scored samples against their resolved outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import buckets

RESOLVED_SCHEMA = (
    "event string, timestamp_ns long, slug string, prediction struct<p_fill:double,pred_expected_profit:double>, "
    "entry struct<best_ask:double,time_to_expiry_seconds:double>, "
    "labels struct<final_profit_10s:double,y_two_leg_entry_10s:string,y_final_profit_entry_10s:string>"
)


def flat_samples(resolved: DataFrame, h: int = 10) -> DataFrame:
    """The nested log's fields that calibration needs, one column each."""
    return resolved.select(
        "timestamp_ns",
        "slug",
        F.col("prediction.p_fill").alias("p_fill"),
        F.col("prediction.pred_expected_profit").alias("pred_expected_profit"),
        F.col("entry.best_ask").alias("best_ask"),
        F.col("entry.time_to_expiry_seconds").alias("time_to_expiry_seconds"),
        F.col(f"labels.final_profit_{h}s").alias("final_profit"),
        F.col(f"labels.y_two_leg_entry_{h}s").alias("two_leg"),
        F.col(f"labels.y_final_profit_entry_{h}s").alias("final_entry"),
    )


def _is_enter(col: str) -> Column:
    return F.coalesce((F.col(col) == "enter").cast("double"), F.lit(0.0))


def groupings() -> dict[str, Column]:
    return {
        "p_fill": buckets.labelled_bin(F.col("p_fill"), buckets.FILL_PROBABILITY_BINS),
        "expected_profit": buckets.labelled_bin(F.col("pred_expected_profit"), buckets.EXPECTED_PROFIT_BINS),
        "entry_ask": buckets.labelled_bin(F.col("best_ask"), buckets.ENTRY_ASK_BINS),
        "time_to_expiry": buckets.labelled_bin(F.col("time_to_expiry_seconds"), buckets.TIME_TO_EXPIRY_BINS),
        "period": buckets.slug_period(F.coalesce("slug", F.lit(""))),
    }


def calibration_tables(flat: DataFrame) -> DataFrame:
    """n, fill rate, positive rate, profits and mean probability per bucket of every grouping."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("grouping"), c.alias("bucket")) for n, c in groupings().items()]))
    return (
        flat.select("*", pairs.alias("g"))
        .groupBy("g.grouping", "g.bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(_is_enter("two_leg")).alias("fill_rate"),
            F.avg(_is_enter("final_entry")).alias("final_profit_positive_rate"),
            F.avg("final_profit").alias("avg_final_profit"),
            F.sum("final_profit").alias("total_final_profit"),
            F.avg("p_fill").alias("avg_p_fill"),
        )
    )


def calibration_summary(flat: DataFrame) -> DataFrame:
    """One row of overall rates, profit and Brier score."""
    fill = _is_enter("two_leg")
    return flat.agg(
        F.count(F.lit(1)).alias("resolved_count"),
        F.avg(fill).alias("two_leg_success_rate"),
        F.avg(_is_enter("final_entry")).alias("final_profit_positive_rate"),
        F.avg("final_profit").alias("avg_final_profit"),
        F.sum("final_profit").alias("total_final_profit"),
        F.avg((F.col("p_fill") - fill) * (F.col("p_fill") - fill)).alias("brier_score"),
    )


def label_counts(flat: DataFrame) -> DataFrame:
    """Counts of both outcome labels."""
    pairs = F.explode(
        F.array(
            F.struct(F.lit("final_entry").alias("label"), F.col("final_entry").alias("value")),
            F.struct(F.lit("two_leg").alias("label"), F.col("two_leg").alias("value")),
        )
    )
    return flat.select(pairs.alias("p")).groupBy("p.label", "p.value").agg(F.count(F.lit(1)).alias("n"))


def aligned_signals(signals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Signal samples from the first candidate sample on (all, if there are no candidates)."""
    since = candidates.agg(F.min("timestamp_ns")).first()[0]
    if since is None:
        return signals
    return signals.where(F.coalesce("timestamp_ns", F.lit(0).cast("long")) >= F.lit(since))
