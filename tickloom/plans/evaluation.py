"""Model and selection metrics as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.combine import few_values
from tickloom.operators.slices import null_safe_join
from tickloom.session import cut_lineage

# Label order of reports and the positive-class preference.
LABEL_ORDER = ["down", "neutral", "up", "skip", "enter"]
POSITIVE_PREFERENCE = ["enter", "up", 1, "1", True]
BUCKET_COLUMNS = ["spread_bucket", "imbalance_bucket", "expiry_bucket", "price_bucket", "market_phase"]


def positive_class(classes: Sequence[object]) -> object | None:
    """The class whose probability counts; the last one when none is preferred."""
    for label in POSITIVE_PREFERENCE:
        for c in classes:
            if c == label and isinstance(c, bool) == isinstance(label, bool):
                return c
    return classes[-1] if len(classes) else None


def bucket_table(df: DataFrame, target: str, prediction: str, columns: Sequence[str] = BUCKET_COLUMNS) -> DataFrame:
    """Rows, mean target, win rate and mean prediction per bucket, all bucket columns at once."""
    present = [c for c in columns if c in df.columns]
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("bucket_column"), F.col(c).cast("string").alias("bucket")) for c in present])
    )
    return (
        df.where(F.col(target).isNotNull() & F.col(prediction).isNotNull())
        .select(target, prediction, pairs.alias("p"))
        .where(F.col("p.bucket").isNotNull())
        .groupBy("p.bucket_column", "p.bucket")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(target).alias("avg_target"),
            F.avg((F.col(target) > 0).cast("double")).alias("win_rate"),
            F.avg(prediction).alias("avg_prediction"),
        )
    )


def passed(score: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds the score reaches; null reaches none."""
    return sum([F.when(score >= F.lit(float(t)), 1).otherwise(0) for t in thresholds], F.lit(0))


def threshold_cells(
    df: DataFrame, dims: dict[str, tuple[str, Sequence[float]]], by: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """`df` with a cell code per dimension; rows that pass no threshold somewhere are dropped."""
    coded = df.select(
        *by, *extra, *[passed(F.col(score), sorted(levels)).alias(f"__c_{d}") for d, (score, levels) in dims.items()]
    )
    for d in dims:
        coded = coded.where(F.col(f"__c_{d}") > 0)
    return coded


def spread_over_grid(cells: DataFrame, dims: dict[str, tuple[str, Sequence[float]]]) -> DataFrame:
    """Each cell once per grid point it belongs to, with the thresholds as columns.

    A cell is a bounded summary, so this never multiplies data rows by the grid.
    """
    out = cells
    for d, (_, levels) in dims.items():
        array = F.slice(F.array(*[F.lit(float(t)) for t in sorted(levels)]), 1, F.col(f"__c_{d}"))
        out = out.withColumn(d, F.explode(array)).drop(f"__c_{d}")
    return out


def grid_medians(coded: DataFrame, dims: dict[str, tuple[str, Sequence[float]]], by: Sequence[str]) -> DataFrame:
    """(by, dims, median_profit) of all grid points, for profits that hardly ever repeat.

    Profits are counted in bins between approximate quantiles, of which there are at least eight for each grid
    point. Counts per cell and bin add up to those of every point, which name the one or two bins that hold
    its middle values. Only rows of these bins are looked at again, each for the points whose middle lies in its
    bin; so the second pass ranks about an eighth of all rows, whatever the grid. Exact, as the
    quantiles only choose the bins.
    """
    points = math.prod(len(set(levels)) for _, levels in dims.values())
    bins = min(max(1000, 8 * points), 20_000)
    edges = coded.agg(F.percentile_approx("__profit", [i / bins for i in range(1, bins)], 10 * bins)).first()[0]
    edges = np.unique(np.array(edges or [0.0]))

    @F.pandas_udf("int")
    def bin_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(), side="right").astype("int32"))

    codes, places = [f"__c_{d}" for d in dims], [f"__l_{d}" for d in dims]
    binned = cut_lineage(coded.select(*by, *codes, "__profit", bin_of("__profit").alias("__bin")), "binned")
    cells = binned.groupBy(*by, *codes, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    counts = spread_over_grid(cells, dims).groupBy(*by, *dims, "__bin").agg(F.sum("__n").alias("__n"))
    point = Window.partitionBy(*by, *dims)
    before = F.coalesce(F.sum("__n").over(point.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"__before": before, "__all": F.sum("__n").over(point)})
    # ranks of the two middle values, counted from 0 within the bin
    for name, rank in (("__r1", F.floor((F.col("__all") - 1) / 2)), ("__r2", F.floor(F.col("__all") / 2))):
        counts = counts.withColumn(name, rank - F.col("__before"))
    inside = [(F.col(r) >= 0) & (F.col(r) < F.col("__n")) for r in ("__r1", "__r2")]
    level = {f"__l_{d}": sum((F.when(F.col(d) >= F.lit(float(t)), 1).otherwise(0) for t in sorted(set(levels))), F.lit(0)) for d, (_, levels) in dims.items()}
    middle = cut_lineage(counts.where(inside[0] | inside[1]).select(*by, *dims, *[c.alias(n) for n, c in level.items()], "__bin", "__r1", "__r2"), "middle")

    values = binned.groupBy(*by, *codes, "__bin", "__profit").agg(F.count(F.lit(1)).alias("__n")).alias("v")
    match = F.col("v.__bin") == F.col("m.__bin")
    for b in by:
        match = match & F.col(f"v.{b}").eqNullSafe(F.col(f"m.{b}"))
    for c, p in zip(codes, places, strict=True):
        match = match & (F.col(f"v.{c}") >= F.col(f"m.{p}"))
    chosen = values.join(middle.alias("m"), match).select(*[F.col(f"m.{x}").alias(x) for x in (*by, *dims, "__bin", "__r1", "__r2")], "v.__profit", "v.__n")
    chosen = chosen.groupBy(*by, *dims, "__bin", "__r1", "__r2", "__profit").agg(F.sum("__n").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by, *dims, "__bin").orderBy("__profit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = chosen.withColumn("__upto", upto)
    at = [(F.col("__upto") - F.col("__n") <= F.col(r)) & (F.col(r) < F.col("__upto")) for r in ("__r1", "__r2")]
    halves = [F.sum(F.when(hit, F.col("__profit") / 2)) for hit in at]
    return chosen.where(at[0] | at[1]).groupBy(*by, *dims).agg((halves[0] + halves[1]).alias("median_profit"))


def grid_statistics(
    df: DataFrame,
    dims: dict[str, tuple[str, Sequence[float]]],
    profit: str,
    by: Sequence[str] = (),
    success: Column | None = None,
    means: Sequence[str] = (),
    median: bool = True,
    continuous: bool = False,
) -> DataFrame:
    """Selection statistics at every point of a threshold grid.

    `dims` = {column name: (score column, thresholds)}; a row is selected where it reaches
    all thresholds. Rows are summed per cell of reached thresholds, and the grid is applied
    to those few sums. Per grid point: entries, average and total profit, success rate
    (share of positive profits unless `success` is given), mean loss of the losers,
    `avg_{c}` for the columns in `means`, and the exact median profit. The median goes over
    the counts of distinct profits, which are few where prices move in ticks; for targets that hardly
    repeat, `continuous` finds it by counting in bins first (`grid_medians`).
    """
    p = F.col("__profit")
    rows = df.where(F.col(profit).isNotNull()).select(
        *by,
        F.col(profit).cast("double").alias("__profit"),
        (F.col(profit) > 0 if success is None else success).cast("int").alias("__win"),
        *[F.col(c).cast("double").alias(f"__m_{c}") for c in means],
        *[F.col(score).alias(f"__s_{d}") for d, (score, _) in dims.items()],
    )
    coded = threshold_cells(
        rows, {d: (f"__s_{d}", levels) for d, (_, levels) in dims.items()}, by, ["__profit", "__win", *[f"__m_{c}" for c in means]]
    )
    codes = [f"__c_{d}" for d in dims]
    cells = coded.groupBy(*by, *codes).agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(p).alias("__total"),
        F.sum("__win").alias("__wins"),
        F.count("__win").alias("__judged"),
        F.sum(F.when(p < 0, -p)).alias("__loss"),
        F.count_if(p < 0).alias("__losers"),
        *[F.sum(f"__m_{c}").alias(f"__m_{c}") for c in means],
    )
    grid = spread_over_grid(cells, dims)
    entries = F.sum("__n")
    stats = grid.groupBy(*by, *dims).agg(
        entries.alias("entries"),
        (F.sum("__total") / entries).alias("avg_profit"),
        F.sum("__total").alias("total_profit"),
        F.try_divide(F.sum("__wins"), F.sum("__judged")).alias("success_rate"),
        F.try_divide(F.sum("__loss"), F.sum("__losers")).alias("avg_loss"),
        *[(F.sum(f"__m_{c}") / entries).alias(f"avg_{c}") for c in means],
    )
    if not median:
        return stats
    if continuous:
        return null_safe_join(stats, grid_medians(coded, dims, by), [*by, *dims])
    values = spread_over_grid(coded.groupBy(*by, *codes, "__profit").agg(F.count(F.lit(1)).alias("__n")), dims)
    medians = values.groupBy(*by, *dims).agg(F.percentile("__profit", F.lit(0.5), F.col("__n")).alias("median_profit"))
    return null_safe_join(stats, medians, [*by, *dims])


def threshold_table(df: DataFrame, target: str, score: str, thresholds: Sequence[float], taker_cost_bps: float = 0.0) -> DataFrame:
    """Entries, mean, median, success rate and value after cost above each threshold.

    Thresholds nobody reaches appear with zero entries.
    """
    stats = grid_statistics(df, {"threshold": (score, thresholds)}, target)
    levels = df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return levels.join(stats, "threshold", "left").select(
        "threshold",
        F.coalesce("entries", F.lit(0).cast("long")).alias("candidate_entries"),
        F.col("avg_profit").alias("avg_realized_target"),
        F.col("median_profit").alias("median_realized_target"),
        "success_rate",
        (F.col("avg_profit") - F.lit(taker_cost_bps)).alias("ev_after_cost"),
    )


def pass_rate_table(df: DataFrame, score: str, outcome: str, thresholds: Sequence[float], min_rows: int = 10) -> DataFrame:
    """Actual rate of `outcome` among rows at or above each threshold."""
    stats = grid_statistics(df, {"threshold": (score, thresholds)}, outcome, median=False)
    return stats.where(F.col("entries") >= min_rows).select("threshold", "entries", F.col("avg_profit").alias("actual_rate"))


def regression_metrics(df: DataFrame, target: str, prediction: str) -> DataFrame:
    err = F.col(prediction) - F.col(target)
    return df.where(err.isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse")
    )


def confusion(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Count per (actual, predicted), zero counts included, in the fixed label order."""
    counts = (
        df.where(F.col(target).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(target).cast("string").alias("actual"), F.col(prediction).cast("string").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seen = few_values(counts.select(F.explode(F.array("actual", "predicted")).alias("label")), "label")
    order = [c for c in LABEL_ORDER if c in seen] + sorted(c for c in seen if c not in LABEL_ORDER)
    place = {c: i for i, c in enumerate(order)}
    pairs = df.sparkSession.createDataFrame(
        [(a, p, place[a], place[p]) for a, p in product(order, order)],
        "actual string, predicted string, actual_order int, predicted_order int",
    )
    return pairs.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def macro_scores(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Macro precision, recall and F1; a class without a denominator counts as 0."""
    counts = (
        df.where(F.col(target).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(target).cast("string").alias("actual"), F.col(prediction).cast("string").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("actual_n"), F.lit(0).cast("long").alias("pred_n"), hit.alias("hits")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("actual_n"), F.col("n").alias("pred_n"), F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("actual_n", "pred_n", "hits")])
    precision = F.coalesce(F.try_divide("hits", "pred_n"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "actual_n"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return per_class.agg(
        F.avg(precision).alias("precision_macro"), F.avg(recall).alias("recall_macro"), F.avg(f1).alias("f1_macro")
    )


def overlap_report(a: DataFrame, b: DataFrame, keys: Sequence[str], profit: str, win: str) -> DataFrame:
    """Count, mean profit and win rate of rows in both selections and in only one."""
    cols = [*keys, profit, win]
    marked = a.select(*cols, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        b.select(*cols, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    rows = marked.groupBy(*keys).agg(
        F.max("__a").alias("a"), F.max("__b").alias("b"), F.max(profit).alias("profit"), F.max(win).alias("win")
    )
    part = F.when((F.col("a") == 1) & (F.col("b") == 1), "common").when(F.col("a") == 1, "only_a").otherwise("only_b")
    return rows.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("profit").alias("avg_profit"), F.avg(F.col("win").cast("double")).alias("win_rate")
    )


def top_rows(df: DataFrame, score: str, n: int, tie: Sequence[str]) -> DataFrame:
    """The `n` rows with the largest score."""
    return df.orderBy(F.col(score).desc_nulls_last(), *tie).limit(n)
