"""Exact ranks, order statistics and rank buckets without a global single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import cut_lineage

BINS = 2048


@dataclass(frozen=True)
class OrderStatistic:
    """The value at a 0-based rank, with the count of smaller and of equal values."""

    rank: int
    value: float | int
    less: int
    equal: int


def is_finite(df: DataFrame, column: str) -> Column:
    """Whether a value is neither null, NaN nor infinite."""
    v = F.col(column)
    if not isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return v.isNotNull()
    return v.isNotNull() & ~F.isnan(v) & (v < float("inf")) & (v > float("-inf"))


class Extent(NamedTuple):
    """Count, least and greatest of the finite values."""

    n: int
    lo: float | int | None
    hi: float | int | None


def finite_values(df: DataFrame, column: str) -> DataFrame:
    """The finite values as column `v`: rows are dropped once, so later expressions meet a plain column."""
    return df.where(is_finite(df, column)).select(F.col(column).alias("v"))


def extent(values: DataFrame) -> Extent:
    return Extent(*values.agg(F.count("v"), F.min("v"), F.max("v")).first())


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int], known: Extent | None = None) -> tuple[int, list[OrderStatistic]]:
    """Exact values at the given 0-based ranks of the non-null values of `column`.

    Repeated histograms: each pass counts `BINS` equal bins inside the interval around
    every wanted rank and keeps one bin. Data is only scanned, never sorted or moved;
    the driver sees at most `BINS` counts per wanted rank and pass. Ranks out of range
    are left out. NaN and infinities have no place in an interval and count as null. `known`
    is the extent of the values where it was found before.
    """
    real = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    values = finite_values(df, column)
    total, least, greatest = known or extent(values)
    wanted = sorted({r for r in ranks if 0 <= r < total})
    found: dict[int, OrderStatistic] = {}
    # interval (lo, hi) -> (values below it, ranks inside it)
    active: dict[tuple, tuple[int, list[int]]] = {(least, greatest): (0, wanted)} if wanted else {}
    if wanted and least == greatest:
        return total, [OrderStatistic(r, least, 0, total) for r in wanted]

    while active:
        bounds = list(active)
        which = None
        bin_of = None
        for i, (lo, hi) in enumerate(bounds):
            inside = (F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi))
            if real:  # halves, as the width itself may be beyond the largest double
                width = float(hi) / 2 - float(lo) / 2
                share = (F.col("v") / 2 - F.lit(float(lo) / 2)) / F.lit(width) if width > 0 else F.when(F.col("v") == F.lit(lo), 0.0).otherwise(1.0)
            else:
                share = (F.col("v") - F.lit(lo)).cast("double") / F.lit(float(hi - lo))
            b = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
            which = F.when(inside, i) if which is None else which.when(inside, i)
            bin_of = F.when(inside, b) if bin_of is None else bin_of.when(inside, b)
        rows = (
            values.select("v", which.alias("i"), bin_of.alias("b"))
            .where(F.col("i").isNotNull())
            .groupBy("i", "b")
            .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        bins: dict[int, list] = {}
        for r in rows:
            bins.setdefault(r["i"], []).append(r)
        following: dict[tuple, tuple[int, list[int]]] = {}
        for i, key in enumerate(bounds):
            below, inside_ranks = active[key]
            for r in sorted(bins.get(i, []), key=lambda x: x["b"]):
                mine = [k for k in inside_ranks if below <= k < below + r["n"]]
                if mine:
                    if r["lo"] == r["hi"]:
                        for k in mine:
                            found[k] = OrderStatistic(k, r["lo"], below, r["n"])
                    else:
                        following[(r["lo"], r["hi"])] = (below, mine)
                below += r["n"]
        if any(key in active for key in following):
            raise ArithmeticError(f"the values of {column} can't be told apart")
        active = following
    return total, [found[r] for r in wanted]


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation between order statistics; NaN/Inf are ignored."""
    clean = df.select(F.col(column).cast("double").alias("v"))
    known = extent(finite_values(clean, "v"))
    total = known.n
    if total == 0:
        return [None for _ in probabilities]
    places = [(total - 1) * p for p in probabilities]
    needed = {math.floor(x) for x in places} | {math.ceil(x) for x in places}
    _, stats = order_statistics(clean, "v", sorted(needed), known)
    at = {s.rank: float(s.value) for s in stats}
    out: list[float | None] = []
    for x in places:
        lo, hi = at[math.floor(x)], at[math.ceil(x)]
        out.append(lo + (hi - lo) * (x - math.floor(x)))
    return out


def quantile_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: min, p10, p25, p50, p75, p90, max of the finite values."""
    names = ["min", "p10", "p25", "p50", "p75", "p90", "max"]
    rows = [(c, *exact_quantiles(df, c, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])) for c in columns]
    schema = "column string, " + ", ".join(f"`{n}` double" for n in names)
    return df.sparkSession.createDataFrame(rows, schema)


def rank_bucket(df: DataFrame, column: str, name: str, prefix: str = "q", n: int = 10) -> DataFrame:
    """`floor((average rank - 1) * n / count)`, clipped, as `{prefix}{i}`.

    Nulls, NaN and infinities, and columns with at most one distinct finite value, get bucket 0.
    The bucket of a value is decided by `n - 1` boundary values, so rows are only mapped.
    """
    known = extent(finite_values(df, column))
    total = known.n
    if total == 0 or known.lo == known.hi:
        return df.withColumn(name, F.lit(f"{prefix}0"))
    # the value at rank ceil(b * total / n) is the only one that can sit on boundary b
    place = {b: -(-b * total // n) for b in range(1, n)}
    _, stats = order_statistics(df, column, sorted(set(place.values())), known)
    by_rank = {s.rank: s for s in stats}
    bucket = F.lit(0)
    for b in range(1, n):
        s = by_rank.get(place[b])
        if s is None:
            continue
        inclusive = (2 * s.less + s.equal - 1) * n >= 2 * b * total
        reached = F.col(column) >= F.lit(s.value) if inclusive else F.col(column) > F.lit(s.value)
        bucket = bucket + F.when(reached, 1).otherwise(0)
    label = F.when(is_finite(df, column), F.concat(F.lit(prefix), bucket.cast("string"))).otherwise(F.lit(f"{prefix}0"))
    return df.withColumn(name, label)


def _single_valued(df: DataFrame, column: str) -> bool:
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return row["lo"] == row["hi"]


def quantile_bucket(df: DataFrame, column: str, name: str, n: int = 10) -> DataFrame:
    """Bucket between the n-quantiles (right-closed), duplicate edges merged into one."""
    if df.agg(F.count(column)).first()[0] == 0 or _single_valued(df, column):
        return df.withColumn(name, F.lit("q0"))
    edges = exact_quantiles(df, column, [i / n for i in range(1, n)])
    distinct = sorted(set(edges))
    bucket = F.lit(0)
    for e in distinct:
        bucket = bucket + F.when(F.col(column) > F.lit(e), 1).otherwise(0)
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.concat(F.lit("q"), bucket.cast("string"))))


def ordinal_rank(df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """Exact 0-based global rank.

    Range partitions over the whole ordering (ties included, so one hot value is still
    split), row number inside each, plus the sizes of the partitions before. The ranged
    frame is checkpointed because two runs would sample different boundaries.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn("__pid", F.spark_partition_id())
    )
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__pid").orderBy(*order)
    return (
        ranged.withColumn("__rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__pid")  # one row per partition
        .withColumn(name, F.col("__offset") + F.col("__rn") - 1)
        .drop("__pid", "__rn", "__offset")
    )


def rank_correlation(df: DataFrame, a: str, b: str, tie: Sequence[str]) -> DataFrame:
    """Pearson correlation of ordinal ranks; null below two rows or without variance."""
    clean = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b, *tie)
    ranked = ordinal_rank(ordinal_rank(clean, [a, *tie], "__ra"), [b, *tie], "__rb")
    return ranked.agg(F.when(F.count(F.lit(1)) >= 2, F.corr("__ra", "__rb")).alias("rank_correlation"))


def top_ranked_values(df: DataFrame, column: str, ks: Sequence[int], digits: int = 6) -> list[float]:
    """The k-th largest finite values for the given ks, rounded, as scalars."""
    clean = df.select(F.col(column).cast("double").alias("v"))
    known = extent(finite_values(clean, "v"))
    _, stats = order_statistics(clean, "v", [known.n - k for k in ks if 0 < k <= known.n], known)
    return sorted({round(float(s.value), digits) for s in stats})
