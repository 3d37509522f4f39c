"""Down-sampling, deduplication and seeded row sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.slices import DEFAULT_SLICE_NS, int_div, previous_values

# Columns whose change makes a book row an event, and the least change
# that counts for the second tier.
FIRST_TIER = ["best_bid", "best_ask", "total_bid_levels", "total_ask_levels"]
SECOND_TIER = {
    "depth_top1_imbalance": 0.001,
    "depth_top3_imbalance": 0.001,
    "depth_top5_imbalance": 0.001,
    "depth_top10_imbalance": 0.001,
    "depth_top20_imbalance": 0.001,
    "cum_bid_depth_top10": 10.0,
    "cum_ask_depth_top10": 10.0,
    "cum_bid_depth_top20": 10.0,
    "cum_ask_depth_top20": 10.0,
}


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key. The rank limit runs before the shuffle, so a hot key
    reaches its task as one row per input partition."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(window)).where(F.col("__rn") == 1).drop("__rn")


def time_bucket_sample(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], interval_ns: int
) -> DataFrame:
    """The last row per key and time bucket."""
    bucketed = df.withColumn("__bucket", int_div(F.col(order[0]), interval_ns))
    return keep_last(bucketed, [*keys, "__bucket"], order).drop("__bucket")


def change_events(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    first_tier: Sequence[str] | None = None,
    second_tier: dict[str, float] | None = None,
    magnitude: float | None = None,
    min_gap_ns: int = 0,
    slice_width: int = DEFAULT_SLICE_NS,
) -> DataFrame:
    """Rows that differ from the row before them in the same key.

    A first-tier column counts on any change, also to or from null; a second-tier column
    when it moves by more than its threshold (`magnitude` overrides all of them). The
    first row of a key is kept. With `min_gap_ns` a changed row closer than that to the
    changed row before it is dropped as well.
    """
    tier1 = [c for c in (FIRST_TIER if first_tier is None else first_tier) if c in df.columns]
    tier2 = {c: t for c, t in (SECOND_TIER if second_tier is None else second_tier).items() if c in df.columns}
    if not tier1 and not tier2:
        return df
    watched = {f"__p_{c}": c for c in [*tier1, *tier2]}
    with_prev = previous_values(df, keys, order, watched, slice_width, flag="__seen")
    changed: Column = ~F.col("__seen")
    for c in tier1:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    for c, threshold in tier2.items():
        limit = threshold if magnitude is None else magnitude
        changed = changed | F.coalesce(F.abs(F.col(c) - F.col(f"__p_{c}")) > F.lit(limit), F.lit(False))
    events = with_prev.where(changed).drop("__seen", *watched)
    if min_gap_ns <= 0:
        return events
    spaced = previous_values(events, keys, order, {"__p_time": order[0]}, slice_width)
    gap = F.col(order[0]) - F.col("__p_time")
    return spaced.where(gap.isNull() | (gap >= F.lit(min_gap_ns))).drop("__p_time")


def seeded_hash(columns: Sequence[str], seed: int) -> Column:
    """A non-negative 63-bit hash of the row identity and the seed."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]).bitwiseAND(F.lit((1 << 63) - 1))


def take_smallest(
    df: DataFrame,
    parts: Sequence[str],
    hash_col: str,
    quota: DataFrame,
    quota_col: str,
    bits: int = 16,
) -> DataFrame:
    """Per part the rows with the `quota_col` smallest hashes, exactly.

    A histogram over the leading hash bits finds the one bin in which the quota runs
    out; whole bins below it are kept by a filter and only rows of that bin are ranked.
    `quota` has one row per part.
    """
    shift = 63 - bits
    binned = df.withColumn("__bin", F.shiftright(F.col(hash_col), shift))
    counts = binned.groupBy(*parts, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*parts).orderBy("__bin")
    edge = (
        counts.withColumn("__upto", F.sum("__n").over(upto))
        .join(quota, list(parts))
        .where(F.col("__upto") - F.col("__n") < F.col(quota_col))
        .groupBy(*parts)
        .agg(
            F.max("__bin").alias("__edge"),
            F.max(F.col("__upto") - F.col("__n")).alias("__before"),
            F.first(quota_col).alias("__quota"),
        )
    )
    marked = binned.join(edge, list(parts))
    whole = marked.where(F.col("__bin") < F.col("__edge"))
    last = marked.where(F.col("__bin") == F.col("__edge"))
    rank = F.row_number().over(Window.partitionBy(*parts).orderBy(hash_col))
    part = last.withColumn("__rn", rank).where(F.col("__rn") <= F.col("__quota") - F.col("__before")).drop("__rn")
    return whole.unionByName(part).select(*df.columns)


def balanced_sample(
    df: DataFrame,
    parts: Sequence[str],
    label: str,
    row_id: Sequence[str],
    seed: int,
    where: Column | None = None,
    cap: int | None = None,
) -> DataFrame:
    """All rows with label 1 and as many others per part, drawn by seeded hash.

    A part without positives (or without others) is kept whole. `where` restricts the
    rows first; `cap` bounds the size of each part afterwards.
    """
    rows = df if where is None else df.where(where)
    rows = rows.withColumn("__hash", seeded_hash(row_id, seed)).withColumn(
        "__pos", F.coalesce(F.col(label) == 1, F.lit(False))
    )
    sizes = rows.groupBy(*parts).agg(
        F.count_if("__pos").alias("__n_pos"), F.count_if(~F.col("__pos")).alias("__n_neg")
    )
    quota = sizes.select(
        *parts,
        F.when((F.col("__n_pos") > 0) & (F.col("__n_neg") > 0), F.least("__n_pos", "__n_neg"))
        .otherwise(F.col("__n_neg"))
        .alias("__quota"),
    )
    others = take_smallest(rows.where(~F.col("__pos")), parts, "__hash", quota, "__quota")
    sample = rows.where("__pos").unionByName(others)
    if cap is not None:
        limit = sample.select(*parts).distinct().withColumn("__cap", F.lit(cap).cast("long"))
        sample = take_smallest(sample, parts, "__hash", limit, "__cap")
    return sample.drop("__hash", "__pos")


def uniform_cap(df: DataFrame, max_rows: int, row_id: Sequence[str], seed: int) -> DataFrame:
    """A seeded uniform sample of exactly `max_rows` rows (all rows if there are fewer)."""
    rows = df.withColumn("__hash", seeded_hash(row_id, seed)).withColumn("__all", F.lit(0))
    quota = df.sparkSession.range(1).select(F.lit(0).alias("__all"), F.lit(max_rows).cast("long").alias("__quota"))
    return take_smallest(rows, ["__all"], "__hash", quota, "__quota").drop("__hash", "__all")
