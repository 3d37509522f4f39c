"""Minimum over a forward time interval on another stream, at constant cost per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.slices import int_div


def forward_interval_min(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_on: str,
    right_on: str,
    row_id: Sequence[str],
    value: str,
    lo: int,
    hi: int,
    value_name: str,
    time_name: str,
) -> DataFrame:
    """For each left row the least `value` of right rows of the key in `[t+lo, t+hi]`.

    Ties take the latest time. `row_id` identifies a left row. The interval has one
    fixed length, so cutting the key's time axis into blocks of that length makes it
    the tail of one block plus the head of the next: two running minima answer every
    row, where a RANGE frame would rescan all rows of the interval for each row.
    """
    width = max(0, hi - lo) + 1
    start = F.col(left_on).cast("long") + F.lit(lo)
    ids = [f"__id{i}" for i in range(len(row_id))]

    # every row asks twice: what follows its start in that block, what precedes its end in that one
    ask = F.explode(
        F.array(
            F.struct(start.alias("__t"), F.lit(1).alias("__side")),
            F.struct((start + F.lit(width - 1)).alias("__t"), F.lit(2).alias("__side")),
        )
    )
    points = (
        left.where(F.col(left_key).isNotNull() & F.col(left_on).isNotNull())
        .select(F.col(left_key).alias("__key"), *[F.col(c).alias(i) for c, i in zip(row_id, ids)], ask.alias("__ask"))
        .select("__key", "__ask.*", *ids)
        .withColumn("__block", int_div(F.col("__t"), width))
    )
    t = F.col(right_on).cast("long")
    events = right.where(F.col(right_key).isNotNull() & t.isNotNull() & F.col(value).isNotNull()).select(
        F.col(right_key).alias("__key"),
        t.alias("__t"),
        F.lit(0).alias("__side"),
        int_div(t, width).alias("__block"),
        F.struct(F.col(value).cast("double").alias("value"), (-t).alias("neg_time")).alias("__event"),
    )
    stacked = points.unionByName(events, allowMissingColumns=True)

    block = Window.partitionBy("__key", "__block")
    head = block.orderBy(F.col("__t").asc(), F.col("__side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    tail = block.orderBy(F.col("__t").desc(), F.col("__side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    answers = (
        stacked.select("__side", *ids, F.min("__event").over(head).alias("__head"), F.min("__event").over(tail).alias("__tail"))
        .where(F.col("__side") > 0)
        .select(*ids, F.when(F.col("__side") == 1, F.col("__tail")).otherwise(F.col("__head")).alias("__best"))
        .groupBy(*ids)
        .agg(F.min("__best").alias("__best"))
        .select(
            *[F.col(i).alias(c) for c, i in zip(row_id, ids)],
            F.col("__best.value").alias(value_name),
            (-F.col("__best.neg_time")).alias(time_name),
        )
    )
    return left.join(answers, list(row_id), "left")
