"""Exponentially weighted means as ordinary window sums.

`mean_t = sum_i x_i w^(n_t - n_i) / sum_i w^(n_t - n_i)` with `n` the count of non-null
values so far. Values are numbered per key, cut into chunks of `CHUNK` values, and each
chunk holds running sums with weights relative to its own start. Each chunk adds its total to the
`REACH` chunks behind it; over so many, the weight falls below the ratio of the smallest to the largest
double, so nothing is lost and no key has to be walked in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.slices import DEFAULT_SLICE_NS, int_div, null_safe_join, with_position
from tickloom.session import cut_lineage, drop_written

SMALLEST_WEIGHT = 1e-24
REACH = 27  # SMALLEST_WEIGHT ** REACH is 1e-648; doubles span 1e632


def chunk_length(spans: Sequence[int]) -> int:
    """Values after which the slowest weight is below `SMALLEST_WEIGHT`."""
    slowest = max(1.0 - 2.0 / (s + 1.0) for s in spans)
    return max(8, math.ceil(math.log(SMALLEST_WEIGHT) / math.log(slowest)))


def ewma(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    spans: dict[str, int],
    slice_width: int = DEFAULT_SLICE_NS,
    written: list | None = None,
) -> DataFrame:
    """Add `{column}_ewma_{name}` for each column and each named span (adjusted weights).

    (`keys`, `order`) must identify a row. Null inputs are skipped and get a null. The numbered
    values, which are read twice, and the means are written, so that no two steps hold shuffle files at once;
    the means are added to `written`, to be dropped when the result has been read.
    With names `fast` and `slow` present, `{column}_ewma_diff` is added as well.
    """
    chunk = chunk_length(list(spans.values()))
    row = [*keys, *order]
    source = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    )
    values = df.select(*row, source.alias("__v")).select(*row, "__v.i", "__v.x").where(F.col("x").isNotNull())
    numbered = with_position(values, [*keys, "i"], order, "__n", slice_width)
    placed = numbered.withColumn("__chunk", int_div(F.col("__n") - 1, chunk)).withColumn(
        "__e", F.pmod(F.col("__n") - 1, F.lit(chunk)).cast("double")
    )
    placed = cut_lineage(placed, "numbered")

    inside = Window.partitionBy(*keys, "i", "__chunk").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    local, totals = [], []
    for name, span in spans.items():
        weight = F.pow(F.lit(1.0 - 2.0 / (span + 1.0)), -F.col("__e"))
        local += [
            F.sum(F.col("x") * weight).over(inside).alias(f"__num_{name}"),
            F.sum(weight).over(inside).alias(f"__den_{name}"),
        ]
        aged = F.pow(F.lit(1.0 - 2.0 / (span + 1.0)), F.lit(chunk - 1) - F.col("__e"))  # relative to the chunk's last value
        totals += [F.sum(F.col("x") * aged).alias(f"__pnum_{name}"), F.sum(aged).alias(f"__pden_{name}")]
    reached = placed.groupBy(*keys, "i", "__chunk").agg(*totals).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(REACH - 1))))
    carried = [
        F.sum(F.col(f"__p{part}_{name}") * F.pow(F.lit((1.0 - 2.0 / (span + 1.0)) ** chunk), F.col("__k")) * F.lit(1.0 - 2.0 / (span + 1.0))).alias(f"__p{part}_{name}")
        for name, span in spans.items()
        for part in ("num", "den")
    ]
    before = reached.groupBy(*keys, "i", (F.col("__chunk") + 1 + F.col("__k")).alias("__chunk")).agg(*carried)
    conditions = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "i", "__chunk"]]
    joined = placed.select("*", *local).alias("a").join(before.alias("b"), conditions, "left")

    means = []
    for name in spans:
        num = F.col(f"a.__num_{name}") + F.coalesce(F.col(f"b.__pnum_{name}"), F.lit(0.0))
        den = F.col(f"a.__den_{name}") + F.coalesce(F.col(f"b.__pden_{name}"), F.lit(0.0))
        means.append((num / den).alias(name))
    long = joined.select(*[F.col(f"a.{c}").alias(c) for c in [*row, "i"]], *means)

    wide = long.groupBy(*row).agg(
        *[
            F.max(F.when(F.col("i") == i, F.col(name))).alias(f"{c}_ewma_{name}")
            for i, c in enumerate(columns)
            for name in spans
        ]
    )
    if {"fast", "slow"} <= set(spans):
        wide = wide.select(
            "*", *[(F.col(f"{c}_ewma_fast") - F.col(f"{c}_ewma_slow")).alias(f"{c}_ewma_diff") for c in columns]
        )
    wide = cut_lineage(wide, "means")
    drop_written(placed)
    if written is not None:
        written.append(wide)
    return null_safe_join(df, wide, row)
