"""Windows over keys that may hold any share of the rows.

A plain `PARTITION BY key` window puts a whole key into one task. Here every key is
also cut along time (or along row position), so that a key with a third of all rows
is spread over as many tasks as it has slices. What a frame needs from a neighbouring
slice is either copied there (a halo, for frames of bounded reach) or carried as one
summary row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

HALO_FACTOR = 64
DEFAULT_SLICE_NS = 900 * 1_000_000_000
DEFAULT_BLOCK_ROWS = 1 << 18


def int_div(col: Column, n: int) -> Column:
    """Floor division of a long column (plain `/` would go through double)."""
    width = F.lit(n).cast("long")
    return F.call_function("div", col - F.pmod(col, width), width)


def spread_for_python(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partitioned by `keys` into the session's number of shuffle partitions.

    Adaptive execution merges partitions by bytes. Python work per row is far dearer than
    its bytes suggest, so such stages keep the full parallelism.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match null keys; the key columns come from `left`."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"__l.{k}").eqNullSafe(F.col(f"__r_{k}"))
    return left.alias("__l").join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


@dataclass(frozen=True)
class Frame:
    """One aggregate over the rows with `lo <= order - current <= hi`."""

    name: str
    agg: Column
    lo: int
    hi: int


def range_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    frames: Sequence[Frame],
    slice_width: int | None = None,
) -> DataFrame:
    """Add every RANGE aggregate in `frames` with one shuffle on (keys, time slice).

    A row is copied to each slice in which some row can see it. With the default
    width of 64 times the total reach at most about 1.6 % of the rows are copied.
    """
    back = max(0, -min(f.lo for f in frames))
    ahead = max(0, max(f.hi for f in frames))
    width = slice_width or max(1, (back + ahead) * HALO_FACTOR)
    sliced = time_slices(df, order, back, ahead, width)
    window = Window.partitionBy(*keys, "__slice").orderBy(order)
    return own_rows(sliced.select("*", *[f.agg.over(window.rangeBetween(f.lo, f.hi)).alias(f.name) for f in frames]))


def time_slices(df: DataFrame, order: str, back: int, ahead: int, width: int) -> DataFrame:
    """Each row in every slice from which it can be seen (`__slice`), and its own (`__home`)."""
    t = F.col(order)
    return df.withColumn("__home", int_div(t, width)).withColumn(
        "__slice",
        F.explode_outer(F.sequence(int_div(t - F.lit(ahead), width), int_div(t + F.lit(back), width))),
    )


def own_rows(sliced: DataFrame) -> DataFrame:
    """Every row once, in its own slice."""
    return sliced.where(F.col("__slice").eqNullSafe(F.col("__home"))).drop("__slice", "__home")


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    slice_width: int = DEFAULT_SLICE_NS,
    flag: str | None = None,
) -> DataFrame:
    """`lag(1)` per key for `values` = {new name: column}.

    Inside a time slice this is an ordinary `lag`. The first row of a slice takes the
    last row of the key's previous slice, known from one summary row per slice.
    `flag` names a boolean column that is true where a previous row exists.
    """
    names = list(values)
    sliced = df.withColumn("__slice", int_div(F.col(order[0]), slice_width))
    payload = F.struct(F.lit(True).alias("__seen"), *[F.col(values[n]).alias(n) for n in names])
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    summary = sliced.groupBy(*keys, "__slice").agg(
        F.max_by(payload, F.struct(*[F.col(c) for c in order])).alias("__last")
    )
    across = Window.partitionBy(*keys).orderBy("__slice")
    carried = summary.select(*keys, "__slice", F.lag("__last").over(across).alias("__carry"))
    out = null_safe_join(
        sliced.withColumn("__lag", F.lag(payload).over(inside)), carried, [*keys, "__slice"]
    ).withColumn("__prev", F.coalesce("__lag", "__carry"))
    for n in names:
        out = out.withColumn(n, F.col(f"__prev.{n}"))
    if flag:
        out = out.withColumn(flag, F.col("__prev").isNotNull())
    return out.drop("__slice", "__lag", "__carry", "__prev")


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    slice_width: int = DEFAULT_SLICE_NS,
) -> DataFrame:
    """Exact 1-based row number per key without a whole key in one task.

    Row number inside (key, time slice) plus the row count of the key's earlier slices.
    """
    sliced = df.withColumn("__slice", int_div(F.col(order[0]), slice_width))
    counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    numbered = sliced.withColumn("__rn", F.row_number().over(inside))
    return (
        null_safe_join(numbered, offsets, [*keys, "__slice"])
        .withColumn(name, F.col("__offset") + F.col("__rn"))
        .drop("__slice", "__rn", "__offset")
    )


@dataclass(frozen=True)
class RowFrame:
    """One aggregate over the current row and the `rows - 1` rows before it.

    The value is null until `rows` rows exist, unless `partial` is set.
    """

    name: str
    agg: Column
    rows: int
    partial: bool = False


def row_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    frames: Sequence[RowFrame],
    slice_width: int = DEFAULT_SLICE_NS,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """ROWS aggregates on blocks of `block_rows` consecutive rows of a key.

    Blocks follow the exact position in the key, so they are equally large however
    unevenly rows are spread over keys or time.
    """
    reach = max(f.rows for f in frames) - 1
    out = block_values(row_blocks(df, keys, order, reach, slice_width, block_rows), keys, frames)
    return out.where(F.col("__block") == F.col("__home")).drop("__block", "__home", "__pos")


def row_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int, slice_width: int, block_rows: int
) -> DataFrame:
    """Each row in its own block (`__home`) and in the next ones that look back `reach` rows (`__block`)."""
    placed = with_position(df, keys, order, "__pos", slice_width)
    zero = F.col("__pos") - 1
    return placed.withColumn("__home", int_div(zero, block_rows)).withColumn(
        "__block", F.explode(F.sequence(int_div(zero, block_rows), int_div(zero + F.lit(reach), block_rows)))
    )


def block_values(blocked: DataFrame, keys: Sequence[str], frames: Sequence[RowFrame]) -> DataFrame:
    """The frames' aggregates inside each block."""
    window = Window.partitionBy(*keys, "__block").orderBy("__pos")

    def value(f: RowFrame) -> Column:
        agg = f.agg.over(window.rowsBetween(-(f.rows - 1), 0))
        return agg if f.partial else F.when(F.col("__pos") >= f.rows, agg)

    return blocked.select("*", *[value(f).alias(f.name) for f in frames])
