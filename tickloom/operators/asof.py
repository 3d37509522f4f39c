"""As-of joins with a tolerance.

Every lookup here has a finite tolerance, so both sides are cut into time buckets and
a right row is copied into the (at most few) buckets from which it can be matched.
That makes the un-keyed form as parallel as the keyed one and keeps a hot key out of
a single task. Several lookups over the same left rows share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.slices import HALO_FACTOR, int_div

# Buckets in a tolerance for a feed of a few keys that all left rows look into: time alone cuts such a feed.
FEED_BUCKETS = 2


@dataclass(frozen=True)
class Lookup:
    """One right side: `columns` = {output name: right column}.

    `shift` is added to the right time first, so a backward lookup with shift `d`
    finds the value at `t - d` and a forward lookup with shift `-h` the one at `t + h`.
    """

    right: DataFrame
    on: str
    columns: dict[str, str]
    tolerance: int
    shift: int = 0
    seq: str | None = None
    matched_at: str | None = None
    by: Sequence[str] | None = field(default=None)


def feed_width(lookups: Sequence[Lookup]) -> int:
    """Narrow buckets for dense feeds: a task holds one bucket, a right row is copied into three at most."""
    return max(1, max(k.tolerance for k in lookups) // FEED_BUCKETS)


def asof_lookups(
    left: DataFrame,
    left_on: str,
    lookups: Sequence[Lookup],
    by: Sequence[str] = (),
    direction: str = "backward",
    bucket_width: int | None = None,
) -> DataFrame:
    """Left rows with the nearest right row per lookup, nulls where none is in reach.

    Equal times match. Among right rows of one time the last (backward) or the first
    (forward) by `seq` is taken. Left rows with a null key survive unmatched.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, got {direction!r}")
    backward = direction == "backward"
    width = bucket_width or (max(1, max(k.tolerance for k in lookups) * HALO_FACTOR) if by else feed_width(lookups))
    keys = [f"__k{i}" for i in range(len(by))]

    parts = [
        left.select(
            *[F.col(c).alias(k) for c, k in zip(by, keys)],
            F.col(left_on).cast("long").alias("__t"),
            F.lit(1).alias("__side"),
            F.lit(None).cast("long").alias("__seq"),
            int_div(F.col(left_on).cast("long"), width).alias("__bucket"),
            F.struct(*[F.col(c) for c in left.columns]).alias("__left"),
        )
    ]
    for i, k in enumerate(lookups):
        right_by = list(k.by or by)
        t = F.col(k.on).cast("long") + F.lit(k.shift)
        first, last = (t, t + F.lit(k.tolerance)) if backward else (t - F.lit(k.tolerance), t)
        usable = k.right.where(F.col(k.on).isNotNull())
        for c in right_by:
            usable = usable.where(F.col(c).isNotNull())
        parts.append(
            usable.select(
                *[F.col(c).alias(n) for c, n in zip(right_by, keys)],
                t.alias("__t"),
                F.lit(0).alias("__side"),
                (F.col(k.seq).cast("long") if k.seq else F.lit(None).cast("long")).alias("__seq"),
                F.explode(F.sequence(int_div(first, width), int_div(last, width))).alias("__bucket"),
                F.struct(t.alias("__t"), *[F.col(c).alias(n) for n, c in k.columns.items()]).alias(f"__m{i}"),
            )
        )
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)

    if backward:
        ordering = [F.col("__t").asc(), F.col("__side").asc(), F.col("__seq").asc()]
    else:
        ordering = [F.col("__t").desc(), F.col("__side").asc(), F.col("__seq").desc()]
    window = (
        Window.partitionBy(*keys, "__bucket").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    )
    found = stacked.select(
        "__t", "__left", *[F.last(f"__m{i}", ignorenulls=True).over(window).alias(f"__m{i}") for i in range(len(lookups))]
    ).where(F.col("__left").isNotNull())

    columns = [F.col(f"__left.{c}").alias(c) for c in left.columns]
    for i, k in enumerate(lookups):
        in_reach = F.abs(F.col("__t") - F.col(f"__m{i}.__t")) <= F.lit(k.tolerance)
        columns += [F.when(in_reach, F.col(f"__m{i}.{n}")).alias(n) for n in k.columns]
        if k.matched_at:
            columns.append(F.when(in_reach, F.col(f"__m{i}.__t") - F.lit(k.shift)).alias(k.matched_at))
    return found.select(*columns)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    columns: dict[str, str] | Sequence[str],
    tolerance: int,
    by: Sequence[str] = (),
    direction: str = "backward",
    seq: str | None = None,
    matched_at: str | None = None,
    bucket_width: int | None = None,
) -> DataFrame:
    """One as-of lookup; see `asof_lookups`."""
    named = columns if isinstance(columns, dict) else {c: c for c in columns}
    lookup = Lookup(right, right_on, named, tolerance, seq=seq, matched_at=matched_at)
    return asof_lookups(left, left_on, [lookup], by, direction, bucket_width)


def asof_adaptive(
    left: DataFrame,
    left_on: str,
    lookups: Sequence[Lookup],
    left_key: str,
    right_key: str,
    keyed: bool = True,
    bucket_width: int | None = None,
) -> DataFrame:
    """As-of by key, or over the whole feed for a feed of one key whose name the left side doesn't know.

    The choice is the caller's and not the data's, so a feed that lacks a key never lends it another's prices.
    A feed has few keys, each of them dense: buckets are narrow unless `bucket_width` says otherwise.
    """
    bucket_width = bucket_width or feed_width(lookups)
    if keyed:
        keyed = [
            Lookup(k.right, k.on, k.columns, k.tolerance, k.shift, k.seq, k.matched_at, [right_key]) for k in lookups
        ]
        return asof_lookups(left, left_on, keyed, [left_key], bucket_width=bucket_width)
    return asof_lookups(left, left_on, lookups, bucket_width=bucket_width)


def shifted_lookups(
    right: DataFrame,
    on: str,
    value: str,
    offsets: dict[str, int],
    tolerances: dict[str, int],
    seq: str | None = None,
) -> list[Lookup]:
    """Lookups of `value` at `t - offset` for each named offset, to be fused in one pass."""
    return [Lookup(right, on, {name: value}, tolerances[name], shift=offset, seq=seq) for name, offset in offsets.items()]
