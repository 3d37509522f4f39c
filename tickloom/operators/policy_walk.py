"""Spaced selection under all combinations of thresholds in one ordered walk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_of(score: Column, levels: Sequence[float]) -> Column:
    """How many of the ascending levels a score reaches; a null reaches none."""
    return F.coalesce(sum((F.when(score >= x, 1).otherwise(0) for x in map(float, levels)), F.lit(0)), F.lit(0))


def walk_policies(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    dims: dict[str, tuple[str, Sequence[float]]],
    profit: str,
    success: Column,
    min_gap_ns: int,
    max_per_key: int = 1,
) -> DataFrame:
    """Statistics of what every policy selects: its levels, entries, profits, total_profit, successes.

    `dims`: {name: (score column, levels)}; a policy is one level of each. Under a policy, a key's
    first row that reaches all its levels is taken, then each at least `min_gap_ns` after the one taken before, at most
    `max_per_key` (0 = no limit).

    A row carries only the cell of levels it reaches, so no row is multiplied: the policies it may serve are
    one corner of the grid, kept as arrays of next-free times and counts while a key's rows pass in
    order. Keys are sorted by Spark and streamed, whatever their length. With one selection per
    key, only the first row of each (key, cell) can be selected, and Spark reduces to those before the shuffle.
    """
    names = list(dims)
    levels = [sorted({float(x) for x in dims[d][1]}) for d in names]
    shape = tuple(map(len, levels))
    size = 1
    for n in shape:
        size *= n
    cells = [cell_of(F.col(dims[d][0]), ls).cast("int").alias(f"__c{i}") for i, (d, ls) in enumerate(zip(names, levels, strict=True))]
    at = [f"__c{i}" for i in range(len(names))]
    narrow = rows.select(F.col(key).alias("__key"), *order, *cells, F.col(profit).cast("double").alias("__profit"), F.coalesce(success, F.lit(False)).alias("__success"))
    narrow = narrow.where(" AND ".join(f"{c} > 0" for c in at))
    if max_per_key == 1:
        first = F.min(F.struct(*order, "__profit", "__success")).alias("first")
        narrow = narrow.groupBy("__key", *at).agg(first).select("__key", *at, "first.*")

    def walk(batches):
        import numpy as np
        import pandas as pd

        present, free, taken = None, None, None
        for pdf in batches:
            entries, known, total, good = (np.zeros(shape) for _ in range(4))
            values = zip(pdf["__key"], pdf[order[0]], pdf["__profit"], pdf["__success"], *[pdf[c] for c in at], strict=True)
            for k, t, value, won, *corner in values:
                if present is None or k != present[0]:
                    present, free, taken = (k,), np.full(shape, np.iinfo(np.int64).min), np.zeros(shape, np.int64)
                part = tuple(slice(0, c) for c in corner)
                pick = free[part] <= t
                if max_per_key:
                    pick &= taken[part] < max_per_key
                if not pick.any():
                    continue
                free[part][pick] = t + min_gap_ns
                taken[part] += pick
                entries[part] += pick
                good[part] += pick & won
                if value == value:
                    known[part] += pick
                    total[part] += pick * value
            used = np.flatnonzero(entries)
            yield pd.DataFrame({"policy": used, **{n: x.reshape(-1)[used] for n, x in (("entries", entries), ("profits", known), ("total_profit", total), ("successes", good))}})

    ordered = narrow.where(F.col("__key").isNotNull()).repartition("__key").sortWithinPartitions("__key", *order)
    sums = ordered.mapInPandas(walk, "policy long, entries double, profits double, total_profit double, successes double").groupBy("policy").agg(
        *[F.sum(c).alias(c) for c in ("entries", "profits", "total_profit", "successes")]
    )
    place, each = F.col("id"), []
    for d, ls in reversed(list(zip(names, levels, strict=True))):
        each.append(F.element_at(F.array(*map(F.lit, ls)), (place % len(ls) + 1).cast("int")).alias(d))
        place = F.floor(place / len(ls))
    grid = rows.sparkSession.range(size)
    out = grid.join(sums, grid.id == sums.policy, "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("entries", "profits", "successes")]
    return out.select(*reversed(each), *counts, F.col("total_profit"))
