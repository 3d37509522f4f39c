"""Greedy selection of spaced signals, in the order the online gates apply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import NS_PER_SECOND
from tickloom.operators.slices import DEFAULT_SLICE_NS, int_div, null_safe_join, previous_values, spread_for_python, with_position
from tickloom.session import cut_lineage


def _chain(times, gap: int):
    """For picks starting at each candidate: time from which the next pick is free, and count."""
    import numpy as np

    n = len(times)
    after = np.searchsorted(times, times + gap, side="left")
    free, count = [0] * n, [0] * n
    for j in range(n - 1, -1, -1):
        k = int(after[j])
        free[j], count[j] = (int(times[j]) + gap, 1) if k >= n else (free[k], count[k] + 1)
    return after, free, count


def greedy_spaced(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    min_gap_ns: int,
    max_per_key: int = 0,
    slice_width: int | None = None,
    most_rows: int = 100_000,
) -> DataFrame:
    """Rows picked when the first row of a key, and then each row at least `min_gap_ns`
    after the last pick, is taken; at most `max_per_key` per key (0 = no limit).

    A key of at most `most_rows` rows is walked in order, one row after the other. A larger
    key is cut into slices. A slice is summarised by where a chain of picks leaves it
    for each way of entering it (only its first `min_gap_ns` matter), the chain is walked
    over those summaries, and the picks inside the slices follow independently.
    (`keys`, `order`) must identify a row.
    """
    if max_per_key == 1:
        # the first row per key; the rank limit runs before the shuffle
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("__n", first).where(F.col("__n") == 1).drop("__n")
    if min_gap_ns <= 0:
        if max_per_key <= 0:
            return df
        numbered = with_position(df, keys, order, "__n", slice_width or DEFAULT_SLICE_NS)
        return numbered.where(F.col("__n") <= max_per_key).drop("__n")

    df = cut_lineage(df, "spaced")  # read to count the keys and to walk them
    if not keys:
        return _spaced_by_slices(df, keys, order, min_gap_ns, max_per_key, slice_width)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most_rows).drop("__n")
    large = cut_lineage(large, "large-keys")
    if large.isEmpty():
        return _spaced_in_order(df, keys, order, min_gap_ns, max_per_key)
    few = null_safe_join(df, large, keys, "left_anti")
    many = null_safe_join(df, large, keys, "inner")
    return _spaced_in_order(few, keys, order, min_gap_ns, max_per_key).unionByName(
        _spaced_by_slices(many, keys, order, min_gap_ns, max_per_key, slice_width)
    )


def _spaced_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], min_gap_ns: int, max_per_key: int) -> DataFrame:
    """The picks of keys that are in one task each, whatever batches they are in."""
    time = order[0]

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        key, free, taken = None, None, 0
        for batch in batches:
            picked = np.zeros(batch.num_rows, bool)
            rows = zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column(time).to_pylist())
            for i, (k, at) in enumerate(rows):
                # a NaN isn't equal to itself
                if key is None or k != key and any(x != y and (x == x or y == y) for x, y in zip(k, key)):
                    key, free, taken = k, None, 0
                if (free is None or at >= free) and not (max_per_key and taken >= max_per_key):
                    picked[i], free, taken = True, at + min_gap_ns, taken + 1
            yield batch.filter(pa.array(picked))

    sorted_rows = spread_for_python(df, keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(walk, df.schema)


def _spaced_by_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], min_gap_ns: int, max_per_key: int, slice_width: int | None
) -> DataFrame:
    """The picks of keys that are cut into slices."""
    time = order[0]
    width = max(slice_width or min_gap_ns * 360, min_gap_ns)
    part = [*keys, "__slice"]
    narrow = spread_for_python(df.select(*keys, *order).withColumn("__slice", int_div(F.col(time), width)), part)
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*part).schema)

    def summarise(pdf):
        import pandas as pd

        times = pdf[time].sort_values(kind="stable").to_numpy(dtype="int64")
        _, free, count = _chain(times, min_gap_ns)
        bound = int(pdf["__slice"].iloc[0]) * width + min_gap_ns - 1
        # entering later than `bound` is impossible: the last pick was before the slice
        ways = [j for j in range(len(times)) if j == 0 or times[j - 1] < bound]
        head = {c: [pdf[c].iloc[0]] * len(ways) for c in part}
        return pd.DataFrame({**head, "at": times[ways], "free": [free[j] for j in ways], "n": [count[j] for j in ways]})

    summaries = narrow.groupBy(*part).applyInPandas(summarise, f"{key_ddl}, at long, free long, n long")

    def walk(batches):
        import pandas as pd

        key, slice_id, free, taken, entered = None, None, None, 0, False
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False, name=None):
                k, s, at = r[: len(keys)], r[len(keys)], r[len(keys) + 1]
                if k != key:
                    key, slice_id, free, taken, entered = k, None, None, 0, False
                if s != slice_id:
                    slice_id, entered = s, False
                if entered or (free is not None and at < free) or (max_per_key and taken >= max_per_key):
                    continue
                rows.append((*k, s, at, taken))
                free, taken, entered = r[len(keys) + 2], taken + r[len(keys) + 3], True
            yield pd.DataFrame(rows, columns=[*part, "entry", "taken"])

    ordered = summaries.repartition(*keys).sortWithinPartitions(*keys, "__slice", "at") if keys else summaries.coalesce(
        1
    ).sortWithinPartitions("__slice", "at")
    entries = ordered.mapInPandas(walk, f"{key_ddl}, entry long, taken long")

    def pick(candidates, entry):
        import pandas as pd

        if entry.empty or candidates.empty:
            return pd.DataFrame(columns=[*part, *order])
        rows = candidates.sort_values(list(order), kind="stable").reset_index(drop=True)
        times = rows[time].to_numpy(dtype="int64")
        after, _, _ = _chain(times, min_gap_ns)
        j, taken, chosen = int(times.searchsorted(entry["entry"].iloc[0])), int(entry["taken"].iloc[0]), []
        while j < len(times) and not (max_per_key and taken >= max_per_key):
            chosen.append(j)
            taken += 1
            j = int(after[j])
        return rows.loc[chosen, [*part, *order]]

    order_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*order).schema)
    picked = narrow.groupBy(*part).cogroup(spread_for_python(entries, part).groupBy(*part)).applyInPandas(pick, f"{key_ddl}, {order_ddl}")
    ids = picked.select(*keys, *order).withColumn("__picked", F.lit(True))
    return null_safe_join(df, ids, [*keys, *order], "inner").drop("__picked")


def signal_key() -> Column:
    """`market:outcome`, falling back to slug and asset."""
    market = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("market_id", "slug", "asset_id")])
    return F.concat_ws(":", market, F.coalesce(F.nullif(F.col("outcome"), F.lit("")), F.col("asset_id")))


def entry_allowed(
    min_ask: float = 0.0, max_ask: float = 1.0, max_spread: float = 0.05, min_tte: float = 0.0
) -> Column:
    """Structural entry filter; any missing value blocks."""
    ok = (
        (F.col("best_bid") > 0)
        & F.col("best_ask").between(min_ask, max_ask)
        & (F.col("current_spread") <= max_spread)
        & (F.col("time_to_expiry_seconds") >= min_tte)
    )
    return F.coalesce(ok, F.lit(False))


def live_like_selection(
    candidates: DataFrame,
    group: Sequence[str] = (),
    cooldown_seconds: float = 10.0,
    max_entries: int = 1,
    entry: Column | None = None,
    slice_width: int | None = None,
) -> DataFrame:
    """Rows an online run would signal on: opposite known, entry filter, cooldown, limit.

    `group` separates policies evaluated side by side. The signal key is `market:outcome`.
    """
    usable = candidates.where(F.col("opposite_asset_id").isNotNull()).where(entry_allowed() if entry is None else entry)
    keyed = usable.withColumn("signal_key", signal_key())
    return greedy_spaced(
        keyed, [*group, "signal_key"], ["recv_ns", "seq"], int(cooldown_seconds * NS_PER_SECOND), max_entries, slice_width
    )


def crossing(df: DataFrame, score: str, slice_width: int = DEFAULT_SLICE_NS) -> DataFrame:
    """Rows with a finite score and `previous_score`: the asset's row before (null if none).

    A missing previous score counts as minus infinity, so it lies below any threshold.
    """
    bad = F.isnan(F.col(score)) | (F.abs(F.col(score)) == F.lit(float("inf")))
    clean = df.withColumn("__score", F.when(~bad, F.col(score)))
    prev = previous_values(clean, ["asset_id"], ["recv_ns", "seq"], {"__prev_score": "__score"}, slice_width, flag="__seen")
    value = F.when(F.col("__seen"), F.coalesce("__prev_score", F.lit(float("-inf"))))
    return prev.where(F.col("__score").isNotNull()).withColumn("previous_score", value).drop("__score", "__prev_score", "__seen")


def threshold_signals(
    df: DataFrame,
    score: str,
    thresholds: Sequence[float],
    slice_width: int = DEFAULT_SLICE_NS,
    **gates,
) -> DataFrame:
    """Live-like selection at each threshold, on upward crossings only."""
    crossed = crossing(df, score, slice_width)
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    at = crossed.withColumn("threshold", levels).where(
        (F.col(score) >= F.col("threshold"))
        & (F.col("previous_score").isNull() | (F.col("previous_score") < F.col("threshold")))
    )
    return live_like_selection(at, ["threshold"], **gates).drop("previous_score")


def spaced_samples(df: DataFrame, interval_ns: int, keys: Sequence[str] = ("asset_id",)) -> DataFrame:
    """Rows at least `interval_ns` after the asset's last kept row."""
    return greedy_spaced(df, keys, ["recv_ns", "seq"], interval_ns)


def quiet_spells(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit_ns: int, slice_width: int = DEFAULT_SLICE_NS) -> DataFrame:
    """Gaps longer than `limit_ns` between consecutive rows of a source: start, end, length."""
    prev = previous_values(df.select(*keys, *order), keys, order, {"quiet_from": order[0]}, slice_width)
    gap = F.col(order[0]) - F.col("quiet_from")
    return prev.where(gap > F.lit(limit_ns)).select(*keys, "quiet_from", F.col(order[0]).alias("quiet_to"), gap.alias("gap_ns"))
