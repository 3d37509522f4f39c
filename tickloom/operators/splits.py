"""Chronological splits by row count, with purge and embargo.

The cuts are order statistics of `(time, seq)`. Finding them only counts rows, and a
split is then a filter: the data is neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ranks import order_statistics

Cut = tuple[int, int]


def cuts_at(df: DataFrame, time: str, seq: str, ranks: Sequence[int]) -> tuple[int, dict[int, Cut]]:
    """Row count and the `(time, seq)` of the rows at the given 0-based ranks."""
    total, stats = order_statistics(df, time, ranks)
    out: dict[int, Cut] = {}
    for s in stats:
        same = df.where(F.col(time) == F.lit(s.value))
        if s.equal == 1:
            out[s.rank] = (s.value, same.agg(F.min(seq)).first()[0])
        else:
            _, inner = order_statistics(same, seq, [s.rank - s.less])
            out[s.rank] = (s.value, inner[0].value)
    return total, out


def at_or_after(time: str, seq: str, cut: Cut) -> Column:
    """Whether a row stands at or after the cut in `(time, seq)` order."""
    t, q = cut
    return (F.col(time) > F.lit(t)) | ((F.col(time) == F.lit(t)) & (F.col(seq) >= F.lit(q)))


def chronological_split(
    df: DataFrame,
    train: float = 0.70,
    validation: float = 0.15,
    test: float = 0.15,
    time: str = "recv_ns",
    seq: str = "seq",
    purge_ms: int = 0,
    embargo_ms: int = 0,
    name: str = "split",
) -> DataFrame:
    """`df` with a column naming the split of each row; purged rows are left out.

    Purge drops rows of the earlier split whose label window can reach over the border,
    embargo drops rows of the later split right behind it.
    """
    if abs(train + validation + test - 1.0) > 1e-6:
        raise ValueError("split fractions must sum to 1")
    n = df.where(F.col(time).isNotNull()).count()
    n_train = int(n * train)
    n_val = n_train + int(n * validation)
    _, cuts = cuts_at(df, time, seq, [n_train, n_val])
    is_val = at_or_after(time, seq, cuts[n_train]) if n_train in cuts else F.lit(False)
    is_test = at_or_after(time, seq, cuts[n_val]) if n_val in cuts else F.lit(False)
    label = F.when(is_test, "test").when(is_val, "validation").otherwise("train")
    out = df.where(F.col(time).isNotNull()).withColumn(name, label)
    keep = F.lit(True)
    borders = []
    if n_train in cuts and n_val > n_train:
        borders.append(("train", "validation", cuts[n_train][0]))
    if n_val in cuts and n > n_val:
        borders.append(("validation", "test", cuts[n_val][0]))
    for earlier, later, start in borders:
        if purge_ms > 0:
            keep = keep & ((F.col(name) != earlier) | (F.col(time) < F.lit(start - purge_ms * 1_000_000)))
        if embargo_ms > 0:
            keep = keep & ((F.col(name) != later) | (F.col(time) >= F.lit(start + embargo_ms * 1_000_000)))
    return out.where(keep)


def split_ranges(df: DataFrame, time: str = "recv_ns", name: str = "split") -> DataFrame:
    """Rows, first and last time per split; empty splits appear with zero rows."""
    names = df.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], f"{name} string")
    found = df.groupBy(name).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("start_ns"), F.max(time).alias("end_ns")
    )
    return names.join(found, name, "left").select(
        name, F.coalesce("rows", F.lit(0)).alias("rows"), "start_ns", "end_ns"
    )


def walk_forward(
    df: DataFrame,
    train: float = 0.60,
    validation: float = 0.20,
    step: float = 0.10,
    time: str = "recv_ns",
    seq: str = "seq",
) -> DataFrame:
    """Rows of every walk-forward window, with `window_id` and `part` (train/validation).

    Windows overlap, so a row appears once per window it belongs to.
    """
    n = df.where(F.col(time).isNotNull()).count()
    n_train, n_val, n_step = (max(1, int(n * f)) for f in (train, validation, step))
    starts = list(range(0, n - n_train - n_val + 1, n_step)) if n else []
    ranks = sorted({r for s in starts for r in (s, s + n_train, s + n_train + n_val)})
    _, cuts = cuts_at(df, time, seq, ranks)
    memberships = []
    for i, s in enumerate(starts):
        begin = at_or_after(time, seq, cuts[s])
        middle = at_or_after(time, seq, cuts[s + n_train])
        end = at_or_after(time, seq, cuts[s + n_train + n_val]) if s + n_train + n_val in cuts else F.lit(False)
        part = F.when(middle, "validation").otherwise("train")
        memberships.append(F.when(begin & ~end, F.struct(F.lit(i).alias("window_id"), part.alias("part"))))
    if not memberships:
        return df.where(F.lit(False)).select("*", F.lit(0).alias("window_id"), F.lit("").alias("part"))
    member = F.explode(F.filter(F.array(*memberships), lambda m: m.isNotNull()))
    return df.where(F.col(time).isNotNull()).select("*", member.alias("__m")).select("*", "__m.window_id", "__m.part").drop("__m")


def trim_dates(
    df: DataFrame,
    date: str = "date",
    time: str = "recv_ns",
    purge_ns: int = 300_000_000_000,
    head: bool = False,
    tail: bool = False,
) -> DataFrame:
    """Drop the first and/or last `purge_ns` of every date's own time range."""
    bounds = df.groupBy(date).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    keep = []
    if head:
        keep.append(F.col(time) >= F.col("__lo") + F.lit(purge_ns))
    if tail:
        keep.append(F.col(time) < F.col("__hi") - F.lit(purge_ns))
    joined = df.join(bounds, date)
    return joined.where(reduce(lambda a, b: a & b, keep, F.lit(True))).select(*df.columns)
