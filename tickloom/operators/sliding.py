"""Trailing statistics whose cost does not grow with the window.

A RANGE frame adds up its whole window again for each row. Here time is cut into blocks as wide
as the window: `(t - w, t]` is then the end of one block and the beginning of the next, and one
running sum from either side of each block answers every row. Nothing is subtracted, so sums of
values of one sign keep their relative accuracy and a value that is not finite spoils only the
windows that hold it.

Rows are dealt by (keys, slice), sorted there and read as Arrow batches; a task holds one group,
or one batch of small groups, at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tickloom.operators.slices import (
    DEFAULT_BLOCK_ROWS, DEFAULT_SLICE_NS, HALO_FACTOR, RowFrame, block_values, own_rows, row_blocks, spread_for_python, time_slices,
)

LARGEST_PLACE = 1 << 62
COMPARED_ROWS = 4096


@dataclass(frozen=True)
class Trailing:
    """A statistic over the rows of `(t - window, t]`, the row and its ties included.

    `count` counts rows, or the rows in which the boolean `column` is true. `sum` and `stddev`
    (of a sample) skip nulls; they are null without a value and with fewer than two.
    """

    name: str
    kind: str
    window: int
    column: str | None = None


@dataclass(frozen=True)
class RowRank:
    """How many of the last `rows` values, the row's own included, are smaller than its own.

    Null until `rows` rows exist and where the value is null. `known` names a second column,
    the number of values that are not null. NaN is larger than any other value.
    """

    name: str
    known: str
    column: str
    rows: int


def group_starts(table, keys: Sequence[str]):
    """First row of each run of equal keys; nulls equal each other."""
    import numpy as np
    import pyarrow as pa

    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        column = table.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def by_sorted_groups(df: DataFrame, keys: Sequence[str], fn: Callable, added: Sequence[StructField]) -> DataFrame:
    """`df`, sorted by its groups inside each partition, with the columns that `fn` adds.

    `fn(table, starts)` gets whole groups and returns one Arrow array per field of `added`.
    """
    schema = StructType([*df.schema.fields, *added])
    names = [f.name for f in added]

    def run(batches):
        import pyarrow as pa

        def finish(parts):
            whole = pa.Table.from_batches(parts).combine_chunks()
            for name, values in zip(names, fn(whole, group_starts(whole, keys))):
                whole = whole.append_column(name, values)
            yield from whole.to_batches(max_chunksize=1 << 14)

        def place(batch, row):
            return str([batch.column(k)[row].as_py() for k in keys])

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and place(batch, 0) != last:
                yield from finish(held)
                held = []
            last = place(batch, batch.num_rows - 1)
            cut = int(group_starts(batch, keys)[-1])
            if cut:
                yield from finish([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from finish(held)

    return df.mapInArrow(run, schema)


def _one_axis(t, starts, gap: int):
    """Times of all groups on one axis, `gap` between groups; None where they do not fit."""
    import numpy as np

    sizes = np.diff(np.append(starts, len(t)))
    base = t[starts]
    span = t[starts + sizes - 1] - base
    if len(starts) > 1 and span.astype(float).sum() + float(gap) * len(starts) > LARGEST_PLACE:
        return None
    offset = np.concatenate([[0], np.cumsum(span[:-1] + gap)])
    return t - np.repeat(base, sizes) + np.repeat(offset, sizes)


class _Windows:
    """Windows of one width over times in ascending order."""

    def __init__(self, t, width: int):
        import numpy as np

        block = t // width
        self.first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        self.sizes = np.diff(np.append(self.first, len(t)))
        self.start = np.repeat(self.first, self.sizes)
        self.last = np.searchsorted(t, t, "right") - 1
        self.edge = np.searchsorted(t, t - width, "right")
        self.reaches = self.edge < self.start

    def parts(self, x):
        """Sums of the window's part in the row's own block and in the block before."""
        import numpy as np

        left, right = x.copy(), x.copy()
        for a, n in zip(self.first[self.sizes > 1], self.sizes[self.sizes > 1]):
            np.cumsum(x[a : a + n], out=left[a : a + n])
            right[a : a + n] = np.cumsum(x[a : a + n][::-1])[::-1]
        return left[self.last], np.where(self.reaches, right[np.where(self.reaches, self.edge, 0)], 0)

    def total(self, x):
        own, before = self.parts(x)
        return own + before

    def deviation(self, v, known):
        """Sample deviation, and where it has fewer than two values.

        Counts, means and squares around the mean are merged pair by pair over doubling
        distances, so no outlier of a block reaches windows that do not hold it.
        """
        import numpy as np

        each = known.astype(float), np.where(known, v, 0.0), np.zeros(len(v))
        place = np.arange(len(v)) - self.start
        to_end = np.repeat(self.sizes, self.sizes) - 1 - place
        left = _running(each, place)
        right = [x[::-1] for x in _running([x[::-1] for x in each], to_end[::-1])]
        edge = np.where(self.reaches, self.edge, 0)
        before = [np.where(self.reaches, x[edge], 0.0) for x in right]
        count, _, squares = _merged(before, [x[self.last] for x in left])
        with np.errstate(invalid="ignore"):
            return np.sqrt(squares / np.maximum(count - 1, 1)), count < 2


def _merged(a, b):
    """(count, mean, sum of squares around the mean) of two sets of values together."""
    import numpy as np

    (n0, m0, q0), (n1, m1, q1) = a, b
    n = n0 + n1
    with np.errstate(all="ignore"):
        apart = m1 - m0
        share = n1 / np.maximum(n, 1)
        mean = np.where(n1 == 0, m0, np.where(n0 == 0, m1, m0 + apart * share))
        squares = q0 + q1 + np.where((n0 > 0) & (n1 > 0), apart * apart * n0 * share, 0.0)
    return n, mean, squares


def _running(each, place):
    """Merged values from the start of each block to each row; `place` counts from that start."""
    state, step = [x.copy() for x in each], 1
    while step <= place.max(initial=0):
        rows = (place >= step).nonzero()[0]
        for x, new in zip(state, _merged([x[rows - step] for x in state], [x[rows] for x in state])):
            x[rows] = new
        step *= 2
    return state


def _column(table, name: str):
    """Values as doubles and where they are known."""
    import numpy as np
    import pyarrow as pa

    column = table.column(name).combine_chunks()
    known = ~column.is_null().to_numpy(zero_copy_only=False)
    values = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.where(known, values, 0.0), known


def trailing_frames(
    df: DataFrame, keys: Sequence[str], order: str, frames: Sequence[Trailing], slice_width: int | None = None
) -> DataFrame:
    """Add every trailing statistic with one shuffle on (keys, time slice).

    Rows whose `order` (a long) is null are each other's window, as in a RANGE frame.
    """
    if any(f.kind not in ("count", "sum", "stddev") or (f.kind != "count" and f.column is None) for f in frames):
        raise ValueError("a trailing statistic is a count, or a sum or stddev of a column")
    reach = max(f.window for f in frames)
    width = slice_width or max(1, reach * HALO_FACTOR)
    group = [*keys, "__slice"]
    sliced = spread_for_python(time_slices(df, order, reach, 0, width), group).sortWithinPartitions(*group, order)
    added = [StructField(f.name, LongType() if f.kind == "count" else DoubleType()) for f in frames]

    def statistics(table, starts):
        import numpy as np
        import pyarrow as pa

        t = _one_axis(table.column(order).combine_chunks().fill_null(0).to_numpy(), starts, 2 * reach + 1)
        if t is None:
            middle = len(starts) // 2
            cut = int(starts[middle])
            halves = statistics(table.slice(0, cut), starts[:middle]), statistics(table.slice(cut), starts[middle:] - cut)
            return [pa.concat_arrays(pair) for pair in zip(*halves)]
        windows = {w: _Windows(t, w) for w in {f.window for f in frames}}
        columns = {c: _column(table, c) for c in {f.column for f in frames if f.column}}
        out = []
        for f in frames:
            at = windows[f.window]
            values, known = columns.get(f.column, (None, None))
            if f.kind == "count":
                out.append(pa.array(at.total(np.ones(len(t), dtype="int64") if f.column is None else values.astype("int64"))))
            elif f.kind == "sum":
                out.append(pa.array(at.total(values), mask=at.total(known.astype("int64")) == 0))
            else:
                deviation, few = at.deviation(values, known)
                out.append(pa.array(deviation, mask=few))
        return out

    return own_rows(by_sorted_groups(sliced, group, statistics, added))


def smaller_among_last(values, known, starts, rows: int):
    """For each row the count of smaller values and of known ones among its group's last `rows`."""
    import numpy as np

    n = len(values)
    smaller, there, short = np.zeros(n, dtype="int64"), np.zeros(n, dtype="int64"), np.ones(n, dtype=bool)
    if n >= rows:
        codes = np.unique(values, return_inverse=True)[1].astype("int64").reshape(-1)
        codes[~known] = n + 1
        seen = np.append(0, np.cumsum(known))
        there[rows - 1 :] = seen[rows:] - seen[: n - rows + 1]
        runs = np.lib.stride_tricks.sliding_window_view(codes, rows)
        for a in range(0, len(runs), COMPARED_ROWS):
            part = runs[a : a + COMPARED_ROWS]
            smaller[a + rows - 1 : a + rows - 1 + len(part)] = (part < part[:, -1:]).sum(axis=1)
        place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        short = place < rows - 1
    return smaller, there, short


def row_frames_and_ranks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    frames: Sequence[RowFrame],
    ranks: Sequence[RowRank],
    slice_width: int = DEFAULT_SLICE_NS,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """ROWS aggregates and ranks among the last rows, on one dealing of blocks of rows."""
    reach = max([f.rows for f in frames] + [r.rows for r in ranks]) - 1
    group = [*keys, "__block"]
    blocked = spread_for_python(row_blocks(df, keys, order, reach, slice_width, block_rows), group)
    valued = block_values(blocked, keys, frames).sortWithinPartitions(*group, "__pos")
    added = [StructField(n, LongType()) for r in ranks for n in (r.name, r.known)]

    def statistics(table, starts):
        import pyarrow as pa

        out = []
        for r in ranks:
            values, known = _column(table, r.column)
            smaller, there, short = smaller_among_last(values, known, starts, r.rows)
            out += [pa.array(smaller, mask=short | ~known), pa.array(there, mask=short)]
        return out

    ranked = by_sorted_groups(valued, group, statistics, added)
    return ranked.where(F.col("__block") == F.col("__home")).drop("__block", "__home", "__pos")
