"""Order-book state from snapshots and deltas, in batch.

Replaying a book is sequential per asset, so an asset is cut into time slices. What a
slice starts with is found relationally: the last update of each price level holds from
the slice after it until the slice of the level's next update or of the next snapshot.
Each (asset, slice) is then replayed on its own from that seed. Spark deals and sorts the
slices; a task walks its rows batch by batch and holds one book, however long a slice is.

A book keeps the levels of each side in order. An event touches the levels it names, and
the top levels are noted only when one of them changed; the columns of a summary are then
computed for all noted tops of a batch at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.depth import DEPTH_COLUMNS, IMBALANCE_LEVELS, NOTIONAL_LEVELS, SLOPE_LEVELS
from tickloom.operators.slices import int_div, null_safe_join, spread_for_python
from tickloom.session import cut_lineage

PRICE_SCALE = 1_000_000
TOP = max(*IMBALANCE_LEVELS, *SLOPE_LEVELS, *NOTIONAL_LEVELS)
TOP_COLUMNS = [
    "best_bid", "best_ask", "best_bid_size", "best_ask_size", "spread", "midpoint", "microprice", "imbalance"
]
SUMMARY_DDL = (
    "asset_id string, recv_ns long, seq long, part2 int, "
    + ", ".join(f"{c} double" for c in TOP_COLUMNS)
    + ", total_bid_levels int, total_ask_levels int, "
    + ", ".join(f"{c} double" for c in DEPTH_COLUMNS)
)

ROW_TYPES = {
    "asset_id": "string", "slice": "long", "recv_ns": "long", "seq": "long", "part2": "int",
    "role": "int", "side": "int", "price": "long", "size": "double",
}


def level_updates(updates: DataFrame) -> DataFrame:
    """One row per touched price level.

    Columns: asset_id, recv_ns, seq, part2 (order), event kind, side (1 bid, -1 ask),
    price as an exact scaled long, size. A snapshot becomes one `clear` row (side 0)
    plus a row per level. Unparsable prices and sizes and unknown sides are marked with
    side null: the event still counts, the book does not change.
    """
    order = ["asset_id", "recv_ns", "seq", "part2"]

    def change(kind: str, side, price, size):
        exact = price.try_cast("decimal(24,6)")
        return F.struct(
            F.lit(kind).alias("kind"),
            side.cast("int").alias("side"),
            (exact * PRICE_SCALE).try_cast("long").alias("price"),
            size.try_cast("decimal(24,6)").cast("double").alias("size"),
        )

    side = F.when(F.col("side") == "buy", 1).when(F.col("side") == "sell", -1)
    valid = F.col("price").try_cast("decimal(24,6)").isNotNull() & F.col("size").try_cast("decimal(24,6)").isNotNull()
    delta = F.array(change("delta", F.when(valid, side), F.col("price"), F.col("size")))

    def levels(column: str, number: int):
        some = F.coalesce(F.col(column), F.array().cast("array<struct<price:string,size:string>>"))
        parsed = F.transform(some, lambda x: change("level", F.lit(number), x["price"], x["size"]))
        return F.filter(parsed, lambda x: x["price"].isNotNull() & (x["size"] > 0))

    clear = F.array(change("clear", F.lit(0), F.lit("0"), F.lit("0")))
    snapshot = F.concat(clear, levels("bids", 1), levels("asks", -1))
    changes = F.when(F.col("kind") == "delta", delta).when(F.col("kind") == "snapshot", snapshot)
    return updates.select(*order, F.explode(changes).alias("c")).select(*order, "c.*")


def joined_slices(levels: DataFrame, least_rows: int) -> DataFrame:
    """(asset_id, slice, run): consecutive slices of an asset are joined until they hold `least_rows` rows.

    Only of assets with several runs, so the table is small beside `levels`: all slices of any other asset are run 0.
    """
    counts = levels.groupBy("asset_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    asset = Window.partitionBy("asset_id")
    before = F.sum("n").over(asset.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    runs = counts.withColumn("run", int_div(F.coalesce(before, F.lit(0)), least_rows))
    return runs.withColumn("last", F.max("run").over(asset)).where(F.col("last") > 0).select("asset_id", "slice", "run")


def slice_seeds(sliced: DataFrame) -> DataFrame:
    """Price levels standing at the start of each (asset, slice) that has events."""
    place = F.struct("recv_ns", "seq", "part2")
    per_slice = sliced.groupBy("asset_id", "slice").agg(F.max(F.when(F.col("kind") == "clear", place)).alias("cleared"))
    by_time = Window.partitionBy("asset_id").orderBy("slice")
    indexed = per_slice.select(
        "asset_id",
        "slice",
        "cleared",
        F.row_number().over(by_time).alias("idx"),
    )
    indexed = indexed.withColumn("last_idx", F.max("idx").over(Window.partitionBy("asset_id")))
    # next snapshot after a slice: running minimum from the end
    backward = Window.partitionBy("asset_id").orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    indexed = indexed.withColumn("next_clear", F.min(F.when(F.col("cleared").isNotNull(), F.col("idx"))).over(backward))

    real = sliced.where(F.col("side").isin(1, -1))
    located = null_safe_join(real, indexed, ["asset_id", "slice"], "inner")
    alive = located.where(F.col("cleared").isNull() | (place >= F.col("cleared")))
    last = alive.groupBy("asset_id", "side", "price", "idx", "last_idx", "next_clear").agg(
        F.max_by("size", F.struct("recv_ns", "seq", "part2")).alias("size")
    )
    level = Window.partitionBy("asset_id", "side", "price").orderBy("idx")
    # `least` skips nulls, so bounds that do not exist fall away
    until = F.least(F.lead("idx").over(level), F.col("next_clear"), F.col("last_idx"))
    standing = last.withColumn("until", until).where((F.col("size") > 0) & (F.col("until") > F.col("idx")))
    spread = standing.select(
        "asset_id", "side", "price", "size", F.explode(F.sequence(F.col("idx") + 1, F.col("until"))).alias("idx")
    )
    slices = indexed.select("asset_id", "slice", "idx")
    placed = null_safe_join(spread, slices, ["asset_id", "idx"], "inner")
    return placed.select("asset_id", "side", "price", "size", "slice")


class Side:
    """The levels of one side, best first, and the tops noted since the last `drain`.

    Levels are kept in order in an array (finding one is a binary search, inserting moves what is behind it).
    """

    def __init__(self, sign: int):
        self.sign = sign  # 1 bid, -1 ask
        self.clear()
        self.prices_noted: list[list[int]] = []
        self.sizes_noted: list[list[float]] = []

    def clear(self) -> None:
        self.keys: list[int] = []
        self.sizes: list[float] = []
        self.moved = True

    def put(self, price: int, size: float) -> None:
        """Set a level; a size at or below zero removes it."""
        key = -self.sign * price
        at = bisect_left(self.keys, key)
        present = at < len(self.keys) and self.keys[at] == key
        if size > 0:
            if present:
                self.sizes[at] = size
            else:
                self.keys.insert(at, key)
                self.sizes.insert(at, size)
        elif present:
            del self.keys[at], self.sizes[at]
        else:
            return
        if at < TOP:
            self.moved = True

    def levels(self) -> dict[int, float]:
        return {-self.sign * k: z for k, z in zip(self.keys, self.sizes)}

    def note(self) -> int:
        """Number of the noted top that holds now."""
        if self.moved or not self.prices_noted:
            self.prices_noted.append(self.keys[:TOP])
            self.sizes_noted.append(self.sizes[:TOP])
            self.moved = False
        return len(self.prices_noted) - 1

    def drain(self) -> dict:
        """Columns of the noted tops, which are forgotten."""
        import numpy as np

        known = np.array([len(k) for k in self.prices_noted], dtype=int)
        filled = np.arange(TOP) < known[:, None]
        price, size = np.zeros(filled.shape), np.zeros(filled.shape)
        price[filled] = np.fromiter(chain.from_iterable(self.prices_noted), dtype="int64", count=known.sum()) * -self.sign / PRICE_SCALE
        size[filled] = np.fromiter(chain.from_iterable(self.sizes_noted), dtype=float, count=known.sum())
        self.prices_noted, self.sizes_noted, self.moved = [], [], True
        sums, notionals = size.cumsum(axis=1), (size * price).cumsum(axis=1)
        out = {"price": price[:, 0], "size": size[:, 0], "known": known}
        for n in IMBALANCE_LEVELS:
            out[f"sum{n}"] = sums[:, n - 1]
        for n in NOTIONAL_LEVELS:
            out[f"notional{n}"] = notionals[:, n - 1]
        for n in SLOPE_LEVELS:
            k = np.minimum(known, n)
            deepest = np.take_along_axis(size, np.maximum(k - 1, 0)[:, None], axis=1)[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                out[f"slope{n}"] = np.where(k >= 2, (deepest - size[:, 0]) / (k - 1), np.nan)
        return out


class Book:
    """Both sides of a book and the events ended since the last `summaries`."""

    def __init__(self, standing: dict[tuple[int, int], float] | None = None):
        self.sides = {1: Side(1), -1: Side(-1)}
        self.ended: list[tuple[int, int, int, int]] = []
        for (side, price), size in (standing or {}).items():
            self.sides[side].put(price, size)

    def clear(self) -> None:
        self.sides[1].clear()
        self.sides[-1].clear()

    def change(self, clear: bool, side: int, price: int, size: float) -> None:
        """One row of an event; other sides than 1 and -1 change nothing."""
        if clear:
            self.clear()
        elif side in self.sides:
            self.sides[side].put(price, size)

    def end(self) -> None:
        """The rows of an event are all in."""
        bids, asks = self.sides[1], self.sides[-1]
        self.ended.append((bids.note(), asks.note(), len(bids.keys), len(asks.keys)))

    def levels(self) -> dict[tuple[int, int], float]:
        return {(s, p): z for s, side in self.sides.items() for p, z in side.levels().items()}

    def summaries(self) -> dict:
        """Summary columns of the ended events, NaN for what has no value; the events are forgotten."""
        import numpy as np

        ended = np.array(self.ended, dtype=int).reshape(-1, 4)
        self.ended = []
        b, a = (
            {c: v[ended[:, i]] for c, v in self.sides[s].drain().items()} for i, s in ((0, 1), (1, -1))
        )
        both = (b["known"] > 0) & (a["known"] > 0)

        def only_both(x):
            return np.where(both, x, np.nan)

        with np.errstate(divide="ignore", invalid="ignore"):
            total = b["size"] + a["size"]
            cols = {
                "best_bid": only_both(b["price"]),
                "best_ask": only_both(a["price"]),
                "best_bid_size": only_both(b["size"]),
                "best_ask_size": only_both(a["size"]),
                "spread": only_both(a["price"] - b["price"]),
                "midpoint": only_both((a["price"] + b["price"]) / 2),
                "microprice": only_both((b["price"] * a["size"] + a["price"] * b["size"]) / total),
                "imbalance": only_both((b["size"] - a["size"]) / total),
                "total_bid_levels": ended[:, 2].astype("int32"),
                "total_ask_levels": ended[:, 3].astype("int32"),
            }
            for n in IMBALANCE_LEVELS:
                sizes = b[f"sum{n}"] + a[f"sum{n}"]
                cols[f"depth_top{n}_imbalance"] = np.where(sizes > 0, (b[f"sum{n}"] - a[f"sum{n}"]) / sizes, np.nan)
                cols[f"cum_bid_depth_top{n}"] = b[f"sum{n}"]
                cols[f"cum_ask_depth_top{n}"] = a[f"sum{n}"]
        for n in SLOPE_LEVELS:
            cols[f"bid_depth_slope_top{n}"] = b[f"slope{n}"]
            cols[f"ask_depth_slope_top{n}"] = a[f"slope{n}"]
        for n in NOTIONAL_LEVELS:
            cols[f"near_touch_bid_notional_{n}"] = b[f"notional{n}"]
            cols[f"near_touch_ask_notional_{n}"] = a[f"notional{n}"]
        return cols


def replay(changes, standing):
    """Book summaries after every event of a stretch, and the levels standing at its end.

    `changes` has columns event, clear (bool), side, price, size in replay order;
    `standing` maps (side, price) to size.
    """
    import pandas as pd

    book = Book(standing)
    event = changes["event"].tolist()
    last = [x != y for x, y in zip(event, event[1:])] + [True] * bool(event)
    rows = zip(changes["clear"].tolist(), changes["side"].tolist(), changes["price"].tolist(), changes["size"].tolist(), last)
    for clear, side, price, size, done in rows:
        book.change(clear, side, price, size)
        if done:
            book.end()
    return pd.DataFrame(book.summaries()), book.levels()


HEAD = ["asset_id", "recv_ns", "seq", "part2"]
SUMMARY = [*TOP_COLUMNS, "total_bid_levels", "total_ask_levels", *DEPTH_COLUMNS]


def walk_slices(batches: Iterator) -> Iterator:
    """Summaries of rows sorted by (asset, slice) and replay order, one book at a time.

    Rows have `HEAD`, slice, role (0 seed, 1 clear, 2 level), side, price and size. The last event of a batch may go
    on in the next one, so its head is kept until another event begins.
    """
    import numpy as np
    import pyarrow as pa

    book, before, head = Book(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        role, side, price = (table[c].fill_null(0).to_pylist() for c in ("role", "side", "price"))
        size = table["size"].fill_null(0.0).to_pylist()
        place = list(zip(*(table[c].to_pylist() for c in ["asset_id", "slice", "recv_ns", "seq", "part2"])))
        heads = [] if head is None else [head]
        starts = []
        for i, here in enumerate(place):
            # `head` is set while an event is open
            if before is None or here != before or role[i] == 0:
                if head is not None:
                    book.end()
                    head = None
                if before is None or here[:2] != before[:2]:
                    book.clear()
            before = here
            if role[i] == 0:
                book.change(False, side[i], price[i], size[i])
                continue
            if head is None:
                head = True
                starts.append(i)
            book.change(role[i] == 1, side[i], price[i], size[i])
        begun = pa.concat_tables([*heads, table.select(HEAD).take(np.array(starts, dtype="int64"))])
        n = len(book.ended)
        if head is not None:
            # copied, so that the rows of the batch can go
            head = pa.Table.from_pylist(begun.slice(n, 1).to_pylist(), begun.schema)
        yield from _with_heads(begun.slice(0, n), book)
    if head is not None:
        book.end()
        yield from _with_heads(head, book)


def _with_heads(heads, book: Book) -> Iterator:
    import pyarrow as pa

    if heads.num_rows:
        columns = book.summaries()
        for name in SUMMARY:
            heads = heads.append_column(name, pa.array(columns[name], from_pandas=True))
        yield from heads.combine_chunks().to_batches()


def book_states(updates: DataFrame, slice_width: int = 60 * 1_000_000_000, least_rows: int = 20_000) -> DataFrame:
    """A full book summary after every snapshot and every delta.

    A slice is seeded with the whole book at its start, so slices are joined until they hold `least_rows` rows, many more
    than the book should have levels. An asset of fewer rows is one slice and needs no seed.
    Without a snapshot, a book starts empty.
    """
    levels = level_updates(updates).withColumn("slice", int_div(F.col("recv_ns"), slice_width))
    levels = cut_lineage(levels, "book-levels")  # read for the runs, the seeds and the replay
    runs = cut_lineage(joined_slices(levels, least_rows), "book-runs")
    events, seeds = levels.withColumn("slice", F.lit(0).cast("long")), None
    if not runs.isEmpty():
        slices = [F.col("run").alias("slice") if c == "slice" else F.col(c) for c in levels.columns]
        seeds = slice_seeds(null_safe_join(levels, runs, ["asset_id", "slice"], "inner").select(*slices))
        slices = [F.coalesce("run", F.lit(0)).alias("slice") if c == "slice" else F.col(c) for c in levels.columns]
        events = null_safe_join(levels, runs, ["asset_id", "slice"], "left").select(*slices)
    rows = events.select(
        "asset_id", "slice", "recv_ns", "seq", "part2", F.when(F.col("kind") == "clear", 1).otherwise(2).alias("role"), "side", "price", "size"
    )
    if seeds is not None:
        absent = [F.lit(None).cast(levels.schema[c].dataType).alias(c) for c in ("recv_ns", "seq", "part2")]
        rows = rows.unionByName(seeds.select("asset_id", "slice", *absent, F.lit(0).alias("role"), "side", "price", "size"))
    # seeds come first: nulls sort before any time, also where an event has none
    order = [F.when(F.col("role") == 0, 0).otherwise(1), "recv_ns", "seq", "part2", "role"]
    rows = spread_for_python(rows, ["asset_id", "slice"]).sortWithinPartitions("asset_id", "slice", *order)
    placed = rows.select(*[F.col(c).cast(t) for c, t in ROW_TYPES.items()])
    return placed.mapInArrow(walk_slices, SUMMARY_DDL)
