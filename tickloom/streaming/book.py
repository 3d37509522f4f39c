"""Streaming order book: the batch replay on top of per-asset state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from tickloom import NS_PER_MS
from tickloom.functions.depth import DEPTH_COLUMNS
from tickloom.operators.book import SUMMARY_DDL, TOP_COLUMNS, level_updates, replay
from tickloom.streaming.common import DEFAULT_IDLE_NS, DEFAULT_WATERMARK, EndingProcessor, in_order, prepare_state_store, with_event_time, with_state

OUTPUT_DDL = SUMMARY_DDL + ", refreshed boolean"


class BookProcessor(EndingProcessor):
    """Levels of both sides in one value of arrays; one summary row per event.

    A micro-batch reads and writes a book once, however many levels it has.

    Rows at or before the last event of a micro-batch handled before are late: what they say is
    superseded, so they are left out rather than put over newer levels.

    With `refresh_threshold`, depth columns are recomputed only for a snapshot or when the
    mid has moved by at least that share since the last refresh; in between the last
    refreshed values are repeated and only the top of the book is current.
    """

    def __init__(self, refresh_threshold: float | None = None, idle_ns: int | None = None):
        self.refresh_threshold, self.idle_ns = refresh_threshold, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getValueState("levels", "side array<int>, price array<long>, size array<double>")
        self.cached = handle.getValueState("cached", "mid double, " + ", ".join(f"{c} double" for c in DEPTH_COLUMNS))
        self.last = handle.getValueState("last", "recv_ns long, seq long, part2 long")
        self.ending(handle, self.levels, self.cached, self.last)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        changes = in_order(rows, ["recv_ns", "seq", "part2", "rank"])
        if changes is None:
            return
        if self.last.exists():
            t, seq, part2 = self.last.get()
            later = (changes["seq"] > seq) | ((changes["seq"] == seq) & (changes["part2"] > part2))
            changes = changes[(changes["recv_ns"] > t) | ((changes["recv_ns"] == t) & later)].reset_index(drop=True)
            if changes.empty:
                return
        newest = changes.iloc[-1]
        self.last.update((int(newest["recv_ns"]), int(newest["seq"]), int(newest["part2"])))
        self.lives_on(newest["recv_ns"])
        ids = changes[["recv_ns", "seq", "part2"]]
        new = (ids != ids.shift()).any(axis=1)
        changes = changes.assign(event=new.cumsum() - 1, clear=changes["kind"] == "clear")
        changes["side"] = changes["side"].fillna(0).astype(int)
        changes["price"] = changes["price"].fillna(0).astype("int64")
        sides, prices, sizes = self.levels.get() if self.levels.exists() else ((), (), ())
        out, after = replay(changes, dict(zip(zip(sides, prices), sizes)))
        self.levels.update(([k[0] for k in after], [k[1] for k in after], [float(z) for z in after.values()]))

        out["refreshed"] = True
        if self.refresh_threshold is not None:
            out = self._gate(out, changes.loc[new, "clear"].to_numpy())
        heads = changes.loc[new, ["asset_id", "recv_ns", "seq", "part2"]].reset_index(drop=True)
        frame = pd.concat([heads, out], axis=1)
        columns = ["asset_id", "recv_ns", "seq", "part2", *TOP_COLUMNS, "total_bid_levels", "total_ask_levels", *DEPTH_COLUMNS, "refreshed"]
        yield frame[columns]

    def _gate(self, out, snapshot):
        """`out` with the depth columns of the row that each row repeats."""
        import numpy as np
        import pandas as pd

        kept = self.cached.get() if self.cached.exists() else None
        last, at, source = kept[0] if kept else None, -1, []
        for i, (mid, whole) in enumerate(zip(out["midpoint"].tolist(), snapshot.tolist())):
            unknown = mid != mid
            quiet = unknown or (last is not None and last > 0 and abs(mid - last) / last < self.refresh_threshold)
            if whole or not quiet:
                at, last = i, last if unknown else mid
            source.append(at)
        # the row behind the last one is what was refreshed before
        values = np.array(kept[1:], dtype=float) if kept else np.full(len(DEPTH_COLUMNS), np.nan)
        depth = np.vstack([out[DEPTH_COLUMNS].to_numpy(), values])[source]
        if kept or at >= 0:
            self.cached.update((last, *[None if v != v else v for v in depth[-1].tolist()]))
        refreshed = np.array(source) == np.arange(len(out))
        rest = out.drop(columns=[*DEPTH_COLUMNS, "refreshed"])
        return pd.concat([rest, pd.DataFrame(depth, columns=DEPTH_COLUMNS).assign(refreshed=refreshed)], axis=1)


def stream_book_states(
    updates: DataFrame, refresh_threshold: float | None = None, idle_ns: int = DEFAULT_IDLE_NS, watermark: str = DEFAULT_WATERMARK
) -> DataFrame:
    """Book summaries of a stream of update rows (see `normalize.book_updates`).

    A book ends `idle_ns` after its last row; markets live minutes, so the default is far beyond their end.
    """
    from pyspark.sql import functions as F

    prepare_state_store(updates.sparkSession)
    levels = level_updates(updates).withColumn("rank", F.when(F.col("kind") == "clear", 0).otherwise(1))
    levels = with_event_time(levels, watermark, NS_PER_MS)
    states = with_state(levels.groupBy("asset_id"), BookProcessor(refresh_threshold, idle_ns), OUTPUT_DDL)
    doubles = {*TOP_COLUMNS, *DEPTH_COLUMNS}
    return states.select(
        *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in doubles else F.col(c) for c in states.columns]
    )
