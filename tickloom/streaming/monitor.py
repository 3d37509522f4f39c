"""Market life cycle, stall detection, windowed samples and gate counts on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.streaming.common import DEFAULT_WATERMARK, prepare_state_store, with_event_time
from tickloom.streaming.signals import gate_counts


def bucket_sample(events: DataFrame, keys: list[str], interval: str, values: list[str], watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Last row per key and tumbling window, emitted when the watermark closes the window."""
    last = F.max_by(F.struct("recv_ns", "seq", *values), F.struct("recv_ns", "seq")).alias("r")
    windowed = with_event_time(events, watermark).groupBy(*keys, F.window("event_time", interval)).agg(last)
    return windowed.select(*keys, "r.*")


def windowed_gate_counts(flagged: DataFrame, interval: str = "1 minute", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Gate counts per time window."""
    out = gate_counts(with_event_time(flagged, watermark), [F.window("event_time", interval)])
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


class LifecycleProcessor(StatefulProcessor):
    """Announces an instrument once and retires it `grace_ns` after its expiry.

    Events after that end never announce, so the state can go with the timer. A later expiry moves the end.
    """

    def __init__(self, grace_ns: int):
        self.grace_ns = grace_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "market_id string, expiry_ns long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame[frame["recv_ns"] <= frame["expiry_ns"] + self.grace_ns]
        if frame.empty:
            return
        market, expiry = frame["market_id"].iloc[0], int(frame["expiry_ns"].max())
        if self.expiry.exists():
            market, before = self.expiry.get()
            if expiry <= before:
                return
            self.handle.deleteTimer((before + self.grace_ns) // NS_PER_MS)
        else:
            yield self._row(key[0], market, "active", expiry)
        self.expiry.update((market, expiry))
        self.handle.registerTimer((expiry + self.grace_ns) // NS_PER_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.expiry.exists():
            return
        market, expiry = self.expiry.get()
        self.expiry.clear()
        yield self._row(key[0], market, "expired", expiry)

    @staticmethod
    def _row(asset, market, state, expiry):
        import pandas as pd

        return pd.DataFrame([(asset, market, state, expiry)], columns=["asset_id", "market_id", "state", "expiry_ns"])

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, grace_ns: int = 5 * NS_PER_SECOND, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """`active` at an asset's first event and `expired` when event time passes its end."""
    prepare_state_store(events.sparkSession)
    timed = with_event_time(events.where(F.col("expiry_ns").isNotNull()), watermark)
    return timed.groupBy("asset_id").transformWithStateInPandas(
        statefulProcessor=LifecycleProcessor(grace_ns), outputStructType="asset_id string, market_id string, state string, expiry_ns long",
        outputMode="Append", timeMode="EventTime",
    )


def live_instruments(instruments: DataFrame, now_ns: Column, lead_ns: int = 60 * NS_PER_SECOND, grace_ns: int = 5 * NS_PER_SECOND) -> DataFrame:
    """Instruments running at `now_ns` or starting within `lead_ns`."""
    return instruments.where(
        (F.col("start_ns") <= now_ns + F.lit(lead_ns)) & (F.col("expiry_ns") + F.lit(grace_ns) >= now_ns)
    )


def stalls(events: DataFrame, source: str, limit: str = "120 seconds", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Activity sessions per source, closed after `limit` without data.

    A closed session is a stall: its `quiet_since` is when the source fell silent.
    """
    sessions = with_event_time(events, watermark).groupBy(F.col(source), F.session_window("event_time", limit))
    out = sessions.agg(F.count(F.lit(1)).alias("events"), F.max("recv_ns").alias("quiet_since"))
    return out.select(source, "events", "quiet_since")
