"""Online feature vector per book event, from bounded per-asset state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.functions.prices import GUARD
from tickloom.plans.features import EWMA_SPANS, OWN_OFFSETS, REFERENCE_OFFSETS_MS, TRADE_RUN
from tickloom.streaming.common import DEFAULT_IDLE_NS, DEFAULT_WATERMARK, EndingProcessor, prepare_state_store, with_event_time, with_state

SMOOTHED = ["realized_vol_short", "depth_top10_imbalance", "ref_return_1000ms", "ref_return_3000ms"]
EVENT_DDL = (
    "kind string, recv_ns long, seq long, asset_id string, best_bid double, best_ask double, mid double, spread double, "
    "depth_top10_imbalance double, price double, size double, signed_side double"
)
FEATURES = [
    "book_update_count_100ms", "book_update_count_500ms", "book_update_count_1s", "spread_widen_count_recent", "spread_narrow_count_recent",
    "realized_vol_short", "trade_count_100ms", "trade_count_500ms", "trade_count_1s", "aggressive_buy_volume_1s", "aggressive_sell_volume_1s",
    "signed_volume_1s", "signed_volume_imbalance_recent", "recent_vwap", "recent_vwap_deviation", "consecutive_buy_trade_run_proxy",
    "consecutive_sell_trade_run_proxy", "ref_mid", "ref_age_ms",
    *[f"ref_return_{ms}ms" for ms in REFERENCE_OFFSETS_MS], *[f"return_{k}" for k in OWN_OFFSETS],
    "lead_lag_ref_minus_own_500ms", "lead_lag_ref_minus_own_1s", "lead_lag_3s",
    *[f"{c}_ewma_{n}" for c in SMOOTHED for n in (*EWMA_SPANS, "diff")],
]
OUTPUT_DDL = (
    "asset_id string, recv_ns long, seq long, best_bid double, best_ask double, mid double, spread double, depth_top10_imbalance double, "
    + ", ".join(f"{c} double" for c in FEATURES)
    + ", sampled boolean, predict boolean"
)


@dataclass(frozen=True)
class FeatureConfig:
    """`scale` stretches all durations. The throttle decides which rows are scored."""

    scale: int = 1
    tolerance_ns: int = 500 * NS_PER_MS
    sample_interval_ns: int = 100 * NS_PER_MS
    min_mid_change: float = 0.02


TEXTS, TIMES = ("kind", "asset_id"), ("recv_ns", "seq")
COLUMNS = {c: object if c in TEXTS else "int64" if c in TIMES else float for c in (x.split()[0] for x in EVENT_DDL.split(", "))}
BOOK_COLUMNS = ["asset_id", "recv_ns", "seq", "best_bid", "best_ask", "mid", "spread", "depth_top10_imbalance"]


def ordered(*parts) -> dict:
    """Rows as one array a column, by time and number; of equal ones those of the first part come first.

    A key has few rows, so a frame of pandas would cost more than the work on it.
    """
    import numpy as np

    rows = {c: np.concatenate([np.asarray(p[c], dtype=kind) for p in parts]) for c, kind in COLUMNS.items()}
    place = np.lexsort((rows["seq"], rows["recv_ns"]))
    return {c: x[place] for c, x in rows.items()}


def of_kind(rows: dict, kind: str) -> dict:
    found = rows["kind"] == kind
    return {c: x[found] for c, x in rows.items()}


def window_features(rows: dict, fresh: dict, config: FeatureConfig) -> dict:
    """Features of the book rows `fresh`, which are among the ordered rows of one asset.

    The same windows and lookups as the batch features, by binary search.
    """
    import numpy as np

    ms, sec = NS_PER_MS * config.scale, NS_PER_SECOND * config.scale
    book, trade, ref = (of_kind(rows, k) for k in ("book", "trade", "ref"))
    t = fresh["recv_ns"]
    out: dict = {}

    def span(times, w):
        return np.searchsorted(times, t - w, side="right"), np.searchsorted(times, t, side="right")

    def summed(values, bounds):
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[bounds[1]] - total[bounds[0]]

    def latest(times, values, at, tolerance):
        i = np.searchsorted(times, at, side="right") - 1
        ok = (i >= 0) & (at - times[np.maximum(i, 0)] <= tolerance) if len(times) else np.zeros(len(at), bool)
        return np.where(ok, values[np.maximum(i, 0)] if len(values) else np.nan, np.nan)

    tb, mid, spread = book["recv_ns"], book["mid"], book["spread"]
    for label, w in (("100ms", 100 * ms), ("500ms", 500 * ms), ("1s", sec)):
        lo, hi = span(tb, w)
        out[f"book_update_count_{label}"] = (hi - lo).astype(float)
    delta = np.diff(spread, prepend=np.nan)
    out["spread_widen_count_recent"] = summed(np.nan_to_num(delta) > 0, span(tb, sec))
    out["spread_narrow_count_recent"] = summed(np.nan_to_num(delta) < 0, span(tb, sec))
    ret = np.concatenate([[np.nan], mid[1:] / mid[:-1] - 1]) if len(mid) else mid
    vols, there = [], ~np.isnan(ret)
    for lo, hi in zip(*(x.tolist() for x in span(tb, 3 * sec))):
        known = ret[lo:hi][there[lo:hi]]
        vols.append(known.std(ddof=1) if len(known) > 1 else np.nan)
    out["realized_vol_short"] = np.array(vols, float)

    tt, size, sign, price = (trade[c] for c in ("recv_ns", "size", "signed_side", "price"))
    recent = latest(tt, np.arange(len(tt), dtype=float), t, sec)
    last = np.where(np.isnan(recent), -1, np.nan_to_num(recent)).astype(int)
    # trade windows end at the last trade, as in the batch features
    at = np.where(last >= 0, tt[np.maximum(last, 0)] if len(tt) else 0, 0)
    has = last >= 0

    def trade_sum(values, w):
        lo, hi = np.searchsorted(tt, at - w, side="right"), np.searchsorted(tt, at, side="right")
        return np.where(has, summed(values, (lo, hi)), np.nan)

    for label, w in (("100ms", 100 * ms), ("500ms", 500 * ms), ("1s", sec)):
        out[f"trade_count_{label}"] = trade_sum(np.ones(len(tt)), w)
    buys, sells = trade_sum(size * (sign > 0), sec), trade_sum(size * (sign < 0), sec)
    signed = trade_sum(size * sign, sec)
    out |= {"aggressive_buy_volume_1s": buys, "aggressive_sell_volume_1s": sells, "signed_volume_1s": signed}
    out["signed_volume_imbalance_recent"] = signed / (buys + sells + GUARD)
    out["recent_vwap"] = trade_sum(price * size, sec) / (trade_sum(size, sec) + GUARD)
    mids = fresh["mid"]
    out["recent_vwap_deviation"] = out["recent_vwap"] - mids
    upto = np.cumsum(np.concatenate([[0], sign > 0])), np.cumsum(np.concatenate([[0], sign < 0]))
    full = has & (last + 1 >= TRADE_RUN)
    for name, c in (("buy", upto[0]), ("sell", upto[1])):
        run = c[last + 1] - c[np.maximum(last + 1 - TRADE_RUN, 0)]
        out[f"consecutive_{name}_trade_run_proxy"] = np.where(full, run, np.nan)

    tr, ref_mid = ref["recv_ns"], ref["mid"]
    now = latest(tr, ref_mid, t, config.tolerance_ns)
    out["ref_mid"] = now
    out["ref_age_ms"] = (t - latest(tr, tr.astype(float), t, config.tolerance_ns)) / NS_PER_MS
    for o in REFERENCE_OFFSETS_MS:
        past = latest(tr, ref_mid, t - o * ms, min(o * ms // 2, 500 * ms))
        out[f"ref_return_{o}ms"] = now / past - 1
    for label, o in OWN_OFFSETS.items():
        out[f"return_{label}"] = mids / latest(tb, mid, t - o * ms, o * ms) - 1
    out["lead_lag_ref_minus_own_500ms"] = out["ref_return_500ms"] - out["return_500ms"]
    out["lead_lag_ref_minus_own_1s"] = out["ref_return_1000ms"] - out["return_1s"]
    out["lead_lag_3s"] = out["ref_return_3000ms"] - out["return_3s"]
    return {c: fresh[c] for c in BOOK_COLUMNS} | out


class FeatureProcessor(EndingProcessor):
    """Recent rows (bounded by the longest window), EWMA sums and the throttle's memory."""

    def __init__(self, config: FeatureConfig, idle_ns: int | None = None):
        self.config, self.idle_ns = config, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", EVENT_DDL)
        sums = ", ".join(f"n{i}_{n} double, d{i}_{n} double" for i in range(len(SMOOTHED)) for n in EWMA_SPANS)
        self.sums = handle.getValueState("sums", sums)
        self.throttle = handle.getValueState("throttle", "sample_ns long, mid double")
        self.ending(handle, self.recent, self.sums, self.throttle)

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        parts = [r for r in rows if len(r)]
        if not parts:
            return
        new = ordered(*parts)
        self.lives_on(new["recv_ns"][-1])
        joined = new
        if self.recent.exists():  # rows that came late take their place
            joined = ordered(dict(zip(COLUMNS, zip(*self.recent.get()))), new)

        keep = joined["recv_ns"] >= int(joined["recv_ns"][-1]) - 11 * NS_PER_SECOND * self.config.scale
        for kind, n in (("book", 1), ("trade", TRADE_RUN)):
            keep[np.flatnonzero(joined["kind"] == kind)[-n:]] = True
        self.recent.put(list(zip(*([None if v != v else v for v in x[keep].tolist()] for x in joined.values()))))
        fresh = of_kind(new, "book")
        if not len(fresh["recv_ns"]):
            return

        frame = window_features(joined, fresh, self.config)
        state = list(self.sums.get()) if self.sums.exists() else [0.0] * (2 * len(SMOOTHED) * len(EWMA_SPANS))
        for i, c in enumerate(SMOOTHED):
            for j, (name, s) in enumerate(EWMA_SPANS.items()):
                at, decay, values = 2 * (i * len(EWMA_SPANS) + j), 1 - 2 / (s + 1), []
                for x in frame[c].tolist():
                    if x != x:
                        values.append(np.nan)
                        continue
                    state[at], state[at + 1] = state[at] * decay + x, state[at + 1] * decay + 1.0
                    values.append(state[at] / state[at + 1])
                frame[f"{c}_ewma_{name}"] = np.array(values)
            frame[f"{c}_ewma_diff"] = frame[f"{c}_ewma_fast"] - frame[f"{c}_ewma_slow"]
        self.sums.update(tuple(state))

        c = self.config
        sample_ns, mid = self.throttle.get() if self.throttle.exists() else (None, None)
        sampled, predict = [], []
        for t, m in zip(frame["recv_ns"].tolist(), frame["mid"].tolist()):
            due = sample_ns is None or t - sample_ns >= c.sample_interval_ns
            moved = due and (mid is None or c.min_mid_change <= 0 or abs(m - mid) >= c.min_mid_change)
            sample_ns, mid = (int(t) if due else sample_ns), (float(m) if moved else mid)
            sampled.append(due)
            predict.append(moved)
        self.throttle.update((sample_ns, mid))
        frame["sampled"], frame["predict"] = sampled, predict
        yield pd.DataFrame({x.split()[0]: frame[x.split()[0]] for x in OUTPUT_DDL.split(", ")})


def online_features(
    events: DataFrame, config: FeatureConfig | None = None, idle_ns: int = DEFAULT_IDLE_NS, watermark: str = DEFAULT_WATERMARK
) -> DataFrame:
    """Feature rows of a stream of book, trade and reference events per asset.

    The history of an asset ends `idle_ns` (times the configured scale) after its last row.
    """
    prepare_state_store(events.sparkSession)
    config = config or FeatureConfig()
    timed = with_event_time(events, watermark, NS_PER_MS)
    out = with_state(timed.groupBy("asset_id"), FeatureProcessor(config, idle_ns * config.scale), OUTPUT_DDL)
    return out.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in FEATURES else F.col(c) for c in out.columns])


def fan_out_reference(reference: DataFrame, instruments: DataFrame, grace_ns: int = 5 * NS_PER_SECOND) -> DataFrame:
    """Reference events once per asset of the symbol whose market is live at that time.

    A stream-static join; `instruments` is the (small) table of markets around now.
    """
    live = instruments.select("symbol", F.col("asset_id").alias("__asset"), "start_ns", "expiry_ns")
    joined = reference.drop("asset_id").join(live, "symbol")
    inside = (F.col("recv_ns") >= F.col("start_ns")) & (F.col("recv_ns") <= F.col("expiry_ns") + F.lit(grace_ns))
    return joined.where(inside).withColumnRenamed("__asset", "asset_id").drop("start_ns", "expiry_ns")
