"""Outcome of open signals: maker fill on the other side, first-leg fill, unwind."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.functions import prices
from tickloom.streaming.common import DEFAULT_IDLE_NS, DEFAULT_WATERMARK, EndingProcessor, in_order, prepare_state_store, with_event_time, with_state

# The columns every event row of the outcome stream has.
EVENT_DDL = (
    "kind string, recv_ns long, seq long, market_id string, asset_id string, opposite_asset_id string, signal_id string, "
    "best_bid double, best_ask double, mid double, side string, price double, tick_size double, tracked boolean"
)
OUTPUT_DDL = (
    "signal_id string, market_id string, asset_id string, predict_ns long, resolve_ns long, tracked boolean, result string, profit double, "
    "first_leg_price double, second_leg_size double, second_leg_quote double, fill_price double, fill_lag_ms double, "
    "future_bid double, future_ask double, future_mid double"
)
RANK = {"book": 0, "trade": 1, "signal": 2}


@dataclass(frozen=True)
class OutcomeConfig:
    horizon_ns: int = 10 * NS_PER_SECOND
    latency_ns: int = 250 * NS_PER_MS
    through_ticks: float = 1.0
    side: str = "SELL"
    fee_rate: float = prices.FEE_RATE
    buffer: float = prices.PRICE_BUFFER
    max_total: float = prices.MAX_TOTAL_PRICE


@dataclass
class Open:
    """A signal waiting for its horizon."""

    signal_id: str
    predict_ns: int
    asset_id: str
    opposite: str | None
    ask: float
    tick: float
    tracked: bool
    fill_price: float | None = None
    fill_ns: int | None = None
    entered: bool = False

    def observe_trade(self, c: OutcomeConfig, asset: str, side: str, price: float, at: int) -> None:
        """The first trade that proves the second leg's quote would have filled."""
        if self.fill_price is not None or asset != self.opposite or side != c.side:
            return
        if not self.predict_ns + c.latency_ns <= at <= self.predict_ns + c.horizon_ns:
            return
        if price <= (c.max_total - self.ask) - c.through_ticks * self.tick + prices.FILL_EPSILON:
            self.fill_price, self.fill_ns = price, at

    def observe_ask(self, c: OutcomeConfig, ask: float | None) -> None:
        """Whether the first leg could be bought at its limit."""
        if ask is not None and ask <= self.ask + c.buffer + prices.FILL_EPSILON:
            self.entered = True

    def outcome(self, c: OutcomeConfig, book: tuple | None) -> dict:
        paid = self.ask + c.buffer
        if self.tracked and not self.entered:
            return {"result": "missed", "profit": 0.0, "first_leg_price": paid}
        size = 1.0 - c.fee_rate * paid * (1.0 - paid)
        quote = c.max_total - self.ask
        bid, ask, mid = book or (0.0, 0.0, 0.0)
        base = {
            "first_leg_price": paid, "second_leg_size": size, "second_leg_quote": quote,
            "future_bid": bid, "future_ask": ask, "future_mid": mid,
        }
        if self.fill_price is not None:
            return base | {
                "result": "success", "profit": size - (paid + size * quote), "fill_price": self.fill_price,
                "fill_lag_ms": (self.fill_ns - self.predict_ns) / NS_PER_MS,
            }
        return base | {"result": "unwind" if self.opposite else "no_opposite", "profit": size * bid - paid}


class OutcomeProcessor(EndingProcessor):
    """Open signals and latest books of one market; a timer closes what no book row closes.

    A signal is resolved at the market's first book row at or after its horizon, with the
    book as of that row, or when the watermark passes the horizon. A market has one timer for that, at the
    earliest horizon of the signals left open, so signals which a book row closes cost none.
    """

    def __init__(self, config: OutcomeConfig, idle_ns: int | None = None):
        self.config, self.idle_ns = config, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState(
            "open", "signal_id string",
            "predict_ns long, asset_id string, opposite string, ask double, tick double, tracked boolean, fill_price double, fill_ns long, entered boolean",
        )
        self.books = handle.getMapState("books", "asset_id string", "bid double, ask double, mid double")
        self.due = handle.getValueState("due", "at_ms long")
        self.ending(handle, self.books)

    def _load(self):
        opened = {k[0]: Open(k[0], *v) for k, v in self.open.iterator()}
        books = {k[0]: (v[0], v[1], v[2]) for k, v in self.books.iterator()}
        return opened, books

    def _store(self, opened: dict, before: dict, books: dict) -> None:
        for i in before.keys() - opened.keys():
            self.open.removeKey((i,))
        for i, o in opened.items():
            if before.get(i) != o:
                self.open.updateValue(
                    (i,), (o.predict_ns, o.asset_id, o.opposite, o.ask, o.tick, o.tracked, o.fill_price, o.fill_ns, o.entered)
                )
        for a, b in books.items():
            self.books.updateValue((a,), b)

    def _due_ms(self, o: Open) -> int:
        return (o.predict_ns + self.config.horizon_ns) // NS_PER_MS + 1

    def _wait(self, opened: dict, fired: int | None = None) -> None:
        """Move the timer to the earliest horizon of the open signals; `fired` is one that is gone already."""
        at = min((self._due_ms(o) for o in opened.values()), default=None)
        before = self.due.get()[0] if self.due.exists() else None
        if at == before and at != fired:
            return
        if before is not None and before != fired:
            self.handle.deleteTimer(before)
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def _close(self, market: str, opened: dict, books: dict, now: int) -> list[dict]:
        c, rows = self.config, []
        for i in [i for i, o in opened.items() if now - o.predict_ns >= c.horizon_ns]:
            o = opened.pop(i)
            head = {
                "signal_id": i, "market_id": market, "asset_id": o.asset_id, "predict_ns": o.predict_ns, "resolve_ns": now, "tracked": o.tracked
            }
            rows.append(head | o.outcome(c, books.get(o.asset_id)))
        return rows

    @staticmethod
    def _frame(rows: list[dict]):
        import pandas as pd

        columns = [x.split()[0] for x in OUTPUT_DDL.split(", ")]
        return pd.DataFrame(rows).reindex(columns=columns)

    def handleInputRows(self, key, rows, timerValues):
        c = self.config
        frame = in_order(rows, ["recv_ns", "seq", "rank"])
        if frame is None:
            return
        self.lives_on(frame["recv_ns"].iloc[-1])
        opened, books = self._load()
        before, closed = {i: replace(o) for i, o in opened.items()}, []
        outside = {i: o for i, o in opened.items() if not o.entered}
        for r in frame.itertuples(index=False):
            if r.kind == "book":
                books[r.asset_id] = (float(r.best_bid), float(r.best_ask), float(r.mid))
                for o in outside.values():
                    o.observe_ask(c, books[o.asset_id][1] if o.asset_id in books else None)
                closed += self._close(key[0], opened, books, int(r.recv_ns))
                outside = {i: o for i, o in outside.items() if not o.entered and i in opened}
            elif r.kind == "trade":
                for o in opened.values():
                    o.observe_trade(c, r.asset_id, r.side, float(r.price), int(r.recv_ns))
            else:
                tick = r.tick_size if r.tick_size == r.tick_size and r.tick_size and r.tick_size > 0 else prices.TICK_FALLBACK
                opposite = r.opposite_asset_id if isinstance(r.opposite_asset_id, str) else None
                opened[r.signal_id] = outside[r.signal_id] = Open(
                    r.signal_id, int(r.recv_ns), r.asset_id, opposite, float(r.best_ask), float(tick), bool(r.tracked)
                )
        self._store(opened, before, books)
        self._wait(opened)
        if closed:
            yield self._frame(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if self.due.exists() and self.due.get()[0] == expired:
            opened, books = self._load()
            before, closed = {i: replace(o) for i, o in opened.items()}, []
            passed = max(expired, timerValues.getCurrentWatermarkInMs() - 1)
            for at in sorted({self._due_ms(o) for o in opened.values()}):
                if at <= passed:
                    closed += self._close(key[0], opened, books, at * NS_PER_MS)
            self._store(opened, before, {})
            self._wait(opened, expired)
            if closed:
                yield self._frame(closed)
        self.ends_at(expired)


def resolve_outcomes(
    events: DataFrame, config: OutcomeConfig | None = None, watermark: str = DEFAULT_WATERMARK, idle_ns: int = DEFAULT_IDLE_NS
) -> DataFrame:
    """Outcomes of the signals among `events` (rows of `EVENT_DDL`), keyed by market.

    The books of a market end `idle_ns` (the horizon at least) after its last row.
    """
    config = config or OutcomeConfig()
    prepare_state_store(events.sparkSession)
    rank = F.when(F.col("kind") == "book", RANK["book"]).when(F.col("kind") == "trade", RANK["trade"]).otherwise(RANK["signal"])
    timed = with_event_time(events.where(F.col("market_id").isNotNull()).withColumn("side", F.upper("side")).withColumn("rank", rank), watermark)
    return with_state(timed.groupBy("market_id"), OutcomeProcessor(config, max(idle_ns, config.horizon_ns + NS_PER_SECOND)), OUTPUT_DDL)


def as_events(df: DataFrame, kind: str) -> DataFrame:
    """Book, trade or signal rows in the outcome stream's columns."""
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(EVENT_DDL)
    named = df.withColumn("kind", F.lit(kind))
    return named.select(
        *[(F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def outcome_samples(outcomes: DataFrame, h: int = 10) -> DataFrame:
    """Resolved samples with the nested labels of the event log."""
    profit = prices.finite_or_null(F.col("profit"))
    return outcomes.where(F.col("result") != "missed").select(
        F.lit(1).alias("schema_version"),
        F.when(F.col("tracked"), "live_signal_resolved_sample").otherwise("live_candidate_resolved_sample").alias("event"),
        F.col("resolve_ns").alias("timestamp_ns"),
        "signal_id",
        "market_id",
        "asset_id",
        F.struct(
            profit.alias(f"final_profit_{h}s"),
            F.when(profit > 0, "enter").otherwise("skip").alias(f"y_final_profit_entry_{h}s"),
            (profit > 0).cast("int").alias(f"y_final_profit_entry_binary_{h}s"),
            F.when(F.col("result") == "success", "enter").otherwise("skip").alias(f"y_two_leg_entry_{h}s"),
        ).alias("labels"),
        F.struct("result", "first_leg_price", "second_leg_quote", "fill_price", "fill_lag_ms", "future_bid").alias("outcome_detail"),
    )


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Counts and profit of tracked signals."""
    tracked = outcomes.where("tracked")
    return tracked.agg(
        F.count(F.lit(1)).alias("resolved"),
        F.count_if(F.col("result") == "success").alias("success"),
        F.count_if(F.col("result").isin("unwind", "no_opposite")).alias("failure"),
        F.sum(F.when(F.col("result") != "missed", F.col("profit"))).alias("total_profit"),
    )


def recent_profit(outcomes: DataFrame, rows: int = 100) -> DataFrame:
    """Mean profit of the last `rows` resolved tracked signals."""
    last = outcomes.where("tracked and result <> 'missed'").orderBy(F.col("resolve_ns").desc(), "signal_id").limit(rows)
    return last.agg(F.count(F.lit(1)).alias("recent_n"), F.avg("profit").alias("avg_profit"))
