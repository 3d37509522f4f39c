"""Online signal gates: threshold, crossing, cooldown, entry limit, structure, models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from tickloom import NS_PER_MS, NS_PER_SECOND
from tickloom.operators.gating import entry_allowed, signal_key
from tickloom.streaming.common import DEFAULT_IDLE_NS, DEFAULT_WATERMARK, EndingProcessor, in_order, prepare_state_store, with_event_time, with_state

GATES = ["raw_signal", "crossed", "cooldown_ok", "max_entries_ok", "has_opposite", "entry_ok", "p_fill_ok", "unwind_ok", "first_leg_ok"]


@dataclass(frozen=True)
class GateConfig:
    """Gate parameters. `crossing` is for single-model scores only."""

    threshold: float
    min_p_fill: float = 0.0
    min_unwind: float = -1.0
    min_p_first: float = 0.0
    crossing: bool = False
    cooldown_seconds: float = 10.0
    max_entries: int = 1
    candidate_seconds: float = 0.0
    min_ask: float = 0.0
    max_ask: float = 1.0
    max_spread: float = 0.05
    min_tte: float = 0.0


def scored_gates(samples: DataFrame, c: GateConfig) -> DataFrame:
    """Stateless gates as columns, before any state is touched."""

    def at_least(col: str, limit: float):
        return F.col(col).isNull() | (F.col(col) >= limit) if col in samples.columns else F.lit(True)

    score = F.col("decision_score")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    return samples.select(
        "*",
        signal_key().alias("signal_key"),
        finite.alias("finite"),
        F.coalesce(finite & (score >= c.threshold), F.lit(False)).alias("raw_signal"),
        F.col("opposite_asset_id").isNotNull().alias("has_opposite"),
        entry_allowed(c.min_ask, c.max_ask, c.max_spread, c.min_tte).alias("entry_ok"),
        F.coalesce(F.col("p_fill") >= c.min_p_fill, F.lit(False)).alias("p_fill_ok"),
        at_least("pred_unwind_profit", c.min_unwind).alias("unwind_ok"),
        at_least("p_first", c.min_p_first).alias("first_leg_ok"),
    )


class GateProcessor(EndingProcessor):
    """Cooldown, entry count and last scores of one signal key, in one value (a map state costs a call a score and an iterator)."""

    def __init__(self, config: GateConfig, idle_ns: int | None = None):
        self.config, self.idle_ns = config, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", "last_ns long, entries long, candidate_ns long, assets array<string>, scores array<double>")
        self.ending(handle, self.state)

    def handleInputRows(self, key, rows, timerValues):
        c = self.config
        frame = in_order(rows, ["recv_ns", "seq"])
        if frame is None:
            return
        self.lives_on(frame["recv_ns"].iloc[-1])
        last, entries, candidate, assets, known = self.state.get() if self.state.exists() else (None, 0, None, [], [])
        cooldown, spacing = int(c.cooldown_seconds * NS_PER_SECOND), int(c.candidate_seconds * NS_PER_SECOND)
        scores = dict(zip(assets, known))
        out = {n: [] for n in ("crossed", "cooldown_ok", "max_entries_ok", "signal", "candidate", "entry_no")}
        for r in frame.itertuples(index=False):
            before = scores.get(r.asset_id)
            crossed = not c.crossing or before is None or before < c.threshold
            cool = last is None or r.recv_ns - last >= cooldown
            room = c.max_entries == 0 or entries < c.max_entries
            signal = bool(
                r.finite and r.raw_signal and crossed and cool and room and r.has_opposite and r.entry_ok
                and r.p_fill_ok and r.unwind_ok and r.first_leg_ok
            )
            due = bool(
                spacing > 0 and r.has_opposite and r.entry_ok and (candidate is None or r.recv_ns - candidate >= spacing)
            )
            if signal:
                last, entries = int(r.recv_ns), entries + 1
            if due:
                candidate = int(r.recv_ns)
            scores[r.asset_id] = float(r.decision_score) if r.finite else float("-inf")
            for n, v in zip(out, (crossed, cool, room, signal, due, entries if signal else 0)):
                out[n].append(v)
        self.state.update((last, entries, candidate, list(scores), list(scores.values())))
        yield frame.assign(**out)


OUTPUT = [
    "recv_ns long", "seq long", "market_id string", "asset_id string", "opposite_asset_id string", "outcome string", "signal_key string",
    "best_bid double", "best_ask double", "p_fill double", "decision_score double", "tick_size double", "raw_signal boolean", "has_opposite boolean",
    "entry_ok boolean", "p_fill_ok boolean", "unwind_ok boolean", "first_leg_ok boolean", "crossed boolean", "cooldown_ok boolean",
    "max_entries_ok boolean", "signal boolean", "candidate boolean", "entry_no long",
]


def gate_signals(samples: DataFrame, config: GateConfig, idle_ns: int = DEFAULT_IDLE_NS, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """Every scored sample with its gate flags, `signal`, and `candidate` (shadow sample).

    For streams: a key's rows of one micro-batch are handled together. Whole tables go
    through `operators.gating`, which cuts keys into slices. On a stream, a key's state ends `idle_ns` (the
    cooldown at least) after its last row.
    """
    prepare_state_store(samples.sparkSession)
    if "tick_size" not in samples.columns:
        samples = samples.withColumn("tick_size", F.lit(None).cast("double"))
    gated = scored_gates(samples, config)
    names = [o.split()[0] for o in OUTPUT]
    kept = [n for n in names if n in gated.columns] + ["finite"]
    schema = ", ".join([*OUTPUT, "finite boolean"])
    ordered = [*names, "finite"]
    rows, ends = gated.select(*kept), None
    if samples.isStreaming:
        rows, ends = with_event_time(rows, watermark, NS_PER_MS), max(idle_ns, int(config.cooldown_seconds * NS_PER_SECOND))
    flagged = with_state(rows.groupBy("signal_key"), _Ordered(config, ordered, ends), schema)
    return flagged.drop("finite")


class _Ordered(GateProcessor):
    """`GateProcessor` with the output columns in schema order."""

    def __init__(self, config: GateConfig, columns: list[str], idle_ns: int | None = None):
        super().__init__(config, idle_ns)
        self.columns = columns

    def handleInputRows(self, key, rows, timerValues):
        for frame in super().handleInputRows(key, rows, timerValues):
            yield frame[self.columns]


def gate_counts(flagged: DataFrame, by: list | None = None) -> DataFrame:
    """How often each gate passed or blocked; blocks are counted for samples without a signal."""
    model = F.col("raw_signal") & F.col("p_fill_ok") & F.col("unwind_ok")
    blocked = {
        "blocked_threshold": ~F.col("raw_signal"),
        "blocked_p_fill": ~F.col("p_fill_ok"),
        "blocked_unwind": ~F.col("unwind_ok"),
        "blocked_crossing": ~F.col("crossed"),
        "blocked_cooldown": ~F.col("cooldown_ok"),
        "blocked_max_entries": ~F.col("max_entries_ok"),
        "blocked_no_opposite": ~F.col("has_opposite"),
        "blocked_entry_filter": ~F.col("entry_ok"),
    }
    return flagged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if("raw_signal").alias("pass_threshold"),
        F.count_if("p_fill_ok").alias("pass_p_fill"),
        F.count_if("unwind_ok").alias("pass_unwind"),
        F.count_if(model).alias("pass_model_gates"),
        F.count_if(model & F.col("entry_ok") & F.col("has_opposite")).alias("pass_model_and_entry_gates"),
        F.count_if("signal").alias("signals"),
        *[F.count_if(~F.col("signal") & c).alias(n) for n, c in blocked.items()],
    )
