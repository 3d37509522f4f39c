"""Streaming queries: the events table replayed as a stream of available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import NS_PER_SECOND
from tickloom.functions.prices import PRICE_BUFFER
from tickloom.streaming import features as online
from tickloom.streaming.book import stream_book_states
from tickloom.streaming.common import read_table_stream, run_to_table
from tickloom.streaming.monitor import bucket_sample, lifecycle, stalls, windowed_gate_counts
from tickloom.streaming.outcomes import OutcomeConfig, as_events, outcome_totals, recent_profit, resolve_outcomes
from tickloom.streaming.signals import GateConfig, gate_counts, gate_signals
from tickloom.workload import mapping as m
from tickloom.workload.base_sql import BOOK, HOUR, SCORED, TICKS, TRADES, with_ctes
from tickloom.workload.model_queries import ENTRY, chain
from tickloom.workload.registry import query


class _Streamed:
    """Stands in for the batch reader, so that the mappings apply to a stream."""

    def __init__(self, spark):
        self._spark = spark
        self.conf = spark.conf
        self.read = self

    def parquet(self, path: str):
        folder, name = path.rsplit("/", 1)
        return read_table_stream(self._spark, folder, name)


def closed(width: int) -> str:
    """Only windows that the final watermark (2 s behind the last event) has closed are emitted."""
    return f"(recv_ns // {width} + 1) * {width} <= (SELECT max(recv_ns) FROM ticks) - 2000000000"


@query(
    "stream_bucket_sample",
    with_ctes(
        BOOK,
        f"""SELECT asset_id, recv_ns, seq, current_mid FROM book WHERE {closed(4 * HOUR)}
            QUALIFY row_number() OVER (PARTITION BY asset_id, recv_ns // {4 * HOUR} ORDER BY recv_ns DESC, seq DESC) = 1""",
    ),
)
def sample_stream(spark, sf):
    return run_to_table(bucket_sample(m.book(_Streamed(spark), sf), ["asset_id"], "4 hours", ["current_mid"]), "bucket-sample")


@query(
    "stream_stalls",
    with_ctes(
        TICKS
        + f""", g AS (SELECT event_type, recv_ns, coalesce(recv_ns // 1000 - lag(recv_ns // 1000) OVER w >= {HOUR // 1000}, true) AS opens FROM ticks
             WINDOW w AS (PARTITION BY event_type ORDER BY recv_ns, seq)),
        s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY recv_ns) AS sid FROM g)""",
        "SELECT event_type, count(*) AS events, max(recv_ns) AS quiet_since FROM s GROUP BY event_type, sid HAVING max(recv_ns) + 3600000000000 <= (SELECT max(recv_ns) FROM ticks) - 2000000000",
    ),
)
def stall_stream(spark, sf):
    return run_to_table(stalls(m.ticks(_Streamed(spark), sf), "event_type", "1 hour"), "stalls")


@query("stream_order_book")
def book_stream(spark, sf):
    d = m.deltas(_Streamed(spark), sf)
    tie = F.xxhash64("price", "size", "side").bitwiseAND(F.lit(0x3FFFFFFF)).cast("int")
    states = run_to_table(stream_book_states(d.withColumn("part2", tie), 0.005), "book")
    return states.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("refreshed").alias("refreshed"), F.round(F.sum("midpoint"), 2).alias("mid_sum")
    )


def scored_stream(spark, sf):
    s = m.scored(spark, sf)
    return s.withColumn("decision_score", F.col("p_fill")).withColumn("tick_size", F.lit(0.01))


GATE = GateConfig(
    threshold=0.5, crossing=True, cooldown_seconds=10 * 3600, max_entries=3, min_ask=0.2, max_ask=0.8, max_spread=0.04, min_tte=20.0
)
GATED = (
    SCORED
    + ", lagged AS (SELECT *, lag(p_fill) OVER (PARTITION BY asset_id ORDER BY recv_ns, seq) AS prev FROM scored), "
    + f"cand AS (SELECT market_id || ':' || outcome AS signal_key, recv_ns FROM lagged WHERE p_fill >= 0.5 AND (prev IS NULL OR prev < 0.5) AND {ENTRY})"
    + chain(["signal_key"], 10 * HOUR)
)


@query("stream_signals", with_ctes(GATED, "SELECT signal_key, recv_ns, CAST(n AS BIGINT) AS entry_no FROM picks WHERE n <= 3"))
def signal_stream(spark, sf):
    flagged = run_to_table(gate_signals(scored_stream(_Streamed(spark), sf), GATE), "signals")
    return flagged.where("signal").select("signal_key", "recv_ns", "entry_no")


@query(
    "gate_counts",
    with_ctes(
        SCORED,
        f"""SELECT count(*) AS samples, count(*) FILTER (WHERE p_fill >= 0.5) AS pass_threshold, count(*) FILTER (WHERE NOT ({ENTRY})) AS blocked_entry_filter FROM scored""",
    ),
)
def counts_query(spark, sf):
    flagged = run_to_table(gate_signals(scored_stream(_Streamed(spark), sf), GATE), "gates")
    return gate_counts(flagged).select("samples", "pass_threshold", "blocked_entry_filter")


@query(
    "stream_gate_counts",
    with_ctes(SCORED, "SELECT recv_ns // 86400000000000 AS day, count(*) AS samples, count(*) FILTER (WHERE p_fill >= 0.5) AS pass_threshold FROM scored WHERE " + closed(24 * HOUR) + " GROUP BY 1"),
)
def gate_count_stream(spark, sf):
    flagged = run_to_table(gate_signals(scored_stream(_Streamed(spark), sf), GATE), "flagged")
    folder = flagged.inputFiles()[0].rsplit("/", 1)[0]
    stream = read_table_stream(spark, folder, "*.parquet", max_files=None)
    counts = run_to_table(windowed_gate_counts(stream, "1 day"), "gate-counts")
    day = F.floor(F.unix_seconds("window_start") / 86400)
    return counts.select(day.alias("day"), "samples", "pass_threshold")


H10 = 10 * HOUR
OUTCOME = (
    SCORED
    + TRADES
    + f""", sig AS (SELECT *, p_fill >= 0.5 AS tracked FROM scored),
    firsts AS (SELECT market_id, recv_ns, min(seq) AS seq FROM scored GROUP BY ALL),
    ends AS (SELECT s.seq, f.recv_ns AS end_ns, f.seq AS end_seq FROM sig s ASOF JOIN firsts f ON s.market_id = f.market_id AND s.recv_ns + {H10} <= f.recv_ns),
    later AS (SELECT s.seq, b.asset_id = s.asset_id AS own, b.best_ask <= s.best_ask + {PRICE_BUFFER}::DOUBLE + 1e-12 AS good, (b.recv_ns, b.seq) AS place
        FROM sig s LEFT JOIN ends e USING (seq) JOIN scored b ON b.market_id = s.market_id AND b.recv_ns >= s.recv_ns AND (b.recv_ns, b.seq) > (s.recv_ns, s.seq)
        WHERE e.end_ns IS NULL OR (b.recv_ns, b.seq) <= (e.end_ns, e.end_seq)),
    bought AS (SELECT seq, bool_or(own AND good) OR coalesce(min(place) FILTER (WHERE NOT own) < min(place) FILTER (WHERE own), bool_or(NOT own)) AS ok FROM later GROUP BY seq),
    fill AS (SELECT s.seq, count(*) AS n FROM sig s JOIN trades t ON t.asset_id = s.opposite_asset_id AND t.side = 'SELL' AND t.recv_ns BETWEEN s.recv_ns + {HOUR // 4} AND s.recv_ns + {H10}
             AND t.price <= (0.96::DOUBLE - s.best_ask) - 1.0::DOUBLE * 0.01::DOUBLE + 1e-12 GROUP BY 1),
    resolved AS (SELECT s.seq, s.tracked, CASE WHEN s.tracked AND NOT coalesce(bought.ok, false) THEN 'missed' WHEN fill.n > 0 THEN 'success' ELSE 'unwind' END AS result
        FROM sig s LEFT JOIN fill ON fill.seq = s.seq LEFT JOIN bought ON bought.seq = s.seq LEFT JOIN ends ON ends.seq = s.seq
        WHERE s.recv_ns + {H10} <= (SELECT max(recv_ns) FROM ticks) - 2000000000 OR ends.seq IS NOT NULL)"""
)


def outcome_events(spark, sf):
    s = m.scored(spark, sf)
    books = as_events(s.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2), "book")
    trades = as_events(m.trades(spark, sf), "trade")
    signals = s.withColumns({"signal_id": F.col("seq").cast("string"), "tracked": F.col("p_fill") >= 0.5, "tick_size": F.lit(0.01)})
    return books.unionByName(trades).unionByName(as_events(signals, "signal"))


def outcomes(spark, sf):
    config = OutcomeConfig(horizon_ns=H10, latency_ns=HOUR // 4)
    return run_to_table(resolve_outcomes(outcome_events(_Streamed(spark), sf), config), "outcomes")


@query("stream_outcomes", with_ctes(OUTCOME, "SELECT CAST(seq AS VARCHAR) AS signal_id, tracked, result FROM resolved"))
def outcome_stream(spark, sf):
    return outcomes(spark, sf).select("signal_id", "tracked", "result")


@query(
    "stream_outcome_totals",
    with_ctes(
        OUTCOME,
        """SELECT count(*) AS resolved, count(*) FILTER (WHERE result = 'success') AS success, count(*) FILTER (WHERE result = 'unwind') AS failure,
           least(count(*) FILTER (WHERE result <> 'missed'), 100) AS recent_n FROM resolved WHERE tracked""",
    ),
)
def totals_stream(spark, sf):
    o = outcomes(spark, sf)
    totals = outcome_totals(o).select("resolved", "success", "failure")
    return totals.withColumn("recent_n", F.lit(recent_profit(o).first()["recent_n"]))


@query(
    "stream_lifecycle",
    with_ctes(
        TICKS,
        f"""SELECT asset_id, unnest(CASE WHEN ends <= (SELECT max(recv_ns) FROM ticks) - {2 * NS_PER_SECOND} THEN ['active', 'expired'] ELSE ['active'] END) AS state
            FROM (SELECT asset_id, recv_ns, {1_704_067_200 * NS_PER_SECOND} + CAST(substr(asset_id, 2) AS BIGINT) % 40 * {24 * HOUR} + {5 * NS_PER_SECOND} AS ends FROM ticks)
            WHERE recv_ns <= ends GROUP BY asset_id, ends""",
    ),
)
def lifecycle_stream(spark, sf):
    """Expiries spread over days: assets seen only after their end never appear, the last ones are still running."""
    expiry = F.lit(1_704_067_200 * NS_PER_SECOND) + F.substring("asset_id", 2, 9).cast("long") % 40 * F.lit(24 * HOUR)
    t = m.ticks(_Streamed(spark), sf).withColumn("expiry_ns", expiry)
    return run_to_table(lifecycle(t), "lifecycle").select("asset_id", "state")


def rng(w: int) -> str:
    return f"OVER (PARTITION BY asset_id ORDER BY recv_ns RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


@query(
    "stream_online_features",
    with_ctes(
        BOOK
        + """, b AS (SELECT b.* FROM book b JOIN ticks t USING (seq) WHERE event_type IN ('click', 'signup')),
        mv AS (SELECT *, current_spread - lag(current_spread) OVER w AS d, current_mid / lag(current_mid) OVER w - 1 AS r FROM b WINDOW w AS (PARTITION BY asset_id ORDER BY recv_ns, seq))""",
        f"""SELECT asset_id, seq, CAST(count(*) {rng(HOUR)} AS DOUBLE) AS book_update_count_1s, CAST(count(*) FILTER (WHERE d > 0) {rng(HOUR)} AS DOUBLE) AS spread_widen_count_recent,
            round(stddev_samp(r) {rng(3 * HOUR)}, 6) AS realized_vol_short,
            (SELECT arg_max(x.mid, x.recv_ns) FROM ticks x WHERE x.event_type = 'view' AND x.asset_id = mv.asset_id AND x.recv_ns <= mv.recv_ns AND x.recv_ns >= mv.recv_ns - {HOUR // 2}) AS ref_mid
            FROM mv""",
    ),
)
def feature_stream(spark, sf):
    t = m.ticks(_Streamed(spark), sf)
    kind = F.when(F.col("event_type") == "view", "ref").when(F.col("event_type").isin("purchase", "error"), "trade").otherwise("book")
    events = t.select(
        kind.alias("kind"), "recv_ns", "seq", "asset_id", (F.col("mid") - 0.01).alias("best_bid"), (F.col("mid") + 0.01).alias("best_ask"), "mid",
        (0.01 + (F.col("k") % 5).cast("double") / 100.0).alias("spread"), F.lit(None).cast("double").alias("depth_top10_imbalance"),
        F.col("mid").alias("price"), (F.col("k") + 1).cast("double").alias("size"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0).alias("signed_side"),
    )
    config = online.FeatureConfig(scale=m.SCALE, tolerance_ns=HOUR // 2, sample_interval_ns=HOUR // 10)
    out = run_to_table(online.online_features(events, config), "online-features")
    return out.select("asset_id", "seq", "book_update_count_1s", "spread_widen_count_recent", F.round("realized_vol_short", 6).alias("realized_vol_short"), "ref_mid")
