"""Queries over ticks: as-of joins, windows, samples, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.buckets import spread_code
from tickloom.operators.asof import Lookup, asof_adaptive, asof_join, asof_lookups, shifted_lookups
from tickloom.operators.combine import opposite_assets, with_opposite
from tickloom.operators.ewma import ewma
from tickloom.operators.gating import quiet_spells
from tickloom.operators.intervals import forward_interval_min
from tickloom.operators.ranks import quantile_bucket, rank_bucket
from tickloom.operators.sampling import change_events, keep_last, time_bucket_sample
from tickloom.operators.slices import with_position
from tickloom.plans import features, labels, research
from tickloom.plans.canonical import quality_filter
from tickloom.plans.evaluation import bucket_table
from tickloom.session import cut_lineage
from tickloom.workload import mapping as m
from tickloom.workload.base_sql import BOOK, HOUR, REFERENCE, TICKS, TRADES, with_ctes
from tickloom.workload.mapping import DAY
from tickloom.workload.registry import query

KEYS = ["market_id", "asset_id"]
TIME = ["recv_ns", "seq"]
SLICE = 2 * DAY


def future_ctes(h: int, tol: int, name: str = "fut", samples: str = "book") -> str:
    """First book row in [t + h, t + h + tol] of the same asset."""
    return f""", {name} AS (
      SELECT s.seq, arg_min(f.current_mid, f.recv_ns) AS future_mid, arg_min(f.best_bid, f.recv_ns) AS future_bid,
             arg_min(f.best_ask, f.recv_ns) AS future_ask
      FROM {samples} s JOIN book f ON f.asset_id = s.asset_id AND f.recv_ns BETWEEN s.recv_ns + {h} AND s.recv_ns + {h + tol}
      GROUP BY s.seq)"""


@query(
    "markout_by_bucket",
    with_ctes(
        BOOK
        + f""", sampled AS (
      SELECT * FROM book QUALIFY row_number() OVER (PARTITION BY market_id, asset_id, recv_ns // {4 * HOUR} ORDER BY recv_ns DESC, seq DESC) = 1)"""
        + future_ctes(10 * HOUR, 5 * HOUR, samples="sampled"),
        """SELECT CASE WHEN current_spread / greatest(current_mid, 0.01) < 0.005 THEN 0
                       WHEN current_spread / greatest(current_mid, 0.01) < 0.02 THEN 1 ELSE 2 END AS spread_bucket,
                  count(*) AS rows, round(avg((future_mid - current_mid) / current_mid * 10000), 4) AS avg_markout_bps,
                  round(avg(CASE WHEN future_mid > current_mid THEN 1.0 ELSE 0.0 END), 6) AS win_rate
           FROM sampled JOIN fut USING (seq) GROUP BY 1""",
    ),
)
def markout_by_bucket(spark, sf):
    book = m.book(spark, sf).select(*KEYS, *TIME, "current_mid", "current_spread", "best_bid", "best_ask")
    samples = time_bucket_sample(book, KEYS, TIME, 4 * HOUR)
    marked = features.future_book(samples, book, [10], 5 * HOUR, m.SCALE)
    bucket = spread_code(F.col("current_spread"), F.col("current_mid"))
    return (
        marked.where(F.col("future_mid_10s").isNotNull())
        .groupBy(bucket.alias("spread_bucket"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.round(F.avg("markout_10s_bps"), 4).alias("avg_markout_bps"),
            F.round(F.avg((F.col("markout_10s_bps") > 0).cast("double")), 6).alias("win_rate"),
        )
    )


@query(
    "time_bucket_sample",
    with_ctes(
        BOOK,
        f"""SELECT market_id, asset_id, recv_ns, seq, current_mid FROM book
            QUALIFY row_number() OVER (PARTITION BY market_id, asset_id, recv_ns // {4 * HOUR} ORDER BY recv_ns DESC, seq DESC) = 1""",
    ),
)
def sample_query(spark, sf):
    return time_bucket_sample(m.book(spark, sf), KEYS, TIME, 4 * HOUR).select(*KEYS, *TIME, "current_mid")


@query(
    "keep_last_per_asset",
    with_ctes(BOOK, "SELECT asset_id, recv_ns, current_mid FROM book QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY recv_ns DESC, seq DESC) = 1"),
)
def keep_last_query(spark, sf):
    return keep_last(m.book(spark, sf), ["asset_id"], TIME).select("asset_id", "recv_ns", "current_mid")


CHANGED = BOOK + """, lagged AS (
  SELECT *, row_number() OVER w AS rn, lag(total_bid_levels) OVER w AS p1, lag(total_ask_levels) OVER w AS p2,
         lag(depth_top10_imbalance) OVER w AS p3
  FROM book WINDOW w AS (PARTITION BY asset_id ORDER BY recv_ns, seq)),
changed AS (
  SELECT * FROM lagged WHERE rn = 1 OR total_bid_levels IS DISTINCT FROM p1
         OR coalesce(abs(depth_top10_imbalance - p3) > 0.6, false))"""


@query("change_events", with_ctes(CHANGED, "SELECT asset_id, recv_ns, seq FROM changed"))
def change_query(spark, sf):
    out = change_events(m.book(spark, sf), ["asset_id"], TIME, ["total_bid_levels"], {"depth_top10_imbalance": 0.6}, slice_width=SLICE)
    return out.select("asset_id", *TIME)


@query(
    "change_events_debounced",
    with_ctes(
        CHANGED,
        f"""SELECT asset_id, recv_ns, seq FROM changed
            QUALIFY coalesce(recv_ns - lag(recv_ns) OVER (PARTITION BY asset_id ORDER BY recv_ns, seq) >= {6 * HOUR}, true)""",
    ),
)
def debounce_query(spark, sf):
    out = change_events(
        m.book(spark, sf), ["asset_id"], TIME, ["total_bid_levels"], {"depth_top10_imbalance": 0.6},
        min_gap_ns=6 * HOUR, slice_width=SLICE,
    )
    return out.select("asset_id", *TIME)


def asof_sql(direction: str, keyed: bool, tol: int) -> str:
    cond = ["r.recv_ns <= s.recv_ns", f"r.recv_ns >= s.recv_ns - {tol}"] if direction == "backward" else [
        "r.recv_ns >= s.recv_ns", f"r.recv_ns <= s.recv_ns + {tol}"]
    pick = "arg_max" if direction == "backward" else "arg_min"
    key = "r.asset_id = s.asset_id AND " if keyed else ""
    return with_ctes(
        BOOK + TRADES,
        f"""SELECT s.asset_id, s.recv_ns, s.seq, {pick}(r.price, r.recv_ns) AS price, {pick}(r.recv_ns, r.recv_ns) AS trade_ns
            FROM book s LEFT JOIN trades r ON {key}{' AND '.join(cond)} GROUP BY ALL""",
    )


def _asof(spark, sf, direction, by, tol):
    left = m.book(spark, sf).select("asset_id", *TIME)
    return asof_join(
        left, m.trades(spark, sf), "recv_ns", "recv_ns", ["price"], tol, by, direction, seq="seq", matched_at="trade_ns"
    )


@query("asof_backward_keyed", asof_sql("backward", True, 12 * HOUR))
def asof_backward(spark, sf):
    return _asof(spark, sf, "backward", ["asset_id"], 12 * HOUR)


@query("asof_forward_keyed", asof_sql("forward", True, 12 * HOUR))
def asof_forward(spark, sf):
    return _asof(spark, sf, "forward", ["asset_id"], 12 * HOUR)


@query("asof_backward_global", asof_sql("backward", False, HOUR // 6))
def asof_global(spark, sf):
    return _asof(spark, sf, "backward", [], HOUR // 6)


@query(
    "asof_adaptive_key",
    with_ctes(
        BOOK + REFERENCE,
        f"""SELECT s.asset_id, s.seq, arg_max(r.ref_mid, r.recv_ns) AS ref_mid
            FROM book s LEFT JOIN ref r ON r.recv_ns <= s.recv_ns AND r.recv_ns >= s.recv_ns - {HOUR // 2} GROUP BY ALL""",
    ),
)
def asof_adaptive_query(spark, sf):
    feed = m.reference_rows(spark, sf)
    lookup = Lookup(feed, "recv_ns", {"ref_mid": "ref_mid"}, HOUR // 2, seq="seq")
    left = m.book(spark, sf).select("asset_id", "symbol", *TIME)
    return asof_adaptive(left, "recv_ns", [lookup], "symbol", "symbol", keyed=False).select("asset_id", "seq", "ref_mid")


@query(
    "asof_by_symbol",
    with_ctes(
        BOOK + REFERENCE,
        f"""SELECT s.asset_id, s.seq, arg_max(r.ref_mid, r.recv_ns) AS ref_mid
            FROM book s LEFT JOIN ref r ON r.recv_ns <= s.recv_ns AND r.recv_ns >= s.recv_ns - {HOUR // 2} AND s.seq % 3 = r.seq % 2 GROUP BY ALL""",
    ),
)
def asof_symbol_query(spark, sf):
    """Three symbols asked for, two of them in the feed: the third gets nothing."""
    feed = m.reference_rows(spark, sf).withColumn("symbol", (F.col("seq") % 2).cast("string"))
    lookup = Lookup(feed, "recv_ns", {"ref_mid": "ref_mid"}, HOUR // 2, seq="seq")
    left = m.book(spark, sf).withColumn("symbol", (F.col("seq") % 3).cast("string")).select("asset_id", "symbol", *TIME)
    return asof_adaptive(left, "recv_ns", [lookup], "symbol", "symbol").select("asset_id", "seq", "ref_mid")


def past(o: int) -> str:
    return f"""(SELECT arg_max(r.ref_mid, r.recv_ns) FROM ref r
               WHERE r.recv_ns + {o} <= s.recv_ns AND r.recv_ns + {o} >= s.recv_ns - {o // 2})"""


@query(
    "asof_shifted_returns",
    with_ctes(
        BOOK + REFERENCE,
        f"SELECT s.asset_id, s.seq, {past(HOUR)} AS past_1h, {past(4 * HOUR)} AS past_4h FROM book s",
    ),
)
def asof_shifted(spark, sf):
    offsets = {"past_1h": HOUR, "past_4h": 4 * HOUR}
    lookups = shifted_lookups(
        m.reference_rows(spark, sf), "recv_ns", "ref_mid", offsets, {k: v // 2 for k, v in offsets.items()}, seq="seq"
    )
    left = m.book(spark, sf).select("asset_id", *TIME)
    return asof_lookups(left, "recv_ns", lookups).select("asset_id", "seq", *offsets)


def own(o: int) -> str:
    return f"arg_max(current_mid, recv_ns) OVER (PARTITION BY asset_id ORDER BY recv_ns RANGE BETWEEN {2 * o} PRECEDING AND {o} PRECEDING)"


@query(
    "own_returns",
    with_ctes(
        BOOK,
        f"""SELECT asset_id, seq, round(current_mid / {own(HOUR // 2)} - 1, 9) AS return_500ms,
                   round(current_mid / {own(HOUR)} - 1, 9) AS return_1s, round(current_mid / {own(3 * HOUR)} - 1, 9) AS return_3s FROM book""",
    ),
)
def own_returns(spark, sf):
    out = features.own_returns(m.book(spark, sf).select(*KEYS, *TIME, "current_mid"), scale=m.SCALE)
    return out.select("asset_id", "seq", *[F.round(f"return_{k}", 9).alias(f"return_{k}") for k in ("500ms", "1s", "3s")])


@query(
    "future_book_markouts",
    with_ctes(
        BOOK + future_ctes(5 * HOUR, 6 * HOUR, "f5") + future_ctes(10 * HOUR, 6 * HOUR, "f10"),
        """SELECT b.asset_id, b.seq, f5.future_mid AS future_mid_5s, f10.future_mid AS future_mid_10s, f10.future_bid AS future_best_bid_10s,
                  round((f10.future_mid - current_mid) / current_mid * 10000, 6) AS markout_10s_bps
           FROM book b LEFT JOIN f5 ON f5.seq = b.seq LEFT JOIN f10 ON f10.seq = b.seq""",
    ),
)
def future_book_query(spark, sf):
    book = m.book(spark, sf).select(*KEYS, *TIME, "current_mid", "best_bid", "best_ask")
    out = features.future_book(book, book, [5, 10], 6 * HOUR, m.SCALE)
    return out.select(
        "asset_id", "seq", "future_mid_5s", "future_mid_10s", "future_best_bid_10s", F.round("markout_10s_bps", 6).alias("markout_10s_bps")
    )


@query(
    "trade_markouts",
    with_ctes(
        BOOK + TRADES,
        f"""SELECT t.asset_id, t.seq, arg_min(b.current_mid, b.recv_ns) AS future_mid_10s,
                   round((arg_min(b.current_mid, b.recv_ns) - t.price) / t.price, 9) AS markout_10s
            FROM trades t LEFT JOIN book b ON b.asset_id = t.asset_id AND b.recv_ns BETWEEN t.recv_ns + {10 * HOUR} AND t.recv_ns + {20 * HOUR}
            GROUP BY t.asset_id, t.seq, t.price""",
    ),
)
def trade_markouts(spark, sf):
    book = m.book(spark, sf).select("asset_id", *TIME, F.col("current_mid").alias("midpoint"))
    out = research.trade_markouts(m.trades(spark, sf).select("asset_id", *TIME, "price"), book, [10], m.SCALE)
    return out.select("asset_id", "seq", "future_mid_10s", F.round("markout_10s", 9).alias("markout_10s"))


@query(
    "opposite_assets",
    with_ctes(
        BOOK,
        """SELECT a.market_id, a.asset_id, b.asset_id AS opposite_asset_id
           FROM (SELECT DISTINCT market_id, asset_id FROM book) a JOIN (SELECT DISTINCT market_id, asset_id FROM book) b
           ON a.market_id = b.market_id AND a.asset_id <> b.asset_id""",
    ),
)
def opposite_query(spark, sf):
    return opposite_assets(m.book(spark, sf))


@query(
    "forward_interval_min",
    with_ctes(
        BOOK + TRADES,
        f"""SELECT s.seq, min(t.price) AS low, max_by(t.recv_ns, -t.price * 1e6 + t.recv_ns / 1e30) AS low_ns
            FROM book s LEFT JOIN trades t ON t.asset_id = 'A' || xor(CAST(substr(s.asset_id, 2) AS BIGINT), 1) AND t.side = 'SELL'
                 AND EXISTS (SELECT 1 FROM book o WHERE o.asset_id = 'A' || xor(CAST(substr(s.asset_id, 2) AS BIGINT), 1))
                 AND t.recv_ns BETWEEN s.recv_ns + {HOUR} AND s.recv_ns + {24 * HOUR}
            GROUP BY s.seq""".replace(
            "max_by(t.recv_ns, -t.price * 1e6 + t.recv_ns / 1e30)",
            "arg_min(t.recv_ns, struct_pack(p := t.price, t := -t.recv_ns))",
        ),
    ),
)
def interval_min_query(spark, sf):
    left = with_opposite(m.book(spark, sf).select(*KEYS, *TIME, "outcome"))
    sells = m.trades(spark, sf).where("side = 'SELL'")
    out = forward_interval_min(
        left, sells, "opposite_asset_id", "asset_id", "recv_ns", "recv_ns", ["asset_id", *TIME], "price", HOUR, 24 * HOUR, "low", "low_ns"
    )
    return out.select("seq", "low", "low_ns")


def rng(w: int) -> str:
    return f"OVER (PARTITION BY asset_id ORDER BY recv_ns RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


@query(
    "book_event_features",
    with_ctes(
        BOOK
        + """, moved AS (SELECT *, current_spread - lag(current_spread) OVER w AS d, current_mid / lag(current_mid) OVER w - 1 AS r
                 FROM book WINDOW w AS (PARTITION BY asset_id ORDER BY recv_ns, seq))""",
        f"""SELECT asset_id, seq, count(*) {rng(HOUR // 10)} AS book_update_count_100ms, count(*) {rng(HOUR // 2)} AS book_update_count_500ms,
                   count(*) {rng(HOUR)} AS book_update_count_1s,
                   count(*) FILTER (WHERE d > 0) {rng(HOUR)} AS spread_widen_count_recent,
                   count(*) FILTER (WHERE d < 0) {rng(HOUR)} AS spread_narrow_count_recent,
                   round(stddev_samp(r) {rng(3 * HOUR)}, 6) AS realized_vol_short FROM moved""",
    ),
)
def book_event_query(spark, sf):
    out = features.book_event_features(m.book(spark, sf), m.SCALE, SLICE)
    return out.select(
        "asset_id", "seq", *features.BOOK_EVENT_FEATURES[:-1], F.round("realized_vol_short", 6).alias("realized_vol_short")
    )


@query(
    "fast_update_flag",
    with_ctes(
        BOOK,
        f"""SELECT asset_id, seq, CAST(coalesce(recv_ns - lag(recv_ns) OVER (PARTITION BY asset_id ORDER BY recv_ns, seq) <= {HOUR}, false) AS TINYINT)
            AS fast_update FROM book""",
    ),
)
def fast_query(spark, sf):
    return features.fast_update_flag(m.book(spark, sf).select(*KEYS, *TIME), HOUR, SLICE).select("asset_id", "seq", "fast_update")


TRADE_ROWS = "OVER (PARTITION BY asset_id ORDER BY recv_ns, seq ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@query(
    "trade_flow_features",
    with_ctes(
        BOOK
        + TRADES
        + f""", w AS (SELECT asset_id, seq, size, price, signed_side,
              count(*) {rng(HOUR)} AS n1, sum(CASE WHEN signed_side > 0 THEN size ELSE 0 END) {rng(HOUR)} AS buys,
              sum(CASE WHEN signed_side < 0 THEN size ELSE 0 END) {rng(HOUR)} AS sells, sum(size * signed_side) {rng(HOUR)} AS signed,
              sum(price * size) {rng(HOUR)} AS notional, sum(size) {rng(HOUR)} AS total,
              count(*) FILTER (WHERE signed_side > 0) {TRADE_ROWS.format(n=9)} AS run,
              row_number() OVER (PARTITION BY asset_id ORDER BY recv_ns, seq) AS rn,
              list_sort(list(size) {TRADE_ROWS.format(n=99)})[95] AS limit95
            FROM trades)""",
        """SELECT asset_id, seq, CAST(n1 AS DOUBLE) AS trade_count_1s, buys AS aggressive_buy_volume_1s, sells AS aggressive_sell_volume_1s,
                  round(signed / (buys + sells + 1e-12), 9) AS signed_volume_imbalance_recent,
                  round(notional / (total + 1e-12), 9) AS recent_vwap,
                  CASE WHEN rn >= 10 THEN run END AS consecutive_buy_trade_run_proxy,
                  CASE WHEN rn >= 100 THEN CAST(size > limit95 AS TINYINT) END AS sweep_indicator_proxy FROM w""",
    ),
)
def trade_query(spark, sf):
    out = features.trade_features(m.trades(spark, sf), scale=m.SCALE, slice_width=SLICE, block_rows=25)
    return out.select(
        "asset_id", "seq", "trade_count_1s", "aggressive_buy_volume_1s", "aggressive_sell_volume_1s",
        F.round("signed_volume_imbalance_recent", 9).alias("signed_volume_imbalance_recent"),
        F.round("recent_vwap", 9).alias("recent_vwap"),
        "consecutive_buy_trade_run_proxy", "sweep_indicator_proxy",
    )


@query(
    "sweep_over_all_trades",
    with_ctes(
        BOOK
        + TRADES
        + """, w AS (SELECT seq, size, row_number() OVER (ORDER BY recv_ns, seq) AS rn,
              list_sort(list(size) OVER (ORDER BY recv_ns, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))[95] AS limit95 FROM trades)""",
        "SELECT seq, CASE WHEN rn >= 100 THEN CAST(size > limit95 AS TINYINT) END AS sweep_indicator_proxy FROM w",
    ),
)
def sweep_query(spark, sf):
    """All trades as one hot key: the case in which a plain window would be one task."""
    one = m.trades(spark, sf).withColumn("asset_id", F.lit("A")).withColumn("market_id", F.lit("m"))
    return features.trade_features(one, scale=m.SCALE, slice_width=SLICE, block_rows=1000).select("seq", "sweep_indicator_proxy")


@query(
    "reference_trade_imbalance",
    with_ctes(
        BOOK
        + TRADES
        + """, w AS (SELECT seq, row_number() OVER (ORDER BY recv_ns, seq) AS rn,
              sum(size * signed_side) OVER (ORDER BY recv_ns, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s,
              sum(size) OVER (ORDER BY recv_ns, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM trades)""",
        "SELECT seq, round(CASE WHEN rn >= 20 THEN s / (v + 1e-12) END, 9) AS ref_recent_trade_imbalance FROM w",
    ),
)
def imbalance_query(spark, sf):
    t = m.trades(spark, sf).withColumn("symbol", F.lit("BTC"))
    out = features.reference_trade_imbalance(t, slice_width=SLICE)
    return out.select("seq", F.round("ref_recent_trade_imbalance", 9).alias("ref_recent_trade_imbalance"))


def ew(span: int) -> str:
    w = 1 - 2 / (span + 1)
    return f"sum(b.x * pow({w!r}, a.n - b.n)) / sum(pow({w!r}, a.n - b.n))"


@query(
    "ewma_features",
    with_ctes(
        BOOK
        + """, v AS (SELECT asset_id, seq, depth_top10_imbalance AS x, row_number() OVER (PARTITION BY asset_id ORDER BY recv_ns, seq) AS n
             FROM book WHERE depth_top10_imbalance IS NOT NULL)"""
        + f""", e AS (SELECT a.asset_id, a.seq, {ew(5)} AS fast, {ew(20)} AS slow
             FROM v a JOIN v b ON a.asset_id = b.asset_id AND b.n <= a.n GROUP BY a.asset_id, a.seq)""",
        """SELECT b.asset_id, b.seq, round(fast, 8) AS depth_top10_imbalance_ewma_fast, round(slow, 8) AS depth_top10_imbalance_ewma_slow,
                  round(fast - slow, 8) AS depth_top10_imbalance_ewma_diff FROM book b LEFT JOIN e ON e.seq = b.seq""",
    ),
)
def ewma_query(spark, sf):
    c = "depth_top10_imbalance"
    out = ewma(m.book(spark, sf).select("asset_id", *TIME, c), ["asset_id"], TIME, [c], features.EWMA_SPANS, SLICE)
    return out.select("asset_id", "seq", *[F.round(f"{c}_ewma_{n}", 8).alias(f"{c}_ewma_{n}") for n in ("fast", "slow", "diff")])


RANK_BUCKET = """'{p}' || CASE WHEN {c} IS NULL THEN 0 ELSE least({n} - 1, CAST(floor((avg_rank - 1) * {n} / total) AS INTEGER)) END"""


@query(
    "rank_buckets",
    with_ctes(
        BOOK
        + """, ranked AS (SELECT seq, current_spread,
             (rank() OVER (ORDER BY current_spread) + rank() OVER (ORDER BY current_spread) + count(*) OVER (PARTITION BY current_spread) - 1) / 2.0::DOUBLE AS avg_rank,
             count(current_spread) OVER () AS total FROM book)""",
        f"SELECT seq, {RANK_BUCKET.format(p='q', c='current_spread', n=10)} AS spread_bucket FROM ranked",
    ),
)
def rank_query(spark, sf):
    return rank_bucket(m.book(spark, sf).select("seq", "current_spread"), "current_spread", "spread_bucket").select("seq", "spread_bucket")


@query(
    "rank_buckets_nonfinite",
    with_ctes(
        BOOK
        + """, ranked AS (SELECT seq, current_spread AS v,
             (2 * rank() OVER (ORDER BY current_spread) + count(*) OVER (PARTITION BY current_spread) - 1) / 2.0::DOUBLE AS avg_rank,
             count(*) OVER () AS total FROM book WHERE seq % 7 > 2)""",
        f"""SELECT b.seq, CASE WHEN b.seq % 7 > 2 THEN {RANK_BUCKET.format(p='q', c='r.v', n=10)} ELSE 'q0' END AS bucket
            FROM book b LEFT JOIN ranked r ON r.seq = b.seq""",
    ),
)
def nonfinite_rank_query(spark, sf):
    """NaN and both infinities among the values get bucket 0 and don't move the others."""
    rest = F.col("seq") % 7
    value = F.when(rest == 0, float("nan")).when(rest == 1, float("inf")).when(rest == 2, float("-inf")).otherwise(F.col("current_spread"))
    return rank_bucket(m.book(spark, sf).select("seq", value.alias("v")), "v", "bucket").select("seq", "bucket")


@query(
    "volatility_buckets",
    with_ctes(
        BOOK
        + """, r AS (SELECT asset_id, seq, recv_ns, current_mid / lag(current_mid) OVER (PARTITION BY asset_id ORDER BY recv_ns, seq) - 1 AS ret FROM book),
        s AS (SELECT asset_id, seq, CASE WHEN count(ret) OVER w >= 20 THEN round(stddev_samp(ret) OVER w, 8) END AS vol FROM r
              WINDOW w AS (PARTITION BY asset_id ORDER BY recv_ns, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
        k AS (SELECT seq, vol, (2 * rank() OVER (ORDER BY vol NULLS LAST) + count(*) OVER (PARTITION BY vol) - 1) / 2.0::DOUBLE AS avg_rank,
              count(vol) OVER () AS total FROM s)""",
        f"SELECT seq, round(vol, 6) AS vol_20rows, {RANK_BUCKET.format(p='v', c='vol', n=10)} AS vol_bucket FROM k",
    ),
)
def volatility_query(spark, sf):
    book = m.book(spark, sf).select("asset_id", *TIME, F.col("current_mid").alias("midpoint"))
    vol = cut_lineage(research.row_volatility(book, 20, "vol", SLICE).withColumn("vol", F.round("vol", 8)))
    return rank_bucket(vol, "vol", "vol_bucket", "v").select("seq", F.round("vol", 6).alias("vol_20rows"), "vol_bucket")


@query(
    "quantile_buckets",
    with_ctes(
        BOOK + ", q AS (SELECT quantile_cont(current_mid, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM book)",
        "SELECT seq, 'q' || len(list_filter(list_distinct(edges), lambda e: current_mid > e)) AS mid_bucket FROM book, q",
    ),
)
def quantile_query(spark, sf):
    return quantile_bucket(m.book(spark, sf).select("seq", "current_mid"), "current_mid", "mid_bucket").select("seq", "mid_bucket")


@query(
    "exact_row_positions",
    with_ctes(BOOK, "SELECT seq, row_number() OVER (PARTITION BY market_id ORDER BY recv_ns, seq) AS position FROM book"),
)
def position_query(spark, sf):
    return with_position(m.book(spark, sf).select("market_id", *TIME), ["market_id"], TIME, slice_width=SLICE).select("seq", "position")


@query(
    "first_leg_fill",
    with_ctes(
        BOOK,
        f"""SELECT seq, CAST(CASE WHEN max(best_ask) OVER (PARTITION BY asset_id ORDER BY recv_ns RANGE BETWEEN CURRENT ROW AND {6 * HOUR} FOLLOWING)
                   > best_ask + 0.01 THEN 0 ELSE 1 END AS TINYINT) AS y_first_leg_fill FROM book""",
    ),
)
def first_leg_query(spark, sf):
    return labels.first_leg_fill(m.book(spark, sf).select("asset_id", *TIME, "best_ask"), 6000, 0.01, m.SCALE).select("seq", "y_first_leg_fill")


FILL = (
    BOOK
    + TRADES
    + f""", low AS (
      SELECT s.seq, min(t.price) AS p FROM book s
      JOIN trades t ON t.asset_id = 'A' || xor(CAST(substr(s.asset_id, 2) AS BIGINT), 1) AND t.side = 'SELL'
           AND t.recv_ns BETWEEN s.recv_ns + {HOUR // 4} AND s.recv_ns + {10 * HOUR} GROUP BY s.seq),
    filled AS (
      SELECT b.*, CASE WHEN p <= (0.96::DOUBLE - best_ask) - 1.0::DOUBLE * 0.01::DOUBLE + 1e-12 THEN p END AS fill_price
      FROM book b LEFT JOIN low USING (seq)),
    legs AS (SELECT *, 0.96::DOUBLE - (best_ask + fill_price) AS edge FROM filled)"""
)


@query(
    "two_leg_fill",
    with_ctes(
        FILL,
        """SELECT seq, fill_price AS future_opposite_maker_fill_price_10s, round(edge, 9) AS two_leg_edge_10s,
                  round(coalesce(edge, -1.0), 9) AS two_leg_realized_edge_10s,
                  CASE WHEN edge >= 0 THEN 'enter' ELSE 'skip' END AS y_two_leg_entry_10s FROM legs""",
    ),
)
def two_leg_query(spark, sf):
    out = labels.two_leg_fill(m.book(spark, sf), m.trades(spark, sf), scale=m.SCALE)
    return out.select(
        "seq", "future_opposite_maker_fill_price_10s",
        *[F.round(c, 9).alias(c) for c in ("two_leg_edge_10s", "two_leg_realized_edge_10s")], "y_two_leg_entry_10s",
    )


@query(
    "two_leg_first_fill",
    with_ctes(
        BOOK
        + TRADES,
        f"""SELECT s.seq, arg_min(t.price, t.recv_ns) AS fill_price, min(t.recv_ns) AS fill_ns FROM book s
            LEFT JOIN trades t ON t.asset_id = 'A' || xor(CAST(substr(s.asset_id, 2) AS BIGINT), 1) AND t.side = 'SELL'
                 AND t.recv_ns BETWEEN s.recv_ns + {HOUR // 4} AND s.recv_ns + {10 * HOUR}
                 AND t.price <= (0.96::DOUBLE - s.best_ask) - 1.0::DOUBLE * 0.01::DOUBLE + 1e-12 GROUP BY s.seq""",
    ),
)
def first_fill_query(spark, sf):
    out = labels.two_leg_fill(m.book(spark, sf), m.trades(spark, sf), scale=m.SCALE, pick="first")
    return out.select(
        "seq", F.col("future_opposite_maker_fill_price_10s").alias("fill_price"), F.col("future_opposite_maker_fill_recv_ns_10s").alias("fill_ns")
    )


@query(
    "next_row_validation",
    with_ctes(
        FILL
        + """, n AS (SELECT *, lead(recv_ns) OVER w - recv_ns AS gap, lead(best_ask) OVER w AS next_ask FROM legs
             WINDOW w AS (PARTITION BY asset_id ORDER BY recv_ns, seq))""",
        f"""SELECT seq, CASE WHEN edge >= 0 AND NOT coalesce(gap <= {6 * HOUR} AND next_ask > best_ask + 0.01, false) THEN 'enter' ELSE 'skip' END
            AS y_two_leg_entry_10s FROM n""",
    ),
)
def validation_query(spark, sf):
    out = labels.two_leg_fill(m.book(spark, sf), m.trades(spark, sf), scale=m.SCALE)
    return labels.next_row_validation(out, 10, 6000, 0.01, m.SCALE, SLICE).select("seq", "y_two_leg_entry_10s")


SIZE = "(1 - 0.072::DOUBLE * (best_ask + 0.01) * (1 - (best_ask + 0.01)))"


@query(
    "final_profit_labels",
    with_ctes(
        FILL
        + future_ctes(10 * HOUR, 12 * HOUR)
        + f""", p AS (SELECT legs.*, future_bid, {SIZE} * future_bid - (best_ask + 0.01) AS unwind,
              CASE WHEN edge >= 0 THEN {SIZE} - ((best_ask + 0.01) + {SIZE} * (0.96 - best_ask))
                   ELSE {SIZE} * future_bid - (best_ask + 0.01) END AS profit FROM legs LEFT JOIN fut ON fut.seq = legs.seq)""",
        """SELECT seq, round(unwind, 7) AS first_unwind_profit_proxy_10s, round(profit, 7) AS final_profit_10s,
                  CASE WHEN profit > 0 THEN 'enter' ELSE 'skip' END AS y_final_profit_entry_10s,
                  CAST(profit > 0 AS TINYINT) AS y_final_profit_entry_binary_10s,
                  round(greatest(abs(profit), CASE WHEN profit IS NOT NULL THEN 1e-6 END), 7) AS final_profit_weight_10s FROM p""",
    ),
)
def profit_query(spark, sf):
    book = m.book(spark, sf)
    df = features.future_book(book, book, [10], 12 * HOUR, m.SCALE)
    out = labels.final_profit(labels.two_leg_fill(df, m.trades(spark, sf), scale=m.SCALE))
    rounded = ["first_unwind_profit_proxy_10s", "final_profit_10s", "final_profit_weight_10s"]
    return out.select("seq", *[F.round(c, 7).alias(c) for c in rounded], "y_final_profit_entry_10s", "y_final_profit_entry_binary_10s")


@query(
    "alpha_and_entry_labels",
    with_ctes(
        BOOK
        + future_ctes(10 * HOUR, 12 * HOUR)
        + """, y AS (SELECT b.*, future_mid, (future_mid - current_mid) / current_mid * 10000 AS bps FROM book b LEFT JOIN fut ON fut.seq = b.seq)""",
        """SELECT seq, round(bps, 6) AS y_reg_10s, CASE WHEN bps > 5 THEN 'up' WHEN bps < -5 THEN 'down' ELSE 'neutral' END AS y_cls_10s,
                  CAST(bps > 8 AS TINYINT) AS y_entry, round(bps - 3, 6) AS realized_edge_after_entry_cost_bps,
                  CAST(bps > 3 AS TINYINT) AS y_entry_after_cost,
                  CASE WHEN round(future_mid - best_ask, 9) = 0 THEN 0.0::DOUBLE ELSE round(future_mid - best_ask, 9) END AS strategy_entry_edge_10s,
                  CASE WHEN future_mid IS NULL THEN NULL WHEN future_mid - best_ask >= 0.04::DOUBLE THEN 'enter' ELSE 'skip' END AS y_strategy_entry_10s
           FROM y""",
    ),
)
def alpha_query(spark, sf):
    book = m.book(spark, sf)
    df = features.future_book(book, book, [10], 12 * HOUR, m.SCALE)
    out = labels.strategy_entry(labels.net_edge(labels.alpha_labels(df)))
    return out.select(
        "seq", F.round("y_reg_10s", 6).alias("y_reg_10s"), "y_cls_10s", "y_entry",
        F.round("realized_edge_after_entry_cost_bps", 6).alias("realized_edge_after_entry_cost_bps"), "y_entry_after_cost",
        F.round("strategy_entry_edge_10s", 9).alias("strategy_entry_edge_10s"), "y_strategy_entry_10s",
    )


@query(
    "quiet_spells",
    with_ctes(
        TICKS,
        f"""SELECT event_type, recv_ns AS quiet_to, recv_ns - lag(recv_ns) OVER w AS gap_ns FROM ticks
            WINDOW w AS (PARTITION BY event_type ORDER BY recv_ns, seq) QUALIFY recv_ns - lag(recv_ns) OVER w > {HOUR}""",
    ),
)
def quiet_query(spark, sf):
    t = m.ticks(spark, sf)
    return quiet_spells(t, ["event_type"], TIME, HOUR, SLICE).select("event_type", "quiet_to", "gap_ns")


@query(
    "bucket_performance",
    with_ctes(
        BOOK
        + future_ctes(10 * HOUR, 12 * HOUR)
        + """, y AS (SELECT b.*, (future_mid - current_mid) / current_mid * 10000 AS bps,
              CASE WHEN top1_imbalance < -0.3 THEN 0 WHEN top1_imbalance < 0 THEN 1 WHEN top1_imbalance < 0.3 THEN 2 ELSE 3 END AS imbalance_bucket,
              CASE WHEN current_mid < 0.1 THEN 0 WHEN current_mid < 0.5 THEN 1 WHEN current_mid < 0.9 THEN 2 ELSE 3 END AS price_bucket
              FROM book b JOIN fut ON fut.seq = b.seq),
        l AS (SELECT 'imbalance_bucket' AS bucket_column, CAST(imbalance_bucket AS VARCHAR) AS bucket, bps, top1_imbalance FROM y
              UNION ALL SELECT 'price_bucket', CAST(price_bucket AS VARCHAR), bps, top1_imbalance FROM y)""",
        """SELECT bucket_column, bucket, count(*) AS rows, round(avg(bps), 4) AS avg_target,
                  round(avg(CASE WHEN bps > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(top1_imbalance), 6) AS avg_prediction FROM l GROUP BY ALL""",
    ),
)
def bucket_query(spark, sf):
    book = m.book(spark, sf)
    df = features.future_book(book, book, [10], 12 * HOUR, m.SCALE).withColumn("realized_vol_short", F.lit(0.0))
    coded = features.add_buckets(df)
    out = bucket_table(coded, "markout_10s_bps", "top1_imbalance", ["imbalance_bucket", "price_bucket"])
    return out.select(
        "bucket_column", "bucket", "rows", F.round("avg_target", 4).alias("avg_target"), F.round("win_rate", 6).alias("win_rate"),
        F.round("avg_prediction", 6).alias("avg_prediction"),
    )


@query(
    "book_quality_filter",
    with_ctes(
        BOOK,
        """SELECT seq, recv_ns FROM book WHERE best_bid > 0 AND best_ask > 0 AND best_bid < best_ask
           AND current_mid BETWEEN 0.1 AND 0.9 AND current_spread BETWEEN 0 AND 0.03""",
    ),
)
def quality_query(spark, sf):
    raw = m.book(spark, sf).withColumnRenamed("current_mid", "midpoint").withColumnRenamed("current_spread", "spread")
    return quality_filter(raw, 0.1, 0.9, 0.03).select("seq", "recv_ns")
