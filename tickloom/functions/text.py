"""Text, time and JSON expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom import NS_PER_SECOND
from tickloom.operators.slices import int_div

# The slug grammar of short markets and their lengths in seconds.
SLUG_PATTERN = r"(?i)(btc|eth)-updown-(5m|15m)-(\d+)"
PERIOD_SECONDS = {"5m": 300, "15m": 900}
SYMBOLS = ["btc", "eth"]


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def first_text(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def _period_seconds(period: Column) -> Column:
    return F.when(period == "5m", 300).when(period == "15m", 900)


def hint_market_id(text: Column) -> Column:
    return blank_to_null(F.lower(F.regexp_extract(text, SLUG_PATTERN, 0)))


def hint_symbol(text: Column) -> Column:
    """Symbol from a slug in the text, else from a symbol name anywhere in it."""
    lower = F.lower(text)
    return (
        F.when(F.regexp_extract(text, SLUG_PATTERN, 1) != "", F.upper(F.regexp_extract(text, SLUG_PATTERN, 1)))
        .when(F.contains(lower, F.lit("eth")), "ETH")
        .when(F.contains(lower, F.lit("btc")) | F.contains(lower, F.lit("bitcoin")), "BTC")
    )


def asset_symbol(asset: Column) -> Column:
    lower = F.lower(asset)
    return (
        F.when(F.contains(lower, F.lit("eth")), "ETH")
        .when(F.contains(lower, F.lit("btc")) | F.contains(lower, F.lit("bitcoin")), "BTC")
        .otherwise("UNKNOWN")
    )


def _to_ns(seconds: Column) -> Column:
    """Seconds become nanoseconds; values too large for seconds are taken as they are."""
    return F.when(seconds < 10_000_000_000, seconds * NS_PER_SECOND).otherwise(seconds)


def hint_start_ns(text: Column) -> Column:
    return _to_ns(F.regexp_extract(text, SLUG_PATTERN, 3).try_cast("long"))


def hint_expiry_ns(text: Column) -> Column:
    period = F.lower(F.regexp_extract(text, SLUG_PATTERN, 2))
    seconds = F.regexp_extract(text, SLUG_PATTERN, 3).try_cast("long")
    return _to_ns(seconds + F.coalesce(_period_seconds(period), F.lit(0)))


def slug_fields(slug: Column) -> dict[str, Column]:
    """symbol, period, start_ns and expiry_ns of `symbol-updown-period-start`."""
    parts = F.split(slug, "-")
    is_slug = (F.size(parts) >= 4) & (F.get(parts, 1) == "updown")
    period = F.lower(F.get(parts, 2))
    start = F.get(parts, 3).try_cast("long")
    return {
        "symbol": F.when(is_slug, F.upper(F.get(parts, 0))),
        "period": F.when(is_slug, period),
        "start_ns": F.when(is_slug, start * NS_PER_SECOND),
        "expiry_ns": F.when(is_slug, (start + _period_seconds(period)) * NS_PER_SECOND),
    }


def iso_to_ns(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text)) * 1000


def ns_to_timestamp(ns: Column) -> Column:
    return F.timestamp_micros(int_div(ns, 1000))


def utc_date(ns: Column, pattern: str = "yyyyMMdd") -> Column:
    """Date partition value; needs the session time zone UTC."""
    return F.date_format(ns_to_timestamp(ns), pattern)


def utc_iso(ns: Column) -> Column:
    return F.concat(F.date_format(ns_to_timestamp(ns), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def json_list(col: Column) -> Column:
    """A JSON array of scalars as strings; null and invalid text give an empty array."""
    return F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))


def safe_double(col: Column) -> Column:
    return blank_to_null(F.trim(col.cast("string"))).try_cast("double")


def safe_long(col: Column) -> Column:
    return blank_to_null(F.trim(col.cast("string"))).try_cast("long")


def partition_name(col: Column) -> Column:
    """A folder name for a value: its readable start and a hash of the whole value, so that values keep apart."""
    text = col.cast("string")
    cleaned = F.left(F.regexp_replace(text, r"[^A-Za-z0-9_.=-]+", "_"), F.lit(180))
    return F.when(blank_to_null(text).isNull(), F.lit("unknown")).otherwise(F.concat(cleaned, F.lit("-"), F.left(F.md5(text), F.lit(16))))


def contains_any(cols: Sequence[Column], words: Column) -> Column:
    """Whether any of the lower-cased words occurs in any of the texts (or text arrays)."""
    text = F.lower(F.concat_ws(" ", *cols))
    return F.exists(words, lambda w: F.contains(text, F.lower(w)))


def _slugs(starts: Column, prefix: str) -> Column:
    return F.transform(starts, lambda s: F.concat(F.lit(prefix), s.cast("string")))


def slugs_between(start_ns: Column, end_ns: Column, buffer_seconds: int = 3600) -> Column:
    """All short-market slugs whose start lies in the buffered range, as one array."""
    lo = F.greatest(F.lit(0).cast("long"), int_div(start_ns, NS_PER_SECOND) - F.lit(buffer_seconds))
    hi = int_div(end_ns, NS_PER_SECOND) + F.lit(buffer_seconds)
    arrays = []
    for symbol in SYMBOLS:
        for period, seconds in PERIOD_SECONDS.items():
            first = lo - F.pmod(lo, F.lit(seconds))
            starts = F.sequence(first, hi, F.lit(seconds).cast("long"))
            arrays.append(_slugs(starts, f"{symbol}-updown-{period}-"))
    return F.concat(*arrays)


def slugs_of_date(date: Column) -> Column:
    """All short-market slugs of one UTC date (`yyyyMMdd`), end of day excluded."""
    day = F.unix_timestamp(F.to_timestamp(date, "yyyyMMdd"))
    arrays = []
    for symbol in SYMBOLS:
        for period, seconds in PERIOD_SECONDS.items():
            starts = F.sequence(day, day + F.lit(86_400 - seconds), F.lit(seconds).cast("long"))
            arrays.append(_slugs(starts, f"{symbol}-updown-{period}-"))
    return F.concat(*arrays)
