"""Unions, set operations and equi-joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.sampling import keep_last

_WIDER = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type both values fit in: the wider number, else string."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _WIDER and b in _WIDER:
        return _WIDER[max(_WIDER.index(a), _WIDER.index(b))]
    return T.StringType()


def union_relaxed(frames: Sequence[DataFrame | None]) -> DataFrame | None:
    """Union by name; missing columns become null and differing types are widened."""
    present = [f for f in frames if f is not None]
    if not present:
        return None
    types: dict[str, T.DataType] = {}
    for f in present:
        for field in f.schema:
            types[field.name] = wider_type(types[field.name], field.dataType) if field.name in types else field.dataType
    cast = [f.select(*[F.col(c).cast(types[c]).alias(c) for c in f.columns]) for f in present]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def few_values(df: DataFrame, column: str, most: int = 10_000) -> list:
    """Distinct values of a column that must be few (classes, policies, dates); more is an error."""
    values = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} distinct values")
    return values


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """Set union."""
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Rows of `a` also in `b`, only in `a`, and only in `b`, compared on `keys`."""
    return {
        "common": a.join(b.select(*keys), list(keys), "left_semi"),
        "only_a": a.join(b.select(*keys), list(keys), "left_anti"),
        "only_b": b.join(a.select(*keys), list(keys), "left_anti"),
    }


def enrich(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    columns: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Left join of the last dimension row per key.

    A column both sides have keeps the fact's value unless it is null (or empty, for
    strings); other columns are added. The join is left to the planner, which broadcasts
    the dimension only below `spark.sql.autoBroadcastJoinThreshold` and splits hot keys
    otherwise.
    """
    taken = [c for c in columns if c in dimension.columns and c != key]
    last = keep_last(dimension.select(key, *taken, *[c for c in order if c not in taken and c != key]), [key], order)
    right = last.select(F.col(key), *[F.col(c).alias(f"__d_{c}") for c in taken])
    joined = facts.join(right, key, "left")
    strings = {f.name for f in facts.schema if isinstance(f.dataType, T.StringType)}
    kept = []
    for c in facts.columns:
        if c not in taken:
            kept.append(F.col(c))
        elif c in strings:
            kept.append(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__d_{c}")).alias(c))
        else:
            kept.append(F.coalesce(F.col(c), F.col(f"__d_{c}")).alias(c))
    added = [F.col(f"__d_{c}").alias(c) for c in taken if c not in facts.columns]
    return joined.select(*kept, *added)


def opposite_assets(samples: DataFrame) -> DataFrame:
    """(market_id, asset_id, opposite_asset_id) of markets with exactly two (asset, outcome) pairs."""
    pairs = samples.select("market_id", "asset_id", "outcome").distinct()
    markets = (
        pairs.groupBy("market_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("asset_id").alias("a"), F.max("asset_id").alias("b"))
        .where((F.col("n") == 2) & F.col("market_id").isNotNull())
    )
    sides = F.array(
        F.struct(F.col("a").alias("asset_id"), F.col("b").alias("opposite_asset_id")),
        F.struct(F.col("b").alias("asset_id"), F.col("a").alias("opposite_asset_id")),
    )
    return markets.select("market_id", F.explode(F.array_distinct(sides)).alias("s")).select("market_id", "s.*")


def with_opposite(samples: DataFrame) -> DataFrame:
    """Samples with `opposite_asset_id` (null where the market is not a pair)."""
    base = samples.drop("opposite_asset_id")
    return base.join(opposite_assets(base), ["market_id", "asset_id"], "left")


def fill_unknown(known: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """`known` plus the fallback rows whose key `known` lacks."""
    return known.unionByName(fallback.join(known.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def relevant_events(
    events: DataFrame, assets: DataFrame, event_assets: str, row_id: Sequence[str]
) -> DataFrame:
    """Events with at least one asset of the array column `event_assets` in `assets`."""
    wanted = assets.select(F.col("asset_id").alias("__asset")).distinct()
    hits = (
        events.select(*row_id, F.explode(F.array_distinct(event_assets)).alias("__asset"))
        .join(wanted, "__asset", "left_semi")
        .select(*row_id)
    )
    return events.join(hits, list(row_id), "left_semi")
