"""What the two searches share: distinct vectors, and rankings of queries from those of distinct vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND = "h1 long, h2 long, vec_id long, score {kind}"


def finite(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def distinct_vectors(rows: DataFrame, every: int, k: int) -> DataFrame:
    """(h1, h2, v, ids, asked) of the distinct vectors of `rows` (vec_id, v).

    Of equal vectors only the k + 1 smallest numbers can be among the k first of any query that
    leaves itself out; `asked` tells whether one of all its numbers is a query's. Spark keeps the
    smallest numbers before it shuffles, so one vector may make up any share of the table.
    """
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    kinds = first.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.col("vec_id") % every == 0).select("h1", "h2").distinct().withColumn("asked", F.lit(True))
    return kinds.join(asked, ["h1", "h2"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def ranked(rows: DataFrame, found: DataFrame, every: int, k: int, best_first: Column) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query of `rows` from candidates of distinct vectors."""
    order = [best_first, F.col("vec_id")]
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order))).where(F.col("place") <= k + 1).drop("place")
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    pairs = asked.join(top, ["h1", "h2"]).where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, dtype) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def best(ids: list[list[int]], scores: np.ndarray, count: int, smallest: bool) -> list[tuple[int, float]]:
    """The `count` first (number, score) of distinct vectors with their numbers, ties to smaller numbers."""
    if not len(scores) or count < 1:
        return []
    sign, place = 1 if smallest else -1, min(count, len(scores)) - 1  # each vector has at least one number
    limit = np.partition(sign * scores, place)[place]
    pairs = [(sign * scores[i], x, scores[i]) for i in np.flatnonzero(sign * scores <= limit).tolist() for x in ids[i]]
    return [(x, s) for _, x, s in sorted(pairs, key=lambda p: p[:2])[:count]]

