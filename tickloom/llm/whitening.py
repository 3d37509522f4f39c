"""Whitening of embeddings by a weighted covariance over distinct vectors.

Components x become whole numbers floor(scale * x). Equal vectors are grouped first: each distinct
one enters the fit once, with weight one or with its number of copies. Sums are exact; the covariance is a sum of
weighted products of centred blocks (one matrix product per batch inside the tasks, entries added by Spark), so what
reaches the driver is one matrix of dim x dim and one row of sums. Each distinct vector is whitened once and joined
to the rows that hold it.

Cases: vectors that are null or hold null or non-finite entries are left out; shorter vectors count as
filled up with zeros; numbers may be null or repeat, each row is returned; components without variance
(eigenvalue at most 1e-12 of the largest) can't be whitened and are not returned, so a single distinct vector,
and an empty table, give no rows. A deviation beyond 64 bits raises an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.vectors import finite, matrix
from tickloom.session import cut_lineage

NO_VARIANCE = 1e-12


def products(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(place, value) of the upper triangle of sum(weight * (x - mean) (x - mean)^T) over the batches of a task."""
    dim = len(mean)
    total = np.zeros((dim, dim))
    for batch in batches:
        centred = matrix(batch.column(0), dim, np.float64) - mean
        total += centred.T @ (centred * batch.column(1).to_numpy()[:, None])
    upper = np.flatnonzero(np.triu(np.ones((dim, dim), bool)))
    yield pa.record_batch({"place": upper, "value": total.reshape(-1)[upper]})


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums of (n * x - sums) ** 2; Python's integers where 64 bits could be too few."""
    most = max((n * int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums), default=0), 1)
    if x.shape[1] * most * most < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]


def projected(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(h1, h2, weight, deviation, z1, z2, ...) of distinct vectors."""
    mean = np.array([s / n for s in sums])
    for batch in batches:
        x = matrix(batch.column(2), len(sums), np.int64)
        z = (x - mean) @ axes
        columns = {"h1": batch.column(0), "h2": batch.column(1), "weight": batch.column(3), "deviation": pa.array(deviations(x, n, sums), pa.int64())}
        yield pa.record_batch(columns | {f"z{i + 1}": z[:, i] for i in range(axes.shape[1])})


def whitened(rows: DataFrame, most: int = 4, scale: int = 256, counts: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for up to `most` components.

    `counts` weighs each distinct vector by its number of rows instead of one; n is the sum of the weights.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    good = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(finite(F.col("v")))
    whole = good.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))
    whole = whole.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})
    kinds = whole.groupBy("x").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.count("*").alias("copies"))
    kinds = cut_lineage(kinds.select("h1", "h2", "x", (F.col("copies") if counts else F.lit(1)).cast("long").alias("weight")), "distinct")
    dim, n = kinds.agg(F.max(F.size("x")), F.sum("weight")).first()
    if not dim:
        return empty
    # exact sums of each dimension
    wide = kinds.select("weight", F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("weight").cast("decimal(19)") * F.col("c").cast("decimal(19)")).alias("s"))
    sums = [0] * dim
    for d, s in wide.collect():  # one row per dimension
        sums[d] = int(s)
    mean = np.array([s / n for s in sums])
    added = kinds.select("x", "weight").mapInArrow(lambda b: products(b, mean), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    cov = np.zeros(dim * dim)
    cov[added["place"].to_numpy()] = added["value"].to_numpy() / n
    cov = cov.reshape(dim, dim)
    cov += np.triu(cov, 1).T
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > NO_VARIANCE * max(values[0], 0.0)).sum())) if values[0] > 0 else 0
    if not keep:
        return empty
    axes = vectors[:, :keep] / np.sqrt(values[:keep])
    names = [f"z{i + 1}" for i in range(keep)]
    found = kinds.select("h1", "h2", "x", "weight").mapInArrow(
        lambda b: projected(b, n, sums, axes), "h1 long, h2 long, weight long, deviation long, " + ", ".join(f"{z} double" for z in names)
    )
    found = cut_lineage(found, "whitened")
    # the covariance of what was whitened, centred before multiplying
    means = found.agg(*[(F.sum(F.col("weight") * F.col(z)) / n).alias(z) for z in names]).first()
    pairs = [(i, j) for i in range(keep) for j in range(i, keep)]
    moved = [F.col(z) - F.lit(means[z]) for z in names]
    entries = found.agg(*[(F.sum(F.col("weight") * moved[i] * moved[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(entries[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(z).alias("whitened"), F.lit(float(values[i] / values.sum())).alias("explained")) for i, z in enumerate(names)]))
    joined = whole.select("vec_id", "h1", "h2").join(found, ["h1", "h2"])
    joined = joined.select("vec_id", "deviation", each.alias("one"))
    return joined.select(
        "vec_id", "one.component", F.lit(n).cast("long").alias("n"), "deviation", "one.whitened", "one.explained", F.lit(float(error)).alias("identity_error")
    )
