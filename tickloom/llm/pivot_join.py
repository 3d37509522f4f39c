"""Exact top-k by inner product with a Voronoi join.

Vectors are grouped by their nearest pivot (a bounded number of distinct vectors, drawn by hash). A
group's summary is its size, its radius, its greatest norm and its k + 1 vectors of greatest norm.
From the summaries alone a query gets

* a floor: its (k + 1)-th best score among all summary vectors, which the answer can't fall below;
* of each group, a ceiling: the score of the pivot plus norm times radius, or norm times greatest
  norm, whichever is less.

A query is sent only to groups whose ceiling reaches its floor (the smaller side of the join is
the one that is replicated), in blocks of bounded size; each block is solved by one matrix product and
the blocks' best are merged by a ranking which Spark limits before it shuffles. Equal vectors are solved once.

Components are floor(256 * x); scores are exact integers. Cases: vectors that are null or hold null or
non-finite components take no part; shorter vectors count as padded with zeros; queries with fewer
candidates get all; equal scores go to the smaller number; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.vectors import FOUND, best, distinct_vectors, finite, matrix, ranked
from tickloom.session import cut_lineage

EXACT = 1 << 53  # integers up to here are exact as doubles


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; by doubles where every partial sum fits."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if most < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def top_products(embeddings: DataFrame, k: int = 5, every: int = 50, pivots: int = 64, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose number is divisible by `every`."""
    given = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), given.alias("x")).where(F.col("vec_id").isNotNull() & finite(F.col("x")))
    rows = rows.select("vec_id", F.transform("x", lambda x: F.floor(x * 256).cast("long")).alias("v"))
    kinds = cut_lineage(distinct_vectors(rows, every, k), "vectors")
    n, asked, dim = kinds.agg(F.count("*"), F.count(F.when(F.col("asked"), 1)), F.max(F.size("v"))).first()
    if not asked:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centres = matrix(kinds.orderBy("h1", "h2").limit(pivots).select("v").toArrow().column(0), dim, np.int64)
    real = centres.astype(np.float64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim, np.float64)
            far = np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in real], 1) if len(x) else np.zeros((0, len(real)))
            group = far.argmin(1)
            cells = [pa.array(group), pa.array(far[np.arange(len(x)), group]), pa.array(np.sqrt((x * x).sum(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], [*batch.schema.names, "group", "far", "norm"])

    shape = "h1 long, h2 long, v array<long>, ids array<long>, asked boolean, group long, far double, norm double"
    data = cut_lineage(kinds.mapInArrow(assign, shape), "groups")
    # of a few groups each: sizes, radii, greatest norms, and k + 1 vectors with their numbers
    summary = data.groupBy("group").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm").alias("norm")).toPandas()
    longest = Window.partitionBy("group").orderBy(F.desc("norm"), "h1", "h2")
    known = data.withColumn("place", F.row_number().over(longest)).where(F.col("place") <= k + 1).select("v", F.size("ids").alias("copies")).toArrow()
    marks, copies = matrix(known.column("v"), dim, np.int64), known.column("copies").to_numpy()
    group, radius, norm = (summary[c].to_numpy() for c in ("group", "radius", "norm"))
    blocks = np.zeros(len(real), np.int64)
    blocks[group] = -(-summary["n"].to_numpy() // block)
    chunks = -(-asked // block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("group").to_numpy()
            part = (batch.column("h1").to_numpy().view(np.uint64) % blocks[own].astype(np.uint64)).astype(np.int64)
            for chunk in range(chunks):
                yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(part), pa.array(np.full(len(own), chunk)), batch.column("v"), batch.column("ids")], ["group", "block", "chunk", "v", "ids"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("v"), dim, np.int64)
            size = np.sqrt((q.astype(np.float64) ** 2).sum(1))[:, None]
            scores = products(q, marks)
            order = np.argsort(-scores, axis=1, kind="stable")
            reach = np.cumsum(copies[order], axis=1) > k  # k + 1 rows score at least so much
            at = np.where(reach.any(1), reach.argmax(1), -1)
            floor = np.where(at >= 0, np.take_along_axis(np.take_along_axis(scores, order, 1), np.maximum(at, 0)[:, None], 1)[:, 0], -np.inf)
            ceiling = np.minimum(products(q, centres[group]) + size * radius, size * norm)
            slack = 1e-9 * (1 + np.abs(ceiling)) + 1e-6
            who, target = np.nonzero(ceiling + slack >= floor[:, None])
            target = group[target]
            count = blocks[target]
            who, target = np.repeat(who, count), np.repeat(target, count)
            part = np.arange(len(who)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(who) else who
            sent = batch.take(pa.array(who))
            chunk = (sent.column("h2").to_numpy().view(np.uint64) % np.uint64(chunks)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(part), pa.array(chunk), *[sent.column(c) for c in ("h1", "h2", "v")]], ["group", "block", "chunk", "h1", "h2", "v"])

    def solve(near: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        ids, x = near.column("ids").to_pylist(), matrix(near.column("v"), dim, np.int64)
        h1, h2 = queries.column("h1").to_pylist(), queries.column("h2").to_pylist()
        q = matrix(queries.column("v"), dim, np.int64)
        for at in range(0, len(q), 256):
            for i, row in enumerate(products(q[at : at + 256], x), at):
                out += [(h1[i], h2[i], v, int(s)) for v, s in best(ids, row, k + 1, False)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], ["h1", "h2", "vec_id", "score"])

    keys = ["group", "block", "chunk"]
    dealt = data.select("h1", "group", "v", "ids").mapInArrow(deal, "group long, block long, chunk long, v array<long>, ids array<long>")
    sent = data.where("asked").select("h1", "h2", "v").mapInArrow(send, "group long, block long, chunk long, h1 long, h2 long, v array<long>")
    found = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, FOUND.format(kind="long"))
    return ranked(rows, found, every, k, F.col("score").desc())
