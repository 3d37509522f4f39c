"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; the pair of codes is its cell.
Codebooks are fitted on at most `sample` distinct vectors, every vector is indexed. A query visits
pairs of centroids by the sum of their squared distances, kept in a heap, until the cells hold
`share` of all vectors (at least `least`); their entries are ranked by the distance of the original
vectors in double precision. `recall` compares with brute force.

Cells are dealt in blocks of bounded size, queries in chunks of bounded size, and a task solves
one chunk against one bucket of blocks; the candidates of a query are merged by a ranking
which Spark limits before it shuffles. Equal vectors are searched once.

Cases: vectors that are null, zero or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; fewer candidates than asked for are all returned, since a query goes on to
further cells; equal distances go to the smaller number; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.vectors import FOUND, best, distinct_vectors, finite, matrix, ranked
from tickloom.session import cut_lineage


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample by Lloyd's rounds, the first ones drawn from it."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(3).permutation(len(start))[:size]].copy()
    for _ in range(rounds):
        own = distances(x, centres).argmin(1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def visits(near_left: np.ndarray, near_right: np.ndarray, counts: np.ndarray, wanted: int) -> Iterator[tuple[int, int]]:
    """Pairs of codes with entries, by the sum of both distances, until they hold `wanted` entries."""
    left, right = np.argsort(near_left, kind="stable"), np.argsort(near_right, kind="stable")
    heap, seen, held = [(near_left[left[0]] + near_right[right[0]], 0, 0)], {(0, 0)}, 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        n = int(counts[left[i], right[j]])
        if n:
            held += n
            yield int(left[i]), int(right[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(left) and b < len(right) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (near_left[left[a]] + near_right[right[b]], a, b))


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, share: float = 0.5, least: int = 1000, sample: int = 8192, most_codes: int = 256, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose number is divisible by `every`."""
    vector = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    kinds = cut_lineage(distinct_vectors(rows, every, k), "vectors")
    n, asked, dim = kinds.agg(F.count("*"), F.count(F.when(F.col("asked"), 1)), F.max(F.size("v"))).first()
    if not asked:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, middle = min(most_codes, max(2, int(np.ceil(np.sqrt(n) / 2)))), dim - dim // 2
    drawn = matrix(kinds.orderBy("h1", "h2").limit(sample).select("v").toArrow().column(0), dim, np.float64)
    left, right = codebook(drawn[:, :middle], size), codebook(drawn[:, middle:], size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim, np.float64)
            cell = distances(x[:, :middle], left).argmin(1) * len(right) + distances(x[:, middle:], right).argmin(1)
            yield batch.append_column("cell", pa.array(cell.astype(np.int64)))

    entries = cut_lineage(kinds.mapInArrow(encode, "h1 long, h2 long, v array<double>, ids array<long>, asked boolean, cell long"), "index")
    counts = np.zeros((len(left), len(right)), np.int64)
    for r in entries.groupBy("cell").count().toLocalIterator():
        counts[divmod(r["cell"], len(right))] = r["count"]
    buckets, chunks = -(-n // block), -(-asked // block)
    blocks = -(-counts.ravel() // block)
    # numbers of the cells' blocks laid end to end; a bucket takes the blocks of equal rest
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    wanted = max(least, int(share * n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            place = first[cell] + batch.column("h1").to_numpy().view(np.uint64) % np.maximum(blocks[cell], 1).astype(np.uint64)
            place = place.astype(np.int64)
            for chunk in range(chunks):
                yield pa.RecordBatch.from_arrays([pa.array(place % buckets), pa.array(np.full(len(place), chunk)), pa.array(place), batch.column("v"), batch.column("ids")], ["bucket", "chunk", "place", "v", "ids"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim, np.float64)
            near_left, near_right = distances(x[:, :middle], left), distances(x[:, middle:], right)
            who, bucket, places = [], [], []
            for i in range(len(x)):
                cells = np.array([a * len(right) + b for a, b in visits(near_left[i], near_right[i], counts, wanted)])
                count = blocks[cells]
                place = np.repeat(first[cells] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                place = place[np.argsort(place % buckets, kind="stable")]
                met, at = np.unique(place % buckets, return_index=True)
                who += [i] * len(met)
                bucket += met.tolist()
                places += np.split(place, at[1:])
            part = batch.take(pa.array(who, pa.int64()))
            chunk = part.column("h2").to_numpy().view(np.uint64) % np.uint64(chunks)
            cells = [pa.array(bucket, pa.int64()), pa.array(chunk.astype(np.int64)), pa.array(places, pa.list_(pa.int64())), *[part.column(c) for c in ("h1", "h2", "v")]]
            yield pa.RecordBatch.from_arrays(cells, ["bucket", "chunk", "places", "h1", "h2", "v"])

    def solve(data: pa.Table, queries: pa.Table) -> pa.Table:
        x, q = matrix(data.column("v"), dim, np.float64), matrix(queries.column("v"), dim, np.float64)
        ids = data.column("ids").to_pylist()
        held, out = data.column("place").to_numpy(), []
        for i, (a, b, places) in enumerate(zip(*[queries.column(c).to_pylist() for c in ("h1", "h2", "places")])):
            spots = np.flatnonzero(np.isin(held, places))
            score = np.sqrt(((x[spots] - q[i]) ** 2).sum(1))
            out += [(a, b, v, s) for v, s in best([ids[j] for j in spots.tolist()], score, k + 1, True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], ["h1", "h2", "vec_id", "score"])

    dealt = entries.select("h1", "cell", "v", "ids").mapInArrow(deal, "bucket long, chunk long, place long, v array<double>, ids array<long>")
    probes = entries.where("asked").select("h1", "h2", "v").mapInArrow(probe, "bucket long, chunk long, places array<long>, h1 long, h2 long, v array<double>")
    found = dealt.groupBy("bucket", "chunk").cogroup(probes.groupBy("bucket", "chunk")).applyInArrow(solve, FOUND.format(kind="double"))
    return ranked(rows, found, every, k, F.col("score").asc())


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, vec_id) pairs that were found."""
    hits = truth.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"]).count()
    return hits / max(1, truth.count())
