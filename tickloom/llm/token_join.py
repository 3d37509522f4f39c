"""N-gram Jaccard join with token-combination prefixes.

Documents whose sets of word shingles reach a Jaccard similarity are linked; the result is
each document's component. Documents with equal sets are one node throughout.

Tokens (shingles) are ordered rare class first, by hash within a class. The class of frequent
tokens is found by counts over all documents; it decides only the order, never the result. Two
sets that are similar enough share at least t tokens, t = ceil(similarity * size) of either, so
they share a token among the first size - t + 1, and m tokens among the first size - t + m.

* Where the first shared token is rare, it is in both short prefixes: each rare token of the
  short prefix is a key.
* Otherwise all shared tokens are frequent. Prefixes are extended by m = c + 1, and tokens are
  dealt into c classes by hash: of m shared tokens two fall into one class, so the pairs of
  frequent tokens within a class are keys, about as many as the prefix has tokens. c follows the
  size of the smaller set in powers of two; a set writes keys for each power that a partner may have.

Every candidate pair thus shares a key. Sets that share a key are first compared with the least
one of the key only, and linked sets are merged. Pairs still open have such a least one in common, too: its
group, if it holds several components, is cut into blocks, and blocks are compared pairwise in memory. Only
links that merge components leave a task, so no pairs are written out, and no link between components is lost.

Most sets that share a key are far from similar. Counts of a set's tokens by their first bits bound what two sets
can share from above, at about a twentieth of a text's size, so texts travel only where the bound leaves a link possible.

Cases: null or empty texts and texts without words have no shingles and are linked with nothing;
repeated rows are copies; a document without a number has its group's smallest number, or none;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import mix, texts
from tickloom.llm.components import connected
from tickloom.llm.shingles import same_size, shingle_sets, signature
from tickloom.session import cut_lineage, drop_written

FREQUENT = 32  # documents from which a token counts as frequent
TILE = 256  # sets of a block that are compared with those of another at once
SKETCH_BITS = 12  # 4,096 counts of a set at most
MOST_FREQUENT = 1 << 20  # frequent tokens known to all tasks (8 MB); the rest stay in the rare class
U = np.uint64


def needed(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def level_classes(level: int) -> int:
    return max(1, (1 << level) // 4)


def keys_of(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Keys of one set under which every similar, unequal set has one as well."""
    n = len(tokens)
    if n < 2:
        return tokens[:0]
    at = np.searchsorted(frequent, tokens)
    at[at == len(frequent)] = 0
    common = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
    ordered = np.concatenate([tokens[~common], tokens[common]])
    rare, t = n - int(common.sum()), needed(n, percent)
    keys = [ordered[: min(rare, n - t + 1)]]
    for level in {t.bit_length() - 1, n.bit_length() - 1}:
        classes = level_classes(level)
        held = ordered[rare : n - t + classes + 1]
        if len(held) <= classes:
            continue
        own = mix(held) % U(classes)
        held = held[np.argsort(own, kind="stable")]
        own = np.sort(own)
        first = np.searchsorted(own, own)
        for gap in range(1, int((np.arange(len(own)) - first).max(initial=0)) + 1):
            pair = np.flatnonzero(own[gap:] == own[:-gap])
            keys.append(mix(held[pair] * U(0x9E3779B97F4A7C15) + mix(held[pair + gap] + U(level))))
    return np.concatenate(keys)


def frequent_tokens(docs: DataFrame, words: int, least: int, most: int) -> np.ndarray:
    """The most frequent tokens, by counts over all documents.

    Tasks add up counts over a few million shingles at a time; what occurs once in such a
    stretch is left out before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

        for batch in batches:
            for tokens in shingle_sets(batch.column("text"), words):
                held.append(tokens)
                size += len(tokens)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).select("token")
    return np.sort(top.toArrow().column(0).to_numpy().view(U))


def sketch(tokens: np.ndarray) -> bytes:
    """Counts of a set's tokens by their first bits, 4 to 8 tokens a count; 255 stands for any number from there on."""
    bits = min(SKETCH_BITS, max(0, len(tokens).bit_length() - 3))
    parts = (tokens >> U(63 - bits) >> U(1)).astype(np.int64)
    return np.minimum(np.bincount(parts, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def unpacked(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of `size` counts; those of more counts are added up."""
    out = np.empty((len(sketches), size), np.int32)
    for i, x in enumerate(sketches):
        counts = np.frombuffer(x, np.uint8).astype(np.int32)
        counts[counts == 255] = 1 << 18
        out[i] = counts.reshape(size, -1).sum(1)
    return out


def most_shared(a: bytes, b: bytes) -> int:
    """No two sets with these sketches share more tokens."""
    size = min(len(a), len(b))
    return int(np.minimum(*[unpacked([x], size)[0] for x in (a, b)]).sum())


def may_link(sketches: list[bytes], sizes: list[int], components: list[int], percent: int) -> np.ndarray:
    """Of each set, whether one of another component may be similar; no such set is missed."""
    order = np.argsort(sizes, kind="stable")
    n, mine = np.array(sizes, np.int64)[order], np.array(components, np.int64)[order]
    ordered = [sketches[i] for i in order.tolist()]
    lengths = np.array([len(x) for x in ordered])
    ends = np.searchsorted(percent * n, 100 * n, side="right")
    hit = np.zeros(len(n), bool)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        at = int(own[0])  # a larger set has as many counts or more
        counts = unpacked(ordered[at : int(ends[own[-1]])], int(length))
        for i in own.tolist():
            others = np.arange(i + 1, ends[i])
            others = others[mine[others] != mine[i]]
            others = others[~hit[others]] if hit[i] else others
            if len(others):
                both = np.minimum(counts[i - at], counts[others - at]).sum(1)
                close = others[100 * both >= percent * (n[i] + n[others] - both)]
                hit[close] = True
                hit[i] |= len(close) > 0
    out = np.zeros(len(n), bool)
    out[order] = hit
    return out


def shared_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets, by products of 0-1 matrices a few thousand tokens wide."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[token] > 1
    owner, token = owner[several], (np.cumsum(count > 1) - 1)[token[several]]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        a, b = np.searchsorted(token, (at, at + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], token[a:b] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def links_between(sets: list[np.ndarray], components: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets that join different components, as few as join them all."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    sizes = np.array([len(x) for x in sets])
    if len(sets) > 12:
        both, mine = shared_sizes(sets), np.array(components)
        close = 100 * both >= percent * (sizes[:, None] + sizes - both)
        pairs = zip(*[x.tolist() for x in np.nonzero(np.triu(close & (mine[:, None] != mine), 1))])
    else:
        pairs = ((i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)))
    out = []
    for i, j in pairs:
        a, b = root(components[i]), root(components[j])
        if a == b:
            continue
        if len(sets) <= 12:
            n, m = int(sizes[i]), int(sizes[j])
            if 100 * min(n, m) < percent * max(n, m):
                continue
            shared = same_size(sets[i], sets[j])
            if 100 * shared < percent * (n + m - shared):
                continue
        parent[max(a, b)] = min(a, b)
        out.append((i, j))
    return out


def linked_components(docs: DataFrame, words: int = 5, percent: int = 80, least: int = FREQUENT, most: int = MOST_FREQUENT, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = texts(docs, id_col, text_col)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, words, least, most))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(signature(x), len(x)) for x in shingle_sets(batch.column("text"), words)]
            cells = [pa.array([x[i] for x in sets], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cells], ["doc_id", "node", "n_shingles"])

    def write_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, keys, nodes, size = set(), [], [], 0
            for tokens in shingle_sets(batch.column("text"), words):
                node = signature(tokens)
                if node in seen:
                    continue
                seen.add(node)
                keys.append(keys_of(tokens, frequent.value, percent).view(np.int64))
                nodes.append(np.full(len(keys[-1]), node))
                size += len(keys[-1])
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes)], ["key", "node"])
                    keys, nodes, size = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes)], ["key", "node"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows: dict[int, tuple] = {}
            for text, tokens in zip(batch.column("text"), shingle_sets(batch.column("text"), words), strict=True):
                node = signature(tokens)
                if node not in rows:
                    rows[node] = (node, len(tokens), sketch(tokens), squeeze(text.as_buffer()))
            cells = zip(*rows.values()) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["node", "n", "sketch", "z"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that may be similar by their sketches."""
        for batch in batches:
            cells = [batch.column(c).to_pylist() for c in ("ka", "kb", "na", "nb")]
            keep = [100 * both >= percent * (na + nb - both) for ka, kb, na, nb in zip(*cells) for both in [most_shared(ka, kb)]]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                a = part.column("a").to_pylist()
                new = [i for i, x in enumerate(a) if not i or x != a[i - 1]]
                left = shingle_sets(pa.array([expand(part.column("za")[i].as_buffer()) for i in new], pa.binary()), words)
                right = shingle_sets(pa.array([expand(x.as_buffer()) for x in part.column("zb")], pa.binary()), words)
                keep, own = [], None
                for i, other in enumerate(right):
                    if not i or a[i] != a[i - 1]:
                        own = next(left)
                    both = same_size(own, other)
                    keep.append(100 * both >= percent * (len(own) + len(other) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = cut_lineage(docs.mapInArrow(describe, "doc_id long, node long, n_shingles long"), "nodes")
    keys = docs.mapInArrow(write_keys, "key long, node long")
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    keys = cut_lineage(keys.join(shared, "key"), "shared-keys")
    first = cut_lineage(keys.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")

    # the texts of all sets that share a key with another; a copy's text serves as well
    wanted = keys.select("node").distinct()
    carried = docs.mapInArrow(carry, "node long, n long, sketch binary, z binary").join(wanted, "node")
    sets = cut_lineage(carried.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "z")]), "sets")

    def texts_of(wanted: DataFrame) -> DataFrame:
        return cut_lineage(sets.select("node", "z").join(wanted.distinct(), "node", "left_semi"), "texts")

    def verified(pairs: DataFrame, purpose: str) -> DataFrame:
        left, right = sets.select("node", "n", "sketch").toDF("a", "na", "ka"), sets.select("node", "n", "sketch").toDF("b", "nb", "kb")
        close = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
        sized = pairs.join(left.select("a", "na"), "a").join(right.select("b", "nb"), "b").where(close).select("a", "b")
        both = sized.join(left.select("a", "na", "ka"), "a").join(right, "b")
        open_pairs = cut_lineage(both.mapInArrow(likely, "a long, b long"), "likely-pairs")
        carried = texts_of(open_pairs.select(F.explode(F.array("a", "b")).alias("node")))
        both = open_pairs.join(carried.toDF("b", "zb"), "b").join(carried.toDF("a", "za"), "a").sortWithinPartitions("a")
        found = cut_lineage(both.mapInArrow(similar, "a long, b long"), purpose)
        drop_written(open_pairs, carried)
        return found

    def tiles(batches: Iterator[pa.RecordBatch], payload: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
        """Each tile with (node, component, ...) of its rows; they follow one another and are bounded in number."""
        held, name = [], None
        for batch in batches:
            names = zip(*[batch.column(c).to_pylist() for c in ("pivot", "left", "right")])
            rows = zip(*[batch.column(c).to_pylist() for c in ("node", "component", *payload)])
            for own, row in zip(names, rows):
                if own != name and held:
                    yield name, held
                    held = []
                name = own
                held.append(row)
        if held:
            yield name, held

    tile_columns = ["pivot", "left", "right", "node", "component"]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a tile that may be similar to one of another component by their sketches."""
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        rows = []

        def flush() -> pa.RecordBatch:
            cells = zip(*rows) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], tile_columns)

        for name, held in tiles(batches, ["n", "sketch"]):
            _, component, n, sketches = zip(*held)
            rows += [(*name, *held[i][:2]) for i in np.flatnonzero(may_link(sketches, n, component, percent)).tolist()]
            if len(rows) > 10_000:
                yield flush()
                rows = []
        yield flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between components within each tile."""
        expand = zstandard.ZstdDecompressor().decompress
        for _, held in tiles(batches, ["z"]):
            node, component, z = zip(*held)
            sets = list(shingle_sets(pa.array([expand(x) for x in z], pa.binary()), words))
            links = [(node[i], node[j]) for i, j in links_between(sets, component, percent)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    def by_tile(rows: DataFrame) -> DataFrame:
        return rows.repartition("pivot", "left", "right").sortWithinPartitions("pivot", "left", "right")

    links = verified(first, "links")
    found = connected(links)
    # sets that share a key share its least one, so groups of that one hold all pairs that are left
    placed = first.toDF("pivot", "node").join(found, "node", "left").select("pivot", "node", F.coalesce("component", "node").alias("component"))
    groups = placed.groupBy("pivot").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x < y")
    open_groups = placed.join(groups.select("pivot", F.ceil(F.col("size") / tile).cast("int").alias("blocks")), "pivot")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiled = open_groups.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = tiled.select("pivot", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "node", "component")
    shape = "pivot long, left int, right int, node long, component long"
    open_rows = cut_lineage(by_tile(tiled.join(sets.select("node", "n", "sketch"), "node")).mapInArrow(screen, shape), "open-rows")
    carried = texts_of(open_rows.select("node"))
    more = cut_lineage(by_tile(open_rows.join(carried, "node")).mapInArrow(compare, "a long, b long"), "links")
    drop_written(keys, first, sets, open_rows, carried)

    found = connected(links.union(more))
    own = nodes.where("n_shingles > 0")
    least_id = own.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = least_id.join(least_id.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("node", "component_id")
    linked = own.join(named, "node").select("doc_id", "n_shingles", "component_id")
    return linked.union(nodes.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the document of smallest number of each component; all columns stay.

    Rows without words stay. Rows with one number stay or go together; rows without a number stay unless each of
    them is linked with a numbered one.
    """
    name = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    linked = linked_components(docs, words, percent, id_col=id_col, text_col=text_col)
    kept = linked.where("doc_id <=> component_id").select("doc_id").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), name)
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select("row.*")
