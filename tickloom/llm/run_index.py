"""Suffix-array dedup with a run-length index.

Bytes that lie in a string of `length` bytes which starts anywhere else are removed. The
corpus is cut so that every such string meets its copies, and only there an index is built:

1. Every window of `length` bytes has an anchor, its `anchor`-byte string of least hash.
   Neighbouring windows with one anchor are a segment. Equal windows have equal anchors.
2. Segments are counted by the anchor's hash; most anchors occur once and end here.
3. Equal segments are counted before anything is shipped. All windows of a segment that occurs
   twice are repeats, however often it occurs.
4. The distinct segments of an anchor with several are indexed, about half a MB of text at a time:
   the run-compressed Burrows-Wheeler transform of the segments with suffix positions sampled at
   both ends of each run. The longest match of each position with its neighbours in suffix
   order shrinks by one from position to position except at samples, so matching statistics
   are streamed over the text from the samples alone. A statistic of `length` marks a window.
5. An anchor with more than `most_variants` distinct segments (the edge of a passage that a
   large part of the corpus holds) isn't gathered: its windows are counted by hash instead,
   which Spark sums before shuffling.

Texts travel compressed and meet their spans in one shuffle; no group is collected that grows
with the corpus. Hashes of 128 bits (anchor and segment, or anchor and window) stand for equal
strings in steps 3 and 5; step 4 compares bytes.

Cases: a null text is empty; texts shorter than `length` are kept; repeated rows are copies of
one another; documents without a number are told apart by their text; strings are judged on the
input; an empty table gives no rows. `cut_repeats` keeps all other columns; where a removed
string starts or ends inside a character, the rest of that character goes with it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import mix, payload
from tickloom.session import cut_lineage

LENGTH, ANCHOR = 200, 32
STEP = 1 << 18  # windows hashed at a time
INDEX_SEGMENTS = 2000  # segments in one index
U = np.uint64


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, and the powers of an odd number and of its inverse mod 2^64."""
    base = 0x9E3779B97F4A7C15
    size = STEP + 4096
    up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.random.default_rng(7).integers(1, 1 << 64, 256, dtype=U), np.cumprod(up), np.cumprod(down)


class Hashes:
    """Hashes of all substrings of a byte array of up to STEP + 4095 bytes."""

    def __init__(self, raw: np.ndarray):
        values, self.up, down = powers()
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum(values[raw] * down[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(U))

    def rolling(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.up[:n] + U(size))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    done, n = 1, len(x) - width + 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n])


def segments(raw: np.ndarray, at: np.ndarray, length: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, start, windows, anchor hash, segment hash) of all segments of texts laid end to end."""
    place = U((1 << 21) - 1)
    for c in range(0, max(0, len(raw) - length + 1), STEP):
        part = raw[c : c + STEP + length - 1]
        n = len(part) - length + 1
        # the documents of this part, and which windows lie inside one
        first, last = np.searchsorted(at, c, side="right") - 1, np.searchsorted(at, c + n, side="left")
        left, right = np.maximum(at[first:last] - c, 0), np.minimum(at[first + 1 : last + 1] - length + 1 - c, n)
        fits = right > left
        left, right, names = left[fits], right[fits], np.arange(first, last)[fits]
        if not len(left):
            continue
        hashes = Hashes(part)
        ranks = hashes.rolling(anchor)
        spot = sliding_minimum((ranks & ~place) | np.arange(len(ranks), dtype=U), length - anchor + 1) & place
        sizes = right - left
        windows = np.repeat(left - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        own = spot[windows]
        fresh = np.ones(len(windows), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)
        heads = np.flatnonzero(fresh)
        count = np.diff(np.append(heads, len(windows)))
        start = windows[heads]
        name = names[np.searchsorted(left, start, side="right") - 1]
        yield name, start + c - at[name], count, ranks[own[heads].astype(np.int64)], hashes.of(start, start + count + length - 1)


class RunIndex:
    """Run-length index of texts laid end to end with a separator of its own behind each.

    `heads` and `tails` are the suffix positions at the first and last place of each run of the
    Burrows-Wheeler transform, `chars` and `runs` the runs themselves.
    """

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(x) for x in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        n, k = int(sizes.sum()) + len(parts), len(parts)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.starts + sizes] = False
        text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + k
        text[~inside] = np.arange(k)
        self.text, self.levels = text, []
        order = self.sort(max(1, int(k + 255).bit_length()))
        before = text[order - 1]  # the text is circular; position 0 follows the last separator
        change = np.ones(n, bool)
        change[1:] = before[1:] != before[:-1]
        first = np.flatnonzero(change)
        last = np.append(first[1:], n) - 1
        self.chars, self.runs = before[first], last - first + 1
        self.heads, self.tails = order[first], order[last]
        above, below = np.full(len(first), -1, np.int64), np.full(len(first), -1, np.int64)
        above[1:], below[:-1] = order[first[1:] - 1], order[last[:-1] + 1]
        self.head_match, self.tail_match = self.common(self.heads, above), self.common(self.tails, below)
        self.levels = []

    def sort(self, bits: int) -> np.ndarray:
        """Suffix positions in order, by ranks of strings of doubling length; ranks are kept for `common`."""
        n, step = len(self.text), max(1, 62 // bits)
        step = 1 << (step.bit_length() - 1)
        padded = np.concatenate([self.text, np.zeros(step, np.int64)])
        keys = np.zeros(n, np.int64)
        for j in range(step):
            keys = (keys << bits) | padded[j : j + n]
        while True:
            order = np.argsort(keys)
            ordered = keys[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            self.levels.append((step, np.append(rank.astype(np.int32), np.int32(-1))))
            if rank[order[-1]] == n - 1:
                return order
            behind = np.zeros(n, np.int64)
            behind[: n - step] = rank[step:] + 1
            keys = rank * (n + 1) + behind
            step *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common string from each a and b; 0 where b is -1."""
        n, found = len(self.text), np.zeros(len(a), np.int64)
        real = b >= 0
        for step, rank in reversed(self.levels):
            same = real & (rank[np.minimum(a + found, n)] == rank[np.minimum(b + found, n)])
            found += np.where(same, step, 0)
        for _ in range(self.levels[0][0] - 1):
            x, y = np.minimum(a + found, n - 1), np.minimum(b + found, n - 1)
            found += real & (self.text[x] == self.text[y]) & (x != y)
        return found

    def matches(self) -> np.ndarray:
        """Of every position, the length of its longest match that starts elsewhere."""
        best = np.zeros(len(self.text), np.int64)
        for spots, known in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            reach = np.full(len(self.text), -1, np.int64)
            reach[spots] = known + spots
            source = np.maximum.accumulate(np.where(reach >= 0, np.arange(len(reach)), 0))
            best = np.maximum(best, reach[source] - np.arange(len(reach)))
        return best


def runs_of(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans covered by windows of `length` at ascending `starts`."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All other columns as one, the text, and what tells documents apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("d"),
        F.xxhash64(text).alias("fp"),
        text.alias("text"),
    )


def compressed(docs: DataFrame) -> DataFrame:
    """`docs` with its text compressed, so that it travels in less than half its size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            small = pa.array([squeeze(x.as_buffer()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], small], [*batch.schema.names[:-1], "z"])

    return docs.mapInArrow(pack, T.StructType([*docs.schema.fields[:-1], T.StructField("z", T.BinaryType())]))


def find_segments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(d, fp, at, key, seg) of every segment; `at` holds its start and, in 16 bits, its windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = payload(batch.column("text"))
            names, prints = batch.column("d").to_numpy(), batch.column("fp").to_numpy()
            for doc, start, count, key, seg in segments(raw, at, length, anchor):
                cells = [names[doc], prints[doc], (start << 16) | count, key.view(np.int64), seg.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["d", "fp", "at", "key", "seg"])

    return docs.select("d", "fp", "text").mapInArrow(cut, "d long, fp long, at long, key long, seg long")


def repeat_spans(found: DataFrame, travelling: DataFrame, length: int, most_variants: int) -> DataFrame:
    """(d, fp, spans) of documents with repeats; a span is start * 2^16 + length."""
    twice = found.groupBy("key").count().where("count > 1").select("key")
    found = cut_lineage(found.join(twice, "key"), "segments")
    kinds = found.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("d", "fp", "at")).alias("rep"))
    variants = kinds.groupBy("key").agg(F.count("*").alias("variants"))
    kinds = cut_lineage(kinds.join(variants, "key"), "segment-kinds")

    whole = found.join(kinds.where("n > 1").select("key", "seg"), ["key", "seg"]).select("d", "fp", (F.col("at") + length - 1).alias("span"))

    mixed = kinds.where("variants > 1").select("key", F.col("n") > 1, F.col("variants") > most_variants, "rep.*").toDF("key", "known", "hot", "d", "fp", "at")
    size = mixed.where("not hot").count()
    wanted = mixed.groupBy("d", "fp").agg(F.collect_list(F.struct("at", "key", "known", "hot")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for d, fp, wanted, z in zip(*[batch.column(c) for c in ("d", "fp", "wanted", "z")], strict=True):
                text, wanted = expand(z.as_buffer()), pa.array(wanted.values)
                at = wanted.field("at").to_numpy()
                data = [text[a >> 16 : (a >> 16) + (a & 65535) + length - 1] for a in at.tolist()]
                n = len(at)
                cells = [pa.array(np.full(n, d.as_py())), pa.array(np.full(n, fp.as_py())), pa.array(at), *[wanted.field(c) for c in ("key", "known", "hot")], pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["d", "fp", "at", "key", "known", "hot", "data"])

    shape = "d long, fp long, at long, key long, known boolean, hot boolean, data binary"
    # one copy of a document is enough where rows are repeated
    fetched = wanted.join(travelling.select("d", "fp", "z"), ["d", "fp"]).dropDuplicates(["d", "fp"]).mapInArrow(fetch, shape)
    spans = "d long, fp long, span long"

    def index(rows: pa.Table) -> pa.Table:
        built = RunIndex(rows.column("data").to_pylist())
        repeated = np.flatnonzero(built.matches() >= length)
        d, fp, at, known = (rows.column(c).to_numpy() for c in ("d", "fp", "at", "known"))
        owner = np.searchsorted(built.starts, repeated, side="right") - 1
        repeated, owner = repeated[~known[owner]], owner[~known[owner]]
        # windows of one segment in a row are one span
        head = np.ones(len(owner), bool)
        head[1:] = (owner[1:] != owner[:-1]) | (repeated[1:] != repeated[:-1] + 1)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(owner)) - 1 if len(first) else first
        who = owner[first]
        start = (at[who] >> 16) + repeated[first] - built.starts[who]
        return pa.table({"d": d[who], "fp": fp[who], "span": (start << 16) + repeated[last] - repeated[first] + length})

    groups = max(1, -(-size // INDEX_SEGMENTS))
    indexed = fetched.where("not hot").withColumn("part", F.pmod("key", F.lit(groups))).groupBy("part").applyInArrow(index, spans)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = payload(batch.column("data"))
            for i in range(batch.num_rows):
                hashes = Hashes(raw[at[i] : at[i + 1]]).rolling(length).view(np.int64)
                n = len(hashes)
                start = (batch.column("at")[i].as_py() >> 16) + np.arange(n)
                cells = {c: np.full(n, batch.column(c)[i].as_py()) for c in ("key", "known", "d", "fp")}
                yield pa.RecordBatch.from_pydict(cells | {"hash": hashes, "span": (start << 16) + length})

    single = fetched.where("hot").mapInArrow(windows, "key long, known boolean, d long, fp long, hash long, span long")
    counts = single.groupBy("key", "hash").agg(F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("n")).where("n > 1")
    counted = single.where("not known").join(counts.select("key", "hash"), ["key", "hash"]).select("d", "fp", "span")
    return whole.union(indexed).union(counted).groupBy("d", "fp").agg(F.collect_list("span").alias("spans"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal covered runs of spans in any order."""
    spans = np.sort(spans)
    start, end = spans >> 16, (spans >> 16) + (spans & 65535)
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(start[1:] > reach[:-1])
    return list(zip(start[np.append(0, cut + 1)].tolist(), reach[np.append(cut, len(spans) - 1)].tolist()))


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for run in runs for x in run], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, length: int, anchor: int, most_variants: int, id_col: str, text_col: str) -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    travelling = compressed(rows)
    spans = repeat_spans(find_segments(rows, length, anchor), travelling, length, most_variants)
    return travelling.join(spans, ["d", "fp"], "left")


def resolved(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    expand = zstandard.ZstdDecompressor().decompress
    for z, spans in zip(batch.column("z"), batch.column("spans"), strict=True):
        found = spans.values.to_numpy() if spans.is_valid else np.zeros(0, np.int64)
        yield expand(z.as_buffer()), merged(found) if len(found) else []


def repeat_digest(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_variants: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in resolved(batch):
                removed = sum(b - a for a, b in runs)
                rows.append((len(text), removed, len(runs), hashlib.sha256(kept_bytes(text, runs)).hexdigest()))
            cells = [pa.array(x) for x in zip(*rows)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cells], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(docs.select(id_col, text_col), length, anchor, most_variants, id_col, text_col)
    rows = found.select(F.col(f"rest.`{id_col}`").cast("long").alias("doc_id"), "z", "spans")
    return rows.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most_variants: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without repeated strings in `text_col`; all rows and columns stay."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [kept_bytes(text, runs).decode("utf-8", errors="ignore") for text, runs in resolved(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(kept, pa.string())], ["rest", "text"])

    found = with_spans(docs, length, anchor, most_variants, id_col, text_col).select("rest", "z", "spans")
    out = found.mapInArrow(cut, T.StructType([found.schema["rest"], T.StructField("text", T.StringType())]))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
