"""Packing into sequences: best fit first, then a local search that empties bins.

Documents longer than a sequence are cut into full pieces, the rest in front. Full pieces
are sequences by themselves. Shorter ones are dealt at random into blocks of about
`block_items`; a block is packed by best fit, largest first, and improved: a bin gives items
to other bins by moves, one-for-one and two-for-one exchanges, each of which raises the sum of
squared fills, until bins are empty. A block ends where no bin can be spared, or where no exchange between
any two of its bins helps.

Cases: a null text is empty (the end id alone); repeated rows are packed as often as they
occur; an empty table gives no rows; pieces of one document may be in different sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import rows_of, texts
from tickloom.llm.encoders import LEADING, encoder
from tickloom.llm.memory import give_back
from tickloom.session import cut_lineage


# of chunks remembered, a generation: workers outlive their stage, beside whatever runs next in the executor
MEMORY = 48 << 20


class Bins:
    """Bins of one block. `items[b]` are the (length, item) pairs of bin b, ascending."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.size, self.total = size, int(lengths.sum())
        self.items: list[list[tuple[int, int]]] = []
        self.fill: list[int] = []
        free: list[list[int]] = [[] for _ in range(size + 1)]
        open_levels = 0  # bit f is set while a bin with f free places exists
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            fitting = open_levels >> n
            if fitting:
                level = n + (fitting & -fitting).bit_length() - 1
                b = free[level].pop()
                if not free[level]:
                    open_levels &= ~(1 << level)
            else:
                level, b = size, len(self.items)
                self.items.append([])
                self.fill.append(0)
            insort(self.items[b], (n, i))
            self.fill[b] += n
            free[level - n].append(b)
            open_levels |= 1 << (level - n)

    @property
    def needed(self) -> int:
        return -(-self.total // self.size)

    def move(self, a: int, b: int, out: list[tuple[int, int]], back: list[tuple[int, int]]) -> None:
        for x in out:
            self.items[a].remove(x)
            insort(self.items[b], x)
        for x in back:
            self.items[b].remove(x)
            insort(self.items[a], x)
        shift = sum(x[0] for x in out) - sum(x[0] for x in back)
        self.fill[a] -= shift
        self.fill[b] += shift

    def exchange(self, a: int, b: int) -> bool:
        """The exchange between a and b which moves most from a to b within b's free places.

        It raises the squared fill, as b ends fuller than a was.
        """
        room, least = self.size - self.fill[b], max(1, self.fill[a] - self.fill[b] + 1)
        if room < least:
            return False
        mine, theirs = self.items[a], self.items[b]
        best, change = least - 1, None
        singles = [((x,), x[0]) for x in mine]
        pairs = [((x, y), x[0] + y[0]) for i, x in enumerate(mine) for y in mine[:i]]
        for out, n in singles:
            if best < n <= room:
                best, change = n, (out, ())
        lengths = [x[0] for x in theirs]
        for out, n in singles + pairs:
            k = bisect_left(lengths, n - room)
            if k < len(theirs) and n - lengths[k] > best:
                best, change = n - lengths[k], (out, (theirs[k],))
        for out, n in singles:
            for i, x in enumerate(theirs):
                k = bisect_left(lengths, n - room - x[0], 0, i)
                if k < i and n - x[0] - lengths[k] > best:
                    best, change = n - x[0] - lengths[k], (out, (x, theirs[k]))
        if change is None:
            return False
        self.move(a, b, list(change[0]), list(change[1]))
        return True

    def improve(self) -> None:
        """Empty bins, the least filled first, until no bin can be spared or no bin has an exchange that helps."""
        live = {b for b, n in enumerate(self.fill) if n}
        index = Partners(self, live)
        waiting, stuck = set(live), set()
        heap = sorted((self.fill[b], b) for b in live)
        changed = False  # since the stuck bins were last tried
        while len(live) > self.needed:
            if not heap:
                if not changed:
                    return
                waiting, stuck, changed = stuck, set(), False
                heap = sorted((self.fill[b], b) for b in waiting)
            n, a = heappop(heap)
            if a not in waiting or n != self.fill[a]:
                continue
            index.drop(a)
            while self.fill[a] and (b := index.partner(a)) is not None:
                index.drop(b)
                while self.fill[a] and self.exchange(a, b):
                    changed = True
                index.add(b)
                if b in waiting:
                    heappush(heap, (self.fill[b], b))
            waiting.discard(a)
            if self.fill[a]:
                index.add(a)
                stuck.add(a)
            else:
                live.discard(a)

    def places(self) -> Iterator[tuple[int, int, int]]:
        """(item, bin, offset) of every item."""
        for b, items in enumerate(self.items):
            at = 0
            for n, i in items:
                yield i, b, at
                at += n


class Partners:
    """Bins by what is left of them without none, one or two of their items, so that a partner is found without trying each.

    With items of sum s in place of those taken back, a bin is filled up to left + s, which must be more than both
    bins hold now and at most a sequence. So of the bins with as much left, the least filled one tells whether any will do.
    """

    def __init__(self, bins: Bins, live: set[int]):
        self.bins, size = bins, bins.size
        self.left = np.arange(size + 1)
        # for one item given (none or two come back), and for one or two given (one comes back)
        self.held: list[list[dict[int, set[int]]]] = [[{} for _ in range(size + 1)] for _ in range(2)]
        self.least = [np.full(size + 1, size), np.full(size + 1, size)]
        self.noted: dict[int, tuple[int, list[list[int]]]] = {}
        for b in live:
            self.add(b)

    def sums(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of single items of a bin, and of pairs."""
        one = np.array([x[0] for x in self.bins.items[b]], np.int64)
        i, j = np.triu_indices(len(one), 1)
        return one, one[i] + one[j]

    def add(self, b: int) -> None:
        fill = self.bins.fill[b]
        if fill >= self.bins.size:
            return
        one, two = self.sums(b)
        lefts = [[fill, *{fill - n for n in two.tolist()}], list({fill - n for n in one.tolist()})]
        self.noted[b] = fill, lefts
        for held, least, known in zip(self.held, self.least, lefts):
            for n in known:
                held[n].setdefault(fill, set()).add(b)
                if fill < least[n]:
                    least[n] = fill

    def drop(self, b: int) -> None:
        if b not in self.noted:
            return
        fill, lefts = self.noted.pop(b)
        for held, least, known in zip(self.held, self.least, lefts):
            for n in known:
                held[n][fill].discard(b)
                if not held[n][fill]:
                    del held[n][fill]
                    if least[n] == fill:
                        least[n] = min(held[n], default=self.bins.size)

    def partner(self, a: int) -> int | None:
        """The least filled bin with which an exchange of a helps; a itself is dropped before."""
        size, found = self.bins.size, None
        one, two = self.sums(a)
        for held, least, given in zip(self.held, self.least, (one, np.concatenate([one, two]))):
            upto = np.cumsum(np.bincount(given[given <= size], minlength=size + 1))  # how many sums are at most so long
            good = upto[size - self.left] > upto[np.maximum(np.maximum(least, self.bins.fill[a]) - self.left, 0)]
            good &= least < size
            if good.any():
                n = int(np.flatnonzero(good)[least[good].argmin()])
                if found is None or least[n] < found[0]:
                    found = int(least[n]), min(held[n][int(least[n])])
        return found and found[1]


def pieces_of(docs: DataFrame, file: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every whole text.

    Without `keep`, workers forget at the end of each task what they remember of chunks: slower, but they are small while idle.
    """
    tail = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file, LEADING, MEMORY)
        for names, values in rows_of(batches, 4 << 20, "doc_id", "text"):
            rows = []
            for name, code in zip(names, coder.encode(values), strict=True):
                code = memoryview(code + tail)
                n = len(code) // 4
                edges = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((name, k, a, b - a, zlib.crc32(code[4 * a : 4 * b])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
        if not keep:
            names = values = rows = code = None
            coder.memory.forget()
            give_back()

    return texts(docs, id_col, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, size: int = 1024, block_items: int = 20_000) -> DataFrame:
    """`pieces` with sequence_id and offset. The table should be written: it is read three times.

    Blocks are equal in expectation whatever the keys, as pieces are dealt by their place.
    """
    short = pieces.where(F.col("length") < size)
    blocks = -(-short.count() // block_items) or 1
    dealt = short.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def fill(rows: pa.Table) -> pa.Table:
        bins = Bins(rows.column("length").to_numpy(), size)
        bins.improve()
        place = np.array(list(bins.places()), dtype=np.int64)
        rows = rows.take(pa.array(place[:, 0]))
        first = rows.column("block").to_numpy() * (1 << 32)
        return rows.drop_columns("block").append_column("sequence_id", pa.array(first + place[:, 1])).append_column("offset", pa.array(place[:, 2]))

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = dealt.groupBy("block").applyInArrow(fill, out)
    full = pieces.where(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, file: str, size: int = 1024, end_id: int = 2, block_items: int = 20_000, keep: bool = True) -> DataFrame:
    """Encode, cut and pack whole texts; see the module's text and `pieces_of`."""
    return pack(cut_lineage(pieces_of(docs, file, size, end_id, keep=keep), "pieces"), size, block_items)
