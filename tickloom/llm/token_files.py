"""Token-ID files: ids of documents end to end, document boundaries in Elias-Fano form.

A block holds whole documents in ascending id: the boundaries of its documents and their
numbers as Elias-Fano sequences (low bits packed, high parts in unary, the place of every
64th set bit as a sample for select) and the ids in 16 bits where the vocabulary allows, in 32
otherwise. Blocks of one range of document numbers make up a shard; a shard table is written
by Spark with its own commit, so a lost executor only repeats its shards.

Cases: a null text is empty and holds only the end id; repeated rows are each kept; rows
without a document number come first; an empty table gives a table without rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import rows_of, texts
from tickloom.llm.encoders import DROPPED, encoder

MAGIC = b"TLEF"
SAMPLE = 64


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits a value."""

    def __init__(self, n: int, base: int, width: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.base, self.width, self.low, self.high, self.samples = n, base, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, b"", b"", np.zeros(0, np.uint32))
        base = int(values[0])
        rest = values.astype(np.uint64) - np.uint64(base & 0xFFFFFFFFFFFFFFFF)
        width = max(0, int(int(rest[-1]) // n).bit_length() - 1)
        bits = (rest[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        ones = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, base, width, low, np.packbits(unary, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value i, from the sample before it and the few bytes up to its set bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        first = np.unpackbits(np.frombuffer(self.high, np.uint8, 1, byte), bitorder="little")
        first[: at % 8] = 0
        found, start = np.flatnonzero(first) + byte * 8, byte + 1
        while len(found) <= left:
            more = np.frombuffer(self.high, np.uint8, min(64, len(self.high) - start), start)
            found = np.concatenate([found, np.flatnonzero(np.unpackbits(more, bitorder="little")) + start * 8])
            start += len(more)
        low = 0
        if self.width:
            a, b = i * self.width, (i + 1) * self.width
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8, (b + 7) // 8 - a // 8, a // 8), bitorder="little")
            low = sum(int(x) << k for k, x in enumerate(bits[a % 8 : a % 8 + self.width]))
        return self.base + (((int(found[left]) - i) << self.width) | low)

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width]
            out |= (bits.reshape(self.n, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (out + np.uint64(self.base & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QqBQQ", self.n, self.base, self.width, len(self.low), len(self.high))
        return head + self.low + self.high + self.samples.astype("<u4").tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, base, width, a, b = struct.unpack_from("<QqBQQ", data, at)
        at += struct.calcsize("<QqBQQ")
        low, high = data[at : at + a], data[at + a : at + a + b]
        at += a + b
        count = -(-n // SAMPLE)
        return cls(n, base, width, low, high, np.frombuffer(data, "<u4", count, at)), at + 4 * count


class Block:
    """Documents of a block: their numbers, boundaries and ids."""

    def __init__(self, nameless: int, names: EliasFano, ends: EliasFano, ids: np.ndarray):
        self.nameless, self.names, self.ends, self.ids = nameless, names, ends, ids

    @classmethod
    def of(cls, names: list[int | None], codes: list[np.ndarray]) -> Block:
        known = [x for x in names if x is not None]
        ids = np.concatenate(codes) if codes else np.zeros(0, "<u4")
        ids = ids.astype("<u2" if not len(ids) or int(ids.max()) < 1 << 16 else "<u4")
        ends = np.cumsum([len(x) for x in codes], dtype=np.int64)
        return cls(len(names) - len(known), EliasFano.of(np.array(known, np.int64)), EliasFano.of(ends), ids)

    def __len__(self) -> int:
        return self.ends.n

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, found by select alone."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def to_bytes(self) -> bytes:
        head = MAGIC + struct.pack("<QB", self.nameless, self.ids.itemsize)
        return head + self.names.to_bytes() + self.ends.to_bytes() + self.ids.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        nameless, size = struct.unpack_from("<QB", data, 4)
        names, at = EliasFano.read(data, 4 + struct.calcsize("<QB"))
        ends, at = EliasFano.read(data, at)
        return cls(nameless, names, ends, np.frombuffer(data, f"<u{size}", offset=at))


def write_token_files(docs: DataFrame, path: str, file: str, spaces: str = DROPPED, end_id: int | None = 1, block_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them as shards in ascending document number.

    A block is closed when it holds `block_ids` ids; a longer document has a block of its own.
    """
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        codes: list[np.ndarray] = []
        held, before = 0, 0

        def close() -> pa.RecordBatch:
            block = Block.of(names, codes)
            return pa.RecordBatch.from_pydict({"start": [before], "n_docs": [len(block)], "n_ids": [held], "payload": [block.to_bytes()]}, schema=schema)

        encode = encoder(file, spaces).encode
        for ids, values in rows_of(batches, 4 << 20, "doc_id", "text"):
            for name, code in zip(ids, encode(values), strict=True):
                names.append(name)
                codes.append(np.frombuffer(code + tail, "<u4"))
                held += len(codes[-1])
                if held >= block_ids:
                    yield close()
                    names, codes, held, before = [], [], 0, before + held
        if names:
            yield close()

    schema = pa.schema([("start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
    # rows with one number (or none) are ordered by a hash of their text, which also parts a large group of them
    rows = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, "start long, n_docs long, n_ids long, payload binary")
    out.select(F.spark_partition_id().alias("shard"), "*").write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards.

    A block knows its start within its shard. Only one row for each shard, of which there are as
    many as shuffle partitions, meets in one task and is broadcast, to add up where shards start.
    """
    blocks = spark.read.schema("shard int, start long, n_docs long, n_ids long, payload binary").parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = blocks.join(F.broadcast(shards), "shard").select((F.col("first") + F.col("start")).alias("start"), "payload")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                block = Block.from_bytes(data.as_py())
                ends = block.ends.values()
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                wide = block.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                names = [None] * block.nameless + block.names.values().tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
