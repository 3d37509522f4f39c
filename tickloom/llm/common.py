"""Helpers shared by the operators: narrow views of a table, Arrow buffers, written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of a table whatever else it holds; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def rows_of(batches: Iterator[pa.RecordBatch], most_bytes: int, *columns: str) -> Iterator[list[list]]:
    """Batches as lists of Python values, cut so that the last column's bytes stay near `most_bytes`."""
    for batch in batches:
        sizes = np.cumsum(lengths(batch.column(columns[-1])))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
            part = batch.slice(start, end - start)
            yield [part.column(c).to_pylist() for c in columns]
            start = end


def offsets(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64)


def lengths(array: pa.Array) -> np.ndarray:
    """Bytes of every value of a string or binary array."""
    return np.diff(offsets(array)) if len(array) else np.zeros(0, np.int64)


def payload(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values as one array, and where each value starts and the last one ends."""
    at = offsets(array) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def salted(*columns: str) -> Column:
    return F.xxhash64(*columns)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; rows go to Python in batches of bounded size from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
