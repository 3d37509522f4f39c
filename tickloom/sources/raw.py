"""Raw message logs: one JSON envelope `{"recv_ns": int, "raw": ...}` per line."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP_MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 20


def envelope(lines: DataFrame, line: str = "value") -> DataFrame:
    """`recv_ns` and `raw` (JSON text) of each parsable line.

    `raw` may be an object, an array or a JSON string holding either. A missing
    `recv_ns` counts as 0.
    """
    text = F.trim(F.col(line))
    parsed = lines.where(F.startswith(text, F.lit("{"))).withColumn(
        "__e", F.from_json(text, "recv_ns long, raw string, bad string", {"columnNameOfCorruptRecord": "bad"})
    )
    raw = F.col("__e.raw")
    return parsed.where(F.col("__e.bad").isNull() & raw.isNotNull()).select(
        F.coalesce(F.col("__e.recv_ns"), F.lit(0).cast("long")).alias("recv_ns"),
        raw.alias("raw"),
        *[c for c in lines.columns if c != line],
    )


def flatten_payload(messages: DataFrame) -> DataFrame:
    """One row per message: an array payload gives one row per element, with its place."""
    is_array = F.startswith(F.ltrim(F.col("raw")), F.lit("["))
    # from_json keeps an array element that is itself an object as its JSON text
    elements = F.when(is_array, F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    return (
        messages.select("*", F.posexplode(elements).alias("part", "message"))
        .where(F.startswith(F.ltrim(F.col("message")), F.lit("{")))
        .drop("raw")
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all `.jsonl` / `.jsonl.gz` files under `path`, with their place.

    (`file`, `block`, `seq`, `part`) is the order of the log: `block` is where the split that
    holds a line starts in its file, and `seq` grows within a split however splits are packed into tasks.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    return flatten_payload(envelope(lines))


def _recovered(data_of, size: int) -> Iterator[tuple[int, bool, bytes]]:
    """(member, member is whole, line) for every line that can still be decompressed.

    `data_of(offset, n)` reads bytes; only one buffer and one line are held at a time.
    """

    def find(start: int) -> int:
        pos = start
        while pos < size:
            buffer = data_of(pos, READ_BYTES + len(GZIP_MAGIC) - 1)
            at = buffer.find(GZIP_MAGIC)
            if at >= 0:
                return pos + at
            pos += READ_BYTES
        return -1

    offset, member = find(0), 0
    while offset >= 0:
        member += 1
        inflate, pos, pending, whole, resume = zlib.decompressobj(16 + zlib.MAX_WBITS), offset, b"", False, offset + 1
        try:
            while pos < size and not inflate.eof:
                chunk = data_of(pos, READ_BYTES)
                pos += len(chunk)
                *lines, pending = (pending + inflate.decompress(chunk)).split(b"\n")
                for line in lines:
                    if line.strip():
                        yield member, False, line.strip()
            if inflate.eof:
                whole, resume = True, pos - len(inflate.unused_data)
                if pending.strip():
                    yield member, False, pending.strip()
        except zlib.error:
            pass
        yield member, whole, b""
        offset = find(resume)


def recover_gzip(spark: SparkSession, paths: DataFrame, column: str = "path") -> DataFrame:
    """Lines of gzip files with damaged members, one task per file.

    Returns `path, member, line_no, value, complete`; each member ends with a row whose
    `value` is null and whose `complete` says whether it was read to its end. Files are
    read in pieces through the file system their URI names.
    """

    def read(batches):
        import pandas as pd
        from pyarrow import fs

        columns = ["path", "member", "line_no", "value", "complete"]
        for batch in batches:
            for path in batch["path"]:
                system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":/", ":///", 1))
                with system.open_input_file(inner) as f:

                    def data_of(offset, n, f=f):
                        f.seek(offset)
                        return f.read(n)

                    rows, number = [], 0
                    for member, whole, line in _recovered(data_of, f.size()):
                        end = line == b""
                        number += not end
                        text = None if end else line.decode("utf-8", "replace")
                        rows.append((path, member, None if end else number, text, whole if end else None))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=columns)

    files = paths.select(F.col(column).alias("path"))
    spread = files.repartitionByRange(max(1, files.count()), "path")
    return spread.mapInPandas(read, "path string, member int, line_no long, value string, complete boolean")


def recovery_report(recovered: DataFrame) -> DataFrame:
    """Per file: whole and damaged members and recovered lines."""
    return recovered.groupBy("path").agg(
        F.count_if(F.col("complete")).alias("recovered_members"),
        F.count_if(~F.col("complete")).alias("skipped_members"),
        F.count("value").alias("lines"),
    )


def read_event_log(lines: DataFrame, schema: str, event: str | None = None, line: str = "value") -> DataFrame:
    """Parsed JSONL event log: bad lines are skipped, `event` filters on the event name."""
    kept = lines.where(F.startswith(F.col(line), F.lit("{")))
    parsed = kept.select(
        F.from_json(F.col(line), f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"}).alias("r")
    )
    rows = parsed.where(F.col("r.__bad").isNull()).select("r.*").drop("__bad")
    return rows if event is None else rows.where(F.col("event") == event)


def json_field(col: Column, path: str) -> Column:
    """A value at a dotted path inside JSON text; null where any step is missing."""
    return F.get_json_object(col, "$." + path)
