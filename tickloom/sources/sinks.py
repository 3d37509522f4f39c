"""Table and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.prices import finite_or_null
from tickloom.functions.text import partition_name, utc_date


def write_dated(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by the UTC date of `recv_ns`."""
    df.withColumn("date", utc_date(F.col("recv_ns"))).write.mode(mode).partitionBy("date").parquet(path)


def write_parts(df: DataFrame, path: str, mode: str = "overwrite", files_per_part: int = 1) -> None:
    """Parquet partitioned by date and `market_part`, a folder name made from `market_id`, which stays as it is.

    Rows are first brought together per (date, market) and `files_per_part` salts, so that
    a partition is written by few tasks and a hot market still by several.
    """
    named = df.withColumn("market_part", partition_name(F.col("market_id")))
    salt = F.pmod(F.xxhash64("recv_ns"), F.lit(files_per_part))
    named.repartition("date", "market_part", salt).write.mode(mode).partitionBy("date", "market_part").parquet(path)


def write_table(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """One distributed write; `files` limits the number of output files."""
    (df.coalesce(files) if files else df).write.mode(mode).parquet(path)


def write_artifacts(dataset: DataFrame, metadata: DataFrame, folder: str, name: str = "dataset", csv: bool = True) -> dict[str, str]:
    """The data set as Parquet (and CSV) and its metadata as JSON."""
    paths = {"parquet": f"{folder}/{name}", "metadata": f"{folder}/{name}_metadata"}
    dataset.write.mode("overwrite").parquet(paths["parquet"])
    metadata.write.mode("overwrite").json(paths["metadata"])
    if csv:
        paths["csv"] = f"{folder}/{name}_csv"
        flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType)) else F.col(f.name) for f in dataset.schema]
        dataset.select(*flat).write.mode("overwrite").option("header", True).csv(paths["csv"])
    return paths


def _clean(col, kind: T.DataType):
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite_or_null(col)
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[_clean(col[f.name], f.dataType).alias(f.name) for f in kind]))
    return col


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities in (nested) floats become null, so every line is strict JSON."""
    return df.select(*[_clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


def write_event_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of samples as JSON lines."""
    writer = json_safe(stream).writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
