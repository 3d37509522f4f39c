"""Date-partitioned tables: discovery, loading, reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical tables and the layer each is kept in.
TABLES = {
    "quotes": "normalized",
    "trades": "normalized",
    "ref_book": "normalized",
    "ref_quotes": "normalized",
    "ref_trades": "normalized",
    "instruments": "normalized",
    "enriched_book": "research",
    "trade_markouts": "research",
    "ref_trade_markouts": "research",
}


@dataclass
class Loaded:
    """A table, or why it could not be read."""

    name: str
    path: str
    frame: DataFrame | None
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.frame is not None and self.error is None


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything matches the (glob) path on its own file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    matches = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return matches is not None and len(matches) > 0


def read_safe(spark: SparkSession, path: str, name: str, merge_schema: bool = False) -> Loaded:
    """The table at `path`; a missing or unreadable one is reported, not raised."""
    if not path_exists(spark, path):
        return Loaded(name, path, None, "missing")
    try:
        return Loaded(name, path, spark.read.option("mergeSchema", merge_schema).parquet(path))
    except Exception as e:  # noqa: BLE001 - any reader failure is the table's status
        return Loaded(name, path, None, f"{type(e).__name__}: {str(e).splitlines()[0]}")


def read_dated(
    spark: SparkSession,
    root: str,
    layer: str,
    table: str,
    start: str | None = None,
    end: str | None = None,
    layout: str = "partitions",
) -> Loaded:
    """One table over all dates, or over `start <= date <= end`.

    Layout `partitions`: `root/layer/table/date=D`; the range prunes partitions. Layout
    `folders`: `root/layer/D/table.parquet`, where the date is taken from the path.
    """
    if layout == "partitions":
        out = read_safe(spark, f"{root}/{layer}/{table}", table)
        if not out.ok:
            return out
        df = out.frame.withColumn("date", F.col("date").cast("string")) if "date" in out.frame.columns else out.frame
    else:
        out = read_safe(spark, f"{root}/{layer}/*/{table}.parquet", table, merge_schema=True)
        if not out.ok:
            return out
        df = out.frame.withColumn("date", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+\.parquet", 1))
    if start is not None:
        df = df.where(F.col("date") >= start)
    if end is not None:
        df = df.where(F.col("date") <= end)
    return Loaded(table, out.path, df)


def load_tables(
    spark: SparkSession, root: str, start: str | None = None, end: str | None = None, layout: str = "partitions"
) -> dict[str, Loaded]:
    """All canonical tables, with the sampled book where it exists and the full book otherwise."""
    out = {name: read_dated(spark, root, layer, name, start, end, layout) for name, layer in TABLES.items()}
    sampled = read_dated(spark, root, "normalized", "sampled_book", start, end, layout)
    out["book"] = sampled if sampled.ok else read_dated(spark, root, "normalized", "book", start, end, layout)
    return out


def discover_dates(tables: Sequence[Loaded], requested: Sequence[str] | None = None) -> list[str]:
    """The requested dates, or every date any of the tables has."""
    if requested:
        return sorted({d for d in requested if d})
    dates: set[str] = set()
    for t in tables:
        if t.ok and "date" in t.frame.columns:
            dates |= {r[0] for r in t.frame.select("date").distinct().collect() if r[0]}
    return sorted(dates)


def values_of(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def rows_of(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows with one value of a column; the filter reaches the Parquet scan."""
    return df.where(F.col(column) == F.lit(value))


def available_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only those of the wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def late_columns(rows: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide columns fetched only for rows that were chosen from narrow ones."""
    return rows.join(table.select(*keys, *columns), list(keys))


def schema_report(spark: SparkSession, tables: dict[str, Loaded]) -> DataFrame:
    """(date, table, path, rows, columns, error) for every table and date."""
    schema = "date string, `table` string, path string, rows long, columns string, error string"
    out = None
    for name, t in tables.items():
        if not t.ok:
            one = spark.createDataFrame([(None, name, t.path, 0, "{}", t.error)], schema)
        else:
            types = json.dumps({f.name: f.dataType.simpleString() for f in t.frame.schema})
            date = F.col("date") if "date" in t.frame.columns else F.lit(None).cast("string")
            one = t.frame.groupBy(date.alias("date")).agg(F.count(F.lit(1)).alias("rows")).select(
                "date", F.lit(name).alias("table"), F.lit(t.path).alias("path"), "rows", F.lit(types).alias("columns"), F.lit(None).cast("string").alias("error")
            )
        out = one if out is None else out.unionByName(one)
    return out
