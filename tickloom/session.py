"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(name: str = "tickloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the cluster's checkpoint folder.

    The folder is the one `spark.checkpoint.dir` names. Where it is unset, a session of a single
    process (as in tests) gets one of its own; a cluster doesn't, as its executors share no other.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(shared_folder, "_own", None)
        if root is None:
            root = shared_folder._own = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# Shuffle files of a query go when it ends. Otherwise they stay until the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df, purpose: str = "lineage"):
    """`df` written once to a table in the shared folder and read back.

    Later steps start from the table, columnar and pruned, and a lost executor costs only
    its own tasks. The shuffle files behind the table are removed, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, purpose), spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop_written(*tables) -> None:
    """Remove tables of `cut_lineage` which nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
