from pathlib import Path

from pyspark.sql import functions as F

from tickloom import session
from tickloom.session import cut_lineage, drop_written


def shuffle_files(spark):
    """Files of shuffles that this process holds on its disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if Path(f).name.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(20_000).withColumn("k", F.col("id") % 5000).repartition(4, "k").groupBy("k").agg(F.sum("id").alias("x"))
    held = cut_lineage(rows.join(rows.withColumnRenamed("x", "y"), "k"), "sums")
    for _ in range(50):  # files are removed in the background
        if not (left := shuffle_files(spark) - before):
            break
        spark.range(1).count()
    assert not left
    assert held.where("x = y").count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_dropped_tables_are_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    a, b = (cut_lineage(spark.range(10), name) for name in ("a", "b"))
    drop_written(a)
    assert [p.name[0] for p in tmp_path.iterdir()] == ["b"] and b.count() == 10
