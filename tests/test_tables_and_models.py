"""Sources, sinks, metadata and models on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.plans import models
from tickloom.plans.dataset import TablePlan, dataset_metadata, feature_columns
from tickloom.plans.evaluation import positive_class
from tickloom.schemas import DDL, conform, schema_of
from tickloom.sources import sinks, tables


def test_canonical_schemas(spark):
    counts = {t: len([f for f in schema_of(t).names if f != "seq"]) for t in DDL}
    assert counts == {"book": 49, "trades": 20, "quotes": 19, "own_orders": 10, "own_trades": 9, "instruments": 29}
    df = conform(spark.createDataFrame([("7", "x")], "recv_ns string, extra string"), "quotes")
    assert df.schema["recv_ns"].dataType.simpleString() == "bigint" and "extra" in df.columns


def test_dated_tables_and_reports(spark, tmp_path):
    root = str(tmp_path)
    day = 86_400 * 1_000_000_000
    df = spark.createDataFrame([(i * day // 2, i, "A") for i in range(6)], "recv_ns long, seq long, asset_id string")
    sinks.write_dated(df, f"{root}/normalized/trades")
    loaded = tables.read_dated(spark, root, "normalized", "trades", "19700102", "19700102")
    assert loaded.ok and loaded.frame.count() == 2
    every = tables.load_tables(spark, root)
    assert every["trades"].ok and every["quotes"].error == "missing" and every["book"].error == "missing"
    assert tables.discover_dates(list(every.values())) == ["19700101", "19700102", "19700103"]
    report = {(r["table"], r["date"]): r["rows"] for r in tables.schema_report(spark, every).collect()}
    assert report[("trades", "19700101")] == 2 and report[("quotes", None)] == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("not parquet")
    assert not tables.read_safe(spark, f"{root}/bad/x.parquet", "bad").ok


def test_parts_and_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("20240101", "m/1", 1, float("nan")), ("20240101", "", 2, 1.0)], "date string, market_id string, recv_ns long, x double")
    sinks.write_parts(df, str(tmp_path / "parts"))
    names = sorted(p.name for p in (tmp_path / "parts" / "date=20240101").iterdir())
    assert names[0].startswith("market_part=m_1-") and names[1:] == ["market_part=unknown"]
    assert sorted(r["market_id"] for r in spark.read.parquet(str(tmp_path / "parts")).collect()) == ["", "m/1"]
    assert {r["x"] for r in sinks.json_safe(df).collect()} == {None, 1.0}
    paths = sinks.write_artifacts(df, dataset_metadata(df, TablePlan()), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(paths["csv"]).count() == 2
    assert json.loads(spark.read.json(paths["metadata"]).first()["config"])["targets"]["main"] == 10


def test_feature_list_has_no_label(spark):
    df = spark.createDataFrame([], "recv_ns long, y_x int, future_mid_1s double, final_profit_10s double, top1_imbalance double, price_bucket string, note string, two_leg_edge_10s double")
    assert feature_columns(df.schema) == ["top1_imbalance", "price_bucket"]


@pytest.mark.parametrize(
    ("classes", "want"), [(["skip", "enter"], "enter"), (["down", "neutral", "up"], "up"), ([0, 1], 1), (["0", "1"], "1"), (["x", "y"], "y"), ([], None)]
)
def test_positive_class(classes, want):
    assert positive_class(classes) == want


def test_fit_score_and_importance(spark):
    rows = [(float(i % 10), None if i % 7 == 0 else float(i % 3), ["a", "b", None][i % 3], "enter" if i % 10 > 4 else "skip", float(i % 10) * 2) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, vol_bucket string, cls string, reg double")
    names = ["x", "z", "vol_bucket"]
    clf = models.fit_model(df, "cls", models.BASELINES["logistic_regression"], "lr", names, winsor=(0.01, 0.99))
    scored = models.score(df, clf, "p").groupBy("cls").agg(F.avg("p").alias("p")).collect()
    p = {r["cls"]: r["p"] for r in scored}
    assert p["enter"] > 0.8 > 0.2 > p["skip"]
    reg = models.fit_model(df, "reg", models.BASELINES["linear_regression"], "lin", names)
    err = models.score(df, reg, "out").agg(F.max(F.abs(F.col("out") - F.col("reg")))).first()[0]
    assert err < 1e-6
    top = models.feature_importance(clf, df).first()
    assert top["feature"] == "x" or top["feature"].endswith("_0")
    metrics = models.evaluate_models(df, {"lr": clf, "lin": reg}, "reg", "cls").collect()
    assert {r["model"] for r in metrics} == {"lr", "lin"}


def test_a_step_of_the_feature_table_drops_what_it_has_read(spark, tmp_path, monkeypatch):
    import random

    from tickloom import session
    from tickloom.workload.training_queries import feature_table

    monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{random.random()}")
    table = feature_table(spark, "/root/testdata/sf0.001")
    assert {p.name.rpartition("-")[0] for p in tmp_path.iterdir()} == {"smoothed", "fills"}
    assert table.columns.index("markout_10s_bps") < table.columns.index("y_reg_10s") < table.columns.index("two_leg_edge_10s") < table.columns.index("final_profit_10s")
    assert table.count() == table.select("asset_id", "seq").distinct().count() > 900
