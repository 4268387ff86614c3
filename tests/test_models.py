"""The governed model, its split, calibration and evaluation, and tables that are published as one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from riskflow.operators import banks, cases, models, views
from riskflow.sources.shared import folder, latest_versions, publish, read_published, tidy

NAMES = ["a", "b"]


def rows(spark, n=240, seed=3):
    r = random.Random(seed)
    made = []
    for k in range(n):
        y = int(r.random() < 0.3)
        made.append((f"k{k}", r.gauss(2.5 * y, 1), r.gauss(0, 1) if k % 9 else None, y))
    return spark.createDataFrame(made, "key string, a double, b double, y int")


def test_split_is_exact_and_stratified(spark):
    t = rows(spark)
    cut = models.split(t, "key", "y", 0.25)
    sizes = {(r["y"], r["is_test"]): r["count"] for r in cut.groupBy("y", "is_test").count().collect()}
    for y in (0, 1):
        whole = sizes[y, True] + sizes[y, False]
        assert sizes[y, True] == int(whole * 0.25 + 0.5)
    again = {r["key"] for r in models.split(t.repartition(7), "key", "y", 0.25).where("is_test").collect()}
    assert again == {r["key"] for r in cut.where("is_test").collect()}
    assert models.split(t.limit(0), "key", "y").count() == 0


def test_gate(spark):
    t = models.split(rows(spark), "key", "y")
    path = folder(spark, "model")
    shut = lambda *a, **k: {(r["probability"], r["unavailable_reason"]) for r in models.predict_supervised(t, path, *a, **k).collect()}
    assert shut(NAMES, enabled=False) == {(None, "disabled_by_configuration")}
    assert shut(NAMES, enabled=True) == {(None, "provenance_manifest_missing")}
    model = models.train_classifier(t.where("not is_test"), NAMES, "y", trees=3)
    models.save_model(model, path, NAMES, {"model_version": "1", "metrics": "x"})
    assert shut(NAMES, enabled=True) == {(None, "provenance_manifest_incomplete: artifact_hashes, feature_semantics_version, library_versions, training_provenance")}
    models.save_model(model, path, NAMES, dict.fromkeys(models.MANIFEST, "x"))
    assert shut(["b", "a"], enabled=True) == {(None, "feature_schema_differs")}
    open_ = models.predict_supervised(t, path, NAMES, enabled=True).collect()
    assert all(0 <= r["probability"] <= 1 and r["unavailable_reason"] is None for r in open_) and len(open_) == 240
    again = {r["key"]: r["probability"] for r in models.predict(model, t).collect()}
    assert {r["key"]: r["probability"] for r in open_} == pytest.approx(again)


def test_calibration_is_fitted_on_other_rows(spark):
    r = random.Random(5)
    made = [(k, p := round(r.random(), 3), int(r.random() < p * p)) for k in range(400)]
    t = spark.createDataFrame(made, "key int, probability double, y int")
    fitted, rest = t.where("key < 300"), t.where("key >= 300")
    got = {x["key"]: x["calibrated"] for x in models.calibrate(fitted, rest, "y").collect()}
    turned = {x["key"]: x["calibrated"] for x in models.calibrate(fitted, rest.withColumn("y", 1 - F.col("y")), "y").collect()}
    assert got == turned and len(got) == 100  # labels of the rows themselves don't count
    error = lambda of: sum((of(k, p) - y) ** 2 for k, p, y in made if k >= 300) / 100
    assert error(lambda k, p: got[k]) < error(lambda k, p: p)
    few = {x["calibrated"] == x["probability"] for x in models.calibrate(t.where("key < 5"), rest, "y").collect()}
    assert few == {True}


def test_metrics_with_ties(spark):
    r = random.Random(6)
    made = [(round(r.random(), 1), int(r.random() < 0.4)) for _ in range(300)]
    t = spark.createDataFrame(made, "s double, y int").withColumn("c", F.lit(0.4))
    got = models.eval_metrics(t, "s", "y", "c").first()
    whole, area, before = sum(y for _, y in made), 0.0, 0.0
    points = []
    for cut in sorted({s for s, _ in made}, reverse=True):
        taken = [y for s, y in made if s >= cut]
        precision, recall = sum(taken) / len(taken), sum(taken) / whole
        area, before = area + (recall - before) * precision, recall
        points.append((cut, precision, recall))
    share = whole / 300
    assert got["pr_auc"] == pytest.approx(area) and got["brier"] == pytest.approx(sum((s - y) ** 2 for s, y in made) / 300)
    assert got["brier_calibrated"] == pytest.approx(sum((0.4 - y) ** 2 for _, y in made) / 300) and got["brier_base_rate"] == pytest.approx(share * (1 - share))
    at = [p for p in points if p[1] >= 0.5]
    assert got["recall_5"] == pytest.approx(max((p[2] for p in at), default=0)) and got["threshold_5"] == min((p[0] for p in at), default=None)


def test_tables_are_published_as_one(spark, tmp_path):
    path = f"{tmp_path}/set"
    table = lambda n: spark.range(n).withColumn("x", F.lit(n))
    assert latest_versions(spark, path).count() == 0 and read_published(spark, path, "a", 1) is None and tidy(spark, path) == []
    first = publish({"a": table(3), "b": table(4)}, path, 1)
    publish({"a": table(30)}, path, 2)

    class Dies(Exception):
        pass

    def broken(_):
        raise Dies

    bad = spark.range(5).mapInPandas(broken, "id long, x int")
    with pytest.raises(Exception):  # noqa: B017, PT011  between the tables of a version
        publish({"a": table(7), "b": bad}, path, 1)
    read = lambda name, k=1: read_published(spark, path, name, k).count()
    assert (read("a"), read("b"), read("a", 2)) == (3, 4, 30)
    second = publish({"a": table(8), "b": table(9)}, path, 1)
    assert (read("a"), read("b"), read("a", 2)) == (8, 9, 30) and read_published(spark, path, "c", 1) is None
    gone = tidy(spark, path)
    assert first in gone and second not in gone and len(gone) == 2  # the replaced one and the one that died
    assert (read("a"), read("b"), read("a", 2)) == (8, 9, 30) and tidy(spark, path) == []


def test_intel_tables(spark, tmp_path):
    data = [(1, "BANK_1", "BANK_2", "a", "b", 100.0, True), (2, "BANK_2", "UNATTRIBUTED", "b", None, 50.0, False), (3, "BANK_1", "BANK_3", "a", "c", 10.0, False)]
    t = spark.createDataFrame(data, "row_idx long, from_bank string, to_bank string, from_account string, to_account string, amount double, labelled boolean")
    t = t.withColumns({"amount": F.col("amount").cast("decimal(18,2)"), "ts": F.lit("2024-01-01").cast("timestamp"), "payment_currency": F.lit("INR"), "receiving_currency": F.lit("INR"), "format": F.lit("wire")})
    derived = banks.derive(t)
    parts = banks.components(derived)
    assert {r["bank"] for r in parts.collect()} == {"BANK_1", "BANK_2", "BANK_3"}  # a placeholder is nobody's peer
    views.sink_intel(t, banks.bank_risk(banks.risk_components(parts)), banks.bank_volume(banks.bank_legs(derived)), banks.bank_edges(t), f"{tmp_path}/intel", 7)
    assert read_published(spark, f"{tmp_path}/intel", "ledger", 7).count() == 3
    assert {(r["bank"], r["display_name"]) for r in read_published(spark, f"{tmp_path}/intel", "banks", 7).collect()} == {("BANK_1", "Bank 1"), ("BANK_2", "Bank 2"), ("BANK_3", "Bank 3"), ("UNATTRIBUTED", "UNATTRIBUTED")}
    assert {r["bank"]: r["n"] for r in read_published(spark, f"{tmp_path}/intel", "profiles", 7).collect()}["BANK_1"] == 2


def test_statements_of_cases(spark):
    statements = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "statement_id long, x string")
    members = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, None)], "case_id long, statement_id long")
    assert sorted(r["x"] for r in cases.case_statements(statements, members).collect()) == ["a", "b"]
    assert [r["x"] for r in cases.case_statements(statements, members, 1).collect()] == ["a"]
