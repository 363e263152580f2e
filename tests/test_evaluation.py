import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions.vectors import argmax, softmax
from paperloom.operators import evaluation as ev
from paperloom.operators import scoring as sc
from paperloom.sources import results as rs

KIND = "model string, m int, y_true int, y_pred int"


@pytest.fixture(scope="module")
def preds(spark):
    rows = [("a", 0, 0, 0), ("a", 0, 0, 1), ("a", 0, 1, 1), ("a", 0, 2, 1), ("b", 1, 0, 0), ("b", 1, 1, 0), ("b", 1, 3, 3), ("b", 1, 1, 1)]
    return spark.createDataFrame(rows, KIND)


def test_accuracy_is_trace_over_rows(preds):
    cells = ev.confusion(preds).collect()
    for model in ("a", "b"):
        mine = [c for c in cells if c.model == model]
        assert sum(c.n for c in mine) == 4 and len(mine) == 9
        trace = sum(c.n for c in mine if c.y_true == c.y_pred)
        acc = {r.model: r.accuracy for r in ev.accuracy(preds).collect()}
        assert acc[model] == trace / 4


def test_report_and_undefined_classes(preds):
    report = {(r.model, r.label): r for r in ev.class_report(preds).collect()}
    assert (report["a", 2].precision, report["a", 2].recall, report["a", 2].f1, report["a", 2].support) == (0.0, 0.0, 0.0, 1)
    assert report["a", 1].precision == pytest.approx(1 / 3) and report["a", 1].recall == 1.0
    weighted = {r.model: r for r in ev.weighted_avg(ev.class_report(preds)).collect()}
    assert weighted["b"].recall == pytest.approx(0.75) and weighted["b"].support == 4


def test_best_rules(preds):
    acc = ev.accuracy(preds).withColumn("m", F.when(F.col("model") == "a", 0).otherwise(1)).withColumn("accuracy", F.lit(0.5))
    assert [r.best for r in ev.rank_models(acc).orderBy("m").collect()] == [True, True]
    assert [r.best for r in ev.rank_models(acc, ties="first").orderBy("m").collect()] == [True, False]


def test_report_json_reads_back(preds):
    for row in rs.report_json(preds).collect():
        value = json.loads(row.payload)
        assert set(value) == {"accuracy", "report"}
        assert {"macro avg", "weighted avg", "email"} <= set(value["report"])


def test_mixed_results(spark):
    raw = spark.createDataFrame([("A+B-c D", "0.5"), ("x", '{"accuracy": 0.25, "report": {"macro avg": {"precision": 1}}}'), ("y", '{"accuracy": 1}')], "model string, payload string")
    rows = {r.model: r for r in rs.read_results(raw).withColumn("p", F.try_variant_get("report", "$['macro avg'].precision", "double")).collect()}
    assert rows["A+B-c D"].accuracy == 0.5 and rows["A+B-c D"].bare and rows["A+B-c D"].image_path == "/reports/cm_a_b_c_d.png"
    assert rows["x"].p == 1.0 and rows["y"].accuracy == 1.0 and rows["y"].p is None


def test_upsert_keeps_others(spark):
    kind = "model string, accuracy double"
    old, new = spark.createDataFrame([("a", 0.1), ("b", 0.2)], kind), spark.createDataFrame([("b", 0.9), ("c", 0.3)], kind)
    once = rs.upsert_results(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", 0.1), ("b", 0.9), ("c", 0.3)}
    assert rs.upsert_results(once, new).exceptAll(once).count() == 0


def test_softmax_and_ties(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 1.0],), ([-5.0, 2.0, 2.0],)], "s array<double>")
    rows = df.select(softmax(F.col("s")).alias("p"), argmax(F.col("s")).alias("i")).collect()
    assert [r.i for r in rows] == [0, 1]
    assert all(sum(r.p) == pytest.approx(1) for r in rows) and rows[0].p[0] == pytest.approx(0.5)


def test_primary_takes_one_model_whole(spark):
    kind = "doc_id int, model string, label string, confidence double"
    rows = [(1, "Stacking", "letter", None), (1, "CNN", "invoice", 0.9), (2, "CNN", "email", 0.4), (3, "HOG+RF", "email", 0.4)]
    got = {r.doc_id: (r.label, r.confidence) for r in sc.primary(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("letter", None), 2: ("email", 0.4), 3: ("-", None)}


def test_repeated_and_unknown_predictions(spark):
    kind = "doc_id int, model string, label string, confidence double"
    rows = [
        (1, "CNN", "letter", 0.2), (1, "CNN", "email", 0.9), (1, "CNN", "letter", 0.3),  # the later class, its highest level
        (2, "Stacking", None, 0.5), (2, "CNN", "email", 0.9),  # a model without a class is still the model that counts
        (3, "other", "email", 0.9), (4, None, "email", 0.9), (5, "HOG+RF", "invoice", None), (5, "CNN", "email", float("nan")),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {r.doc_id: (r.label, r.confidence) for r in sc.primary(df).where("doc_id < 5").collect()}
    assert got == {1: ("letter", 0.3), 2: ("-", 0.5), 3: ("-", None), 4: ("-", None)}
    listed = {r.doc_id: [(p.model, p.label, str(p.confidence)) for p in r.predictions] for r in sc.ordered_predictions(df).collect()}
    assert listed == {
        1: [("CNN", "letter", "0.3")], 2: [("Stacking", None, "0.5"), ("CNN", "email", "0.9")],
        5: [("CNN", "email", "nan"), ("HOG+RF", "invoice", "None")],
    }
    for result in (sc.primary(df), sc.ordered_predictions(df)):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_meta_rows_without_a_member_are_null(spark):
    rows = [(1, m, [0.1, 0.2, 0.3, 0.4]) for m in ("svd_svm", "hog_svm", "hog_rf", "cnn")] + [(2, "cnn", [1.0, 0.0, 0.0, 0.0])]
    got = {r.doc_id: r.meta for r in sc.meta_features(spark.createDataFrame(rows, "doc_id int, model string, probs array<double>")).collect()}
    assert len(got[1]) == 16 and got[2] is None
