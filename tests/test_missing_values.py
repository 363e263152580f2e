"""Rows with missing or odd values stay, with a defined result."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import images as im
from paperloom.operators.evaluation import class_report
from paperloom.operators.profile import pixel_histogram
from paperloom.operators.ranking import number_in_group
from paperloom.sources.corpus import read_text_lines
from paperloom.sources.results import report_json
from paperloom.streaming import incremental as inc
from paperloom.training.members import score, train_text


def test_missing_text_is_scored(spark):
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", i % 2) for i in range(20)]
    model = train_text(spark.createDataFrame(rows, "doc_id int, text string, label int"))
    got = score(model, spark.createDataFrame([(1, None), (2, ""), (3, "alpha")], "doc_id int, text string")).collect()
    assert len(got) == 3 and {r.doc_id: r.y_pred for r in got}[3] == 1


def test_text_that_comes_later_fills_the_table(spark, tmp_path):
    for text in (None, "late"):
        spark.createDataFrame([("a", text), ("b", "now")], "path string, text string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = inc.arriving(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        inc.incremental_text(stream, f"{tmp_path}/table", f"{tmp_path}/progress")
    got = dict(map(tuple, inc.current_text(spark.read.parquet(f"{tmp_path}/table")).collect()))
    assert got == {"a": "late", "b": "now"}


def test_report_of_unknown_labels_and_missing_predictions(spark):
    rows = [("m", 0, 0), ("m", 7, 8), ("m", 8, 8), ("m", 1, None)]
    preds = spark.createDataFrame(rows, "model string, y_true int, y_pred int")
    report = {r.label: r for r in class_report(preds).collect()}
    assert set(report) == {0, 1, 7, 8} and report[1].recall == 0 and report[1].support == 1
    entries = json.loads(report_json(preds).first().payload)["report"]
    assert {"label 7", "label 8", "macro avg"} <= set(entries)


def test_images_without_size_stay(spark):
    px = [10] * 32 + [200] * 32
    rows = [(1, 8, 8, px), (2, None, 8, px), (3, 8, 8, None), (4, 0, 0, [])]
    df = spark.createDataFrame(rows, "doc_id int, width int, height int, px array<int>")
    got = {r.doc_id: r.threshold for r in im.otsu(df).collect()}
    assert got[1] is not None and [got[i] for i in (2, 3, 4)] == [None] * 3
    hist = pixel_histogram(df.select(F.lit(0).alias("label"), "px"))
    assert hist.count() > 0
    with pytest.raises(Exception, match="levels must lie"):
        im.otsu(spark.createDataFrame([(1, 1, 1, [300])], df.schema)).collect()


def test_broken_cache_lines_are_told(spark, tmp_path):
    lines = ['{"seq": 1, "path": "a", "label": 0, "label_name": "email", "text": "x"}', "{broken", '{"seq": 2, "path": "b", "label": "no"}']
    (tmp_path / "c.json").write_text("\n".join(lines))
    got = read_text_lines(spark, str(tmp_path)).collect()
    assert len(got) == 3 and sum(r.broken is not None for r in got) == 2


def test_numbers_need_no_dense_order(spark):
    rows = spark.range(5000).select(F.lit("one").alias("g"), F.xxhash64("id").alias("o"))
    got = number_in_group(rows, ["g"], ["o"]).orderBy("o").collect()
    assert [r.pos for r in got] == list(range(5000))
