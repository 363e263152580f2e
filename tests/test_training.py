import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from paperloom.operators import evaluation as ev
from paperloom.training import history as hi
from paperloom.training import members as mb
from paperloom.training import prepare as pr
from paperloom.training import stacking as st


@pytest.fixture(scope="module")
def features(spark):
    """Four classes told apart by which quarter of the image is bright."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(160):
        label = i % 4
        img = rng.integers(0, 60, (8, 8))
        r, c = divmod(label, 2)
        img[r * 4 : r * 4 + 4, c * 4 : c * 4 + 4] += 150
        rows.append((i, "train" if i < 100 else "validation" if i < 130 else "test", label, 8, 8, img.ravel().tolist()))
    images = spark.createDataFrame(rows, "doc_id int, split string, label int, width int, height int, px array<int>")
    return st.build_features(images, 8, 32)


@pytest.fixture(scope="module")
def models(features):
    return {
        "svd_svm": mb.train_svd_svm(features.where("train").pixels, 16, outputs=64, max_iter=10),
        "hog_svm": mb.train_hog_svm(features.where("train").hog, max_iter=10),
        "hog_rf": mb.train_hog_rf(features.where("train").hog, trees=10, depth=4),
        "cnn": mb.train_pixel_net(features.where("train").pixels, features.where("validation").pixels, 16, rounds=2, iterations=15)[0],
    }


def test_members_and_stack(spark, features, models, tmp_path):
    scores = st.member_scores(models, features)
    accuracy = {r.model: r.a for r in scores.where("split = 'test'").groupBy("model").agg(F.avg((F.col("y_pred") == F.col("label")).cast("double")).alias("a")).collect()}
    assert set(accuracy) == {"svd_svm", "hog_svm", "hog_rf", "cnn"} and min(accuracy.values()) > 0.7
    assert scores.where("model in ('svd_svm', 'hog_svm') and confidence is not null").count() == 0
    stack = st.train_stack(scores.where("split = 'validation'"))
    test = scores.where("split = 'test'")
    stacked = st.predict_stack(stack, test).join(test.select("doc_id", "label").distinct(), "doc_id")
    assert stacked.count() == 30 and stacked.where("y_pred = label").count() >= 28
    long = st.predictions_long(test, st.predict_stack(stack, test))
    assert long.groupBy("model").count().where("count = 30").count() == 5 and long.where("split <> 'test' or y_true is null").count() == 0
    assert {r.model: r.accuracy for r in ev.accuracy(long).collect()}["Stacking"] >= 28 / 30
    for name, model in models.items():
        path = str(tmp_path / name)
        model.write().save(path)
        before = mb.score(model, features.of(name), name in st.MARGIN_MEMBERS).select("doc_id", "y_pred")
        after = mb.score(PipelineModel.load(path), features.of(name), name in st.MARGIN_MEMBERS).select("doc_id", "y_pred")
        assert before.exceptAll(after).count() == 0
    assert {r.model for r in st.member_scores({"cnn": models["cnn"]}, features).select("model").distinct().collect()} == {"cnn"}


def test_scaling_uses_the_population(spark):
    df = spark.createDataFrame([(1, [1.0, 7.0]), (2, [2.0, 7.0]), (3, [6.0, 7.0])], "id int, a array<double>").select("id", array_to_vector("a").alias("features"))
    got = np.array([r.s for r in pr.standardise(df).orderBy("id").select(vector_to_array("scaled").alias("s")).collect()])
    x = np.array([1.0, 2.0, 6.0])
    assert got[:, 0] == pytest.approx((x - x.mean()) / x.std()) and (got[:, 1] == 0).all()


def test_svd_gives_the_best_low_rank_form(spark):
    x = np.random.default_rng(3).normal(size=(40, 6)) @ np.diag([9, 5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(row.tolist(),) for row in x], "a array<double>").select(array_to_vector("a").alias("features"))
    v = pr.truncated_svd(df, 2).weights
    top = np.linalg.svd(x)[2][:2]
    assert np.abs(v @ top.T) == pytest.approx(np.eye(2), abs=1e-6)
    assert len(pr.truncated_svd(df, 200).weights) == 6


def test_svd_of_a_wide_table_of_low_rank(spark):
    """The range finder sees fewer directions than columns: rank 5 of 60, in rows on several tasks, one of them missing."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 5)) @ np.diag([8, 4, 2, 1, 0.5]) @ np.linalg.qr(rng.normal(size=(60, 5)))[0].T
    df = spark.createDataFrame([(row.tolist(),) for row in x] + [(None,)], "a array<double>").repartition(7)
    df = df.select(F.when(F.col("a").isNotNull(), array_to_vector("a")).alias("features"))
    top = np.linalg.svd(x)[2]
    v = pr.truncated_svd(df, 3).weights
    assert v.shape == (3, 60) and np.abs(v @ top[:3].T) == pytest.approx(np.eye(3), abs=1e-8)
    assert len(pr.truncated_svd(df, 40).weights) == 5  # no more than the rank
    with pytest.raises(ValueError):
        pr.truncated_svd(df.where("features is null"), 3)


def test_svd_with_a_long_tail(spark):
    """Where the rank is full, passes turn the directions to the leading vectors."""
    rng = np.random.default_rng(5)
    values = np.r_[[9.0, 7.0, 5.0], np.linspace(1, 0.1, 57)]
    x = np.linalg.qr(rng.normal(size=(80, 60)))[0] * values @ np.linalg.qr(rng.normal(size=(60, 60)))[0].T
    df = spark.createDataFrame([(row.tolist(),) for row in x], "a array<double>").select(array_to_vector("a").alias("features"))
    v = pr.truncated_svd(df, 3).weights
    assert np.abs(v @ np.linalg.svd(x)[2][:3].T) == pytest.approx(np.eye(3), abs=1e-4)


def test_text_model_among_the_members(spark, features, models):
    """Its scores are evaluated beside the others'; a blank text is scored for the report and left out of what is served."""
    words = ("mail", "bill", "dear", "abstract")
    labelled = features.pixels.select("doc_id", "split", "label")
    texts = labelled.withColumn("text", F.get(F.array(*map(F.lit, words)), F.col("label")))
    text = mb.train_text(texts.where("split = 'train'"), buckets=1024)
    scores = st.member_scores(models, features).unionByName(st.text_scores(text, texts))
    stack = st.train_stack(scores.where("split = 'validation'"))
    report = st.evaluate(scores.where("split = 'test'"), stack).collect()
    assert {r.model for r in report} == {"SVD+SVM", "HOG+SVM", "HOG+RF", "CNN", "DistilBERT-OCR", "Stacking"}
    assert {r.accuracy for r in report if r.model == "DistilBERT-OCR"} == {1.0} and sum(r.support for r in report) == 6 * 30
    held = st.validate(models, features).collect()
    assert len(held) == 16 and {r.model for r in held} == {"SVD+SVM", "HOG+SVM", "HOG+RF", "CNN"}
    assert {r.support for r in held} == {7, 8}

    arriving = st.Features(features.pixels.where("doc_id < 8").drop("split", "label"), features.hog.where("doc_id < 8").drop("split", "label"))
    shown = texts.where("doc_id < 10").select("doc_id", F.when(F.col("doc_id") != 3, F.col("text")).alias("text"))
    said = st.all_predictions(models, arriving, stack, text, shown).collect()
    assert {r.doc_id for r in said if r.model == "DistilBERT-OCR"} == set(range(10)) - {3}
    assert {r.doc_id for r in said if r.model == "Stacking"} == set(range(8)) and len(said) == 8 * 5 + 9


def test_fourier_features_approach_the_kernel():
    fm = mb.fourier_map(3, 0.5, 20000, "a", "b")
    x, y = np.array([0.1, 0.2, 0.3]), np.array([0.5, -0.2, 0.0])
    z = [np.sqrt(2 / 20000) * np.cos(fm.weights @ v + fm.offset) for v in (x, y)]
    assert z[0] @ z[1] == pytest.approx(np.exp(-0.5 * ((x - y) ** 2).sum()), abs=0.02)


def test_weights_balance(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    assert {r.label: r.weight for r in pr.class_weights(df).collect()} == {0: 8 / 12, 1: 2.0}
    assert pr.with_class_weight(df).agg(F.sum("weight")).first()[0] == pytest.approx(8)


def test_first_best_epoch(spark):
    rows = [(1, 1, 0.5), (1, 2, 0.7), (1, 3, 0.7), (2, 1, 0.0), (3, 5, 0.1)]
    got = {r.run_id: r.epoch for r in hi.best_epoch(spark.createDataFrame(rows, "run_id int, epoch int, val_acc double")).collect()}
    assert got == {1: 2, 3: 5}


def test_log_of_the_network(spark, features):
    """The log's last validation row is what the kept model gives, where it is the best one."""
    train, val = features.where("train").pixels, features.where("validation").pixels
    model, log = mb.train_pixel_net(train, val, 16, rounds=3, iterations=3)
    rows = {(r.epoch, r.phase): r for r in hi.epoch_metrics(log.withColumn("run_id", F.lit("net"))).collect()}
    assert set(rows) == {(e, p) for e in (1, 2, 3) for p in ("train", "val")}
    assert {(r.phase, r.n) for r in log.collect()} == {("train", train.count()), ("val", val.count())}
    best = hi.best_epoch(hi.epoch_metrics(log.withColumn("run_id", F.lit("net"))).where("phase = 'val'").withColumnRenamed("accuracy", "val_acc")).first()
    scored = mb.score(model, val).select("label", "probs", "y_pred").collect()
    assert best.val_acc == pytest.approx(np.mean([r.label == r.y_pred for r in scored]), abs=1e-4)
    assert rows[best.epoch, "val"].loss == pytest.approx(-np.mean([np.log(r.probs[r.label]) for r in scored]), abs=1e-4)


def test_text_model_reads_whole_texts(spark):
    long = "noise " * 400
    rows = [(i, long + word, label) for i in range(30) for word, label in (("apple", 0), ("pear", 1))] + [(99, " ", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, label int")
    whole = mb.score(mb.train_text(docs, buckets=1024), docs)
    assert whole.where("doc_id < 99 and y_pred <> label").count() == 0
    cut = mb.score(mb.train_text(docs, max_tokens=256, buckets=1024), docs)
    assert cut.where("doc_id < 99").select("y_pred").distinct().count() == 1


def test_rows_of_other_models_do_not_reach_the_meta_features(spark, monkeypatch):
    probs = [0.1, 0.2, 0.3, 0.4]
    rows = [(1, m, probs) for m in st.MEMBER_ORDER] + [(d, st.TEXT_MEMBER, probs) for d in (1, 2, 3)]
    seen, real = [], st.meta_features
    monkeypatch.setattr(st, "meta_features", lambda df: seen.append(df) or real(df))
    got = st.meta_vectors(spark.createDataFrame(rows, "doc_id int, model string, probs array<double>")).collect()
    assert [(r.doc_id, list(r.features)) for r in got] == [(1, probs * 4)]
    assert {r.model for r in seen[0].collect()} == set(st.MEMBER_ORDER)


def test_fits_read_stored_rows(spark, monkeypatch):
    """Texts are cut once for all passes of a fit, and the network's rows are mapped once for all rounds."""
    stored, real = [], mb.materialise
    monkeypatch.setattr(mb, "materialise", lambda df: stored.append(df) or real(df))
    texts = spark.createDataFrame([("red apple", 0), ("blue sea", 1), (" ", 1), (None, 0)] * 4, "text string, label int")
    model = mb.train_text(texts, buckets=64)
    assert stored[0].columns == ["tf", "label"] and stored[0].count() == 8
    got = {r.text: r.y_pred for r in mb.score(model, texts).collect()}
    assert got["red apple"] == 0 and got["blue sea"] == 1
    images = spark.createDataFrame([([float(i % 4 == k) + i / 999 for k in range(4)], i % 4) for i in range(40)], "x array<double>, label int")
    vectors = images.select("label", array_to_vector("x").alias("features"))
    _, log = mb.train_pixel_net(vectors, vectors, 4, 4, rounds=2, iterations=3)
    assert len(stored) == 2 and stored[1].count() == 80 and log.count() == 4


def test_a_dense_map_passes_on_parts(spark, monkeypatch):
    from paperloom.training import dense_map as dm

    sizes = []
    monkeypatch.setattr(dm.F, "pandas_udf", lambda kind: lambda fn: sizes.append(fn) or F.udf(lambda x: x, kind))
    stage = dm.DenseMap(np.ones((2, 3)))
    stage.transform(spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(array_to_vector("x").alias("features")))
    batch = pd.Series([np.array([i, 1.0, 2.0]) for i in range(dm.CHUNK * 2 + 5)])
    parts = list(sizes[0](iter([batch])))
    assert [len(p) for p in parts] == [dm.CHUNK, dm.CHUNK, 5] and list(parts[2].iloc[4]) == [dm.CHUNK * 2 + 7.0] * 2


def test_a_table_that_is_multiplied_is_dealt_to_tasks(spark, tmp_path, monkeypatch):
    from paperloom.plans import fixtures as fx
    from paperloom.plans.training import ml_epoch_metrics

    spark.range(50).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(fx, "ROWS_A_TASK", 1000)
    for name, made, tasks in (("train_batches", 200, 10), ("train_history", 20, 1)):
        view = fx.load(spark, str(tmp_path), name)
        assert view.count() == 50 * made and view.rdd.getNumPartitions() == tasks
    assert ml_epoch_metrics(spark, str(tmp_path)).count() == 50 * 40
