"""Queries that fit, save and apply models.

Fitted models are kept per session and data folder, as several queries read the same ones.  The classes of their inputs
are far apart, so a sound model answers with the true class and the checking SQL says so; a blank text tells the text
model nothing, and it answers with the commonest class.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from paperloom.functions.labels import label_name
from paperloom.operators.scoring import named_predictions
from paperloom.plans.evaluation import ACC_SQL, REPORT_SQL
from paperloom.plans.fixtures import load
from paperloom.plans.registry import query
from paperloom.session import shared_folder
from paperloom.sources.sinks import materialise
from paperloom.training import history as hi
from paperloom.training import members as mb
from paperloom.training import prepare as pr
from paperloom.training import stacking as st

# The stand-in images are 8×8, so features are taken at small sizes; the library's defaults are 64 and 128.
PIXEL_SIZE, HOG_SIZE, COMPONENTS = 8, 32, 32
RANK = 16

_FITTED: dict = {}


def _kept(spark, sf, what, make):
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def features(spark, sf) -> st.Features:
    return _kept(spark, sf, "features", lambda: st.build_features(load(spark, sf, "class_images"), PIXEL_SIZE, HOG_SIZE))


def member(spark, sf, name) -> PipelineModel:
    return _kept(spark, sf, name, lambda: st.fit_member(name, features(spark, sf), COMPONENTS))


def members(spark, sf) -> dict[str, PipelineModel]:
    return {m: member(spark, sf, m) for m in st.MEMBER_ORDER}


def scores(spark, sf):
    """Scores of every member and of the text model, stored."""

    def make():
        texts = st.text_scores(text_model(spark, sf), load(spark, sf, "doc_texts").select("doc_id", "split", "label", "text"))
        return materialise(st.member_scores(members(spark, sf), features(spark, sf)).unionByName(texts))

    return _kept(spark, sf, "scores", make)


def stack(spark, sf) -> PipelineModel:
    return _kept(spark, sf, "stack", lambda: st.train_stack(scores(spark, sf).where("split = 'validation'")))


def text_model(spark, sf) -> PipelineModel:
    return _kept(spark, sf, "text", lambda: mb.train_text(load(spark, sf, "doc_texts").where("split = 'train'")))


@query("ml_class_weight", "SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM doc_images GROUP BY label", ("doc_images",))
def ml_class_weight(spark, sf):
    return pr.class_weights(load(spark, sf, "doc_images")).withColumn("weight", F.round("weight", 9))


@query(
    "ml_standardise",
    """SELECT doc_id, p, round(CASE WHEN s = 0 THEN 0 ELSE (px - m) / s END, 6) AS z FROM (
      SELECT doc_id, p, px, avg(px) OVER (PARTITION BY p) AS m, stddev_pop(px) OVER (PARTITION BY p) AS s FROM doc_pixels) t""",
    ("doc_pixels",),
)
def ml_standardise(spark, sf):
    vectors = load(spark, sf, "doc_images").select("doc_id", array_to_vector(F.col("px").cast("array<double>")).alias("features"))
    rows = pr.standardise(vectors).select("doc_id", F.posexplode(vector_to_array("scaled")).alias("p", "z"))
    return rows.withColumn("z", F.round("z", 6))


# Sixty-four columns made of multiples of sixteen: with sixteen components, projecting back gives all of them.
@query(
    "ml_svd",
    f"SELECT doc_id, p + {RANK} * m AS p, px * (m + 1) AS px FROM doc_pixels CROSS JOIN (SELECT CAST(unnest(range(0, 4)) AS INT) AS m) c WHERE p < {RANK}",
    ("doc_pixels",),
)
def ml_svd(spark, sf):
    multiples = F.expr(f"flatten(transform(sequence(1, 4), m -> transform(slice(px, 1, {RANK}), v -> CAST(v * m AS DOUBLE))))")
    # read once for each pass of the range finder
    vectors = materialise(load(spark, sf, "doc_images").select("doc_id", array_to_vector(multiples).alias("features")))
    svd = pr.truncated_svd(vectors, RANK)
    back = st.mb.DenseMap(svd.weights.T, inputCol="reduced", outputCol="back")
    restored = back.transform(svd.transform(vectors))
    return restored.select("doc_id", F.posexplode(vector_to_array("back")).alias("p", "v")).select(
        "doc_id", "p", F.round("v").cast("int").alias("px")
    )


def _member_rows(spark, sf, name):
    scored = mb.score(member(spark, sf, name), features(spark, sf).of(name), name in st.MARGIN_MEMBERS)
    # Probabilities of a fit aren't known beforehand; that they add up to one is.
    total = F.round(F.aggregate("probs", F.lit(0.0), lambda a, p: a + p), 6).alias("p_total")
    return scored.select("doc_id", "split", F.col("label").alias("y_true"), "y_pred", total)


IMAGES = ("class_images",)
MEMBER_SQL = "SELECT doc_id, split, label AS y_true, label AS y_pred, 1.0::DOUBLE AS p_total FROM class_images"
IMAGE_MODELS = "(VALUES ('svd_svm', 'SVD+SVM', false), ('hog_svm', 'HOG+SVM', false), ('hog_rf', 'HOG+RF', true), ('cnn', 'CNN', true)) AS v(model, shown, sure)"
TEXT_PRED = "CASE WHEN label = 0 THEN 1 ELSE label END"
NAMES = "(VALUES (0, 'email'), (1, 'invoice'), (2, 'letter'), (3, 'scientific_report')) AS n(label, label_name)"
# A model without confidence has none; the answer of one that has is more likely than all others together.
SURE = "confidence > 0.5 AS sure"
SURE_SQL = "CASE WHEN v.sure THEN true END AS sure"


@query("ml_svd_svm", MEMBER_SQL, IMAGES)
def ml_svd_svm(spark, sf):
    return _member_rows(spark, sf, "svd_svm")


@query("ml_hog_svm", MEMBER_SQL, IMAGES)
def ml_hog_svm(spark, sf):
    return _member_rows(spark, sf, "hog_svm")


@query("ml_hog_rf", MEMBER_SQL, IMAGES)
def ml_hog_rf(spark, sf):
    return _member_rows(spark, sf, "hog_rf")


@query("ml_pixel_net", MEMBER_SQL, IMAGES)
def ml_pixel_net(spark, sf):
    return _member_rows(spark, sf, "cnn")


@query("ml_text_clf", f"SELECT doc_id, split, label AS y_true, {TEXT_PRED} AS y_pred, true AS sure FROM doc_texts", ("doc_texts",))
def ml_text_clf(spark, sf):
    docs = load(spark, sf, "doc_texts").select("doc_id", "split", "text", "label")
    return mb.score(text_model(spark, sf), docs).selectExpr("doc_id", "split", "label AS y_true", "y_pred", SURE)


@query("ml_text_quality")
def ml_text_quality(spark, sf):
    """The same text model on the given documents, with their quality mark as the class."""
    docs = load(spark, sf, "documents").select("doc_id", "text").join(load(spark, sf, "labels"), "doc_id")
    model = _kept(spark, sf, "quality", lambda: mb.train_text(docs, label_col="quality"))
    return mb.score(model, docs.select("doc_id", "text", "quality")).select("doc_id", "quality", "y_pred", "confidence")


@query("ml_stack_fit", "SELECT doc_id, label AS y_true, label AS y_pred, true AS sure FROM class_images WHERE split = 'validation'", IMAGES)
def ml_stack_fit(spark, sf):
    held = scores(spark, sf).where("split = 'validation'")
    labels = held.groupBy("doc_id").agg(F.max("label").alias("y_true"))
    return st.predict_stack(stack(spark, sf), held).join(labels, "doc_id").selectExpr("doc_id", "y_true", "y_pred", SURE)


@query(
    "sc_base_predict",
    f"""SELECT doc_id, v.shown AS model, label_name AS label, {SURE_SQL} FROM class_images i CROSS JOIN {IMAGE_MODELS} JOIN {NAMES} ON i.label = n.label
    UNION ALL SELECT doc_id, 'DistilBERT-OCR', n.label_name, true FROM (SELECT doc_id, {TEXT_PRED} AS y FROM doc_texts) t JOIN {NAMES} ON t.y = n.label""",
    ("class_images", "doc_texts"),
)
def sc_base_predict(spark, sf):
    long = scores(spark, sf)
    named = F.coalesce(*[F.when(F.col("model") == k, F.lit(v)) for k, v in st.DISPLAY_NAME.items()])
    shown = long.withColumns({"model": named, "label": label_name(F.col("y_pred"))})
    return shown.selectExpr("doc_id", "model", "label", SURE)


@query(
    "sc_stack_predict",
    f"SELECT doc_id, 'Stacking' AS model, label_name AS label, true AS sure FROM class_images i JOIN {NAMES} ON i.label = n.label",
    IMAGES,
)
def sc_stack_predict(spark, sf):
    long = scores(spark, sf)
    stacked = st.predict_stack(stack(spark, sf), long)
    rows = named_predictions(st.predictions_long(long, stacked)).where("model = 'Stacking'")
    return rows.selectExpr("doc_id", "model", "label", SURE)


@query(
    "ml_validate",
    f"""SELECT v.shown AS model, i.label, label_name, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, count(*) AS support
    FROM class_images i CROSS JOIN {IMAGE_MODELS} JOIN {NAMES} ON i.label = n.label WHERE split = 'validation' GROUP BY ALL""",
    IMAGES,
)
def ml_validate(spark, sf):
    """Report of the fitted members on the split that none of them learned from."""
    return st.validate(members(spark, sf), features(spark, sf))


@query(
    "ml_evaluate",
    f"SELECT r.model, r.label, label_name, accuracy, precision, recall, f1, support FROM report r JOIN acc ON r.model = acc.model LEFT JOIN {NAMES} ON r.label = n.label",
    ("class_images", "doc_texts"),
    f"""answers AS (SELECT model, label AS y_true, label AS y_pred, 0 AS m FROM class_images
        CROSS JOIN (VALUES ('SVD+SVM'), ('HOG+SVM'), ('HOG+RF'), ('CNN'), ('Stacking')) AS v(model) WHERE split = 'test'
      UNION ALL SELECT 'DistilBERT-OCR', label, {TEXT_PRED}, 0 FROM doc_texts WHERE split = 'test'), """
    + f"{REPORT_SQL}, {ACC_SQL}".replace("FROM predictions", "FROM answers"),
)
def ml_evaluate(spark, sf):
    """Test report of every fitted model: members, text model and meta model."""
    return st.evaluate(scores(spark, sf).where("split = 'test'"), stack(spark, sf))


@query("sink_models", f"SELECT doc_id, v.model, label AS y_pred, {SURE_SQL} FROM class_images CROSS JOIN {IMAGE_MODELS}", IMAGES)
def sink_models(spark, sf):
    """Save and load the members; predictions of the loaded ones."""
    folder = shared_folder(spark)
    loaded = {}
    for name in st.MEMBER_ORDER:
        member(spark, sf, name).write().overwrite().save(f"{folder}/{name}")
        loaded[name] = PipelineModel.load(f"{folder}/{name}")
    return st.member_scores(loaded, features(spark, sf)).selectExpr("doc_id", "model", "y_pred", SURE)


@query(
    "ml_best_epoch",
    "SELECT run_id, epoch, val_acc FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY val_acc DESC, epoch) AS r FROM train_history WHERE val_acc > 0) t WHERE r = 1",
    ("train_history",),
)
def ml_best_epoch(spark, sf):
    return hi.best_epoch(load(spark, sf, "train_history"))


@query(
    "ml_epoch_metrics",
    "SELECT run_id, epoch, phase, round(sum(loss * n) / sum(n), 4) AS loss, round(sum(correct) / sum(n), 4) AS accuracy FROM train_batches GROUP BY ALL",
    ("train_batches",),
)
def ml_epoch_metrics(spark, sf):
    return hi.epoch_metrics(load(spark, sf, "train_batches"))


@query("ml_lr_schedule", "SELECT run_id, epoch, val_acc, round(0.001::DOUBLE * (1 + cos(pi() * (epoch - 1) / 20)) / 2, 12) AS lr FROM train_history", ("train_history",))
def ml_lr_schedule(spark, sf):
    return hi.cosine_lr(load(spark, sf, "train_history")).withColumn("lr", F.round("lr", 12))
