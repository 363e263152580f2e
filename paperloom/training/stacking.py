"""Fitting the members on train rows and the meta model on validation rows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import is_blank
from paperloom.operators.evaluation import accuracy, class_report
from paperloom.operators.scoring import meta_features
from paperloom.schemas import MEMBER_ORDER
from paperloom.sources.sinks import materialise
from paperloom.training import members as mb
from paperloom.training.prepare import HOG_SIZE, PIXEL_SIZE, SVD_COMPONENTS, fit_scaler, hog_vectors, pixel_vectors

TEXT_MEMBER = "text"
DISPLAY_NAME = {"svd_svm": "SVD+SVM", "hog_svm": "HOG+SVM", "hog_rf": "HOG+RF", "cnn": "CNN", TEXT_MEMBER: "DistilBERT-OCR"}
MARGIN_MEMBERS = ("svd_svm", "hog_svm")
PIXEL_MEMBERS = ("svd_svm", "cnn")


@dataclass
class Features:
    """Pixel and gradient vectors of the same images, each computed once and stored."""

    pixels: DataFrame
    hog: DataFrame

    def of(self, member: str) -> DataFrame:
        return self.pixels if member in PIXEL_MEMBERS else self.hog

    def where(self, split: str) -> "Features":
        return Features(self.pixels.where(F.col("split") == split), self.hog.where(F.col("split") == split))


def build_features(images: DataFrame, pixel_size: int = PIXEL_SIZE, hog_size: int = HOG_SIZE) -> Features:
    return Features(materialise(pixel_vectors(images, pixel_size)), materialise(hog_vectors(images, hog_size)))


def fit_member(name: str, features: Features, k: int = SVD_COMPONENTS) -> PipelineModel:
    train = features.where("train").of(name)
    if name == "svd_svm":
        return mb.train_svd_svm(train, k)
    if name == "hog_svm":
        return mb.train_hog_svm(train)
    if name == "hog_rf":
        return mb.train_hog_rf(train)
    if name == "cnn":
        return mb.train_pixel_net(train, features.where("validation").of(name), k)[0]
    raise ValueError(f"unknown member {name}")


def _long_scores(model: PipelineModel, name: str, df: DataFrame) -> DataFrame:
    """Arriving documents have no split or true class; both are null there."""
    absent = {c: F.lit(None).cast(t) for c, t in (("split", "string"), ("label", "int")) if c not in df.columns}
    scored = mb.score(model, df.withColumns(absent), name in MARGIN_MEMBERS)
    return scored.select("doc_id", "split", "label", F.lit(name).alias("model"), "probs", "y_pred", "confidence")


def text_scores(model: PipelineModel, docs: DataFrame, blank: bool = True) -> DataFrame:
    """Long scores of the text model on ``docs(doc_id, text)``, alike in form to :func:`member_scores`.

    A missing or blank text is scored as one space; with ``blank`` off such a document gets no row.
    """
    given = docs if blank else docs.where(~is_blank(F.col("text")))
    return _long_scores(model, TEXT_MEMBER, given)


def member_scores(models: dict[str, PipelineModel], features: Features) -> DataFrame:
    """Long scores ``(doc_id, split, label, model, probs, y_pred, confidence)`` of every model given.

    A member that was not trained is simply absent.
    """
    parts = [_long_scores(models[name], name, features.of(name)) for name in MEMBER_ORDER if name in models]
    if not parts:
        raise ValueError("no member has been trained")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def meta_vectors(scores: DataFrame) -> DataFrame:
    """Sixteen probabilities per document; documents that lack a member are set aside, and rows of other models, of which
    there may be many more, before they move."""
    meta = meta_features(scores.where(F.col("model").isin(*MEMBER_ORDER))).where(F.col("meta").isNotNull())
    return meta.withColumn("features", array_to_vector("meta")).drop("meta")


def train_stack(val_scores: DataFrame, c: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """Scale and multinomial logistic model on validation scores ``(doc_id, model, label, probs)``."""
    labels = val_scores.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = materialise(meta_vectors(val_scores).join(labels, "doc_id"))
    scaler = fit_scaler(rows, "features", "scaled")
    n = rows.count()
    meta = LogisticRegression(
        featuresCol="scaled", family="multinomial", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter
    )
    return PipelineModel([*scaler.stages, meta.fit(scaler.transform(rows))])


def predict_stack(stack: PipelineModel, scores: DataFrame) -> DataFrame:
    """Class and confidence of the meta model per document."""
    return mb.score(stack, meta_vectors(scores)).drop("features")


def predictions_long(scores: DataFrame, stacked: DataFrame) -> DataFrame:
    """All predictions under their display names, with ``split`` and the true class ``y_true`` that the evaluation reads.

    The meta model's rows take both from the document's first member; every document it scores has all members.
    """
    columns = ["doc_id", "split", "y_true", "model", "y_pred", "confidence"]
    names = F.coalesce(*[F.when(F.col("model") == k, F.lit(v)) for k, v in DISPLAY_NAME.items()])
    marked = scores.withColumn("y_true", F.col("label"))
    known = marked.where(F.col("model") == MEMBER_ORDER[0]).select("doc_id", "split", "y_true")
    meta = stacked.select("doc_id", F.lit("Stacking").alias("model"), "y_pred", "confidence").join(known, "doc_id")
    return marked.withColumn("model", names).select(*columns).unionByName(meta.select(*columns))


def validate(models: dict[str, PipelineModel], features: Features, split: str = "validation") -> DataFrame:
    """Accuracy and per-class report of each member on a split that it was not fitted on."""
    return evaluate(member_scores(models, features.where(split)))


def evaluate(scores: DataFrame, stack: PipelineModel | None = None) -> DataFrame:
    """Accuracy and per-class report of every model in the long scores, the text model included if its scores are, and of
    the meta model if given.  Scores are read several times: pass a stored table."""
    if stack is None:
        names = F.coalesce(*[F.when(F.col("model") == k, F.lit(v)) for k, v in DISPLAY_NAME.items()])
        long = scores.select("doc_id", names.alias("model"), F.col("label").alias("y_true"), "y_pred")
    else:
        long = predictions_long(scores, predict_stack(stack, scores))
    return class_report(long).join(accuracy(long), "model")


def all_predictions(
    models: dict[str, PipelineModel],
    features: Features,
    stack: PipelineModel | None = None,
    text_model: PipelineModel | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """What every fitted model says of arriving documents, ``(doc_id, model, y_pred, confidence)`` under display names.

    Each member scores once into a stored table that the meta model reads.  The text model speaks only of documents
    with a readable text, the meta model only of those that all members scored.
    """
    scores = member_scores(models, features)
    if text_model is not None and texts is not None:
        scores = scores.unionByName(text_scores(text_model, texts, blank=False))
    scores = materialise(scores)
    names = F.coalesce(*[F.when(F.col("model") == k, F.lit(v)) for k, v in DISPLAY_NAME.items()])
    long = scores.select("doc_id", names.alias("model"), "y_pred", "confidence")
    if stack is None:
        return long
    return long.unionByName(predict_stack(stack, scores).select("doc_id", F.lit("Stacking").alias("model"), "y_pred", "confidence"))
