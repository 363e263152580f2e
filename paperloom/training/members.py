"""The base models.  Each trainer returns one saved-and-loadable pipeline that scores vectors.

Differences from textbook forms, for scale: the radial kernel is approximated by random Fourier
features under a linear machine (Rahimi & Recht 2007), one-against-rest margins stand for
one-against-one votes, and the network member works on reduced pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import is_blank
from paperloom.functions.vectors import argmax, softmax
from paperloom.schemas import LABEL_NAMES
from paperloom.sources.sinks import materialise
from paperloom.training.dense_map import DenseMap
from paperloom.training.prepare import SEED, SVD_COMPONENTS, fit_scaler, truncated_svd, with_class_weight

FOURIER_FEATURES = 512
RF_TREES = 200
RF_DEPTH = 30  # the limit of the library
TEXT_BUCKETS = 1 << 16


def _balanced_svm(df: DataFrame, features_col: str, c: float, max_iter: int):
    """One linear machine per class on balanced rows; ``1/(C n)`` is the matching penalty."""
    n = df.count()
    svm = LinearSVC(
        featuresCol=features_col, weightCol="weight", regParam=1.0 / (c * n), maxIter=max_iter, standardization=False
    )
    # The machines of all classes are fitted at the same time, sharing one stored input.
    rest = OneVsRest(classifier=svm, featuresCol=features_col, weightCol="weight", parallelism=len(LABEL_NAMES))
    return rest.fit(with_class_weight(df))


def fourier_map(width: int, gamma: float, outputs: int, input_col: str, output_col: str) -> DenseMap:
    """Random features whose inner products approach ``exp(-gamma |x - y|^2)``."""
    rng = np.random.default_rng(SEED)
    weights = rng.normal(scale=np.sqrt(2 * gamma), size=(outputs, width))
    return DenseMap(weights, rng.uniform(0, 2 * np.pi, outputs), True, input_col, output_col)


def train_svd_svm(train: DataFrame, k: int = SVD_COMPONENTS, c: float = 10.0, outputs: int = FOURIER_FEATURES, max_iter: int = 50) -> PipelineModel:
    """Pixels → truncated SVD → scale → radial kernel machine."""
    svd = truncated_svd(train, k)
    reduced = svd.transform(train)
    scaler = fit_scaler(reduced, "reduced", "scaled")
    # The scaled columns have variance one, so the kernel width "scale" is one over their number.
    width = len(svd.weights)
    waves = fourier_map(width, 1.0 / width, outputs, "scaled", "waves")
    prepared = waves.transform(scaler.transform(reduced)).select("label", "waves")
    return PipelineModel([svd, *scaler.stages, waves, _balanced_svm(prepared, "waves", c, max_iter)])


def train_hog_svm(train: DataFrame, c: float = 1.0, max_iter: int = 50) -> PipelineModel:
    """Gradient features → scale → linear machine."""
    scaler = fit_scaler(train, "features", "scaled")
    prepared = scaler.transform(train).select("label", "scaled")
    return PipelineModel([*scaler.stages, _balanced_svm(prepared, "scaled", c, max_iter)])


def train_hog_rf(train: DataFrame, trees: int = RF_TREES, depth: int = RF_DEPTH) -> PipelineModel:
    """Gradient features → scale → random forest on balanced rows.

    Trees grow as deep as the library allows; an executor holds whole trees, so lower ``depth`` where memory is short.
    """
    scaler = fit_scaler(train, "features", "scaled")
    forest = RandomForestClassifier(
        featuresCol="scaled", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=SEED, weightCol="weight"
    )
    prepared = with_class_weight(scaler.transform(train)).select("label", "scaled", "weight")
    return PipelineModel([*scaler.stages, forest.fit(prepared)])


def train_pixel_net(
    train: DataFrame, val: DataFrame, k: int = SVD_COMPONENTS, hidden: int = 64, rounds: int = 5, iterations: int = 20
) -> tuple[PipelineModel, DataFrame]:
    """Reduced pixels → multilayer network, kept at its first best validation accuracy.

    Each round goes on from the weights of the round before.  Returns the pipeline and the log of the rounds: one row
    per round and phase as `history.epoch_metrics` takes it (``epoch, phase, n, loss, correct``), the loss being the
    mean negative log of the true class's probability.
    """
    svd = truncated_svd(train, k)
    scaler = fit_scaler(svd.transform(train), "reduced", "scaled")
    head = [svd, *scaler.stages]
    layers = [len(svd.weights), hidden, len(LABEL_NAMES)]
    phases = train.withColumn("phase", F.lit("train")).unionByName(val.withColumn("phase", F.lit("val")))
    # every round passes over the rows, which are mapped once
    sets = materialise(PipelineModel(head).transform(phases).select("label", "scaled", "phase"))
    prepared = sets.where("phase = 'train'").drop("phase")
    best, best_accuracy, weights, log = None, 0.0, None, []
    for step in range(1, rounds + 1):
        net = MultilayerPerceptronClassifier(featuresCol="scaled", layers=layers, maxIter=iterations, seed=SEED)
        if weights is not None:
            net = net.setInitialWeights(weights)
        model = net.fit(prepared)
        weights = model.weights
        right = (F.col("prediction") == F.col("label")).cast("bigint")
        true = F.get(vector_to_array("probability"), F.col("label").cast("int"))
        totals = model.transform(sets).groupBy("phase").agg(
            F.count(F.lit(1)).alias("n"), F.avg(-F.log(F.greatest(true, F.lit(1e-12)))).alias("loss"), F.sum(right).alias("correct")
        )
        found = {r["phase"]: r for r in totals.collect()}
        log += [(step, phase, r["n"], r["loss"], r["correct"]) for phase, r in sorted(found.items())]
        accuracy = found["val"]["correct"] / found["val"]["n"] if "val" in found else 0.0
        if best is None or accuracy > best_accuracy:
            best, best_accuracy = model, accuracy
    history = train.sparkSession.createDataFrame(log, "epoch int, phase string, n bigint, loss double, correct bigint")
    return PipelineModel([*head, best]), history


def train_text(train: DataFrame, max_tokens: int | None = None, buckets: int = TEXT_BUCKETS, label_col: str = "label") -> PipelineModel:
    """Text only: hashed term weights under a logistic model, on rows that have text.

    Whole texts are read; ``max_tokens`` keeps the first tokens only, as a fixed-length model would.
    """
    tokens = RegexTokenizer(inputCol="shown", outputCol="tokens", pattern=r"(?U)\W+")
    cut = f"slice(tokens, 1, {max_tokens})" if max_tokens else "tokens"
    head = [
        # a missing text is scored as a blank one
        SQLTransformer(statement="SELECT *, coalesce(text, ' ') AS shown FROM __THIS__"),
        tokens,
        SQLTransformer(statement=f"SELECT *, {cut} AS kept FROM __THIS__"),
        HashingTF(inputCol="kept", outputCol="tf", numFeatures=buckets),
    ]
    given = train.where(~is_blank(F.col("text"))).select("text", label_col)
    # Both fits pass over the rows, so texts are read and cut once and their counts stored.
    counted = materialise(PipelineModel(head).transform(given).select("tf", label_col))
    weights = IDF(inputCol="tf", outputCol="tfidf").fit(counted)
    linear = LogisticRegression(featuresCol="tfidf", labelCol=label_col, regParam=0.01, maxIter=30)
    return PipelineModel([*head, weights, linear.fit(weights.transform(counted))])


def score(model: PipelineModel, df: DataFrame, margins: bool = False) -> DataFrame:
    """Add ``probs``, ``y_pred`` and ``confidence``.

    A margin model has no confidence; its margins go through a softmax to serve as meta features.
    """
    scored = model.transform(df)
    if margins:
        probs = softmax(vector_to_array("rawPrediction"))
        level = F.lit(None).cast("double")
    else:
        probs = vector_to_array("probability")
        level = F.round(F.array_max(probs), 4)
    extra = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn("probs", probs).withColumns({"y_pred": argmax(F.col("probs")), "confidence": level}).drop(*extra)
