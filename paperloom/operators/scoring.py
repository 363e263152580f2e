"""Choosing and listing a document's predictions; meta features of the stacking model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.labels import label_index, label_name
from paperloom.functions.vectors import argmax, confidence
from paperloom.schemas import DISPLAY_ORDER, LABEL_NAMES, MEMBER_ORDER, literal_array

NO_LABEL = "-"


def named_predictions(preds: DataFrame) -> DataFrame:
    """Long predictions with class names: ``(doc_id, model, label, confidence)``."""
    return preds.select("doc_id", "model", label_name(F.col("y_pred")).alias("label"), "confidence")


def _chosen(preds: DataFrame, models: tuple[str, ...]) -> tuple[DataFrame, list]:
    """Per document and model the largest (class, confidence), as structs of label and confidence, null where the model
    gave nothing; a prediction of no class comes before all classes.

    Class numbers and confidences are aggregated as plain numbers, a confidence per model and class, so the aggregation
    stays hashed and label and confidence are of one prediction.
    """
    number = F.coalesce(label_index(F.col("label")), F.lit(-1))
    known = preds.select("doc_id", F.array_position(literal_array(models), F.col("model")).cast("int").alias("_m"), number.alias("_c"), "confidence")
    classes = range(-1, len(LABEL_NAMES))
    numbers = [F.max(F.when(F.col("_m") == m, F.col("_c"))).alias(f"_c{m}") for m in range(1, len(models) + 1)]
    levels = [
        F.max(F.when((F.col("_m") == m) & (F.col("_c") == c), F.col("confidence"))).alias(f"_l{m}_{c + 1}")
        for m in range(1, len(models) + 1) for c in classes
    ]
    structs = []
    for m, model in enumerate(models, 1):
        level = F.get(F.array(*[f"_l{m}_{c + 1}" for c in classes]), F.col(f"_c{m}") + 1)
        given = F.struct(F.lit(model).alias("model"), label_name(F.col(f"_c{m}")).alias("label"), level.alias("confidence"))
        structs.append(F.when(F.col(f"_c{m}").isNotNull(), given))
    return known.groupBy("doc_id").agg(*numbers, *levels), structs


def primary(preds: DataFrame) -> DataFrame:
    """The stacking prediction, else the network's, else the label ``-`` without confidence.

    Label and confidence always belong to the same prediction.  Of repeated predictions of one model the last class in
    the class list counts, with its highest confidence.
    """
    rows, (stacked, network) = _chosen(preds, ("Stacking", "CNN"))
    return rows.select("doc_id", F.coalesce(stacked, network).alias("_p")).select(
        "doc_id",
        F.coalesce(F.col("_p.label"), F.lit(NO_LABEL)).alias("label"),
        F.col("_p.confidence").alias("confidence"),
    )


def ordered_predictions(preds: DataFrame) -> DataFrame:
    """Each document's predictions in display order; models that gave none are left out.

    One struct per (document, known model), so the list is bounded by the model list.
    """
    known = preds.where(F.array_contains(literal_array(DISPLAY_ORDER), F.col("model")))
    rows, structs = _chosen(known, tuple(DISPLAY_ORDER))
    return rows.select("doc_id", F.array_compact(F.array(*structs)).alias("predictions"))


def with_probabilities(scores: DataFrame, score_cols: list[str]) -> DataFrame:
    """Raw class scores in scalar columns to a probability vector column ``probs``.

    Scalar arithmetic keeps the softmax in generated code; the array is only built at the end.
    """
    top = F.greatest(*score_cols)
    powers = {f"_e{i}": F.exp(F.col(c) - top) for i, c in enumerate(score_cols)}
    total = sum((F.col(e) for e in list(powers)[1:]), F.col("_e0"))
    shifted = scores.withColumns(powers).withColumn("_z", total)
    return shifted.withColumn("probs", F.array(*[F.col(e) / F.col("_z") for e in powers])).drop("_z", *powers)


def best_class(df: DataFrame, vector_col: str = "probs") -> DataFrame:
    """Class number and confidence of the largest entry, first on ties."""
    v = F.col(vector_col)
    return df.withColumns({"y_pred": argmax(v), "confidence": confidence(v)})


def meta_features(probs: DataFrame, members: tuple[str, ...] = MEMBER_ORDER) -> DataFrame:
    """Side-by-side probabilities of the members in fixed order, ``(doc_id, meta)``.

    ``meta`` is null for a document that lacks a member; such rows are kept for the caller to set aside.
    Each probability is a number of its own in the aggregation, which thus stays hashed.
    """
    names = {f"_{m}_{i}": F.when(F.col("model") == m, F.get("probs", F.lit(i))) for m in members for i in range(len(LABEL_NAMES))}
    wide = probs.groupBy("doc_id").agg(*(F.max(value).alias(name) for name, value in names.items()))
    whole = reduce(lambda a, b: a & b, (F.col(name).isNotNull() for name in names))
    return wide.select("doc_id", F.when(whole, F.array(*names)).alias("meta"))


def class_probabilities(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id", "model")) -> DataFrame:
    """One row per class with its probability."""
    return df.select(*id_cols, F.posexplode("probs").alias("class_idx", "probability")).withColumn(
        "class_name", F.get(literal_array(LABEL_NAMES), F.col("class_idx"))
    )
