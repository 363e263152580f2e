"""Model evaluation from long predictions ``(model, y_true, y_pred)``.

Predictions are reduced once to counts per (model, true, predicted) with map-side combining; every
report works on that small table, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.labels import label_name
from paperloom.functions.text import artifact_slug
from paperloom.schemas import LABEL_NAMES, RANDOM_BASELINE, literal_array

METRICS = ("precision", "recall", "f1-score", "support")


def outcome_counts(preds: DataFrame) -> DataFrame:
    return preds.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def accuracy(preds: DataFrame) -> DataFrame:
    """Share of right predictions per model."""
    return accuracy_of(outcome_counts(preds))


def accuracy_of(counts: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return counts.groupBy("model").agg((right / F.sum("n")).alias("accuracy"))


def confusion(preds: DataFrame) -> DataFrame:
    """Counts per true and predicted class, zeros shown, over the classes seen by that model."""
    counts = outcome_counts(preds)
    seen = counts.groupBy("model").agg(
        F.array_union(F.collect_set("y_true"), F.collect_set("y_pred")).alias("_classes")
    )
    cells = seen.withColumn("y_true", F.explode("_classes")).withColumn("y_pred", F.explode("_classes"))
    return cells.join(counts, ["model", "y_true", "y_pred"], "left").select(
        "model", "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_wide(preds: DataFrame) -> DataFrame:
    """Confusion matrix with one column per known class."""
    counts = outcome_counts(preds)
    columns = [
        F.coalesce(F.sum(F.when(F.col("y_pred") == i, F.col("n"))), F.lit(0)).alias(name)
        for i, name in enumerate(LABEL_NAMES)
    ]
    return counts.groupBy("model", "y_true").agg(*columns)


def _ratio(top, bottom):
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; zero where undefined."""
    counts = outcome_counts(preds)
    # Each cell counts once for its true class and once for its predicted class.
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("truth"), F.lit(0).cast("bigint").alias("guess"), hit.cast("bigint").alias("hit")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("guess"), F.lit(0).cast("bigint").alias("hit")),
    )
    # A missing prediction is a miss of its true class, not a class of its own.
    per_class = (
        counts.select("model", F.inline(sides))
        .where(F.col("label").isNotNull())
        .groupBy("model", "label")
        .agg(F.sum("truth").alias("truth"), F.sum("guess").alias("guess"), F.sum("hit").alias("hit"))
    )
    return per_class.select(
        "model",
        "label",
        label_name(F.col("label")).alias("label_name"),
        _ratio(F.col("hit"), F.col("guess")).alias("precision"),
        _ratio(F.col("hit"), F.col("truth")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("truth") + F.col("guess")).alias("f1"),
        F.col("truth").alias("support"),
    )


def macro_avg(report: DataFrame) -> DataFrame:
    """Unweighted mean over classes."""
    return report.groupBy("model").agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.sum("support").alias("support"),
    )


def weighted_avg(report: DataFrame) -> DataFrame:
    """Mean over classes weighted by support."""
    total = F.sum("support")
    means = [F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in ("precision", "recall", "f1")]
    return report.groupBy("model").agg(*means, total.alias("support"))


def rank_models(acc: DataFrame, order_col: str = "m", ties: str = "all") -> DataFrame:
    """Models by accuracy, best first, with a ``best`` flag.

    ``ties='all'`` flags every model that reaches the maximum; ``ties='first'`` only the first of
    them in input order.  One row per model, so the single window partition is tiny.
    """
    if ties not in ("all", "first"):
        raise ValueError("ties is 'all' or 'first'")
    by_accuracy = Window.orderBy(F.desc("accuracy"), order_col)
    best = (
        F.col("accuracy") == F.max("accuracy").over(Window.partitionBy())
        if ties == "all"
        else F.row_number().over(by_accuracy) == 1
    )
    return acc.select("*", F.row_number().over(by_accuracy).alias("place"), best.alias("best"))


def baseline_lift(acc: DataFrame) -> DataFrame:
    """Accuracy against the random line."""
    return acc.withColumns(
        {
            "baseline": F.lit(RANDOM_BASELINE),
            "lift": F.col("accuracy") - RANDOM_BASELINE,
            "above": F.col("accuracy") > RANDOM_BASELINE,
        }
    )


def report_long(preds: DataFrame) -> DataFrame:
    """Evaluation report as rows ``(model, entry, metric, value)`` with classes and both averages."""
    report = class_report(preds)

    def rows(df: DataFrame, entry):
        values = [
            ("precision", F.col("precision")),
            ("recall", F.col("recall")),
            ("f1-score", F.col("f1")),
            ("support", F.col("support").cast("double")),
        ]
        items = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values])
        return df.select("model", entry.alias("entry"), F.inline(items))

    return (
        rows(report, F.coalesce("label_name", F.concat(F.lit("label "), F.col("label").cast("string"))))
        .unionByName(rows(macro_avg(report), F.lit("macro avg")))
        .unionByName(rows(weighted_avg(report), F.lit("weighted avg")))
    )


def availability(models: DataFrame, preds: DataFrame) -> DataFrame:
    """Which models of the wanted list have predictions, and the rest as skipped."""
    present = preds.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))
    return models.join(present, "model", "left").select(
        "model",
        artifact_slug(F.col("model")).alias("slug"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.when(F.col("n_rows").isNull(), "skipped").otherwise("evaluated").alias("status"),
    )


def macro_series(results: DataFrame) -> DataFrame:
    """Per run and model: accuracy and macro averages, null when the report lacks them."""
    return results.select("run_id", "model", "accuracy", *[
        F.try_variant_get("report", f"$['macro avg']['{m}']", "double").alias(out)
        for m, out in (("precision", "macro_precision"), ("recall", "macro_recall"), ("f1-score", "macro_f1"))
    ])


def class_series(results: DataFrame) -> DataFrame:
    """Per run, model and class in fixed class order: precision, recall, F1; null when missing."""
    classes = results.select("run_id", "model", "report", F.posexplode(literal_array(LABEL_NAMES)).alias("class_idx", "class_name"))

    def metric(name: str):
        cases = F.coalesce(*[
            F.when(F.col("class_idx") == i, F.try_variant_get("report", f"$['{c}']['{name}']", "double"))
            for i, c in enumerate(LABEL_NAMES)
        ])
        return cases

    return classes.select(
        "run_id", "model", "class_idx", "class_name",
        metric("precision").alias("precision"), metric("recall").alias("recall"), metric("f1-score").alias("f1"),
    )
