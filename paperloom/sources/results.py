"""The evaluation results file: values that are numbers or objects, upserts, nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import dashboard_slug
from paperloom.operators.evaluation import accuracy, report_long


def read_results(raw: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Parse a column of JSON values that are a bare accuracy or an object per model.

    Gives ``accuracy``, ``report`` (variant, null when absent) and ``image_path``, which is made
    from the model name when the value does not carry one.
    """
    value = F.parse_json(payload_col)
    parsed = raw.withColumn("_v", value).withColumn("_bare", F.try_variant_get("_v", "$", "double"))
    given_path = F.nullif(F.try_variant_get("_v", "$.confusion_matrix_image", "string"), F.lit(""))
    own_path = F.concat(F.lit("/reports/cm_"), dashboard_slug(F.col("model")), F.lit(".png"))
    return parsed.select(
        *[c for c in raw.columns if c != payload_col],
        F.coalesce("_bare", F.try_variant_get("_v", "$.accuracy", "double")).alias("accuracy"),
        F.try_variant_get("_v", "$.report", "variant").alias("report"),
        F.coalesce(given_path, own_path).alias("image_path"),
        F.col("_bare").isNotNull().alias("bare"),
    )


def upsert_results(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """New entries replace old ones of the same key, all others stay."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def report_json(preds: DataFrame) -> DataFrame:
    """One JSON object per model: accuracy and the nested report.

    The lists gathered per model hold classes times metrics, not documents.
    """
    entries = report_long(preds).groupBy("model", "entry").agg(
        F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("metrics")
    )
    listed = F.array_sort(F.collect_list(F.struct("entry", "metrics")))
    named = F.transform(listed, lambda e: F.struct(e.entry, F.map_from_entries(e.metrics)))
    reports = entries.groupBy("model").agg(F.map_from_entries(named).alias("report"))
    payload = F.to_json(F.struct("accuracy", "report"))
    return reports.join(accuracy(preds), "model").select("model", payload.alias("payload"))
