"""Queries on predictions and result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import evaluation as ev
from paperloom.plans.fixtures import load
from paperloom.plans.registry import query
from paperloom.sources import results as rs

P = ("predictions",)

REPORT_SQL = """report AS (
  SELECT model, label, CASE WHEN g = 0 THEN 0.0 ELSE CAST(hit AS DOUBLE) / g END AS precision,
    CASE WHEN t = 0 THEN 0.0 ELSE CAST(hit AS DOUBLE) / t END AS recall,
    CASE WHEN t + g = 0 THEN 0.0 ELSE CAST(2 * hit AS DOUBLE) / (t + g) END AS f1, t AS support
  FROM (SELECT model, label, sum(t) AS t, sum(g) AS g, sum(hit) AS hit FROM (
      SELECT model, y_true AS label, 1 AS t, 0 AS g, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS hit FROM predictions
      UNION ALL SELECT model, y_pred, 0, 1, 0 FROM predictions) s GROUP BY model, label) c)"""
NAMES = "(VALUES (0, 'email'), (1, 'invoice'), (2, 'letter'), (3, 'scientific_report')) AS n(label, label_name)"
ACC_SQL = "acc AS (SELECT model, min(m) AS m, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM predictions GROUP BY model)"


def _preds(spark, sf):
    return load(spark, sf, "predictions")


def _accuracy(spark, sf):
    """Accuracy with the model's place in the input order."""
    preds = _preds(spark, sf)
    counts = preds.groupBy("model", "m", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return counts.groupBy("model").agg(F.min("m").alias("m"), (right / F.sum("n")).alias("accuracy"))


@query("ev_accuracy", "SELECT model, accuracy FROM acc", P, ACC_SQL)
def ev_accuracy(spark, sf):
    return ev.accuracy(_preds(spark, sf))


@query(
    "ev_confusion",
    """SELECT a.model, a.y AS y_true, b.y AS y_pred, count(p.doc_id) AS n
    FROM (SELECT model, y_true AS y FROM predictions UNION SELECT model, y_pred FROM predictions) a
    JOIN (SELECT model, y_true AS y FROM predictions UNION SELECT model, y_pred FROM predictions) b ON a.model = b.model
    LEFT JOIN predictions p ON p.model = a.model AND p.y_true = a.y AND p.y_pred = b.y GROUP BY ALL""",
    P,
)
def ev_confusion(spark, sf):
    return ev.confusion(_preds(spark, sf))


@query(
    "ev_confusion_wide",
    """SELECT model, y_true, count(*) FILTER (y_pred = 0) AS email, count(*) FILTER (y_pred = 1) AS invoice,
      count(*) FILTER (y_pred = 2) AS letter, count(*) FILTER (y_pred = 3) AS scientific_report
    FROM predictions GROUP BY model, y_true""",
    P,
)
def ev_confusion_wide(spark, sf):
    return ev.confusion_wide(_preds(spark, sf))


@query("ev_report", f"SELECT model, report.label, label_name, precision, recall, f1, support FROM report LEFT JOIN {NAMES} ON report.label = n.label", P, REPORT_SQL)
def ev_report(spark, sf):
    return ev.class_report(_preds(spark, sf))


def _rounded(df):
    return df.select("model", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "ev_macro",
    "SELECT model, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, sum(support) AS support FROM report GROUP BY model",
    P,
    REPORT_SQL,
)
def ev_macro(spark, sf):
    return _rounded(ev.macro_avg(ev.class_report(_preds(spark, sf))))


@query(
    "ev_weighted",
    """SELECT model, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall,
      round(sum(f1 * support) / sum(support), 6) AS f1, sum(support) AS support FROM report GROUP BY model""",
    P,
    REPORT_SQL,
)
def ev_weighted(spark, sf):
    return _rounded(ev.weighted_avg(ev.class_report(_preds(spark, sf))))


@query(
    "ev_rank",
    """SELECT model, m, accuracy, row_number() OVER (ORDER BY accuracy DESC, m) AS place,
      accuracy = max(accuracy) OVER () AS best, row_number() OVER (ORDER BY accuracy DESC, m) = 1 AS first_best FROM acc""",
    P,
    ACC_SQL,
)
def ev_rank(spark, sf):
    acc = _accuracy(spark, sf)
    first = ev.rank_models(acc, ties="first").select("model", F.col("best").alias("first_best"))
    return ev.rank_models(acc).join(first, "model")


@query("ev_baseline_lift", "SELECT model, accuracy, 0.25::DOUBLE AS baseline, accuracy - 0.25 AS lift, accuracy > 0.25 AS above FROM acc", P, ACC_SQL)
def ev_baseline_lift(spark, sf):
    return ev.baseline_lift(ev.accuracy(_preds(spark, sf)))


@query(
    "ml_val_report",
    f"""SELECT r.model, r.label, label_name, accuracy, precision, recall, f1, support FROM report r
    JOIN acc ON r.model = acc.model LEFT JOIN {NAMES} ON r.label = n.label""",
    P,
    "held AS (SELECT * FROM predictions WHERE split = 'validation'), "
    + f"{REPORT_SQL}, {ACC_SQL}".replace("FROM predictions", "FROM held"),
)
def ml_val_report(spark, sf):
    held_out = _preds(spark, sf).where(F.col("split") == "validation")
    return ev.class_report(held_out).join(ev.accuracy(held_out), "model")


@query(
    "ev_skip_missing",
    """SELECT w.model, replace(replace(lower(w.model), ' ', '_'), '+', '_') AS slug, count(p.doc_id) AS n_rows,
      CASE WHEN count(p.doc_id) = 0 THEN 'skipped' ELSE 'evaluated' END AS status
    FROM (SELECT DISTINCT model FROM predictions UNION SELECT DISTINCT model FROM results_raw) w
    LEFT JOIN predictions p ON p.model = w.model GROUP BY w.model""",
    ("predictions", "results_raw"),
)
def ev_skip_missing(spark, sf):
    preds = _preds(spark, sf)
    wanted = preds.select("model").union(load(spark, sf, "results_raw").select("model")).distinct()
    return ev.availability(wanted, preds)


R = ("results_raw",)
SLUG_SQL = "replace(replace(replace(lower(model), ' ', '_'), '+', '_'), '-', '_')"
PARSED = f"""parsed AS (SELECT run_id, ord, model, payload,
  CASE WHEN payload LIKE '{{%' THEN CAST(json_extract(payload, '$.accuracy') AS DOUBLE) ELSE CAST(payload AS DOUBLE) END AS accuracy,
  coalesce(json_extract_string(payload, '$.confusion_matrix_image'), concat('/reports/cm_', {SLUG_SQL}, '.png')) AS image_path,
  payload NOT LIKE '{{%' AS bare FROM results_raw)"""


def _results(spark, sf):
    return rs.read_results(load(spark, sf, "results_raw"))


@query(
    "src_results_mixed",
    """SELECT run_id, ord, model, accuracy, image_path, bare,
      CAST(json_extract_string(payload, '$.report."macro avg".precision') AS DOUBLE) AS macro_precision FROM parsed""",
    R,
    PARSED,
)
def src_results_mixed(spark, sf):
    precision = F.try_variant_get("report", "$['macro avg'].precision", "double").alias("macro_precision")
    return _results(spark, sf).select("run_id", "ord", "model", "accuracy", "image_path", "bare", precision)


@query(
    "ev_series_macro",
    """SELECT run_id, model, accuracy, CAST(json_extract_string(payload, '$.report."macro avg".precision') AS DOUBLE) AS macro_precision,
      CAST(json_extract_string(payload, '$.report."macro avg".recall') AS DOUBLE) AS macro_recall,
      CAST(json_extract_string(payload, '$.report."macro avg"."f1-score"') AS DOUBLE) AS macro_f1 FROM parsed""",
    R,
    PARSED,
)
def ev_series_macro(spark, sf):
    return ev.macro_series(_results(spark, sf))


@query(
    "ev_series_class",
    f"""SELECT run_id, model, n.label AS class_idx, n.label_name AS class_name,
      CAST(json_extract_string(payload, concat('$.report.', n.label_name, '.precision')) AS DOUBLE) AS precision,
      CAST(json_extract_string(payload, concat('$.report.', n.label_name, '.recall')) AS DOUBLE) AS recall,
      CAST(json_extract_string(payload, concat('$.report.', n.label_name, '."f1-score"')) AS DOUBLE) AS f1
    FROM parsed CROSS JOIN {NAMES}""",
    R,
    PARSED,
)
def ev_series_class(spark, sf):
    return ev.class_series(_results(spark, sf))


@query("ev_artifact_slug", f"SELECT run_id, model, replace(replace(lower(model), ' ', '_'), '+', '_') AS slug, {SLUG_SQL} AS page_slug FROM results_raw", R)
def ev_artifact_slug(spark, sf):
    return load(spark, sf, "results_raw").select(
        "run_id", "model", tx.artifact_slug(F.col("model")).alias("slug"), tx.dashboard_slug(F.col("model")).alias("page_slug")
    )


# New entries: each run's own stacking accuracy and a network entry.
NEW_SQL = """fresh AS (SELECT run_id, 'Stacking' AS model, CAST(50 + run_id % 50 AS DOUBLE) / 100 AS accuracy FROM results_raw WHERE ord = 3
  UNION ALL SELECT run_id, 'CNN', CAST(40 + run_id % 60 AS DOUBLE) / 100 FROM results_raw WHERE ord = 3)"""


@query(
    "sink_results",
    """SELECT run_id, model, accuracy FROM parsed p
      WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.run_id = p.run_id AND f.model = p.model)
    UNION ALL SELECT * FROM fresh""",
    R,
    f"{PARSED}, {NEW_SQL}",
)
def sink_results(spark, sf):
    from paperloom.sources.sinks import write_and_read

    old = _results(spark, sf).select("run_id", "model", "accuracy")
    runs = load(spark, sf, "results_raw").where("ord = 3").select("run_id")
    stacking = runs.selectExpr("run_id", "'Stacking' AS model", "CAST(50 + run_id % 50 AS DOUBLE) / 100 AS accuracy")
    net = runs.selectExpr("run_id", "'CNN' AS model", "CAST(40 + run_id % 60 AS DOUBLE) / 100 AS accuracy")
    return write_and_read(rs.upsert_results(old, stacking.unionByName(net), ("run_id", "model")))


@query(
    "sink_report_json",
    f"""SELECT acc.model, acc.accuracy, r.precision AS invoice_precision, r.support AS invoice_support, round(a.f1, 6) AS macro_f1
    FROM acc JOIN report r ON r.model = acc.model AND r.label = 1
    JOIN (SELECT model, avg(f1) AS f1 FROM report GROUP BY model) a ON a.model = acc.model""",
    P,
    f"{REPORT_SQL}, {ACC_SQL}",
)
def sink_report_json(spark, sf):
    from paperloom.sources.sinks import write_and_read

    written = write_and_read(rs.report_json(_preds(spark, sf)), "json")
    v = F.parse_json("payload")
    return written.select(
        "model",
        F.variant_get(v, "$.accuracy", "double").alias("accuracy"),
        F.variant_get(v, "$.report.invoice.precision", "double").alias("invoice_precision"),
        F.variant_get(v, "$.report.invoice.support", "double").cast("bigint").alias("invoice_support"),
        F.round(F.variant_get(v, "$.report['macro avg']['f1-score']", "double"), 6).alias("macro_f1"),
    )
