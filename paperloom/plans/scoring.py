"""Queries on scores and predictions that need no fitted model."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.labels import label_name
from paperloom.operators import scoring as sc
from paperloom.plans.fixtures import load
from paperloom.plans.registry import query
from paperloom.schemas import MEMBER_ORDER

S = ("base_scores",)
SCORE_COLS = ["s0", "s1", "s2", "s3"]
PROB_SQL = """top AS (SELECT *, greatest(s0, s1, s2, s3) AS hi FROM base_scores),
prob AS (SELECT doc_id, m, model, hi, s0, s1, s2, s3, exp(s0 - hi) / z AS p0, exp(s1 - hi) / z AS p1, exp(s2 - hi) / z AS p2, exp(s3 - hi) / z AS p3,
    CASE hi WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 3 END AS y_pred
  FROM (SELECT *, exp(s0 - hi) + exp(s1 - hi) + exp(s2 - hi) + exp(s3 - hi) AS z FROM top) t)"""
NAMES = "(VALUES (0, 'email'), (1, 'invoice'), (2, 'letter'), (3, 'scientific_report')) AS n(label, label_name)"


def _probs(spark, sf):
    return sc.with_probabilities(load(spark, sf, "base_scores"), SCORE_COLS)


@query("sc_softmax", "SELECT doc_id, model, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM prob", S, PROB_SQL)
def sc_softmax(spark, sf):
    return _probs(spark, sf).select("doc_id", "model", *[F.round(F.get("probs", F.lit(i)), 6).alias(f"p{i}") for i in range(4)])


@query("sc_argmax", "SELECT doc_id, model, y_pred, round(greatest(p0, p1, p2, p3), 4) AS confidence FROM prob", S, PROB_SQL)
def sc_argmax(spark, sf):
    return sc.best_class(_probs(spark, sf)).select("doc_id", "model", "y_pred", "confidence")


@query(
    "sc_meta_features",
    "SELECT doc_id, " + ", ".join(f"round(max(p{i % 4}) FILTER (m = {i // 4}), 6) AS f{i}" for i in range(16)) + " FROM prob GROUP BY doc_id",
    S,
    PROB_SQL,
)
def sc_meta_features(spark, sf):
    meta = sc.meta_features(_probs(spark, sf), MEMBER_ORDER)
    return meta.select("doc_id", *[F.round(F.get("meta", F.lit(i)), 6).alias(f"f{i}") for i in range(16)])


@query(
    "sc_class_probs",
    f"""SELECT doc_id, model, class_idx, label_name AS class_name, round(p, 6) AS probability
    FROM (SELECT doc_id, model, 0 AS class_idx, p0 AS p FROM prob UNION ALL SELECT doc_id, model, 1, p1 FROM prob
      UNION ALL SELECT doc_id, model, 2, p2 FROM prob UNION ALL SELECT doc_id, model, 3, p3 FROM prob) x JOIN {NAMES} ON class_idx = n.label""",
    S,
    PROB_SQL,
)
def sc_class_probs(spark, sf):
    return sc.class_probabilities(_probs(spark, sf)).withColumn("probability", F.round("probability", 6))


PRIMARY_SQL = """best AS (SELECT doc_id,
    CASE WHEN bool_or(m = 4) THEN max(y_pred) FILTER (m = 4) ELSE max(y_pred) FILTER (m = 3) END AS y_pred,
    CASE WHEN bool_or(m = 4) THEN max(confidence) FILTER (m = 4) ELSE max(confidence) FILTER (m = 3) END AS confidence
  FROM predictions GROUP BY doc_id)"""


@query(
    "sc_primary",
    f"SELECT doc_id, coalesce(label_name, '-') AS label, confidence FROM best LEFT JOIN {NAMES} ON y_pred = n.label",
    ("predictions",),
    PRIMARY_SQL,
)
def sc_primary(spark, sf):
    return sc.primary(sc.named_predictions(load(spark, sf, "predictions")))


@query(
    "sc_ordered_list",
    f"""SELECT doc_id, count(*) AS n_models, string_agg(concat(model, '=', label_name, '@', coalesce(CAST(CAST(round(confidence * 100) AS INT) AS STRING), '-')), ';'
      ORDER BY CASE m WHEN 4 THEN 0 WHEN 3 THEN 2 ELSE m + 3 END) AS listed
    FROM predictions JOIN {NAMES} ON y_pred = n.label GROUP BY doc_id""",
    ("predictions",),
)
def sc_ordered_list(spark, sf):
    lists = sc.ordered_predictions(sc.named_predictions(load(spark, sf, "predictions")))
    shown = F.transform(
        "predictions",
        lambda p: F.concat(
            p.model, F.lit("="), p.label, F.lit("@"),
            F.coalesce(F.round(p.confidence * 100).cast("int").cast("string"), F.lit("-")),
        ),
    )
    return lists.select("doc_id", F.size("predictions").alias("n_models"), F.array_join(shown, ";").alias("listed"))


@query(
    "flt_decode_label",
    f"SELECT doc_id, model, a.label_name AS true_name, b.label_name AS pred_name FROM predictions LEFT JOIN {NAMES.replace('n(', 'a(')} ON y_true = a.label LEFT JOIN {NAMES.replace('n(', 'b(')} ON y_pred = b.label",
    ("predictions",),
)
def flt_decode_label(spark, sf):
    return load(spark, sf, "predictions").select(
        "doc_id", "model", label_name(F.col("y_true")).alias("true_name"), label_name(F.col("y_pred")).alias("pred_name")
    )
