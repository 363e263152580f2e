"""Queries that run incremental jobs over tables that Spark has landed as files."""

from __future__ import annotations


from pyspark.sql import functions as F

from paperloom.operators.scoring import named_predictions, primary
from paperloom.plans.fixtures import load
from paperloom.plans.registry import query
from paperloom.plans.text import BLANK_CLASS, sql_fields
from paperloom.plans.training import NAMES, SURE, TEXT_PRED, text_model
from paperloom.schemas import FIELD_ORDER
from paperloom.session import shared_folder
from paperloom.streaming import incremental as inc


@query(
    "st_incremental_text",
    rf"SELECT doc_id, trim(regexp_replace(text, '{BLANK_CLASS}+', ' ', 'g')) AS text FROM documents",
)
def st_incremental_text(spark, sf):
    """Documents arrive in two loads that overlap; the table ends with each of them once."""
    folder = shared_folder(spark)
    docs = load(spark, sf, "documents").select("doc_id", "text")
    # Each load is four sets of files, of which a batch takes three; a set has as many files as the scan has tasks.
    tasks = docs.rdd.getNumPartitions()
    for part in (docs.where("doc_id % 3 <> 0"), docs):
        part.repartition(4 * tasks).write.mode("append").parquet(f"{folder}/in")
        stream = inc.arriving(spark, f"{folder}/in", docs.schema, 3 * tasks)
        inc.incremental_text(stream, f"{folder}/table", f"{folder}/progress", "doc_id")
    return inc.current_text(spark.read.parquet(f"{folder}/table"), "doc_id")


@query(
    "st_score",
    f"""SELECT s.doc_id, label_name AS label, true AS sure, invoice_number, invoice_date, due_date,
      issuer_line AS issuer_name, recipient_line AS recipient_name, total_amount
    FROM s JOIN {NAMES} ON s.y_pred = n.label LEFT JOIN f ON f.doc_id = s.doc_id""",
    ("doc_texts",),
    f"""s AS (SELECT doc_id, text, {TEXT_PRED} AS y_pred FROM doc_texts),
    f AS (SELECT doc_id, {sql_fields()} FROM s WHERE y_pred = 1)""",
)
def st_score(spark, sf):
    folder = shared_folder(spark)
    docs = load(spark, sf, "doc_texts").select("doc_id", "text")
    docs.write.parquet(f"{folder}/in")
    stream = inc.arriving(spark, f"{folder}/in", docs.schema)
    scored = inc.score_stream(stream, text_model(spark, sf))
    inc.append_files(scored, f"{folder}/out", f"{folder}/progress")
    out = spark.read.schema(scored.schema).parquet(f"{folder}/out")
    return out.selectExpr("doc_id", "label", SURE, *FIELD_ORDER)


@query(
    "st_extract",
    f"""SELECT p.doc_id, coalesce(n.label_name, '-') AS label, confidence, invoice_number, invoice_date, due_date,
      issuer_line AS issuer_name, recipient_line AS recipient_name, total_amount
    FROM best p LEFT JOIN (VALUES (0, 'email'), (1, 'invoice'), (2, 'letter'), (3, 'scientific_report')) AS n(label, label_name) ON p.y_pred = n.label
    LEFT JOIN f ON f.doc_id = p.doc_id""",
    ("predictions",),
    f"""best AS (SELECT d.doc_id, d.text, CASE WHEN bool_or(m = 4) THEN max(y_pred) FILTER (m = 4) ELSE max(y_pred) FILTER (m = 3) END AS y_pred,
      CASE WHEN bool_or(m = 4) THEN max(confidence) FILTER (m = 4) ELSE max(confidence) FILTER (m = 3) END AS confidence
      FROM doc_texts d LEFT JOIN predictions p ON d.doc_id = p.doc_id GROUP BY d.doc_id, d.text),
    f AS (SELECT doc_id, {sql_fields()} FROM best WHERE y_pred = 1)""",
)
def st_extract(spark, sf):
    """Arriving documents joined to a stored table of primary labels, then gated and extracted."""
    folder = shared_folder(spark)
    docs = load(spark, sf, "doc_texts").select("doc_id", "text")
    docs.write.parquet(f"{folder}/in")
    labels = primary(named_predictions(load(spark, sf, "predictions")))
    stream = inc.arriving(spark, f"{folder}/in", docs.schema)
    labelled = stream.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit("-")))
    out = inc.extract_labelled(labelled)
    inc.append_files(out, f"{folder}/out", f"{folder}/progress")
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
