"""Queries that locate field values on the page, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import boxes as bx
from paperloom.operators.flagship import classify_and_extract, score_and_extract
from paperloom.operators.scoring import named_predictions
from paperloom.plans.fixtures import load
from paperloom.plans.registry import query
from paperloom.plans import training as tr
from paperloom.plans.text import CHOSEN, FIELD_ROWS, ext_fields, sql_fields
from paperloom.schemas import FIELD_ORDER
from paperloom.sources.sinks import materialise

WORDS_SQL = r"""words AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS word_idx, text, x, y, w, h
  FROM (SELECT * REPLACE (regexp_replace(text, '^\s+|\s+$', '', 'g') AS text) FROM ocr_words WHERE conf > 0) s WHERE text <> '')"""


def _long(source: str, issuer: str, recipient: str) -> str:
    columns = {"issuer_name": issuer, "recipient_name": recipient}
    return "\n UNION ALL ".join(
        f"SELECT doc_id, {i} AS field_ord, '{name}' AS field, {columns.get(name, name)} AS value FROM {source}"
        for i, name in enumerate(FIELD_ORDER)
    )


def boxes_sql(source: str) -> str:
    """Anchors and spans of the fields in ``source``."""
    return rf"""{WORDS_SQL},
vals AS (SELECT *, left(regexp_extract_all(lower(value), '\S+')[1], 4) AS prefix,
    len(regexp_split_to_array(regexp_replace(value, '^\s+|\s+$', '', 'g'), '\s+')) AS n_words
  FROM ({_long(source, 'issuer_line', 'recipient_line')}) l WHERE regexp_matches(value, '\S')),
anchor AS (SELECT v.doc_id, field_ord, field, n_words, min(word_idx) AS word_idx
  FROM vals v JOIN words w ON v.doc_id = w.doc_id AND starts_with(lower(w.text), v.prefix) GROUP BY ALL),
span AS (SELECT a.doc_id, field_ord, field, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h
  FROM anchor a JOIN words w ON a.doc_id = w.doc_id AND w.word_idx BETWEEN a.word_idx AND a.word_idx + n_words + 1 GROUP BY ALL)"""


BOX_VIEWS = ("doc_texts", "ocr_words")
BOXES = f"{FIELD_ROWS}, {boxes_sql('f')}"
BOX_TEXT = "string_agg(concat(field, ':', x, ',', y, ',', w, ',', h), ';' ORDER BY field_ord)"


def _located(spark, sf):
    return bx.locate_fields(materialise(ext_fields(spark, sf)), load(spark, sf, "ocr_words"))


def _box_text(column: str = "boxes"):
    parts = F.transform(
        column, lambda b: F.concat(b.field, F.lit(":"), F.concat_ws(",", b.x, b.y, b.w, b.h))
    )
    return F.array_join(parts, ";")


@query("box_words", "SELECT * FROM words", ("ocr_words",), WORDS_SQL)
def box_words(spark, sf):
    return bx.word_boxes(load(spark, sf, "ocr_words"))


@query("box_anchor", "SELECT * FROM anchor", BOX_VIEWS, BOXES)
def box_anchor(spark, sf):
    return bx.anchors(_located(spark, sf))


@query("box_span", "SELECT * FROM span", BOX_VIEWS, BOXES)
def box_span(spark, sf):
    return bx.span_boxes(_located(spark, sf))


@query(
    "box_list",
    f"""SELECT d.doc_id, count(s.doc_id) AS n_boxes, coalesce({BOX_TEXT} FILTER (field IS NOT NULL), '') AS boxes
    FROM doc_texts d LEFT JOIN span s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
    BOX_VIEWS,
    BOXES,
)
def box_list(spark, sf):
    docs = load(spark, sf, "doc_texts").select("doc_id")
    lists = bx.box_lists(docs, bx.span_boxes(_located(spark, sf)))
    return lists.select("doc_id", F.size("boxes").alias("n_boxes"), _box_text().alias("boxes"))


RECORDS_SQL = f"""f AS (SELECT doc_id, {sql_fields('chosen')} FROM (SELECT doc_id, {CHOSEN} AS chosen FROM best WHERE y_pred = 1) c),
{boxes_sql('f')},
listed AS (SELECT doc_id, {BOX_TEXT} AS boxes FROM span GROUP BY doc_id)"""
FLAGSHIP_SQL = f"""best AS (SELECT d.doc_id, d.pdf_text, d.ocr_text,
    CASE WHEN p.has_stack THEN p.stack_pred WHEN p.has_cnn THEN p.cnn_pred END AS y_pred,
    CASE WHEN p.has_stack THEN p.stack_conf WHEN p.has_cnn THEN p.cnn_conf END AS confidence
  FROM doc_texts d LEFT JOIN (SELECT doc_id, bool_or(m = 4) AS has_stack, bool_or(m = 3) AS has_cnn,
    max(y_pred) FILTER (m = 4) AS stack_pred, max(confidence) FILTER (m = 4) AS stack_conf,
    max(y_pred) FILTER (m = 3) AS cnn_pred, max(confidence) FILTER (m = 3) AS cnn_conf FROM predictions GROUP BY doc_id) p
  ON d.doc_id = p.doc_id),
{RECORDS_SQL}"""


@query(
    "sc_classify_extract",
    """SELECT b.doc_id, coalesce(n.label_name, '-') AS label, confidence, invoice_number, invoice_date, due_date,
      issuer_line AS issuer_name, recipient_line AS recipient_name, total_amount, coalesce(boxes, '') AS boxes
    FROM best b LEFT JOIN (VALUES (0, 'email'), (1, 'invoice'), (2, 'letter'), (3, 'scientific_report')) AS n(label, label_name) ON b.y_pred = n.label
    LEFT JOIN f ON f.doc_id = b.doc_id LEFT JOIN listed l ON l.doc_id = b.doc_id""",
    ("predictions", "ocr_words"),
    FLAGSHIP_SQL,
)
def sc_classify_extract(spark, sf):
    docs = load(spark, sf, "doc_texts").select("doc_id", "ocr_text", "pdf_text")
    preds = named_predictions(load(spark, sf, "predictions"))
    records = classify_and_extract(docs, preds, load(spark, sf, "ocr_words"))
    return records.withColumn("boxes", _box_text())


@query(
    "sc_score_extract",
    f"""SELECT b.doc_id, coalesce(n.label_name, '-') AS label, CASE WHEN b.y_pred IS NOT NULL THEN true END AS sure,
      concat_ws(';', 'Stacking=' || n.label_name, 'DistilBERT-OCR=' || t.label_name, 'CNN=' || n.label_name, 'SVD+SVM=' || n.label_name,
        'HOG+SVM=' || n.label_name, 'HOG+RF=' || n.label_name) AS said,
      invoice_number, invoice_date, due_date, issuer_line AS issuer_name, recipient_line AS recipient_name, total_amount, coalesce(boxes, '') AS boxes
    FROM best b LEFT JOIN {tr.NAMES} ON b.y_pred = n.label LEFT JOIN {tr.NAMES.replace('n(', 't(')} ON b.t_pred = t.label
    LEFT JOIN f ON f.doc_id = b.doc_id LEFT JOIN listed l ON l.doc_id = b.doc_id""",
    ("class_images", "ocr_words"),
    rf"""best AS (SELECT d.doc_id, d.pdf_text, d.ocr_text, i.label AS y_pred,
      CASE WHEN d.ocr_text = 'unreadable' THEN 1 WHEN regexp_matches(d.ocr_text, '\S') THEN d.label END AS t_pred
      FROM doc_texts d LEFT JOIN class_images i ON i.doc_id = d.doc_id),
    {RECORDS_SQL}""",
)
def sc_score_extract(spark, sf):
    """From fitted models to records.  Documents without an image are known to the text model alone."""
    docs = load(spark, sf, "doc_texts").select("doc_id", "ocr_text", "pdf_text")
    records = score_and_extract(
        docs, tr.features(spark, sf), load(spark, sf, "ocr_words"), tr.members(spark, sf), tr.stack(spark, sf), tr.text_model(spark, sf)
    )
    said = F.transform("predictions", lambda p: F.concat(p.model, F.lit("="), p.label))
    shown = records.withColumns({"said": F.array_join(said, ";"), "boxes": _box_text()})
    return shown.selectExpr("doc_id", "label", tr.SURE, "said", *FIELD_ORDER, "boxes")
