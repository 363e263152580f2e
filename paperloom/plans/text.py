"""Queries on text: cleaning, choice of source, field extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import extraction as ex
from paperloom.plans.fixtures import load
from paperloom.plans.registry import query
from paperloom.schemas import FIELD_ORDER

# White space of every kind for the checking engine, whose own class is ASCII.
BLANK_CLASS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The labels and value shapes are those of the library; only flags and look-aheads differ between the dialects.
ANY_CASE, ANY_CASE_LINES = "(?i)", "(?im)"
SQL_DATE = ANY_CASE + r"\b(?:" + "|".join(tx.DATE_FORMS) + r")\b"


def sql_strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def sql_first(e: str, pattern: str) -> str:
    """First match's first group, or null."""
    return f"regexp_extract_all({e}, '{pattern}', 1)[1]"


def spelt(pattern: str) -> str:
    """The classes of white space and word characters and the closing word boundary, which are ASCII in the checking
    engine, spelt out."""
    pattern = pattern.replace(tx.BLANKS, BLANK_CLASS[1:-1]).replace(r"[\w", r"[\p{L}\p{M}\p{N}_")
    return pattern[:-2] + r"(?:[^\p{L}\p{M}\p{N}_]|$)" if pattern.endswith(r")\b") else pattern


def sql_fields(text: str = "text") -> str:
    """The extraction as columns over one text column, for the checking engine."""
    dates = f"regexp_extract_all({text}, '{SQL_DATE}', 0)"
    inv_window = sql_first(text, ANY_CASE + spelt(tx.INVOICE_DATE_LABEL) + "(.{1,30})")
    due_window = sql_first(text, ANY_CASE + spelt(tx.DUE_DATE_LABEL) + "(.{1,40})")
    numbers = [
        ANY_CASE + spelt(tx.INVOICE_LABEL + tx.NUMBER_TOKEN),
        ANY_CASE + spelt(tx.BILL_LABEL + tx.NUMBER_TOKEN),
        ANY_CASE + spelt(tx.HASH_NUMBER),
    ]
    totals = [ANY_CASE_LINES + spelt(tx.TOTAL_LABEL + tx.TOTAL_AMOUNT), ANY_CASE_LINES + spelt(tx.LINE_END_AMOUNT)]
    issuer = sql_first(text, ANY_CASE + spelt(tx.ISSUER_LABEL) + "(.+)")
    recipient = sql_first(text, ANY_CASE + spelt(tx.RECIPIENT_LABEL) + "(.+)")
    return f"""coalesce({", ".join(sql_first(text, p) for p in numbers)}) AS invoice_number,
  coalesce(regexp_extract_all({inv_window}, '{SQL_DATE}', 0)[1], {dates}[1]) AS invoice_date,
  CASE WHEN {due_window} IS NOT NULL
    THEN coalesce(regexp_extract_all({due_window}, '{SQL_DATE}', 0)[1], left({sql_strip(due_window)}, 30))
    ELSE {dates}[2] END AS due_date,
  left({sql_strip(issuer)}, 60) AS issuer_line,
  left({sql_strip(recipient)}, 60) AS recipient_line,
  coalesce({", ".join(sql_strip(sql_first(text, p)) for p in totals)}) AS total_amount"""


# Entity roles as expressions over one document's entities.
ROLES_SQL = """roles AS (SELECT doc_id,
    coalesce(max(CASE WHEN ent_label = 'ORG' AND nth = 1 THEN ent_text END), max(CASE WHEN ent_label = 'PERSON' AND nth = 1 THEN ent_text END)) AS issuer_name,
    coalesce(max(CASE WHEN ent_label = 'ORG' AND nth = 2 THEN ent_text END), max(CASE WHEN ent_label = 'PERSON' AND nth = 2 THEN ent_text END)) AS recipient_name
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ent_label ORDER BY ord) AS nth FROM doc_entities) e GROUP BY doc_id)"""

TEXTS = ("doc_texts",)


@query(
    "txt_clean",
    rf"""SELECT doc_id, length(c) AS clean_len, md5(c) AS clean_md5, left(c, 2000) AS cached_text
    FROM (SELECT doc_id, trim(regexp_replace(text, '{BLANK_CLASS}+', ' ', 'g')) AS c FROM documents) t""",
)
def txt_clean(spark, sf):
    cleaned = load(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text"), None).alias("c"))
    return cleaned.select(
        "doc_id",
        F.length("c").alias("clean_len"),
        F.md5("c").alias("clean_md5"),
        F.left("c", F.lit(tx.CACHE_CHARS)).alias("cached_text"),
    )


@query("flt_blank_text", r"SELECT doc_id, label, text FROM doc_texts WHERE regexp_matches(text, '\S')", TEXTS)
def flt_blank_text(spark, sf):
    return load(spark, sf, "doc_texts").where(~tx.is_blank(F.col("text"))).select("doc_id", "label", "text")


@query(
    "prj_blank_to_space",
    r"SELECT doc_id, CASE WHEN regexp_matches(pdf_text, '\S') THEN pdf_text ELSE ' ' END AS filled FROM doc_texts",
    TEXTS,
)
def prj_blank_to_space(spark, sf):
    return load(spark, sf, "doc_texts").select("doc_id", tx.fill_blank(F.col("pdf_text")).alias("filled"))


CHOSEN = f"CASE WHEN length({sql_strip('pdf_text')}) > 30 THEN pdf_text ELSE ocr_text END"


@query("prj_text_source", f"SELECT doc_id, {CHOSEN} AS chosen FROM doc_texts", TEXTS)
def prj_text_source(spark, sf):
    return load(spark, sf, "doc_texts").select(
        "doc_id", tx.choose_text(F.col("pdf_text"), F.col("ocr_text")).alias("chosen")
    )


@query(
    "prj_join_pages",
    "SELECT doc_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page_no) AS pdf_text FROM doc_pages GROUP BY doc_id",
    ("doc_pages",),
)
def prj_join_pages(spark, sf):
    return ex.join_pages(load(spark, sf, "doc_pages"))


@query(
    "txt_find_dates",
    f"""SELECT doc_id, len(d) AS n_dates, array_to_string(d, '|') AS dates
    FROM (SELECT doc_id, regexp_extract_all(text, '{SQL_DATE}', 0) AS d FROM doc_texts) t""",
    TEXTS,
)
def txt_find_dates(spark, sf):
    dates = load(spark, sf, "doc_texts").select("doc_id", tx.find_dates(F.col("text")).alias("d"))
    return dates.select("doc_id", F.size("d").cast("bigint").alias("n_dates"), F.array_join("d", "|").alias("dates"))


FIELD_ROWS = f"f AS (SELECT doc_id, label_name, {sql_fields()} FROM doc_texts)"


def _with_dates(spark, sf):
    text = F.col("text")
    return load(spark, sf, "doc_texts").select(
        "doc_id",
        tx.find_dates(text).alias("dates"),
        tx.invoice_date_window(text).alias("dated"),
        tx.due_date_window(text).alias("due"),
    )


@query("txt_invoice_number", "SELECT doc_id, invoice_number FROM f", TEXTS, FIELD_ROWS)
def txt_invoice_number(spark, sf):
    return load(spark, sf, "doc_texts").select("doc_id", tx.invoice_number(F.col("text")).alias("invoice_number"))


@query("txt_invoice_date", "SELECT doc_id, invoice_date FROM f", TEXTS, FIELD_ROWS)
def txt_invoice_date(spark, sf):
    return _with_dates(spark, sf).select("doc_id", tx.invoice_date(F.col("dated"), F.col("dates")).alias("invoice_date"))


@query("txt_due_date", "SELECT doc_id, due_date FROM f", TEXTS, FIELD_ROWS)
def txt_due_date(spark, sf):
    return _with_dates(spark, sf).select("doc_id", tx.due_date(F.col("due"), F.col("dates")).alias("due_date"))


@query("txt_total_amount", "SELECT doc_id, total_amount FROM f", TEXTS, FIELD_ROWS)
def txt_total_amount(spark, sf):
    return load(spark, sf, "doc_texts").select("doc_id", tx.total_amount(F.col("text")).alias("total_amount"))


@query("txt_names_labelled", "SELECT doc_id, issuer_line AS issuer_name, recipient_line AS recipient_name FROM f", TEXTS, FIELD_ROWS)
def txt_names_labelled(spark, sf):
    return load(spark, sf, "doc_texts").select(
        "doc_id",
        tx.issuer_line(F.col("text")).alias("issuer_name"),
        tx.recipient_line(F.col("text")).alias("recipient_name"),
    )


@query("ent_roles", "SELECT * FROM roles", ("doc_entities",), ROLES_SQL)
def ent_roles(spark, sf):
    return ex.entity_roles(load(spark, sf, "doc_entities"))


@query(
    "ext_fields",
    """SELECT doc_id, invoice_number, invoice_date, due_date, issuer_line AS issuer_name,
      recipient_line AS recipient_name, total_amount FROM f""",
    TEXTS,
    FIELD_ROWS,
)
def ext_fields(spark, sf):
    return ex.extract_fields(load(spark, sf, "doc_texts").select("doc_id", "text")).drop("text")


@query(
    "ext_fields_entities",
    """SELECT f.doc_id, invoice_number, invoice_date, due_date, issuer_name, recipient_name, total_amount
    FROM f LEFT JOIN roles ON f.doc_id = roles.doc_id""",
    ("doc_texts", "doc_entities"),
    f"{FIELD_ROWS}, {ROLES_SQL}",
)
def ext_fields_entities(spark, sf):
    docs = load(spark, sf, "doc_texts").select("doc_id", "text")
    return ex.extract_fields(docs, load(spark, sf, "doc_entities")).drop("text")


# The extraction of free prose: dates and the labels occur there by chance, whole texts are read as they are.
@query(
    "ext_fields_documents",
    """SELECT doc_id, invoice_number, invoice_date, due_date, issuer_line AS issuer_name,
      recipient_line AS recipient_name, total_amount FROM f""",
    (),
    f"f AS (SELECT doc_id, {sql_fields('text')} FROM documents)",
)
def ext_fields_documents(spark, sf):
    return ex.extract_fields(load(spark, sf, "documents").select("doc_id", "text")).drop("text")


@query(
    "ext_field_rows",
    "\nUNION ALL ".join(
        f"SELECT doc_id, {i} AS field_ord, '{name}' AS field, {name.replace('_name', '_line')} AS value FROM f"
        for i, name in enumerate(FIELD_ORDER)
    ),
    TEXTS,
    FIELD_ROWS,
)
def ext_field_rows(spark, sf):
    return ex.fields_long(ext_fields(spark, sf))


@query(
    "flt_gate_invoice",
    """SELECT d.doc_id, coalesce(p.stack_label, p.cnn_label) AS label, d.text
    FROM doc_texts d JOIN (SELECT doc_id, max(CASE WHEN m = 4 THEN y_pred END) AS stack_label,
      max(CASE WHEN m = 3 THEN y_pred END) AS cnn_label FROM predictions GROUP BY doc_id) p ON d.doc_id = p.doc_id
    WHERE coalesce(p.stack_label, p.cnn_label) = 1""",
    ("predictions",),
)
def flt_gate_invoice(spark, sf):
    from paperloom.operators.scoring import named_predictions, primary

    best = primary(named_predictions(load(spark, sf, "predictions")))
    docs = load(spark, sf, "doc_texts").select("doc_id", "text")
    gated = docs.join(ex.gate(best), "doc_id")
    return gated.select("doc_id", F.lit(1).alias("label"), "text")
