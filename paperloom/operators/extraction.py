"""Invoice fields of every document from its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.schemas import FIELD_ORDER


def entity_roles(entities: DataFrame) -> DataFrame:
    """Issuer and recipient per document from ``(doc_id, ord, ent_label, ent_text)``.

    The rank limit is applied on the map side first, so a document with very many entities
    ships two rows per label and map task, never all of them.
    """
    w = Window.partitionBy("doc_id", "ent_label").orderBy("ord")
    top = (
        entities.where(F.col("ent_label").isin("ORG", "PERSON"))
        .withColumn("_nth", F.row_number().over(w))
        .where(F.col("_nth") <= 2)
    )

    def pick(label: str, nth: int):
        return F.max(F.when((F.col("ent_label") == label) & (F.col("_nth") == nth), F.col("ent_text")))

    return top.groupBy("doc_id").agg(
        F.coalesce(pick("ORG", 1), pick("PERSON", 1)).alias("issuer_name"),
        F.coalesce(pick("ORG", 2), pick("PERSON", 2)).alias("recipient_name"),
    )


def join_pages(pages: DataFrame) -> DataFrame:
    """One PDF text per document: its pages in order, newline between, null page as empty."""
    return pages.groupBy("doc_id").agg(
        F.expr("listagg(coalesce(text, ''), '\n') WITHIN GROUP (ORDER BY page_no)").alias("pdf_text")
    )


def gate(df: DataFrame, force: bool = False, label_col: str = "label") -> DataFrame:
    """Only documents whose primary label is an invoice go on to extraction, unless forced."""
    return df if force else df.where(F.col(label_col) == "invoice")


def extract_fields(
    docs: DataFrame,
    entities: DataFrame | None = None,
    text_col: str = "text",
    strict: bool = False,
) -> DataFrame:
    """Add the six fields.

    With ``entities`` (the recogniser ran) names come from entity roles, null where it found none;
    without, from labelled lines.

    Patterns are the cost of this job.  They run in stages of their own, each at most once per
    document: a later form of a field is tried only where the earlier ones found nothing.
    """
    text = F.col(text_col)
    numbers = tx.STRICT_NUMBER_FORMS if strict else tx.NUMBER_FORMS

    def unless(earlier: list[str], pattern: str):
        missed = F.lit(True)
        for name in earlier:
            missed = missed & (F.col(name) == "")
        return F.when(missed, tx.match(text, pattern)).otherwise("")

    first = {
        "_dates": tx.find_dates(text),
        "_dated": tx.match(text, tx.INVOICE_DATE_WINDOW),
        "_due": tx.match(text, tx.DUE_DATE_WINDOW),
        "_n0": tx.match(text, numbers[0]),
        "_t0": tx.match(text, tx.TOTAL_FORMS[0]),
    }
    if entities is None:
        first |= {"_from": tx.match(text, tx.ISSUER_LINE), "_to": tx.match(text, tx.RECIPIENT_LINE)}
    second = {
        "_dated_date": tx.match(F.col("_dated"), tx.DATE, 0),
        "_due_date": tx.match(F.col("_due"), tx.DATE, 0),
        "_n1": unless(["_n0"], numbers[1]),
        "_t1": unless(["_t0"], tx.TOTAL_FORMS[1]),
    }
    third = {"_n2": unless(["_n0", "_n1"], numbers[2])}
    out = docs.withColumns(first).withColumns(second).withColumns(third)

    due_text = F.left(tx.strip(F.col("_due")), F.lit(tx.DUE_CHARS))
    fields = {
        "invoice_number": tx.found(F.col("_n0"), F.col("_n1"), F.col("_n2")),
        "invoice_date": F.coalesce(tx.found(F.col("_dated_date")), F.get("_dates", F.lit(0))),
        "due_date": F.when(F.col("_due") == "", F.get("_dates", F.lit(1)))
        .when(F.col("_due_date") != "", F.col("_due_date"))
        .otherwise(due_text),
        "total_amount": tx.strip(tx.found(F.col("_t0"), F.col("_t1"))),
    }
    if entities is None:
        for name, raw in (("issuer_name", "_from"), ("recipient_name", "_to")):
            fields[name] = F.when(F.col(raw) != "", F.left(tx.strip(F.col(raw)), F.lit(tx.NAME_CHARS)))
    out = out.withColumns(fields)
    if entities is not None:
        out = out.join(entity_roles(entities), "doc_id", "left")
    return out.select(*docs.columns, *FIELD_ORDER)


def fields_long(df: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Six field columns to rows ``(ids, field_ord, field, value)``; nulls are kept."""
    items = F.array(
        *[F.struct(F.lit(name).alias("field"), F.col(name).alias("value")) for name in FIELD_ORDER]
    )
    return df.select(*id_cols, F.posexplode(items).alias("field_ord", "_item")).select(
        *id_cols, "field_ord", "_item.field", "_item.value"
    )


def fields_wide(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`fields_long`."""
    return rows.groupBy("doc_id").pivot("field", list(FIELD_ORDER)).agg(F.max("value"))
