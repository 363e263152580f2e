import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators.extraction import entity_roles, extract_fields, fields_long, fields_wide, join_pages

COLUMNS = ["invoice_number", "invoice_date", "due_date", "issuer_name", "recipient_name", "total_amount"]

CASES = [
    ("Invoice No: 123", ("No", None, None, None, None, None)),
    ("Inv. No. 55", ("55", None, None, None, None, None)),
    ("INVOICE\n#\n123", ("123", None, None, None, None, None)),
    ("invite", ("ite", None, None, None, None, None)),
    ("Bill Number: X-9/1", ("X-9/1", None, None, None, None, None)),
    ("see # AB12 here", ("AB12", None, None, None, None, None)),
    ("inv 1", (None, None, None, None, None, None)),
    ("Subtotal: 5", (None, None, None, None, None, "5")),
    ("Total: 100.5", (None, None, None, None, None, "100")),
    ("Total Amount: $5", (None, None, None, None, None, None)),
    ("paid $1,234.50 \nthanks", (None, None, None, None, None, "$1,234.50")),
    ("Due by: 1/2/24", (None, "1/2/24", "1/2/24", None, None, None)),
    ("3 Mar 2024 and June 5, 24", (None, "3 Mar 2024", "June 5, 24", None, None, None)),
    ("Due date:\nnext line", (None, None, "next line", None, None, None)),
    ("due date:  ", (None, None, "", None, None, None)),
    ("nothing to see here", (None, None, None, None, "see here", None)),
    ("From: Acme\r\nBill To: Bob  ", (None, None, None, "Acme", "Bob", None)),
    ("20240112 12/2024", (None, None, None, None, None, None)),
    ("", (None, None, None, None, None, None)),
    (None, (None, None, None, None, None, None)),
]


def test_fields(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)]
    got = extract_fields(spark.createDataFrame(rows, "doc_id int, text string")).orderBy("doc_id").collect()
    for row, (text, want) in zip(got, CASES):
        assert tuple(row[c] for c in COLUMNS) == want, text


def test_column_forms_agree_with_the_job(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id int, text string")
    text = F.col("text")
    dates = tx.find_dates(text)
    single = df.select(
        "doc_id",
        tx.invoice_number(text).alias("invoice_number"),
        tx.invoice_date(tx.invoice_date_window(text), dates).alias("invoice_date"),
        tx.due_date(tx.due_date_window(text), dates).alias("due_date"),
        tx.issuer_line(text).alias("issuer_name"),
        tx.recipient_line(text).alias("recipient_name"),
        tx.total_amount(text).alias("total_amount"),
    )
    assert single.exceptAll(extract_fields(df).drop("text")).count() == 0


def test_strict_numbers(spark):
    texts = ["Invoice No: 123", "Invoice Number: A-1", "two invoices", "Invoice Date: 2024-01-02", "INV 77"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = [r.invoice_number for r in extract_fields(df, strict=True).orderBy("doc_id").collect()]
    assert got == ["123", "A-1", None, None, "77"]


def test_strip_and_clean(spark):
    raw = "  a\t\n\x1c b　 "
    df = spark.createDataFrame([(raw,), ("x" * 2500,)], "t string")
    got = [tuple(r) for r in df.select(tx.strip(F.col("t")), tx.clean_text(F.col("t"), 2000), F.length(tx.clean_text(F.col("t")))).collect()]
    assert got[0][:2] == (raw.strip(), " ".join(raw.split()))
    assert len(got[1][1]) == 2000 and got[1][2] == 2500


@pytest.mark.parametrize("text,blank", [(None, True), ("", True), ("  \x1f", True), ("a", False)])
def test_blank(spark, text, blank):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(tx.is_blank(F.col("t")).alias("b"), tx.fill_blank(F.col("t")).alias("f")).first()
    assert row.b == blank and row.f == (" " if blank else text)


def test_pages_keep_order(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, None)]
    got = dict(map(tuple, join_pages(spark.createDataFrame(rows, "doc_id int, page_no int, text string")).collect()))
    assert got == {1: "a\nb\n", 2: ""}


def test_roles(spark):
    rows = [(1, 1, "PERSON", "Pat"), (1, 2, "ORG", "A"), (1, 3, "PERSON", "Sam"), (1, 4, "DATE", "x"), (2, 1, "DATE", "y")]
    rows += [(3, i, "ORG", f"O{i}") for i in range(5000)]
    got = {r[0]: tuple(r)[1:] for r in entity_roles(spark.createDataFrame(rows, "doc_id int, ord int, ent_label string, ent_text string")).collect()}
    assert got == {1: ("A", "Sam"), 3: ("O0", "O1")}


def test_long_and_back(spark):
    df = extract_fields(spark.createDataFrame([(1, "Invoice No: 9\nTotal: 5")], "doc_id int, text string")).drop("text")
    assert fields_wide(fields_long(df)).select(df.columns).exceptAll(df).count() == 0
