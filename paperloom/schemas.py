"""Row shapes and fixed values shared by every job.

A row is one document (or one word, one pixel, one prediction of a document).
Identity is always a column (``doc_id`` or ``path``) and order is always an
explicit integer column, so no job depends on row position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Class names by index, and their codes in the 16-class source corpus.
LABEL_NAMES = ("email", "invoice", "letter", "scientific_report")
CORPUS_CODES = {2: "email", 6: "invoice", 7: "letter", 14: "scientific_report"}
CORPUS_CLASS_COUNT = 16
SPLITS = ("train", "validation", "test")
SPLIT_TARGETS = {"train": 10000, "validation": 1000, "test": 1000}

# Extraction fields in report order, base members in stacking order,
# and the order in which a document's predictions are listed.
FIELD_ORDER = (
    "invoice_number",
    "invoice_date",
    "due_date",
    "issuer_name",
    "recipient_name",
    "total_amount",
)
MEMBER_ORDER = ("svd_svm", "hog_svm", "hog_rf", "cnn")
DISPLAY_ORDER = ("Stacking", "DistilBERT-OCR", "CNN", "SVD+SVM", "HOG+SVM", "HOG+RF")
RANDOM_BASELINE = 0.25

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField(
            "image",
            T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())]),
        ),
        T.StructField("label", T.IntegerType()),
    ]
)

TEXT_CACHE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("label_name", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

BOX_TYPE = "struct<field:string,x:int,y:int,w:int,h:int>"


def literal_array(values) -> Column:
    """A constant array column, for exploding a short fixed list without a join."""
    return F.array(*[F.lit(v) for v in values])


def literal_map(mapping: dict) -> Column:
    """A constant map column from a small fixed dictionary."""
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*flat)
