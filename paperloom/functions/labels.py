"""Class names and class numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.schemas import CORPUS_CODES, LABEL_NAMES, literal_map


def label_name(label: Column) -> Column:
    """Class name of a class number; null for a number outside the class list."""
    return F.get(F.array(*[F.lit(n) for n in LABEL_NAMES]), label.cast("int"))


def label_index(name: Column) -> Column:
    """Class number of a class name; null for an unknown name."""
    return F.try_element_at(literal_map({n: i for i, n in enumerate(LABEL_NAMES)}), name)


def encode_corpus_labels(df: DataFrame, code_col: str = "label") -> DataFrame:
    """Keep the wanted corpus codes and add ``label_name`` and ``label_idx``.

    The code list is a constant, so the filter reaches the parquet scan and the names are a map
    look-up in the projection: no join, no shuffle.
    """
    wanted = df.where(F.col(code_col).isin(list(CORPUS_CODES)))
    names = F.try_element_at(literal_map(CORPUS_CODES), F.col(code_col).cast("int"))
    return wanted.withColumn("label_name", names).withColumn("label_idx", label_index(F.col("label_name")))
