"""Keeping a text cache in step with the current files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("path", "label", "label_name", "text")


def latest_entries(cache: DataFrame, order_col: str = "seq") -> DataFrame:
    """Last entry of each path.  A maximum combines on the map side, so a path that occurs very
    often costs one row per task."""
    last = F.max(F.struct(order_col, "label", "label_name", "text")).alias("_last")
    return cache.groupBy("path").agg(last).select("path", "_last.label", "_last.label_name", "_last.text")


def missing(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with no cached row, or whose cached text is null; empty text counts as cached."""
    return files.join(cache.where(F.col("text").isNotNull()).select("path"), "path", "left_anti")


def merge(files: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Current files only: the cached row where it has text, else the file with its fresh text.

    ``cache`` has one row per path; merging again changes nothing.
    """
    new = fresh.select("path", F.col("text").alias("_new"))
    files = files.select("path", "label", "label_name").join(new, "path", "left")
    return refresh(files, cache, F.col("_new"))


def refresh(files: DataFrame, cache: DataFrame, fresh: Column) -> DataFrame:
    """`merge` where the fresh text is a column over ``files``: they are read once, joined once, and the column is only
    worked out for files without a cached text."""
    valid = cache.where(F.col("text").isNotNull()).select("path", F.struct("label", "label_name", "text").alias("_old"))
    return files.join(valid, "path", "left").select(
        "path",
        F.when(F.col("_old").isNotNull(), F.col("_old.label")).otherwise(F.col("label")).alias("label"),
        F.when(F.col("_old").isNotNull(), F.col("_old.label_name")).otherwise(F.col("label_name")).alias("label_name"),
        F.coalesce(F.col("_old.text"), fresh).alias("text"),
    )
