"""Profiles of a labelled image and text corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import is_blank
from paperloom.operators.images import flat_levels, level_counts
from paperloom.schemas import LABEL_NAMES, SPLITS, literal_array

def class_distribution(df: DataFrame) -> DataFrame:
    """Rows per split and class, zeros shown."""
    spine = (
        df.sparkSession.range(1)
        .select(F.explode(literal_array(SPLITS)).alias("split"))
        .select("split", F.posexplode(literal_array(LABEL_NAMES)).alias("label", "label_name"))
    )
    counts = df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, ["split", "label"], "left").select(
        "split", "label", "label_name", F.coalesce("n", F.lit(0)).alias("n")
    )


def text_coverage(df: DataFrame) -> DataFrame:
    """Entries and entries with text per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(~is_blank(F.col("text"))).alias("with_text")
    )


def dataset_check(images: DataFrame) -> DataFrame:
    """Images, their size range and the number of labels per split."""
    return images.groupBy("split").agg(
        F.count("px").alias("images"),
        F.count("label").alias("labels"),
        F.min("width").alias("min_width"),
        F.max("width").alias("max_width"),
        F.min("height").alias("min_height"),
        F.max("height").alias("max_height"),
        (F.count("px") == F.count("label")).alias("agree"),
    )


def _level_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Gray-level counts per class of each batch, so pixels never leave their task."""
    for pdf in batches:
        known = pdf[pdf["label"].notna() & pdf["px"].notna()]
        if not len(known):
            continue
        label, group = np.unique(known["label"].to_numpy().astype(np.int32), return_inverse=True)
        levels, ends = flat_levels(known["px"])
        counts = level_counts(levels, np.repeat(group, np.diff(ends)), len(label))
        row, level = np.nonzero(counts)
        yield pd.DataFrame({"label": label[row], "level": level.astype(np.int32), "n": counts[row, level]})


def pixel_histogram(images: DataFrame, bins: int = 50) -> DataFrame:
    """Per class: ``bins`` equal bins from that class's lowest to highest level, as a density.

    A class of one single level gets the range one half to each side.  After the first map step
    the data is at most 256 rows per class and task.
    """
    levels = (
        images.select("label", "px")
        .mapInPandas(_level_counts, "label int, level int, n bigint")
        .groupBy("label", "level")
        .agg(F.sum("n").alias("n"))
    )
    ends = levels.groupBy("label").agg(
        F.min("level").alias("_lo"), F.max("level").alias("_hi"), F.sum("n").alias("total")
    )
    flat = F.col("_lo") == F.col("_hi")
    slot = F.when(flat, F.lit(bins // 2)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("level") - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))).cast("int"))
    )
    counts = levels.join(ends, "label").groupBy("label", slot.alias("bin")).agg(F.sum("n").alias("n"))
    low = F.col("_lo") - F.when(flat, 0.5).otherwise(0.0)
    width = F.when(flat, F.lit(1.0)).otherwise((F.col("_hi") - F.col("_lo")).cast("double")) / bins
    spine = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return spine.join(counts, ["label", "bin"], "left").select(
        "label",
        "bin",
        (low + F.col("bin") * width).alias("bin_left"),
        n.alias("n"),
        (n / (F.col("total") * width)).alias("density"),
    )
