"""Folds, calibration and the join of labels, shared by the learned operators."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
CALIBRATION_FOLD = 4
STEPS = 1024


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out, 4 calibrates, 1 to 3 fit.  A null id counts as fold 0."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def training_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``id, label`` of the rows that may be learned from, one row per id; nulls and ids with two labels go."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    once = rows.dropna().where(fold("id") != 0).groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_m"))
    return once.where("label = _m").drop("_m")


def isotonic_steps(scored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rising map from raw scores to probabilities, fitted to ``raw, label`` rows.

    Scores meet in `STEPS` equal steps of their range, so the fit gets a bounded number of weighted rows.
    Without rows, or with one class only, the map is constant.
    """
    low, high = scored.agg(F.min("raw"), F.max("raw")).first()
    if low is None:
        return np.array([0.0, 1.0]), np.array([0.5, 0.5])
    width = (high - low) / STEPS or 1.0
    binned = (
        scored.groupBy(F.floor((F.col("raw") - low) / width).alias("bin"))
        .agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
        .coalesce(1)
    )
    rows = VectorAssembler(inputCols=["raw"], outputCol="x").transform(binned)
    model = IsotonicRegression(featuresCol="x", labelCol="label", weightCol="w").fit(rows)
    return np.array(model.boundaries.toArray()), np.clip(model.predictions.toArray(), 0.0, 1.0)


def smoothed(raw: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Calibrated scores; a hundredth of the raw order is kept so that flat steps still rank rows."""
    at, value = steps
    spread = at[-1] - at[0]
    rank = np.clip((raw - at[0]) / spread, 0.0, 1.0) if spread > 0 else np.full(len(raw), 0.5)
    return 0.99 * np.interp(raw, at, value) + 0.01 * rank
