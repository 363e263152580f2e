"""Quality scores: random Fourier features of document statistics under a ridge fit, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.blocks import fresh_name, map_batches, narrow, widened
from paperloom.llm.labelled import CALIBRATION_FOLD, fold, isotonic_steps, smoothed, training_labels
from paperloom.llm.stats import ratios, with_document_stats
from paperloom.sources.sinks import materialise

FEATURES = 256
WIDTH = 2.0  # of the kernel, in units of sqrt(measures)
RIDGE = 1e-3
SEED = 7


@dataclass(frozen=True)
class KernelModel:
    centre: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray  # measures x features
    phase: np.ndarray
    weight: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Features whose inner products approximate a Gaussian kernel, a constant, and the measures themselves."""
        z = np.clip((x - self.centre) / self.scale, -8.0, 8.0)
        waves = np.cos(z @ self.frequency + self.phase) * np.sqrt(2.0 / self.frequency.shape[1])
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weight if len(self.weight) else np.zeros(len(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return smoothed(self.raw(x), self.steps)


def measures(stats: Column) -> Column:
    return F.array(*ratios(stats).values())


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _raw_scores(rows: DataFrame, model: KernelModel) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"raw": model.raw(_matrix(batch.column(0))), "label": batch.column(1)})

    return map_batches(rows.select("x", "label"), apply, "raw double, label double")


def fit_kernel_quality(
    measured: DataFrame, labels: DataFrame, label_col: str = "quality", features: int = FEATURES
) -> KernelModel:
    """Fit on ``id, x`` rows that have a label and are not held out.

    Each partition adds up its part of the normal equations (features x features numbers); the parts are added per
    matrix row, and only the sum reaches the driver.  Rows of the calibration fold fit the isotonic steps.  Classes
    weigh alike.  Without labelled rows every score is the same.
    """
    rows = materialise(
        measured.join(training_labels(labels, label_col), "id").select("x", "label", fold("id").alias("fold"))
    )
    size = len(ratios(F.lit(0)))
    part = rows.where(F.col("fold") != CALIBRATION_FOLD)
    moments = part.agg(
        F.count(F.lit(1)), F.sum("label"),
        *(f(F.col("x")[i]) for i in range(size) for f in (F.avg, F.stddev_pop)),
    ).first()
    n, positive = moments[0], moments[1] or 0.0
    draw = np.random.default_rng(SEED)
    empty = KernelModel(
        np.array([moments[2 + 2 * i] or 0.0 for i in range(size)]),
        np.array([max(moments[3 + 2 * i] or 0.0, 1e-6) for i in range(size)]),
        draw.normal(size=(size, features)) / (WIDTH * np.sqrt(size / 2)),
        draw.uniform(0, 2 * np.pi, features),
        np.zeros(0),
        (np.array([0.0, 1.0]), np.array([0.5, 0.5])),
    )
    if not n:
        return empty
    weigh = {1.0: n / (2 * max(positive, 1.0)), 0.0: n / (2 * max(n - positive, 1.0))}
    width = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z, y = empty.lifted(_matrix(batch.column(0))), batch.column(1).to_numpy()
                w = np.where(y > 0, weigh[1.0], weigh[0.0])
                total += (z * w[:, None]).T @ np.column_stack([z, y])
        if total.any():
            yield pa.record_batch(
                {"i": pa.array(np.arange(width), pa.int32()), "v": pa.array(list(total), pa.list_(pa.float64()))}
            )

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"][:1], "v": [np.sum(np.stack(list(pdf["v"])), axis=0)]})

    sums = map_batches(part.select("x", "label"), equations, "i int, v array<double>")
    summed = sums.groupBy("i").applyInPandas(added, "i int, v array<double>").orderBy("i").collect()
    system = np.array([r["v"] for r in summed])
    gram = system[:, :width] + RIDGE * n / width * np.eye(width)
    model = KernelModel(
        empty.centre, empty.scale, empty.frequency, empty.phase, np.linalg.solve(gram, system[:, width]), empty.steps
    )
    calibration = _raw_scores(rows.where(F.col("fold") == CALIBRATION_FOLD), model)
    return KernelModel(*(getattr(model, f) for f in ("centre", "scale", "frequency", "phase", "weight")),
                       isotonic_steps(calibration))


def score_measured(measured: DataFrame, model: KernelModel, x_col: str, out: str) -> DataFrame:
    """Add the score of each row's measures as ``out``, in place of the measures."""
    columns = [c for c in measured.columns if c != x_col]
    schema = widened(measured.select(*(F.col(f"`{c}`") for c in columns)), out, T.DoubleType())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(model.score(_matrix(batch.column(0))))
                yield pa.record_batch([*batch.columns[1:], scores], [*columns, out])

    return map_batches(measured.select(x_col, *(F.col(f"`{c}`") for c in columns)), apply, schema)


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, x``: the measures of every whole text, stored once for the fit and the scores."""
    rows = narrow(docs, id=id_col, text=text_col)
    return materialise(with_document_stats(rows, "text", "stats").select("id", measures(F.col("stats")).alias("x")))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score``: one row per document, the score higher where label 1 is likelier.

    Null and empty texts are measured as texts of no words; repeated rows get equal scores, rows without an id are
    scored and never learned from; labels without a document are not used; an empty table gives no rows.
    """
    measured = measure_documents(docs, id_col, text_col)
    return score_measured(measured, fit_kernel_quality(measured, labels), "x", "score").withColumnRenamed("id", id_col)


def keep_good(
    docs: DataFrame, labels: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns; scored in the pass that filters."""
    measured = measure_documents(docs, id_col, text_col)
    model = fit_kernel_quality(measured, labels)
    stats, x, score = (fresh_name(docs, n) for n in ("_stats", "_x", "_score"))
    rows = with_document_stats(docs, text_col, stats)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    scored = score_measured(rows.select(*columns, measures(F.col(stats)).alias(x)), model, x, score)
    return scored.where(F.col(score) >= least).select(*columns)
