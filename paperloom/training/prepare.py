"""Vectors, weights and scaling shared by the training jobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.images import hog_features, pixel_features
from paperloom.training.dense_map import DenseMap

HOG_SIZE = 128
PIXEL_SIZE = 64
SVD_COMPONENTS = 200
SEED = 42


def pixel_vectors(images: DataFrame, size: int = PIXEL_SIZE) -> DataFrame:
    return pixel_features(images, size).withColumn("features", array_to_vector("features"))


def hog_vectors(images: DataFrame, size: int = HOG_SIZE) -> DataFrame:
    return hog_features(images, size).withColumn("features", array_to_vector("features"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights ``n / (classes * n_class)``; one row per class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    # One row per class is all that meets in this window.
    everything = Window.partitionBy(F.lit(0))
    return counts.select(
        label_col, "n", (F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight")
    )


def with_class_weight(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Join the weights; that side has one row per class, so it is broadcast."""
    return df.join(F.broadcast(class_weights(df, label_col).drop("n")), label_col)


def fit_scaler(df: DataFrame, input_col: str, output_col: str) -> PipelineModel:
    """z-scores with the population deviation; a constant feature gives zero.

    The library scaler divides by the sample deviation, so its result is stretched by a fixed factor.
    """
    scaler = StandardScaler(withMean=True, withStd=True, inputCol=input_col, outputCol=f"{output_col}_sample")
    model = scaler.fit(df)
    n = df.count()
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    stretch = ElementwiseProduct(
        scalingVec=Vectors.dense([factor] * model.mean.size), inputCol=f"{output_col}_sample", outputCol=output_col
    )
    return PipelineModel([model, stretch])


def standardise(df: DataFrame, input_col: str = "features", output_col: str = "scaled") -> DataFrame:
    return fit_scaler(df, input_col, output_col).transform(df).drop(f"{output_col}_sample")


def truncated_svd(
    df: DataFrame, k: int = SVD_COMPONENTS, input_col: str = "features", output_col: str = "reduced", passes: int = 4, spare: int = 10
) -> DenseMap:
    """Projection on the first ``k`` right singular vectors, without centring.

    A randomised range finder (Halko, Martinsson & Tropp 2011): ``k + spare`` random directions are turned towards the
    leading singular vectors by ``passes`` passes over the rows, then the rows in these directions are reduced to one
    triangle by QR steps along a tree.  Exact, up to rounding, where the rank is at most ``k + spare``; else as close as the
    gap after the ``k``-th value and the passes make it.  The driver and each task hold features times ``k + spare``
    numbers, whatever the number of rows.  The vectors are as many as the rank allows and their signs are arbitrary;
    rows without a vector are left out, and a table without any is an error.
    """
    rows = df.where(F.col(input_col).isNotNull()).select(vector_to_array(input_col).alias("x"))
    first = rows.first()
    if first is None:
        raise ValueError("no row has a vector")
    width = len(first.x)
    sought = min(k + spare, width)
    if sought == width:
        directions = np.eye(width)
    else:
        directions = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, sought)))[0]
        for _ in range(passes):
            turned = _reduced(rows, directions, lambda x, y: x.T @ y, lambda a, b: a + b)
            directions = np.linalg.qr(turned)[0]
    triangle = _reduced(
        rows, directions, lambda x, y: np.linalg.qr(y, mode="r"), lambda a, b: np.linalg.qr(np.vstack([a, b]), mode="r")
    )
    _, sizes, turns = np.linalg.svd(triangle)
    kept = min(k, int((sizes > 1e-9 * sizes[0]).sum()))
    return DenseMap(turns[:kept] @ directions.T, inputCol=input_col, outputCol=output_col)


def _reduced(rows: DataFrame, directions: np.ndarray, part: Callable, join: Callable) -> np.ndarray:
    """``part(x, x @ directions)`` of each Arrow block of rows, joined within its task and then along a tree of tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                here = part(x, x @ shared.value)
                total = here if total is None else join(total, here)
        if total is not None:
            columns = [pa.array([total.shape[0]], pa.int32()), pa.array([total.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["height", "numbers"])

    # One row per task from here on.
    parts = rows.mapInArrow(blocks, "height int, numbers binary").rdd
    return parts.map(lambda r: np.frombuffer(bytes(r.numbers)).reshape(r.height, -1)).treeReduce(join)
