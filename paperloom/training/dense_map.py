"""A fixed dense matrix applied to a vector column, as a pipeline stage that can be saved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 512


class DenseMap(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """``W x``, or with ``wave`` the random Fourier features ``sqrt(2/D) cos(W x + b)``.

    The matrix goes to each executor once, as a broadcast; its size is features times outputs,
    whatever the number of rows.
    """

    wave = Param(Params._dummy(), "wave", "apply the cosine of random Fourier features", TypeConverters.toBoolean)

    def __init__(self, weights=None, offset=None, wave=False, inputCol="features", outputCol="mapped"):
        super().__init__()
        self.weights = None if weights is None else np.asarray(weights, dtype=np.float64)
        outputs = 0 if self.weights is None else len(self.weights)
        self.offset = np.zeros(outputs) if offset is None else np.asarray(offset, dtype=np.float64)
        self._set(wave=wave, inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = dataset.sparkSession.sparkContext.broadcast((self.weights, self.offset))
        wave = self.getOrDefault(self.wave)

        @F.pandas_udf("array<double>")
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            weights, offset = shared.value
            for batch in batches:
                # A part is passed on before the next is made, so a task holds the numbers of one.
                for start in range(0, len(batch), CHUNK):
                    x = np.stack(batch.iloc[start : start + CHUNK].to_numpy())
                    y = x @ weights.T + offset
                    yield pd.Series(list(np.sqrt(2.0 / len(offset)) * np.cos(y) if wave else y))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(apply(vector_to_array(self.getInputCol()))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, stage: DenseMap):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        rows = [
            (i, row.tolist(), float(b)) for i, (row, b) in enumerate(zip(self.stage.weights, self.stage.offset))
        ]
        table = self.sparkSession.createDataFrame(rows, "output int, weights array<double>, offset double")
        table.write.parquet(f"{path}/matrix")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> DenseMap:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        # One row per output of the matrix, so what is collected is the model, not data.
        rows = self.sparkSession.read.parquet(f"{path}/matrix").orderBy("output").collect()
        stage = self.cls([r.weights for r in rows], [r.offset for r in rows])
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage
