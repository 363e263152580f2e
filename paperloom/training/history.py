"""Training logs: epoch metrics, learning rate and the best epoch of each run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCHS = 20
LEARNING_RATE = 1e-3


def epoch_metrics(batches: DataFrame) -> DataFrame:
    """Row-weighted loss and accuracy per run, epoch and phase, to four decimals."""
    rows = F.sum("n")
    return batches.groupBy("run_id", "epoch", "phase").agg(
        F.round(F.sum(F.col("loss") * F.col("n")) / rows, 4).alias("loss"),
        F.round(F.sum("correct") / rows, 4).alias("accuracy"),
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """First epoch with the highest validation accuracy above zero, per run.

    A maximum over (accuracy, minus epoch) combines on the map side, so a run of any length is fine.
    """
    top = F.max(F.struct("val_acc", (-F.col("epoch")).alias("_back"))).alias("_top")
    return history.where(F.col("val_acc") > 0).groupBy("run_id").agg(top).select(
        "run_id", (-F.col("_top._back")).alias("epoch"), F.col("_top.val_acc").alias("val_acc")
    )


def cosine_lr(history: DataFrame, rate: float = LEARNING_RATE, epochs: int = EPOCHS) -> DataFrame:
    """Learning rate in force during each epoch, falling along half a cosine."""
    return history.withColumn("lr", F.lit(rate) * (1 + F.cos(F.lit(math.pi) * (F.col("epoch") - 1) / epochs)) / 2)
