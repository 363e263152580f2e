"""Session for local runs and tests, and the shared folder jobs write to."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str | None = None) -> SparkSession:
    """A local session; on a cluster the session comes from its own configuration."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("paperloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "1000")  # plans show the whole path of a table
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared folder that the session names.

    A session of a single local process that names none gets a folder of its own set.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set(CHECKPOINT_CONF, root)
    return f"{root.rstrip('/')}/paperloom-{uuid.uuid4().hex}"
