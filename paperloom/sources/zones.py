"""Zone maps of stored tables: least and greatest value of a column per row group, from the files' footers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.schemas import literal_array
from paperloom.sources.files import located


def zone_map(spark: SparkSession, path: str, col: str) -> DataFrame:
    """``file, row_group, n, low, high, nulls`` of the Parquet files under ``path``; only footers are read, by many tasks.

    ``low`` and ``high`` are null where a file keeps no statistics or all values are null; ``nulls`` is null where
    their number is not kept.  ``col`` is a top-level column whose statistics are values of its own type (numbers,
    strings, dates).
    """
    kind = spark.read.parquet(path).schema[col].dataType
    files = (
        spark.read.format("binaryFile")  # the content isn't selected, so it isn't read
        .option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path")
    )
    fields = [T.StructField("file", T.StringType()), T.StructField("row_group", T.IntegerType()), T.StructField("n", T.LongType()),
              T.StructField("low", kind), T.StructField("high", kind), T.StructField("nulls", T.LongType())]

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file in pdf["path"]:
                fs, name = located(file)
                with fs.open_input_file(name) as source:
                    meta = pq.ParquetFile(source).metadata
                    for g in range(meta.num_row_groups):
                        group = meta.row_group(g)
                        chunks = (group.column(i) for i in range(group.num_columns))
                        stats = next((c.statistics for c in chunks if c.path_in_schema == col), None)
                        known = stats is not None and stats.has_min_max
                        nulls = stats.null_count if stats is not None and stats.has_null_count else None
                        rows.append((file, g, group.num_rows, stats.min if known else None, stats.max if known else None, nulls))
            yield pd.DataFrame(rows, columns=[f.name for f in fields], dtype=object)

    return files.mapInPandas(footers, T.StructType(fields))


def may_hold(zones: DataFrame, values: list) -> DataFrame:
    """The row groups whose range holds one of ``values``; those without statistics stay unless all their values are null."""
    inside = F.exists(literal_array(values), lambda v: v.between(F.col("low"), F.col("high")))
    unknown = F.col("low").isNull() & ~F.equal_null("nulls", "n")
    return zones.where(F.coalesce(inside, F.lit(False)) | unknown)


def read_holding(spark: SparkSession, path: str, col: str, values: list, zones: DataFrame | None = None) -> DataFrame:
    """Rows of the table under ``path`` whose ``col`` is one of ``values``; files that can't hold one are not opened.

    The names of the chosen files reach the driver, as they do when a scan is planned.  Within a chosen file the same
    filter is pushed to the scan, which skips row groups.
    """
    zones = zone_map(spark, path, col) if zones is None else zones
    names = [r["file"] for r in may_hold(zones, values).select("file").distinct().collect()]
    whole = spark.read.parquet(path)
    chosen = spark.read.schema(whole.schema).option("basePath", path).parquet(*names) if names else whole.limit(0)
    return chosen.where(F.col(col).isin(values))


def shard_span(zones: DataFrame, codes: list[int], by: list[str], shard_col: str = "shard_idx", code_col: str = "label16") -> DataFrame:
    """First and last shard of each code per group ``by``, from the ranges kept in the shards of a label-sorted corpus.

    Unlike `sampling.shard_range` nothing is assumed of the classes' sizes.  Shards without statistics may hold any
    code and count for all.
    """
    grid = zones.withColumn(code_col, F.explode(literal_array(codes)))
    inside = F.col(code_col).between(F.col("low"), F.col("high"))
    held = grid.where(F.coalesce(inside, ~F.equal_null("nulls", "n")))
    return held.groupBy(*by, code_col).agg(F.min(shard_col).alias("first_shard"), F.max(shard_col).alias("last_shard"))
