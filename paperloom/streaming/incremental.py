"""Incremental jobs over arriving documents.

Sources are folders of files read with a checkpoint, so a restart goes on where the last run
stopped.  Nothing here keeps state beyond that checkpoint.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.labels import label_name
from paperloom.functions.text import clean_text
from paperloom.operators.extraction import extract_fields
from paperloom.schemas import FIELD_ORDER
from paperloom.training.members import score

BUCKETS = 64
FILES_PER_BUCKET = 4


def arriving(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files landing in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def key_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def known_keys(spark: SparkSession, table: str, schema: T.StructType, touched: list[int], batch_id: int, key: str) -> DataFrame:
    """Keys that have a text in the buckets ``touched``, from other batches than ``batch_id``; other buckets stay unread."""
    rows = spark.read.schema(schema).parquet(table)
    here = F.col("bucket").isin(touched) & (F.col("batch") != batch_id)
    return rows.where(here & F.col("text").isNotNull()).select(key)


def incremental_text(
    stream: DataFrame, table: str, checkpoint: str, key: str = "path", max_chars: int | None = None, buckets: int = BUCKETS
) -> None:
    """Add the cleaned text of new keys to ``table`` until no input is left.

    The table is kept in ``buckets`` folders by a hash of the key, and a batch reads the buckets of its own keys only.
    ``buckets`` has to stay the same for a table.  Each micro-batch owns one partition of every bucket it writes and
    overwrites only those, so a batch that is run again after a failure gives the same table.  Keys whose text is already
    in the table are skipped by an anti-join; a key that came without text is taken again when its text comes, and
    :func:`current_text` reads it.
    """
    fields = [
        stream.schema[key], T.StructField("text", T.StringType()),
        T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType()),
    ]
    schema = T.StructType(fields)
    spark = stream.sparkSession
    # Writing no rows makes the folder, so that the first batch can read it.
    no_rows = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    no_rows.write.mode("append").partitionBy("bucket", "batch").parquet(table)

    def add(batch: DataFrame, batch_id: int) -> None:
        # At most as many numbers as there are buckets.
        touched = [r.bucket for r in batch.select(key_bucket(key, buckets).alias("bucket")).distinct().collect()]
        known = known_keys(batch.sparkSession, table, schema, touched, batch_id, key)
        new = batch.join(known, key, "left_anti").select(key, clean_text(F.col("text"), max_chars).alias("text"))
        # A key that occurs twice in one batch gives one row, the same one on every run.
        rows = new.groupBy(key).agg(F.max("text").alias("text")).withColumns(
            {"bucket": key_bucket(key, buckets), "batch": F.lit(batch_id).cast("bigint")}
        )
        # Rows of a bucket are brought together, so that a batch adds few files to each.
        spread = rows.repartition("bucket", F.pmod(F.hash(key), F.lit(FILES_PER_BUCKET)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(table)

    query = (
        stream.select(key, "text")
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def current_text(table: DataFrame, key: str = "path") -> DataFrame:
    """One row per key: the text that came last, null only while none has come."""
    order = F.struct(F.col("text").isNotNull(), F.col("batch"), F.col("text"))
    return table.groupBy(key).agg(F.max(order).alias("_last")).select(key, F.col("_last.text").alias("text"))


def score_stream(stream: DataFrame, model: PipelineModel) -> DataFrame:
    """Classify arriving texts and extract the fields of invoices; a stateless stream."""
    scored = score(model, stream).withColumn("label", label_name(F.col("y_pred")))
    return extract_labelled(scored.select("doc_id", "text", "label", "confidence"))


def extract_labelled(docs: DataFrame) -> DataFrame:
    """Fields of documents labelled as invoices, null for all others, without a second pass.

    The text is blanked for other documents before the patterns see it, which keeps one stateless
    projection; a join of two branches would need stream state.
    """
    gated = docs.withColumn("_text", F.when(F.col("label") == "invoice", F.col("text")))
    return extract_fields(gated, text_col="_text").select("doc_id", "label", "confidence", *FIELD_ORDER)


def append_files(df: DataFrame, folder: str, checkpoint: str) -> None:
    """Write a stateless stream to parquet, each input file exactly once, until no input is left."""
    query = (
        df.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
