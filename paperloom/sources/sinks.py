"""Writing results to the shared folder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.schemas import SPLITS, TEXT_CACHE_SCHEMA
from paperloom.session import shared_folder
from paperloom.sources.files import located


def write_split(df: DataFrame, root: str) -> None:
    """Images and labels, one folder per split, so that a split is read without the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(root)


def write_and_read(df: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Write to a fresh folder and read back with the known schema; the old data is never overwritten."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    df.write.format(fmt).save(folder)
    return spark.read.format(fmt).schema(df.schema).load(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Store a costly intermediate table in the shared folder and go on from there: it is computed
    once, and a lost executor costs a re-read rather than a recomputation."""
    return write_and_read(df)


def write_text_cache(entries: DataFrame, folder: str) -> None:
    """Entries as JSON text caches, one list per task and file, that `read_text_cache` reads.  A task passes its rows on
    as they come, so a list may be of any length."""
    row = F.to_json(F.struct(*TEXT_CACHE_SCHEMA.names), {"ignoreNullFields": "false"}).alias("value")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            values = batch.column(0).to_pylist()
            if values:
                values[0] = (", " if begun else "[") + values[0]
                values[1:] = [f", {v}" for v in values[1:]]
                begun = True
                yield pa.record_batch([pa.array(values, pa.string())], ["value"])
        if begun:
            yield pa.record_batch([pa.array(["]"])], ["value"])

    entries.select(row).mapInArrow(listed, "value string").write.text(folder)


def gray_png(px: np.ndarray) -> bytes:
    """A PNG file of one 8-bit gray channel, from an array of height x width levels."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = px.shape
    lines = np.hstack([np.zeros((height, 1), np.uint8), px.astype(np.uint8)])  # each line begins with filter 0
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_image_tree(images: DataFrame, root: str, name_col: str = "file_name") -> int:
    """Write images as ``{root}/{split}/{label_name}/{file_name}`` and return how many files there are.

    ``images`` has ``split, label_name, width, height, px`` (levels as binary or a list) and the file's name, each path
    once.  Each task writes the files of its own rows; a repeated attempt writes the same bytes again.  Rows with
    a null in one of these columns have no file.  The folder of each known split exists afterwards.
    """
    columns = ["split", "label_name", name_col, "width", "height", "px"]

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = located(root)
        for pdf in batches:
            for split, label, name, width, height, px in pdf.itertuples(index=False):
                levels = np.frombuffer(px, np.uint8) if isinstance(px, bytes | bytearray) else np.asarray(px)
                fs.create_dir(f"{base}/{split}/{label}", recursive=True)
                with fs.open_output_stream(f"{base}/{split}/{label}/{name}") as out:
                    out.write(gray_png(levels.reshape(int(height), int(width))))
            yield pd.DataFrame({"n": [len(pdf)]})

    fs, base = located(root)
    for split in SPLITS:
        fs.create_dir(f"{base}/{split}", recursive=True)
    rows = images.select(*[F.col(f"`{c}`") for c in columns]).dropna()
    return rows.mapInPandas(save, "n bigint").agg(F.sum("n")).first()[0] or 0
