"""Token-ID output: documents as one stream of ids per file, cut into equal-length sequences with masks.

Each file is Arrow's random-access IPC form.  A row is one sequence: ``ids``, a fixed-size list of 16-bit numbers
(32-bit for vocabularies over 65,536), and ``mask``, a fixed-size list of bits that are false on the padding of the
last sequence.  All batches but the last have the same number of rows, so sequence ``i`` lies in batch
``i // rows`` and is a view of the mapped file.  A second file per part tells where each document starts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.blocks import WIDE_BLOCK_BYTES, map_batches, narrow, text_blocks
from paperloom.llm.codecs import BytePairCodec, model_bytes, shared
from paperloom.llm.storage import attempt_name, create, open_read
from paperloom.session import shared_folder
from paperloom.sources.sinks import materialise

SEQUENCE = 2048
ROWS = 128
MANIFEST = "part int, file string, n_docs bigint, n_tokens bigint"


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Collects ids and writes a batch whenever ``rows`` sequences are full."""

    def __init__(self, sink: pa.NativeFile, length: int, rows: int, wide: bool) -> None:
        self.schema = sequence_schema(length, wide)
        self.length, self.rows, self.kind = length, rows, np.uint32 if wide else np.uint16
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def _batch(self, ids: np.ndarray) -> None:
        fill = -len(ids) % self.length
        mask = np.ones(len(ids) + fill, bool)
        mask[len(ids) :] = False
        ids = np.concatenate([ids, np.zeros(fill, self.kind)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n += len(ids)
        full = self.length * self.rows
        if self.n >= full:
            joined = np.concatenate(self.held)
            whole = self.n // full * full
            for start in range(0, whole, full):
                self._batch(joined[start : start + full])
            self.held, self.n = [joined[whole:]], self.n - whole

    def close(self) -> None:
        if self.n:
            self._batch(np.concatenate(self.held))
        self.writer.close()


class SequenceFile:
    """Reads sequences and token ranges of one file; on a mapped file they are views of it."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0
        self._at, self._flat = -1, None

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.reader.get_batch(i // self.rows)
        row = i % self.rows
        return self._ids(batch)[row * self.length : (row + 1) * self.length], batch.column("mask")[row].values

    @staticmethod
    def _ids(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("ids").flatten().to_numpy(zero_copy_only=True)

    def tokens(self, start: int, count: int) -> np.ndarray:
        span, parts = self.rows * self.length, []
        while count:
            number, skip = divmod(start, span)
            if number != self._at:
                self._at, self._flat = number, self._ids(self.reader.get_batch(number))
            part = self._flat[skip : skip + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    length: int = SEQUENCE,
    rows: int = ROWS,
) -> tuple[str, DataFrame]:
    """Encode whole texts and write the ids, each document followed by ``end_id``, in ascending id order.

    One shuffle brings the documents into id ranges; each range becomes one part of files.  Returns the folder and
    the manifest (part, file, n_docs, n_tokens).  Null and empty texts give the end id alone, rows without an id
    come first, rows of the same id are ordered by a hash of their text (by which they spread over ranges) and the
    text, an empty table gives no file.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    held = spark.sparkContext.broadcast(model_bytes(vocabulary).decode())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = shared(BytePairCodec, held.value)
        wide = codec.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        part, writer, starts, total, docs_seen = TaskContext.get().partitionId(), None, None, 0, 0
        for batch, text in text_blocks(batches, "text", WIDE_BLOCK_BYTES):
            if writer is None:
                name = attempt_name(part, ".arrow")
                ids_sink, index_sink = create(folder, name), create(folder, name + ".index")
                writer = SequenceWriter(ids_sink, length, rows, wide)
                schema = index_schema(batch)
                starts = pa.ipc.new_file(index_sink, schema)
            ids, ends = codec.rows(text)
            ids = np.insert(ids, ends[1:], end_id)
            sizes = np.diff(ends) + 1
            begin = total + np.cumsum(sizes) - sizes
            starts.write_batch(pa.record_batch([batch.column(0), pa.array(begin), pa.array(sizes)], schema=schema))
            writer.add(ids)
            total, docs_seen = total + len(ids), docs_seen + len(text)
        if writer is not None:
            writer.close()
            starts.close()
            ids_sink.close()
            index_sink.close()
            yield pa.record_batch(
                {"part": pa.array([part], "int32"), "file": [name], "n_docs": [docs_seen], "n_tokens": [total]}
            )

    ordered = (
        narrow(docs, id=id_col, text=text_col)
        .withColumn("turn", F.xxhash64("text"))
        .repartitionByRange("id", "turn")
        .sortWithinPartitions("id", "turn", "text")
        .select("id", "text")
    )
    return folder, materialise(map_batches(ordered, write, MANIFEST))


def index_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([("id", batch.schema.field("id").type), ("start", "int64"), ("n", "int64")])


def with_starts(manifest: DataFrame) -> DataFrame:
    """Ids before each part; one row per part meets in the running sum."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_index(folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: id, ``start`` (ids of all documents before it), ``n_tokens`` and the unsigned
    crc32 of its ids as little-endian 32-bit numbers.  One task per part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["file", "before"]).to_pylist():
                index = pa.ipc.open_file(open_read(folder, row["file"] + ".index"))
                tokens = SequenceFile(open_read(folder, row["file"]))
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    starts, sizes = part.column("start").to_numpy(), part.column("n").to_numpy()
                    sums = [
                        zlib.crc32(tokens.tokens(a, n).astype("<u4"))
                        for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)
                    ]
                    yield pa.record_batch(
                        {
                            "id": part.column("id"),
                            "start": pa.array(starts + row["before"]),
                            "n_tokens": pa.array(sizes),
                            "ids_crc32": pa.array(sums, pa.int64()),
                        }
                    )

    parts = max(1, manifest.count())
    dealt = with_starts(manifest).repartition(parts, "part")
    return map_batches(dealt, read, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
