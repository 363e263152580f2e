"""Text columns of Arrow batches as flat arrays, so that whole texts are handled without a loop over words.

Every helper takes nulls as empty texts and works on blocks of a bounded number of text bytes (one longer
text forms a block of its own).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
WIDE_BLOCK_BYTES = 4 << 20  # where the distinct words of a block are the cost

_SAME = np.arange(256, dtype=np.uint8)
# The separators of a word are the space and the characters 9 to 13.
SPACED = _SAME.copy()
SPACED[9:14] = 32
SPACED_LOWER = SPACED.copy()
SPACED_LOWER[65:91] += 32


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names an operator works with; other columns can't clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def widened(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of ``df`` with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` on Arrow batches of about `BATCH_BYTES` at most, however long the rows are (a longer row is a
    batch by itself).  The session keeps this bound, or its own if that is lower.  Memory that Arrow holds in reserve
    goes back to the system when a task ends, so that stages of a pipeline don't add up in a worker."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(_BATCH_CONF))) > BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def whole_text(column: pa.Array) -> pa.Array:
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its rows in them."""
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    _, offsets, data = text.buffers()
    ends = np.frombuffer(offsets, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with their texts, of at most ``limit`` bytes unless one text is longer."""
    for batch in batches:
        text = whole_text(batch.column(batch.schema.get_field_index(column)))
        _, ends = raw(text)
        start = 0
        while start < len(text):
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start), text.slice(start, stop - start)
            start = stop


def translate(text: pa.Array, table: np.ndarray) -> pa.Array:
    """Single-byte characters replaced by a table of 256 entries."""
    data, ends = raw(text)
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(ends), pa.py_buffer(table[data]))


def split_words(text: pa.Array, table: np.ndarray = SPACED) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all rows: their numbers in a dictionary, the dictionary, and each row's offset."""
    lists = pc.split_pattern(translate(text, table), " ")
    filled = pc.not_equal(lists.values, "").to_numpy(zero_copy_only=False)
    coded = lists.values.filter(pa.array(filled)).dictionary_encode()
    before = np.concatenate([[0], np.cumsum(filled)])
    return coded.indices.to_numpy(), coded.dictionary, before[lists.offsets.to_numpy()]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sum_rows(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the elements of each row; rows may be empty."""
    if values.dtype == bool:
        return np.diff(np.searchsorted(np.flatnonzero(values), offsets))
    running = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in rising order."""
    ordered = np.sort(values)
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return ordered[fresh]


def take_ranges(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given ranges of ``flat``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
