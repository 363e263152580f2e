"""Statistics of whole texts, one row per document, computed on the flat arrays of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.blocks import distinct, map_batches, mix, raw, row_of, split_words, sum_rows, text_blocks, whole_text, widened

WINDOW = 8
#: Counts of every whole text; `document_stats` returns them in this order as 64-bit numbers.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_same_next",
    "n_upper", "n_letters", "n_digits", "n_bangs", "n_bars", "n_ends", "n_marks", "n_chars", "n_short_words",
    "n_long_words", "n_capital_words",
)
SYMBOLS = b"#*$%&|<>"


def _flags(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_IS = {
    "n_symbols": _flags(SYMBOLS),
    "n_digits": _flags(b"0123456789"),
    "n_bangs": _flags(b"!"),
    "n_bars": _flags(b"|"),
    "n_ends": _flags(b".?!;:"),
    "n_marks": _flags(bytes(c for c in range(33, 127) if not chr(c).isalnum())),
    "n_chars": ~_flags(bytes(range(0x80, 0xC0))),
}
_UPPER, _LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_SPACE = _flags(b" \t\n\v\f\r")


def repeated_words(words: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in the row.

    Windows meet by a 64-bit hash; equal hashes are compared word by word, and rows where two different windows
    share a hash are done again on the windows themselves.
    """
    rows = row_of(offsets)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(len(offsets) - 1, np.int64)
    start = np.flatnonzero(rows[:n] == rows[window - 1 :])
    coded = mix(words)
    hashed = mix(rows[start])
    for k in range(window):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + coded[start + k]
    order = np.argsort(hashed)
    ordered, placed = hashed[order], start[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    left, right = placed[same], placed[same + 1]
    equal = rows[left] == rows[right]
    for k in range(window):
        equal &= words[left + k] == words[right + k]
    again = np.zeros(len(start), bool)
    again[same] = again[same + 1] = True
    edge = np.zeros(len(words) + 1, np.int64)
    hits = placed[again]
    edge[hits] += 1  # each place begins one window
    edge[hits + window] -= 1
    covered = sum_rows(np.cumsum(edge[:-1]) > 0, offsets)
    for row in np.unique(rows[np.concatenate([left[~equal], right[~equal]])]) if not equal.all() else ():
        a, b = offsets[row], offsets[row + 1]
        seen: dict[bytes, list[int]] = {}
        for p in range(a, b - window + 1):
            seen.setdefault(words[p : p + window].tobytes(), []).append(p - a)
        mark = np.zeros(b - a, bool)
        for places in seen.values():
            for p in places if len(places) > 1 else ():
                mark[p : p + window] = True
        covered[row] = mark.sum()
    return covered


def _duplicate_lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that are equal to an earlier line of the row; all lines of each row."""
    lists = pc.split_pattern(text, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    lines = lists.flatten()
    coded = lines.dictionary_encode()
    number, rows = coded.indices.to_numpy().astype(np.int64), row_of(offsets)
    data, ends = raw(coded.dictionary)
    with_word = sum_rows(~_SPACE[data], ends) > 0
    first = np.zeros(len(number), bool)
    first[np.unique(rows * (len(coded.dictionary) + 1) + number, return_index=True)[1]] = True
    return sum_rows(~first & with_word[number], offsets), np.diff(offsets)


def document_stats(text: pa.Array) -> dict[str, np.ndarray]:
    """`COUNTS` of each text.  Words are runs of characters other than the space and characters 9 to 13; null and
    empty texts have zeros."""
    data, ends = raw(text)
    out = {name: sum_rows(table[data], ends) for name, table in _IS.items()}
    two = data[:-1] == 0xC3  # capitals and small letters of the Latin-1 block
    upper, lower = _UPPER[data], _LOWER[data]
    upper[:-1] |= two & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    lower[:-1] |= two & (data[1:] >= 0x9F)
    out["n_upper"] = sum_rows(upper, ends)
    out["n_letters"] = out["n_upper"] + sum_rows(lower, ends)
    out["word_chars"] = sum_rows(_IS["n_chars"][data] & ~_SPACE[data], ends)
    words, dictionary, offsets = split_words(text)
    rows = row_of(offsets)
    out["n_words"] = np.diff(offsets)
    held, word_ends = raw(dictionary)
    chars = sum_rows(_IS["n_chars"][held], word_ends)
    capital = sum_rows(_UPPER[held], word_ends) * 2 > chars
    out["n_short_words"] = sum_rows((chars <= 2)[words], offsets)
    out["n_long_words"] = sum_rows((chars >= 20)[words], offsets)
    out["n_capital_words"] = sum_rows(capital[words], offsets)
    cells = distinct(rows * (len(dictionary) + 1) + words)
    out["n_distinct"] = np.bincount(cells // (len(dictionary) + 1), minlength=len(text))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    out["n_same_next"] = sum_rows(same, offsets)
    out["n_repeat_words"] = repeated_words(words, offsets)
    out["n_dup_lines"], out["n_lines"] = _duplicate_lines(text)
    return {name: out[name].astype(np.int64) for name in COUNTS}


def with_document_stats(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add the struct ``out`` of `COUNTS`; all rows and other columns stay as they are.  Map-only."""
    schema = widened(docs, out, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_blocks(batches, text_col):
            stats = document_stats(text)
            struct = pa.StructArray.from_arrays([pa.array(stats[c]) for c in COUNTS], names=list(COUNTS))
            yield pa.record_batch([*batch.columns, struct], [*batch.schema.names, out])

    return map_batches(docs, measure, schema)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def ratios(stats: Column) -> dict[str, Column]:
    """Named measures of one text from its counts, all finite; shares are 0 where there is nothing to divide by."""
    c = {name: stats.getField(name) for name in COUNTS}
    words, chars, letters = c["n_words"], c["n_chars"], c["n_letters"]
    return {
        "log_words": F.log1p(words.cast("double")),
        "mean_word": _share(c["word_chars"], words),
        "symbols_per_word": _share(c["n_symbols"], words),
        "dup_line_share": _share(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": _share(c["n_repeat_words"], words),
        "distinct_share": _share(c["n_distinct"], words),
        "same_next_share": _share(c["n_same_next"], words),
        "upper_share": _share(c["n_upper"], letters),
        "letter_share": _share(letters, chars),
        "digit_share": _share(c["n_digits"], chars),
        "bangs_per_word": _share(c["n_bangs"], words),
        "bars_per_word": _share(c["n_bars"], words),
        "ends_per_word": _share(c["n_ends"], words),
        "mark_share": _share(c["n_marks"], chars),
        "short_share": _share(c["n_short_words"], words),
        "long_share": _share(c["n_long_words"], words),
        "capital_share": _share(c["n_capital_words"], words),
        "words_per_line": F.log1p(_share(words, c["n_lines"])),
    }


__all__ = ["COUNTS", "document_stats", "ratios", "repeated_words", "whole_text", "with_document_stats"]
