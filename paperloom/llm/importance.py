"""Importance resampling towards a target: hashed word runs of corpus and target give each document a log weight, and a
seeded draw without replacement keeps the documents of highest weight plus noise."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import map_batches, narrow, sum_rows, text_blocks
from paperloom.operators.ranking import number_in_group
from paperloom.sources.sinks import materialise

BUCKETS = 10_000
GRAMS = 2
SHARE_PERCENT = 25
LEAST_WORDS = 20
SEED = 7
PIECE = 1 << 20  # bytes of a text that are split at a time


def word_table() -> bytes:
    """Single bytes of UTF-8: letters A-Z become lower case, digits, a-z and bytes of longer characters stay, all
    others become blanks."""
    table = bytearray(b" " * 256)
    table[0x80:] = range(0x80, 256)
    for b in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[b] = b
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    return bytes(table)


TABLE = word_table()


def pieces(data: bytes, limit: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about ``limit`` bytes, cut at blanks only."""
    start = 0
    while len(data) - start > limit:
        cut = data.find(b" ", start + limit)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:]


def features(text: str, grams: int = GRAMS, limit: int = PIECE) -> tuple[np.ndarray, int]:
    """crc32 of every run of 1 to ``grams`` words of a whole text, joined by one space, repeats kept; the word count.

    The sum of a run is the seed for the run that is one word longer, so no run is ever put together.
    """
    out, held, count = [], [], 0
    for piece in pieces(text.encode().translate(TABLE), limit):
        words = held + piece.split()
        fresh = len(words) - len(held)
        spaced = [b" " + w for w in words]
        sums = list(map(crc32, words))
        for k in range(grams):
            if k:
                sums = list(map(crc32, spaced[k:], sums))
            again = max(len(held) - k, 0)  # runs that lie in the words held from the piece before
            out.append(np.fromiter(sums[again:], np.uint32, len(sums) - again))
        count += fresh
        held = words[len(words) - (grams - 1) :] if grams > 1 else []
    return np.concatenate(out), count


def bucketed(docs: DataFrame, grams: int, buckets: int) -> DataFrame:
    """``id, n_words, buckets`` (one entry per feature) of every row with columns ``id, text``.  Map-only."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_blocks(batches, "text"):
            found = [features(t, grams) for t in text.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(hashes) for hashes, _ in found])])
            flat = (np.concatenate([hashes for hashes, _ in found]) % buckets).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            words = pa.array([n for _, n in found], pa.int64())
            yield pa.record_batch([batch.column(0), words, lists], ["id", "n_words", "buckets"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, split, f"id {kind}, n_words bigint, buckets array<int>")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: a counter per task, summed by bucket.  ``buckets`` numbers reach the
    driver, whatever the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            flat = batch.column(0).flatten()
            for start in range(0, len(flat), PIECE):
                seen.update(flat.slice(start, PIECE).to_pylist())
        yield pa.record_batch({"bucket": pa.array(list(seen), pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})

    summed = map_batches(rows.select("buckets"), count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to corpus share of each bucket, rounded down."""
    buckets, in_corpus, in_target = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float(t + 1) * (in_corpus + buckets) / (float(s + 1) * (in_target + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id, n_words, n_features, weight``: the mean gain of a row's features, rounded down; 0 without features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            n = np.diff(ends)
            total = sum_rows(gain[lists.flatten().to_numpy()], ends - ends[0])
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.record_batch(columns, ["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_features bigint, weight bigint"
    return map_batches(rows.select("id", "n_words", "buckets"), weigh, schema)


def noise(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw, a function of seed and id alone, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    share_percent: int = SHARE_PERCENT,
    least_words: int = LEAST_WORDS,
    grams: int = GRAMS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """``id_col, n_features, weight, score, rank`` of every row of ``docs``, all numbers long.

    ``weight`` is the mean gain of the row's features, ``score`` adds seeded noise.  Of the N rows with at least
    ``least_words`` words and an id, ``floor(share_percent * N / 100)`` of highest score are drawn and numbered from
    1; ``rank`` is null for the others.  Whole texts are split once: their buckets are stored and read again by the
    counts over all rows and by the weights.  Numbering goes by ranges of the score, never in one task.

    Null, empty and word-less texts have no features and weight 0.  Rows without an id get a weight, count in the
    corpus and are never drawn (score and rank null).  Equal scores go to the smaller id; repeated rows are rows of
    their own.  An empty corpus gives no rows; an empty target leaves only the corpus' own shares.
    """
    corpus = materialise(bucketed(narrow(docs, id=id_col, text=text_col), grams, buckets))
    wanted = bucketed(narrow(target, text=target_text_col).select(F.lit(None).cast("bigint").alias("id"), "text"), grams, buckets)
    gain = gains(bucket_counts(corpus, buckets), bucket_counts(wanted, buckets))
    scored = weighted(corpus, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    may = F.col("id").isNotNull() & (F.col("n_words") >= least_words)
    placed = number_in_group(
        scored.where(may).withColumn("_down", -F.col("score")), [], ["_down", "id", "n_features", "weight"], "_at"
    )
    drawn = corpus.where(may).count() * share_percent // 100
    rank = F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("bigint")
    columns = (F.col("id").alias(id_col), "n_features", "weight", "score")
    rest = scored.where(~may).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return placed.select(*columns, rank.alias("rank")).unionByName(rest)
