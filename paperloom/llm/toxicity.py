"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.blocks import (
    WIDE_BLOCK_BYTES, map_batches, narrow, raw, row_of, split_words, sum_rows, text_blocks, widened,
)
from paperloom.llm.labelled import CALIBRATION_FOLD, FOLDS, fold, isotonic_steps, training_labels
from paperloom.sources.sinks import materialise

LEXICON_FOLDS = (1, 2)  # learned from by the first lexicon alone; the fold after them fits the trees
FIT_DOCS = 50_000  # labelled documents of the other folds that trees and steps are fitted on
LEXICON_DOCS = 6_000  # labelled documents of each class that the lexicon is learned from
LEXICON_ENTRIES = 4_000
LEAST_SUPPORT = 4
LEAST_RATIO = 8.0
PREFIXES = (4, 5, 6)
WORD_GAP = r"[\x20\x09-\x0D]+"
TREES, DEPTH = 20, 3
NEAR = 4
# Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted "
    "ustedes vosotros".split()
)
# Signs that stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
FEATURES = (
    "lexicon_share", "lexicon_hits", "prefix_share", "prefix_hits", "weight_share", "weight_max", "near_second_person",
    "second_person_share", "capital_share", "capital_hits", "mark_share", "bang_share", "obfuscated_share",
    "obfuscated_hits", "log_words",
)
_INNER = re.compile(r"[^\W\d_][\d@$!*#._\-]+[^\W\d_]")


@dataclass(frozen=True)
class Lexicon:
    """Log ratios of words and of word beginnings that toxic documents hold more often."""

    words: dict[str, float]
    prefixes: dict[str, float]

    def prefix(self, word: str) -> float:
        return max((self.prefixes.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n), default=0.0)


def letters(word: str) -> str:
    return re.sub(r"[\W\d_]+", "", word).lower()


def plain_form(word: str) -> str:
    """The word without the signs that hide its letters."""
    return letters(word.strip(".,;:!?\"'()").translate(LEET))


def learn_lexicon(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...]) -> Lexicon:
    """Terms by document counts in a bounded sample of labelled documents of each class in ``folds``.

    The sample is the `LEXICON_DOCS` rows of each class with the smallest hash of their id; its ids are few enough to
    be sent to all executors, so no text is shuffled.
    """
    rows = materialise(labelled_rows(labels, folds))
    sample = None
    for value in (0.0, 1.0):
        part = rows.where(F.col("label") == value).orderBy("h", "id").limit(LEXICON_DOCS).select("id", "label")
        sample = part if sample is None else sample.unionByName(part)
    sample = materialise(sample)
    texts = docs.select(F.col("id"), "text").join(F.broadcast(sample), "id")
    words = F.transform(
        F.split(F.lower(F.coalesce("text", F.lit(""))), WORD_GAP), lambda w: F.regexp_replace(w, r"(?U)[\W\d_]+", "")
    )
    words = texts.select("label", F.filter(words, lambda w: F.length(w) > 2).alias("w"))
    kinds = [F.transform("w", lambda w: F.concat(F.lit("w"), w)), *map(_beginnings, PREFIXES)]
    terms = words.select("label", F.explode(F.array_distinct(F.concat(*kinds))).alias("term"))
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not bad:
        return Lexicon({}, {})
    ratio = (F.col("a") / F.lit(float(bad))) / ((F.col("n") - F.col("a") + 0.5) / F.lit(good + 1.0))
    found = (
        terms.groupBy("term")
        .agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"))
        .where((F.col("a") >= LEAST_SUPPORT) & (ratio >= LEAST_RATIO))
        .select("term", "a", ratio.alias("ratio"))
        .orderBy(F.desc(F.col("a") * F.log("ratio")), "term")
        .limit(LEXICON_ENTRIES)
        .collect()
    )
    pick = lambda kind: {r["term"][1:]: log(r["ratio"]) for r in found if r["term"][0] == kind}
    return Lexicon(pick("w"), pick("p"))


def labelled_rows(labels: DataFrame, folds: tuple[int, ...]) -> DataFrame:
    """``id, label, h`` of the labelled rows in ``folds``; ``h`` is a hash of the id."""
    return training_labels(labels, "toxic").where(fold("id").isin(*folds)).withColumn("h", F.xxhash64("id"))


def _beginnings(length: int) -> Column:
    long = F.filter("w", lambda w: F.length(w) >= length)
    return F.transform(long, lambda w: F.concat(F.lit("p"), F.substring(w, 1, length)))


def toxic_features(text: pa.Array, lexicon: Lexicon, known: dict[str, tuple]) -> np.ndarray:
    """`FEATURES` of each text; distinct words are looked up once, ``known`` keeps them between blocks."""
    number, dictionary, offsets = split_words(text)
    if len(known) > 200_000:
        known.clear()
    seen = []
    for w in dictionary.to_pylist():
        got = known.get(w)
        if got is None:
            low = letters(w)
            hit, head = lexicon.words.get(low, 0.0), lexicon.prefix(low)
            hidden = bool(_INNER.search(w))
            shown = lexicon.words.get(plain_form(w), 0.0) if hidden and not hit else 0.0
            upper = len(low) > 2 and w.upper() == w
            got = known[w] = (hit, head, hidden, shown, upper, low in SECOND_PERSON)
        seen.append(got)
    table = np.array(seen, float).reshape(-1, 6)[number]
    hit, head, hidden, shown, upper, second = table.T
    rows, n = row_of(offsets), np.maximum(np.diff(offsets), 1)
    weight = np.maximum(np.maximum(hit, shown), head)
    listed = (hit > 0) | (shown > 0)
    near = np.zeros(len(number), bool)
    spoken = second > 0
    for k in range(1, NEAR + 1):
        if len(number) > k:
            same = rows[k:] == rows[:-k]
            near[k:] |= spoken[:-k] & same
            near[:-k] |= spoken[k:] & same
    top = np.zeros(len(text))
    np.maximum.at(top, rows[weight > 0], weight[weight > 0])
    data, ends = raw(text)
    size = np.maximum(np.diff(ends), 1)
    marks = ((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64))
    total = lambda x: sum_rows(np.ascontiguousarray(x), offsets)
    return np.column_stack([
        total(listed) / n, total(listed), total(head > 0) / n, total(head > 0), total(weight) / n, top,
        total((weight > 0) & near) / n, total(spoken) / n, total(upper > 0) / n, total((upper > 0) & (weight > 0)),
        sum_rows(marks, ends) / size, sum_rows(data == 33, ends) / size, total(hidden > 0) / n, total(shown > 0),
        np.log1p(np.diff(offsets)),
    ])


def with_toxic_features(docs: DataFrame, lexicon: Lexicon, text_col: str, out: str) -> DataFrame:
    """Add the array ``out`` of `FEATURES`; other columns stay.  Map-only."""
    schema = widened(docs, out, T.ArrayType(T.DoubleType()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch, text in text_blocks(batches, text_col, WIDE_BLOCK_BYTES):
            x = toxic_features(text, lexicon, known)
            ends = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
            column = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
            yield pa.record_batch([*batch.columns, column], [*batch.schema.names, out])

    return map_batches(docs, measure, schema)


def calibrated(margins: DataFrame, steps: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``id, score`` of rows ``id, raw``: the step that a margin is on, with a hundredth of the margin's own order."""
    at, value = steps
    spread = float(at[-1] - at[0]) or 1.0

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_score = batch.column(1).to_numpy()
            level = value[np.maximum(np.searchsorted(at, raw_score, "right") - 1, 0)]
            rank = np.clip((raw_score - at[0]) / spread, 0.0, 1.0)
            yield pa.record_batch([batch.column(0), pa.array(0.99 * level + 0.01 * rank)], ["id", "score"])

    kind = margins.schema["id"].dataType.simpleString()
    return map_batches(margins.select("id", "raw"), look_up, f"id {kind}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score``: one row per document, the score higher where label 1 is likelier.

    Only labelled rows that are not held out are learned from.  Trees and isotonic steps are fitted on folds of their
    own (of at most `FIT_DOCS` rows, those of smallest hash), on features under a lexicon of the other folds, so that
    they see features of documents that their lexicon was not learned from; scores then use a lexicon of all of these
    folds.  Null and empty texts have zero features; repeated rows score alike; rows without an id are scored and never
    learned from; without labelled rows of both classes every score is 0; an empty table gives no rows.
    """
    rows = narrow(docs, id=id_col, text=text_col)
    everything = tuple(range(1, FOLDS))
    others = tuple(f for f in everything if f not in LEXICON_FOLDS)
    fitted = materialise(labelled_rows(labels, others).orderBy("h", "id").limit(FIT_DOCS).select("id", "label"))
    known = with_toxic_features(rows.join(F.broadcast(fitted), "id"), learn_lexicon(rows, labels, LEXICON_FOLDS), "text", "x")
    learned = materialise(known.select(array_to_vector("x").alias("features"), "label", fold("id").alias("fold")))
    part = learned.where(F.col("fold") != CALIBRATION_FOLD)
    if part.agg(F.count_distinct("label")).first()[0] < 2:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.2, seed=7).fit(part)
    margin = vector_to_array("rawPrediction")[1]
    held = model.transform(learned.where(F.col("fold") == CALIBRATION_FOLD)).select(margin.alias("raw"), "label")
    steps = isotonic_steps(materialise(held))
    measured = with_toxic_features(rows, learn_lexicon(rows, labels, everything), "text", "x").select("id", "x")
    scored = model.transform(measured.withColumn("features", array_to_vector("x")))
    return calibrated(scored.select("id", margin.alias("raw")), steps).withColumnRenamed("id", id_col)
