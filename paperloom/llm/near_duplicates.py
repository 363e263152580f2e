"""Near-duplicates by b-bit MinHash: bands propose pairs, packed low bits estimate, whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.blocks import SPACED_LOWER, distinct, map_batches, mix, narrow, split_words, text_blocks
from paperloom.sources.sinks import materialise

ROWS = 4  # minima in a band
BANDS = 28  # a pair of similarity 0.8 shares a band with probability 1 - 4e-7
BITS = 2  # low bits kept of each minimum
MARGIN = 5.5  # standard deviations of the estimate below the threshold that are still confirmed on whole sets
PARITY_BITS = 512
PARITIES = [f"b{i}" for i in range(PARITY_BITS // 64)]
PART = 1 << 17  # shingles hashed at a time
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(text: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles; a shorter text is one shingle by itself."""
    number, dictionary, offsets = split_words(text, SPACED_LOWER)
    coded = np.fromiter((xxhash.xxh64_intdigest(w) for w in dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(dictionary))
    words = mix(coded)[number]
    rolled = np.zeros(max(len(words) - shingle + 1, 0), np.uint64)
    for k in range(shingle):
        rolled = rolled * _MULTIPLIER + words[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(distinct(rolled[a : b - shingle + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole = mix(whole * _MULTIPLIER + w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(sets: list[np.ndarray], count: int, seed: int = 1) -> np.ndarray:
    """For each non-empty set the smallest value under each of ``count`` hash functions."""
    draw = np.random.default_rng(seed)
    factor = draw.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 1 << 63, count, np.uint64)
    out = np.empty((len(sets), count), np.uint64)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sets):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + PART, "right")))
        joined = np.concatenate(sets[start:stop])
        begins = ends[start:stop] - sizes[start:stop] - base
        for k in range(count):
            out[start:stop, k] = np.minimum.reduceat(joined * factor[k] + shift[k], begins)
        start = stop
    return out


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of each minimum as bit planes of 64-bit words, ``bits`` planes one after the other."""
    count = values.shape[1]
    words = -(-count // 64)
    out = np.zeros((len(values), bits * words), np.int64)
    for plane in range(bits):
        low = ((values >> np.uint64(plane)) & np.uint64(1)).astype(np.uint8)
        padded = np.zeros((len(values), words * 64), np.uint8)
        padded[:, :count] = low
        out[:, plane * words : (plane + 1) * words] = np.packbits(padded, axis=1, bitorder="little").view("<i8")
    return out


def _words_per_plane(bands: int, rows: int) -> int:
    return -(-bands * rows // 64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, bits: int) -> DataFrame:
    """``id, n, d0, d1`` (digest of the set), packed planes ``p0..`` and ``bands`` of every document.  Map-only."""
    planes = [f"p{i}" for i in range(bits * _words_per_plane(bands, rows))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in text_blocks(batches, "text"):
            sets = shingle_sets(text, shingle)
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            low = minima([sets[i] for i in some], bands * rows)
            digest = np.zeros((len(sets), 2), np.int64)
            for i in some:
                digest[i] = np.frombuffer(xxhash.xxh128_digest(sets[i].tobytes()), "<i8")
            bit = np.zeros((len(sets), len(planes)), np.int64)
            bit[some] = packed(low, bits)
            keys = np.zeros((len(some), bands), np.uint64)
            for k in range(rows):
                keys = mix(keys * _MULTIPLIER + low[:, k::rows] + np.arange(bands, dtype=np.uint64))
            ends = np.concatenate([[0], np.cumsum((sizes > 0) * bands)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            columns = [batch.column(0), pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
            yield pa.record_batch(
                [*columns, *(pa.array(bit[:, i]) for i in range(len(planes))), lists],
                ["id", "n", "d0", "d1", *planes, "bands"],
            )

    longs = "".join(f", {p} bigint" for p in planes)
    return map_batches(docs, sign, f"id bigint, n bigint, d0 bigint, d1 bigint{longs}, bands array<bigint>")


def estimated(left: list[Column], right: list[Column], count: int, bits: int) -> Column:
    """Similarity from the share of minima with equal low bits, corrected for bits that are equal by chance."""
    words = len(left) // bits
    unlike = []
    for w in range(words):
        planes = [left[p * words + w].bitwiseXOR(right[p * words + w]) for p in range(bits)]
        unlike.append(F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), planes)))
    equal = 1 - reduce(lambda a, b: a + b, unlike) / float(count)
    return (equal - 2.0**-bits) / (1 - 2.0**-bits)


def lowest_estimate(similarity: float, count: int, bits: int, margin: float = MARGIN) -> float:
    chance = 2.0**-bits
    equal = chance + (1 - chance) * similarity
    return similarity - margin * (equal * (1 - equal) / count) ** 0.5 / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """``id, comp``: the smallest id reachable over ``edges`` (a, b), for all ids in them.

    Each round takes the smallest label among neighbours and then the label of one's label, which halves the
    distances; every round is stored once, so that lost executors cost a re-read.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialise(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp"))
    )
    while True:
        heard = (
            both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("heard"))
        )
        lower = labels.join(heard.withColumnRenamed("a", "id"), "id").select(
            "id", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp")
        )
        of = lower.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        jumped = materialise(lower.join(of, "comp").select("id", "was", F.col("next").alias("comp")))
        labels = jumped.select("id", "comp")
        if not jumped.where("comp != was").limit(1).count():
            return labels


def roots(parents: DataFrame) -> DataFrame:
    """``id, comp``: the root above each ``a`` whose parent ``b`` is a smaller id.  Each round doubles the steps."""
    rows = parents.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    while True:
        up = rows.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        step = rows.join(up, "comp", "left").select(
            "id", F.coalesce("next", "comp").alias("comp"), F.col("next").isNotNull().alias("moved")
        )
        step = materialise(step)
        rows = step.select("id", "comp")
        if not step.where("moved").limit(1).count():
            return rows


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """`PARITY_BITS` bits of each set, as 64-bit words: whether an odd number of its hashes falls on the bit.

    A hash that is in one of two sets only changes one bit, so two sets differ in at least as many hashes as their bits
    do: a bound that needs no test of the sets and is never wrong.
    """
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (np.concatenate(sets) & np.uint64(PARITY_BITS - 1)).astype(np.int64) if sets else np.zeros(0, np.int64)
    odd = (np.bincount(row * PARITY_BITS + at, minlength=len(sets) * PARITY_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), PARITY_BITS), axis=1, bitorder="little").view("<i8")


class _Sets:
    """Whole shingle sets of the documents that a band has proposed, and the exact test of pairs of them."""

    def __init__(self, docs: DataFrame, proposed: DataFrame, shingle: int, percent: int) -> None:
        self.percent = percent

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, text in text_blocks(batches, "text"):
                sets = shingle_sets(text, shingle)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                bits = parities(sets)
                columns = [batch.column(0), lists, pa.array(np.diff(ends)), *(pa.array(b) for b in bits.T.copy())]
                yield pa.record_batch(columns, ["id", "items", "n", *PARITIES])

        found = docs.join(proposed, "id", "left_semi")
        self.sets = materialise(map_batches(found, collect, f"id bigint, items array<bigint>, n bigint, {', '.join(f'{b} bigint' for b in PARITIES)}"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the similarity."""
        left = self.sets.select(F.col("id").alias("a"), F.col("items").alias("left"), F.col("n").alias("na"))
        right = self.sets.select(F.col("id").alias("b"), F.col("items").alias("right"), F.col("n").alias("nb"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")
        shared = F.size(F.array_intersect("left", "right"))
        return materialise(
            both.where(100 * shared >= self.percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")
        )


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    shingle: int = 4,
    bands: int = BANDS,
    rows: int = ROWS,
    bits: int = BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every row.

    Documents of equal sets form a class and go on as its smallest id.  Classes that share a band form buckets, and the
    smallest class of a bucket is its hub.  (1) Each class is tested against one of the hubs of its buckets, the one of
    highest estimate that is not clearly too low; these links form trees.  (2) In buckets that still hold several
    trees, classes of different trees meet on their rarest shingles (`_across`), which finds every link between
    trees; (3) the found links join the trees.  No proposed link between different components goes unseen, and no
    bucket is expanded into all its pairs.  Every test is on whole sets of 64-bit shingle hashes.

    Null, empty and word-less texts have no shingles, are linked with nothing and stay.  Rows without an id stay,
    with a null component.  Repeated rows share their id and component.  Ties go to the smaller id.  An empty table
    gives no rows.
    """
    source = narrow(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint"))
    planes = [f"p{i}" for i in range(bits * _words_per_plane(bands, rows))]
    count = bands * rows
    least = lowest_estimate(percent / 100, count, bits)
    signed = materialise(signatures(source, shingle, bands, rows, bits))
    usable = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = materialise(
        usable.groupBy("d0", "d1").agg(
            F.min("id").alias("rep"), F.first("n").alias("n"), *(F.first(p).alias(p) for p in planes)
        )
    )
    reps = classes.select(F.col("rep").alias("id"), "d0", "d1")
    banded = usable.join(reps, ["id", "d0", "d1"], "left_semi").select("id", "n", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    members = materialise(banded.join(hubs.select("key", "hub"), "key"))
    whole = _Sets(source, members.select("id").distinct(), shingle, percent)

    def sketch(side: str) -> DataFrame:
        own = [F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(p).alias(f"{p}_{side}") for p in planes)]
        return classes.select(*own)

    left, right = ([F.col(f"{p}_{side}") for p in planes] for side in "ab")
    alike = estimated(left, right, count, bits)
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = members.where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    likely = pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(sizes & (alike >= least))
    trees = roots(whole.linked(likely.groupBy("a").agg(F.max_by("b", alike).alias("b"))))
    met = _across(members, trees, whole.sets, percent)
    labels = trees if met is None else _joined(trees, whole.linked(met))
    of_class = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "d0", "d1", F.coalesce("comp", "rep").alias("component_id")
    )
    joined = signed.select("id", "n", "d0", "d1").join(of_class, ["d0", "d1"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


def _divided(members: DataFrame, trees: DataFrame) -> DataFrame:
    """``key, id, n, comp, least, main`` of the buckets that hold several trees: the least size in the bucket and the
    tree of its hub."""
    rows = members.join(trees, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    several = rows.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.min_by("comp", "id").alias("main")
    )
    return rows.join(several.where("low != high").select("key", "least", "main"), "key")


def _joined(trees: DataFrame, links: DataFrame) -> DataFrame:
    """Labels of ``trees`` (id, comp) after ``links`` between them: only the roots that links touch are worked on."""
    if not links.limit(1).count():
        return trees
    ends = links
    for side in "ab":
        root = trees.select(F.col("id").alias(side), F.col("comp").alias(f"root_{side}"))
        ends = ends.join(root, side, "left").withColumn(side, F.coalesce(f"root_{side}", side)).drop(f"root_{side}")
    above = components(ends.where("a != b").distinct())
    lifted = trees.join(above.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left")
    fresh = above.join(trees.select("id"), "id", "left_anti")
    return lifted.select("id", F.coalesce("top", "comp").alias("comp")).unionByName(fresh)


def _across(members: DataFrame, trees: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Pairs between different trees of one bucket, enough of them to find every link between trees; None if no bucket
    holds several.

    Only shingles that classes of different trees share add to an overlap that counts here.  Of the classes of a tree
    that have the same shared shingles the smallest is at least as similar to any class of another tree, so it stands
    for them; in a large group of copies with few edits each, the classes that stand are far fewer than the copies.

    All shingles have one order, the rarest first.  Two sets of m and n that are linked share at least
    ``percent / (100 + percent) * (m + n)`` shingles, and the smallest class of its buckets bounds a partner's size from
    below; so the first shingle that two linked sets share comes early in both, and a class with too many unshared
    shingles can't be linked and goes.  What is shared among the rest is counted once more, as it is less.  Classes meet
    on early shingles alone, and a pair goes on if what follows its first shared one can still make up the least
    number.  None of this loses a link between trees, nor sets a cap.
    """
    undecided = materialise(
        _divided(members, trees)
        .groupBy("id")
        .agg(F.min("comp").alias("comp"), F.min("least").alias("least"), F.max(F.col("comp") != F.col("main")).alias("out"))
    )
    if not undecided.limit(1).count():
        return None
    items = sets.join(undecided, "id").select("id", "comp", "n", "least", "out", F.explode("items").alias("item"))
    shared = _shared(items)
    stands = _stands(shared, percent).select("id", "comp", "n", "least", "out")
    again = _shared(shared.select("item", "id").join(stands, "id"))
    marked = _stands(again, percent).join(sets.select("id", *PARITIES), "id")
    return _meeting(again, marked, percent)


def _shared(items: DataFrame) -> DataFrame:
    """The rows of ``items`` whose item classes of several trees hold, one of them outside its bucket's main tree; with how
    many such classes and how many in all do; stored."""
    held = items.groupBy("item").agg(
        F.count_if("out").alias("outside"), F.count(F.lit(1)).alias("holders"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    wanted = held.where("low != high AND outside > 0").select("item", "outside", "holders")
    return materialise(items.join(wanted, "item"))


def _stands(shared: DataFrame, percent: int) -> DataFrame:
    """``id, comp, n, own, out, misses`` of the smallest class for each tree and set of shared items, if it can be linked:
    ``own`` of its items are not shared, and at most ``misses`` may be missing in a partner."""
    digests = [F.bit_xor(F.xxhash64("item", F.lit(seed))).alias(f"_d{seed}") for seed in (1, 2)]
    each = shared.groupBy("id", "comp", "n", "least", "out").agg(F.count(F.lit(1)).alias("common"), *digests)
    stands = (
        each.groupBy("comp", "_d1", "_d2")
        .agg(F.min(F.struct("n", "id", "common")).alias("s"), F.min("least").alias("least"), F.max("out").alias("out"))
        .select("s.id", "comp", "s.n", (F.col("s.n") - F.col("s.common")).alias("own"), "least", "out")
    )
    scale = 100 * (100 + percent)
    other = F.greatest(100 * F.col("least"), percent * F.col("n"))  # hundredfold
    misses = F.floor((scale * F.col("n") - percent * (100 * F.col("n") + other)) / F.lit(scale))
    return stands.withColumn("misses", misses).where("own <= misses")


def _meeting(shared: DataFrame, stands: DataFrame, percent: int) -> DataFrame:
    """Pairs of standing classes of different trees, one of them outside a main tree, that meet on an early item and can
    still be linked: where they first meet, what is left of both sets can make up the least overlap, and their parities
    differ in no more bits than linked sets may differ in items."""
    rarest = Window.partitionBy("id").orderBy("outside", "holders", "item")
    early = materialise(
        shared.select("item", "id", "outside", "holders")
        .join(stands, "id")
        .withColumn("rank", F.col("own") + F.row_number().over(rarest))
        .where("rank <= misses + 1")
        .select("item", "id", "comp", "n", "rank", "out", *PARITIES)
    )
    columns = ("id", "comp", "n", "rank", "out", *PARITIES)
    side = {s: early.select("item", *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s in "ab"}
    unlike = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in PARITIES))
    most = 1 + F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b"))
    met = (
        side["a"].where("out_a").join(side["b"], "item")
        .where((F.col("comp_a") != F.col("comp_b")) & (~F.col("out_b") | (F.col("id_a") < F.col("id_b"))))
        .where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
        .where((100 + percent) * unlike <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    )
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    Ids that go are told apart from those that stay by id alone; repeated rows of an id that stays all stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    ids = found.groupBy(F.col(id_col).alias("_gone")).agg(F.max("kept").alias("_kept"))
    gone = materialise(ids.where(~F.col("_kept")).select("_gone"))
    return docs.join(gone, F.col(f"`{id_col}`").cast("bigint") == F.col("_gone"), "left_anti")
