"""Locating field values among OCR word boxes.

Words are shuffled once, by ``(doc_id, salt of the block)``, so a page dump with a huge number of words is shared by many
tasks; which pages have more than one block is read from the words' positions beforehand.  A block is searched where it
is gathered; what is left of a box that starts near a block's end is found among the first few words of the blocks after
it, which are all that moves a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.schemas import BOX_TYPE, FIELD_ORDER
from paperloom.sources.sinks import materialise

WORD_BLOCK = 4096
SPAN_EXTRA = 2
SALTS = 32  # tasks that share the words of one long page


def usable_words(ocr: DataFrame) -> DataFrame:
    """Words with confidence above zero, stripped, not blank."""
    return (
        ocr.where(F.col("conf") > 0)
        .withColumn("text", tx.strip(F.col("text")))
        .where(F.col("text") != "")
        .select("doc_id", "p", "text", "x", "y", "w", "h")
    )


def word_boxes(ocr: DataFrame, block: int = WORD_BLOCK) -> DataFrame:
    """Usable words with their number in the page; numbering comes after filtering.

    Words are numbered within blocks of positions; only blocks after a page's first have words before them, so pages
    of one block meet no offset.
    """
    words = usable_words(ocr).withColumn("block", _block(block))
    sizes = words.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.withColumn("_offset", F.sum("_size").over(_blocks_before())).where("block > 0").drop("_size")
    in_block = Window.partitionBy("doc_id", "block").orderBy("p")
    placed = words.join(offsets, ["doc_id", "block"], "left").withColumn("_at", F.row_number().over(in_block) - 1)
    number = (F.coalesce("_offset", F.lit(0)) + F.col("_at")).cast("bigint")
    return placed.select("doc_id", number.alias("word_idx"), "text", "x", "y", "w", "h")


def _block(width: int) -> Column:
    return F.floor(F.col("p") / width).cast("bigint")


def _blocks_before():
    return Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def field_probes(fields: DataFrame) -> DataFrame:
    """Per document an array of its non-empty values: field number, anchoring prefix, word count.

    ``_reach`` is how many words after its anchor the longest value may cover.
    """
    values = [
        F.when(
            ~tx.is_blank(F.col(name)),
            F.struct(
                F.lit(i).alias("field_ord"),
                tx.anchor_prefix(F.col(name)).alias("prefix"),
                tx.word_count(F.col(name)).alias("n_words"),
            ),
        )
        for i, name in enumerate(FIELD_ORDER)
    ]
    probes = fields.select("doc_id", F.array_compact(F.array(*values)).alias("probes")).where(F.size("probes") > 0)
    return probes.withColumn("_reach", F.array_max(F.transform("probes", lambda v: v.n_words)) + (SPAN_EXTRA - 1))


def searched_blocks(fields: DataFrame, ocr: DataFrame, block: int, salts: int) -> DataFrame:
    """One row per block of the pages that have fields, stored: ``_offset`` (usable words before it), ``_boxes`` (for each
    field whose prefix occurs in it the first place, the box as far as this block goes, and how many words of the span
    are missing) and, but for a page's first block, ``_head``, its first ``_reach`` words.

    The fields are stored once per salt that their page has words for: once for a page of one block, as a look at the
    positions of the words tells.  The stored table is what Catalyst may turn into a run-time filter of documents at
    the scan of the words.  A block is gathered into one array, which its width bounds, in the partitions of the join,
    so words move once.
    """
    salt = F.pmod("block", F.lit(salts)).cast("int").alias("_salt")
    probes = field_probes(fields)
    beyond = ocr.where((F.col("p") < 0) | (F.col("p") >= block)).select("doc_id", _block(block).alias("block"))
    further = beyond.select("doc_id", salt).where("_salt > 0").distinct()
    further = probes.join(further, "doc_id").select(*probes.columns, "_salt")
    probes = materialise(probes.withColumn("_salt", F.lit(0)).unionByName(further)).where(F.col("_salt") >= 0)
    words = usable_words(ocr).withColumn("block", _block(block))
    words = words.withColumn("lower", F.lower("text")).select("*", salt)
    word = F.struct("p", "lower", "x", "y", (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("low"))
    gathered = words.join(probes, ["doc_id", "_salt"]).groupBy("doc_id", "_salt", "block").agg(
        F.array_sort(F.collect_list(word)).alias("words"), F.first("probes").alias("probes"), F.first("_reach").alias("_reach")
    )

    def start(v: Column) -> Column:
        """Place of the first word of this block that starts with the prefix; zero when there is none."""
        return F.array_position(F.transform("words", lambda t: F.startswith(t.lower, v.prefix)), True)

    def box(v: Column) -> Column:
        left, top = F.array_min(F.transform(v.span, lambda t: t.x)), F.array_min(F.transform(v.span, lambda t: t.y))
        right, low = F.array_max(F.transform(v.span, lambda t: t.right)), F.array_max(F.transform(v.span, lambda t: t.low))
        return F.struct(
            v.field_ord.alias("field_ord"), v.at.alias("at"), v.n_words.alias("n_words"),
            (v.n_words + SPAN_EXTRA - F.size(v.span)).alias("missing"),
            left.alias("left"), top.alias("top"), right.alias("right"), low.alias("low"),
        )

    hits = F.filter(F.transform("probes", lambda v: v.withField("at", start(v))), lambda v: v.at > 0)
    spans = F.transform("_hits", lambda v: v.withField("span", F.slice("words", v.at.cast("int"), v.n_words + SPAN_EXTRA)))
    head = F.transform(F.slice("words", F.lit(1), F.col("_reach")), lambda t: F.struct(t.x.alias("x"), t.y.alias("y"), t.right.alias("right"), t.low.alias("low")))
    searched = gathered.withColumn("_hits", hits).select(
        "doc_id", "block", "_reach", F.size("words").alias("_size"), F.transform(spans, box).alias("_boxes"),
        F.when(F.col("block") > 0, head).alias("_head"),
    )
    before = F.coalesce(F.sum("_size").over(_blocks_before()), F.lit(0))
    return materialise(searched.withColumn("_offset", before))


def locate_fields(fields: DataFrame, ocr: DataFrame, block: int = WORD_BLOCK, salts: int = SALTS) -> DataFrame:
    """Anchor and box of every field value that occurs on its page, one row per located field.

    The anchor is the first word that starts with the value's prefix; the box is the union over the
    anchor and the words after it, value length plus two in all, cut at the page end.  The fields are read twice: pass a
    stored table.
    """
    searched = searched_blocks(fields, ocr, block, salts)
    found = searched.select("doc_id", "_offset", "_reach", F.inline("_boxes"))
    parts = ("n_words", "missing", "_reach", "left", "top", "right", "low")
    first = found.groupBy("doc_id", "field_ord").agg(
        F.min(F.struct((F.col("_offset") + F.col("at") - 1).alias("word_idx"), *parts)).alias("_first")
    )
    first = first.select("doc_id", "field_ord", "_first.*")
    # Words numbered `_next` to `_next + missing - 1` are still to come.  Each is among the first `_reach` of its block;
    # spans and words meet on stretches of `_reach` numbers, of which a span touches two at most.
    open_spans = first.where("missing > 0").withColumn("_next", F.col("word_idx") + F.col("n_words") + SPAN_EXTRA - F.col("missing"))
    ends = F.array_distinct(F.array(*(F.floor(n / F.col("_reach")) for n in (F.col("_next"), F.col("_next") + F.col("missing") - 1))))
    spans = open_spans.select("doc_id", "field_ord", "_next", "missing", F.explode(ends).alias("_stretch"))
    heads = searched.where("block > 0").select("doc_id", "_offset", "_reach", F.posexplode("_head").alias("_at", "_word"))
    heads = heads.withColumn("_number", F.col("_offset") + F.col("_at"))
    heads = heads.select("doc_id", F.floor(F.col("_number") / F.col("_reach")).alias("_stretch"), "_number", "_word.*")
    more = (
        spans.join(heads, ["doc_id", "_stretch"])
        .where((F.col("_number") >= F.col("_next")) & (F.col("_number") < F.col("_next") + F.col("missing")))
        .groupBy("doc_id", "field_ord")
        .agg(
            F.min("x").alias("_left"), F.min("y").alias("_top"), F.max("right").alias("_right"), F.max("low").alias("_low"),
        )
    )
    left, top = F.least("left", "_left"), F.least("top", "_top")
    right, low = F.greatest("right", "_right"), F.greatest("low", "_low")
    names = F.array(*[F.lit(n) for n in FIELD_ORDER])
    return first.join(more, ["doc_id", "field_ord"], "left").select(
        "doc_id", "field_ord", F.get(names, F.col("field_ord")).alias("field"), "word_idx", "n_words",
        left.alias("x"), top.alias("y"), (right - left).alias("w"), (low - top).alias("h"),
    )


def anchors(located: DataFrame) -> DataFrame:
    """Number of the word at which each located value starts."""
    return located.select("doc_id", "field_ord", "field", "n_words", "word_idx")


def span_boxes(located: DataFrame) -> DataFrame:
    """Box of each located value."""
    return located.select("doc_id", "field_ord", "field", "x", "y", "w", "h")


def box_lists(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Boxes of each document in field order; an empty list where nothing was found.

    A document has at most one box per field, so the list is bounded by the field count.
    """
    listed = spans.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("field_ord", "field", "x", "y", "w", "h"))).alias("_boxes")
    )
    boxes = F.transform("_boxes", lambda b: F.struct(b.field.alias("field"), b.x.alias("x"), b.y.alias("y"), b.w.alias("w"), b.h.alias("h")))
    return docs.join(listed, "doc_id", "left").select(
        *docs.columns, F.coalesce(boxes, F.array().cast(f"array<{BOX_TYPE}>")).alias("boxes")
    )
