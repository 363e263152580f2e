import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import boxes as bx
from paperloom.schemas import FIELD_ORDER

WORDS = "doc_id int, p int, text string, x int, y int, w int, h int, conf int"
FIELDS = "doc_id int, " + ", ".join(f"{n} string" for n in FIELD_ORDER)


def by_hand(words, fields):
    out = set()
    for doc in fields:
        usable = [w for w in sorted(words) if w[0] == doc[0] and w[7] > 0 and w[2].strip()]
        for n, (name, value) in enumerate(zip(FIELD_ORDER, doc[1:])):
            parts = (value or "").lower().split()
            if not parts:
                continue
            for i, w in enumerate(usable):
                if w[2].strip().lower().startswith(parts[0][:4]):
                    span = usable[i : i + len(parts) + 2]
                    x, y = min(s[3] for s in span), min(s[4] for s in span)
                    right, low = max(s[3] + s[5] for s in span), max(s[4] + s[6] for s in span)
                    out.add((doc[0], n, name, i, x, y, right - x, low - y))
                    break
    return out


def sample(seed):
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "al", "Gamma", "be", "delta", " ", "alphabet"]
    words = []
    for doc, size in ((1, 40), (2, 3), (3, 200), (4, 0), (5, 12)):
        for p in sorted(rng.sample(range(size * 3 + 1), size)):
            words.append((doc, p, rng.choice(vocab), rng.randrange(500), rng.randrange(500), rng.randrange(1, 60), 12, rng.choice([-1, 5, 90])))
    values = ["alpha beta", "AL", "gamma x y z w v u", "", None, "delta", "nowhere at all", "  "]
    fields = [(doc, *[rng.choice(values) for _ in FIELD_ORDER]) for doc in range(1, 7)]
    return words, fields


@pytest.mark.parametrize("block,seed", [(1, 0), (2, 1), (3, 2), (7, 3), (4096, 4)])
def test_boxes_match_a_plain_loop(spark, block, seed):
    words, fields = sample(seed)
    located = bx.locate_fields(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(words, WORDS), block)
    got = {(r.doc_id, r.field_ord, r.field, r.word_idx, r.x, r.y, r.w, r.h) for r in located.collect()}
    assert got == by_hand(words, fields)


def test_a_page_of_many_blocks(spark):
    """A page beyond one block of the usual width: boxes run over the edge, over a stretch of unusable words and over
    blocks of one word; numbers go on from block to block."""
    rng = random.Random(1)
    words = [(1, p, rng.choice(["aa", "bb", "cc"]), p % 97, p % 89, 1 + p % 7, 5, 90) for p in range(9000)]
    words[4094] = (1, 4094, "mark", 3, 4, 5, 6, 90)
    words[4095:4500] = [(1, p, "gone", 0, 0, 1, 1, -1) for p in range(4095, 4500)]
    words[8190] = (1, 8190, "zenith", 900, 900, 9, 9, 90)
    words += [(1, 20_000 + 5000 * k, "tail", 100 * k, 7, 3, 3, 50) for k in range(6)] + [(2, 0, "mark", 1, 1, 1, 1, 90)]
    values = ["mark one two three", "zenith", "tail of five words x", None, "aa", "bb cc"]
    fields = [(1, *values), (2, *values), (3, *values)]
    for salts in (1, 3, 32):
        located = bx.locate_fields(spark.createDataFrame(fields, FIELDS), spark.createDataFrame(words, WORDS), salts=salts)
        assert {(r.doc_id, r.field_ord, r.field, r.word_idx, r.x, r.y, r.w, r.h) for r in located.collect()} == by_hand(words, fields)


def test_words_are_read_and_moved_once(spark, tmp_path):
    words, fields = sample(3)
    spark.createDataFrame(words, WORDS).write.parquet(str(tmp_path / "words"))
    spark.createDataFrame(fields, FIELDS).write.parquet(str(tmp_path / "fields"))
    plans, real = [], bx.materialise

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    old = {k: spark.conf.get(k) for k in confs}
    bx.materialise = noted
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        bx.locate_fields(spark.read.parquet(str(tmp_path / "fields")), spark.read.parquet(str(tmp_path / "words"))).count()
    finally:
        bx.materialise = real
        for k, v in old.items():
            spark.conf.set(k, v)
    search = plans[1]
    assert search.count("/words") == 1  # one scan
    assert "might_contain" in search  # documents without fields leave at the scan
    below_join = search[search.index("SortMergeJoin") :]
    scan_side = below_join[: below_join.index("/words")]
    assert scan_side.count("Exchange hashpartitioning(doc_id") == 1
    grouped = [line for line in scan_side.split("\n") if "Aggregate(keys=[" in line and "Aggregate(keys=[]" not in line]
    assert not grouped  # but for the filter of documents, nothing is aggregated below the gate


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_numbering(spark, block):
    words, _ = sample(9)
    got = {(r.doc_id, r.word_idx, r.text) for r in bx.word_boxes(spark.createDataFrame(words, WORDS), block).collect()}
    want = set()
    for doc in {w[0] for w in words}:
        usable = [w for w in sorted(words) if w[0] == doc and w[7] > 0 and w[2].strip()]
        want |= {(doc, i, w[2].strip()) for i, w in enumerate(usable)}
    assert got == want


def test_lists_keep_field_order_and_empty_documents(spark):
    words, fields = sample(5)
    docs = spark.createDataFrame(fields, FIELDS)
    spans = bx.span_boxes(bx.locate_fields(docs, spark.createDataFrame(words, WORDS)))
    lists = {r.doc_id: [FIELD_ORDER.index(b.field) for b in r.boxes] for r in bx.box_lists(docs.select("doc_id"), spans).collect()}
    assert set(lists) == {d[0] for d in fields}
    assert lists[4] == [] and lists[6] == []
    assert all(v == sorted(v) for v in lists.values())


def test_flagship_keeps_every_document_and_gates(spark):
    from paperloom.operators.flagship import classify_and_extract

    docs = spark.createDataFrame([(1, "Invoice #A1\nTotal: 5", None), (2, "Invoice #B2", None), (3, "x", None)], "doc_id int, ocr_text string, pdf_text string")
    preds = spark.createDataFrame([(1, "Stacking", "invoice", 0.9), (1, "CNN", "letter", 0.5), (2, "CNN", "letter", 0.6)], "doc_id int, model string, label string, confidence double")
    ocr = spark.createDataFrame([(1, 0, "A1", 1, 2, 3, 4, 90), (2, 0, "B2", 1, 2, 3, 4, 90)], WORDS)
    rows = {r.doc_id: r for r in classify_and_extract(docs, preds, ocr).collect()}
    assert rows[1].invoice_number == "A1" and rows[1].total_amount == "5" and [b.field for b in rows[1].boxes] == ["invoice_number"]
    assert rows[2].label == "letter" and rows[2].invoice_number is None and rows[2].boxes == []
    assert rows[3].label == "-" and rows[3].confidence is None
    forced = {r.doc_id: r.invoice_number for r in classify_and_extract(docs, preds, ocr, force=True).collect()}
    assert forced == {1: "A1", 2: "B2", 3: None}


def test_fields_are_stored_once_per_salt_of_their_page(spark, monkeypatch):
    words, fields = sample(3)
    stored, real = [], bx.materialise
    monkeypatch.setattr(bx, "materialise", lambda df: stored.append(real(df)) or stored[-1])
    docs = spark.createDataFrame(fields, FIELDS)
    bx.locate_fields(docs, spark.createDataFrame(words + [(5, 5000, "alpha", 1, 1, 1, 1, 90)], WORDS)).count()
    per_doc = {r.doc_id: r["count"] for r in stored[0].groupBy("doc_id").count().collect()}
    assert per_doc.pop(5, 2) == 2 and set(per_doc.values()) == {1}
