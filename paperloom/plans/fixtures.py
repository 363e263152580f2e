"""Input views over the given tables, as SQL text for Spark and for the checking engine.

The given tables hold no invoices, scans or model scores, so each input is a deterministic view
that grows with `orders`, `customer` or `embeddings`.  Where one text cannot serve both engines
(`lateral view` against `cross join`), the two are written side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPLIT_OF = "CASE WHEN {k} % 10 < 8 THEN 'train' WHEN {k} % 10 = 8 THEN 'validation' ELSE 'test' END"

DOC_IMAGES = """
SELECT vec_id AS doc_id, %s AS split, CAST(label %% 4 AS INT) AS label, 8 AS width, 8 AS height, %s AS px
FROM embeddings"""

DOC_TEXTS = """
SELECT doc_id, variant, split, label,
  CASE label WHEN 0 THEN 'email' WHEN 1 THEN 'invoice' WHEN 2 THEN 'letter' ELSE 'scientific_report' END AS label_name,
  concat('raw/', split, '/', CASE label WHEN 0 THEN 'email' WHEN 1 THEN 'invoice' WHEN 2 THEN 'letter' ELSE 'scientific_report' END,
    '/', lpad(CAST(doc_id AS STRING), 8, '0'), '.png') AS path,
  text,
  CASE WHEN doc_id % 3 = 2 THEN 'unreadable' ELSE text END AS ocr_text,
  CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'scan' ELSE text END AS pdf_text
FROM (
  SELECT o_orderkey AS doc_id, variant,
    CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
    CASE variant WHEN 2 THEN 3 WHEN 5 THEN 2 WHEN 7 THEN 0 ELSE 1 END AS label,
    CASE variant
      WHEN 0 THEN concat_ws(chr(10), concat('INVOICE #', lpad(k, 6, '0')), concat('Invoice Date: ', ymd), concat('Due Date: ', dmy), concat('Bill To: ', c_name), concat('Subtotal: $', amt), concat('Grand Total: $', amt))
      WHEN 1 THEN concat_ws(chr(10), concat('Invoice No: ', k), concat('Date Issued: 12 January ', yy), 'From: Acme Corp', concat('Sold To: ', c_name), concat('Total Amount Due: $', amt))
      WHEN 2 THEN concat_ws(chr(10), concat('Bill No: B-', k), ymd, concat('March 3, ', yy), concat('Amount Due: €', amt))
      WHEN 3 THEN concat_ws(chr(10), concat('Ref # AB', lpad(k, 6, '0')), dmy, concat('balance  $', amt, '  '), 'thank you')
      WHEN 4 THEN concat_ws(chr(10), concat('Invoice: INV-', k), 'Payment due: 30 days net', concat('Total  ', amt))
      WHEN 5 THEN concat_ws(chr(10), 'Minutes of the meeting', 'nothing to see here', 'refer to page nine')
      WHEN 6 THEN concat_ws(chr(10), concat('Inv. No. ', k), 'two  invoices', 'Total: ,', 'Due date:  ')
      ELSE '  ' END AS text
  FROM (
    SELECT o.o_orderkey, c.c_name, CAST(o.o_orderkey % 8 AS INT) AS variant, CAST(o.o_orderkey AS STRING) AS k,
      substr(CAST(o.o_orderdate AS STRING), 1, 10) AS ymd, substr(CAST(o.o_orderdate AS STRING), 1, 4) AS yy,
      concat(substr(CAST(o.o_orderdate AS STRING), 9, 2), '/', substr(CAST(o.o_orderdate AS STRING), 6, 2), '/', substr(CAST(o.o_orderdate AS STRING), 1, 4)) AS dmy,
      CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS STRING) AS amt
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) q) r"""

WORD_COLUMNS = """doc_id, CAST(p AS INT) AS p, w AS text, CAST((p % 8) * 60 AS INT) AS x, CAST(floor(p / 8) * 20 AS INT) AS y,
  CAST(8 * length(w) AS INT) AS w, 12 AS h, CASE WHEN p % 11 = 10 THEN -1 ELSE 90 END AS conf"""

ENTITY_KINDS = """(1, 1, 'ORG', 'Org A'), (2, 1, 'ORG', 'Org A'), (2, 2, 'PERSON', 'Pat'), (2, 3, 'ORG', 'Org B'),
  (3, 1, 'PERSON', 'Pat'), (3, 2, 'PERSON', 'Sam'), (4, 1, 'PERSON', 'Pat'), (4, 2, 'ORG', 'Org A'), (4, 3, 'PERSON', 'Sam')"""
MODEL_ROWS = "(0, 'SVD+SVM'), (1, 'HOG+SVM'), (2, 'HOG+RF'), (3, 'CNN'), (4, 'Stacking')"
MEMBER_ROWS = "(0, 'svd_svm'), (1, 'hog_svm'), (2, 'hog_rf'), (3, 'cnn')"
PHASE_ROWS = "(0, 'train'), (1, 'val')"


def _structs(rows: str) -> str:
    """The same constant rows as an array of structs, for Spark's `inline`."""
    return "array(" + rows.replace("(", "struct(") + ")"


PREDICTION_COLUMNS = """v.m, v.model, t.doc_id, t.split, t.label AS y_true,
  CASE WHEN (t.doc_id + v.m) % (3 + v.m) = 0 THEN (t.label + 1) % 4 ELSE t.label END AS y_pred,
  CASE WHEN v.m < 2 THEN NULL ELSE CAST(60 + (t.doc_id * 7 + v.m) % 40 AS DOUBLE) / 100 END AS confidence"""
PREDICTION_FILTER = "NOT (v.m = 4 AND t.doc_id % 7 = 0) AND NOT (v.m = 3 AND t.doc_id % 49 = 0)"

SCORE_COLUMNS = """v.m, v.model, t.doc_id,
  CAST((t.doc_id * 3 + v.m * 5) % 17 AS DOUBLE) / 4 AS s0, CAST((t.doc_id * 4 + v.m * 5) % 17 AS DOUBLE) / 4 AS s1,
  CAST((t.doc_id * 5 + v.m * 5) % 17 AS DOUBLE) / 4 AS s2, CAST((t.doc_id * 6 + v.m * 5) % 17 AS DOUBLE) / 4 AS s3"""

HISTORY_COLUMNS = """c.c_custkey AS run_id, e.epoch,
  CAST(least(75, 50 + (c.c_custkey * 3 + e.epoch * 7) % 31) AS DOUBLE) / 100 AS val_acc"""

BATCH_COLUMNS = """c.c_custkey AS run_id, e.epoch, f.phase, b.batch, CASE WHEN b.batch = 4 THEN 9 ELSE 32 END AS n,
  CAST((c.c_custkey * 3 + e.epoch * 13 + b.batch * 7 + f.k) % 50 AS DOUBLE) / 100 AS loss,
  CAST((c.c_custkey + e.epoch * 3 + b.batch * 5 + f.k) % 8 AS INT) AS correct"""

OCR_CACHE = """
SELECT 0 AS seq, path, label, label_name, CASE CAST(doc_id % 4 AS INT) WHEN 1 THEN NULL WHEN 2 THEN '' ELSE concat('old ', CAST(doc_id AS STRING)) END AS text
FROM doc_texts WHERE doc_id % 4 <> 0
UNION ALL SELECT 1, path, label, label_name, concat('newer ', CAST(doc_id AS STRING)) FROM doc_texts WHERE doc_id % 12 = 3
UNION ALL SELECT 0, concat('raw/gone/', CAST(doc_id AS STRING), '.png'), label, label_name, 'stale' FROM doc_texts WHERE doc_id % 12 = 5"""

CORPUS_SHARDS = """
SELECT split, CAST(floor(doc_id * 10 / (top + 1)) AS INT) AS shard_idx, doc_id AS row_idx,
  CAST(floor(doc_id * 16 / (top + 1)) AS INT) AS label16,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('bytes', CAST(doc_id AS STRING)) END AS image_bytes,
  concat('img/', CAST(doc_id AS STRING)) AS image_path
FROM (SELECT o_orderkey AS doc_id, (SELECT max(o_orderkey) FROM orders) AS top,
    CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'validation' ELSE 'test' END AS split
  FROM orders) z"""

RESULT_COLUMNS = """c.c_custkey AS run_id, r.ord, r.model,
  CASE r.ord
    WHEN 0 THEN concat('{"accuracy": 0.', a, ', "report": {"email": {"precision": 0.', b, ', "recall": 0.', a, ', "f1-score": 0.7', b,
      '}, "macro avg": {"precision": 0.', a, ', "recall": 0.', b, ', "f1-score": 0.6', a, '}}, "confusion_matrix_image": "/reports/cm_svd_svm.png"}')
    WHEN 1 THEN concat('{"accuracy": 0.', b, '}')
    WHEN 2 THEN concat('{"accuracy": 0.6', a, ', "report": {}}')
    ELSE concat('0.8', b) END AS payload"""
RESULT_SOURCE = "(SELECT c_custkey, CAST(51 + c_custkey % 48 AS STRING) AS a, CAST(11 + c_custkey % 88 AS STRING) AS b FROM customer) c"
RESULT_MODELS = "(0, 'SVD+SVM'), (1, 'HOG+RF'), (2, 'DistilBERT-OCR'), (3, 'Stacking')"

# Images whose class shows clearly, as the quarter that is bright, so that a fitted model's answer is known: the checking
# engine needs no pixels.  Classes follow `doc_texts`, where document and vector number are the same; eight neighbours share a
# split, so that each split holds all classes.
CLASS_IMAGES = f"""
SELECT vec_id AS doc_id, {SPLIT_OF.format(k="floor(vec_id / 8)")} AS split, CASE vec_id % 8 WHEN 2 THEN 3 WHEN 5 THEN 2 WHEN 7 THEN 0 ELSE 1 END AS label"""
BRIGHT_QUARTER = """transform(embedding, (v, i) -> CAST(floor((CAST(v AS DOUBLE) + 1) * 30) AS INT)
  + CASE WHEN i div 32 = label div 2 AND (i % 8) div 4 = label % 2 THEN 150 ELSE 0 END)"""

# name -> (inputs, Spark text, checking engine text)
_BOTH = {
    "doc_texts": (("orders", "customer"), DOC_TEXTS),
    "ocr_cache": (("doc_texts",), OCR_CACHE),
    "corpus_shards": (("orders",), CORPUS_SHARDS),
}
_SPLIT_IMAGES = SPLIT_OF.format(k="vec_id")
_PAGE_TEXT = "CASE WHEN n.page_no = 1 THEN t.text WHEN t.doc_id % 2 = 0 THEN NULL ELSE 'page two' END AS text"
_EITHER = {
    "doc_images": (
        ("embeddings",),
        DOC_IMAGES % (_SPLIT_IMAGES, "transform(embedding, v -> CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS INT))"),
        DOC_IMAGES % (_SPLIT_IMAGES, "list_transform(embedding, lambda v : CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS INT))"),
    ),
    "class_images": (
        ("embeddings",),
        f"SELECT doc_id, split, label, 8 AS width, 8 AS height, {BRIGHT_QUARTER} AS px FROM ({CLASS_IMAGES}, embedding FROM embeddings) z",
        f"{CLASS_IMAGES} FROM embeddings",
    ),
    "doc_pixels": (
        ("doc_images",),
        "SELECT doc_id, split, label, posexplode(px) AS (p, px) FROM doc_images",
        "SELECT doc_id, split, label, CAST(unnest(range(len(px))) AS INT) AS p, unnest(px) AS px FROM doc_images",
    ),
    "doc_pages": (
        ("doc_texts",),
        f"SELECT t.doc_id, n.page_no, {_PAGE_TEXT} FROM doc_texts t LATERAL VIEW explode(array(1, 2)) n AS page_no",
        f"SELECT t.doc_id, n.page_no, {_PAGE_TEXT} FROM doc_texts t CROSS JOIN (VALUES (1), (2)) AS n(page_no)",
    ),
    "ocr_words": (
        ("doc_texts",),
        f"SELECT {WORD_COLUMNS} FROM (SELECT doc_id, posexplode(split(trim(text), '\\\\s+')) AS (p, w) FROM doc_texts) s",
        f"""SELECT {WORD_COLUMNS} FROM (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS w
          FROM (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS ws FROM doc_texts) a) s""",
    ),
    "doc_entities": (
        ("doc_texts",),
        f"""SELECT t.doc_id, e.ord, e.ent_label, concat(e.tag, ' ', CAST(t.doc_id AS STRING)) AS ent_text
          FROM doc_texts t LATERAL VIEW inline({_structs(ENTITY_KINDS)}) e AS kind, ord, ent_label, tag
          WHERE CAST(t.doc_id % 5 AS INT) = e.kind""",
        f"""SELECT t.doc_id, e.ord, e.ent_label, concat(e.tag, ' ', CAST(t.doc_id AS STRING)) AS ent_text
          FROM doc_texts t JOIN (VALUES {ENTITY_KINDS}) AS e(kind, ord, ent_label, tag) ON CAST(t.doc_id % 5 AS INT) = e.kind""",
    ),
    "predictions": (
        ("doc_texts",),
        f"SELECT {PREDICTION_COLUMNS} FROM doc_texts t LATERAL VIEW inline({_structs(MODEL_ROWS)}) v AS m, model WHERE {PREDICTION_FILTER}",
        f"SELECT {PREDICTION_COLUMNS} FROM doc_texts t CROSS JOIN (VALUES {MODEL_ROWS}) AS v(m, model) WHERE {PREDICTION_FILTER}",
    ),
    "base_scores": (
        ("doc_texts",),
        f"SELECT {SCORE_COLUMNS} FROM doc_texts t LATERAL VIEW inline({_structs(MEMBER_ROWS)}) v AS m, model",
        f"SELECT {SCORE_COLUMNS} FROM doc_texts t CROSS JOIN (VALUES {MEMBER_ROWS}) AS v(m, model)",
    ),
    "train_history": (
        ("customer",),
        f"SELECT {HISTORY_COLUMNS} FROM customer c LATERAL VIEW explode(sequence(1, 20)) e AS epoch",
        f"SELECT {HISTORY_COLUMNS} FROM customer c CROSS JOIN (SELECT CAST(unnest(range(1, 21)) AS INT) AS epoch) e",
    ),
    "train_batches": (
        ("customer",),
        f"""SELECT {BATCH_COLUMNS} FROM customer c LATERAL VIEW explode(sequence(1, 20)) e AS epoch
          LATERAL VIEW explode(sequence(0, 4)) b AS batch LATERAL VIEW inline({_structs(PHASE_ROWS)}) f AS k, phase""",
        f"""SELECT {BATCH_COLUMNS} FROM customer c CROSS JOIN (SELECT CAST(unnest(range(1, 21)) AS INT) AS epoch) e
          CROSS JOIN (SELECT CAST(unnest(range(0, 5)) AS INT) AS batch) b CROSS JOIN (VALUES {PHASE_ROWS}) AS f(k, phase)""",
    ),
    "results_raw": (
        ("customer",),
        f"SELECT {RESULT_COLUMNS} FROM {RESULT_SOURCE} LATERAL VIEW inline({_structs(RESULT_MODELS)}) r AS ord, model",
        f"SELECT {RESULT_COLUMNS} FROM {RESULT_SOURCE} CROSS JOIN (VALUES {RESULT_MODELS}) AS r(ord, model)",
    ),
}
VIEWS = {name: (deps, text, text) for name, (deps, text) in _BOTH.items()} | _EITHER


#: Rows that these views make of each row of their table, and how many of them one task is given at most.
ROWS_MADE = {"train_history": 20, "train_batches": 200}
ROWS_A_TASK = 1_000_000

# Table schemas by path, so that a table's footer is read for its schema once per process.
_SCHEMAS: dict = {}


#: A session may set this so that a small table of one row group is worked on by several tasks; unset, scans stay as they are.
INPUT_PARTITIONS = "paperloom.input.partitions"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or an input view as a DataFrame."""
    if name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = spark.read.parquet(path).schema
        table, parts = spark.read.schema(_SCHEMAS[path]).parquet(path), spark.conf.get(INPUT_PARTITIONS, None)
        return table.repartition(int(parts)) if parts else table
    deps, text, _ = VIEWS[name]
    for dep in deps:
        table = load(spark, sf_dir, dep)
        if name in ROWS_MADE:
            # a row group of the table is one task's, however many rows are made of it
            tasks = -(-table.count() * ROWS_MADE[name] // ROWS_A_TASK)
            table = table.repartition(tasks) if tasks > table.rdd.getNumPartitions() else table
        table.createOrReplaceTempView(dep)
    return spark.sql(text)


def with_views(names: list[str], query: str, extra: str = "") -> str:
    """Checking-engine query text with the views it reads as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for dep in VIEWS[name][0]:
                visit(dep)
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{name} AS ({VIEWS[name][2]})" for name in ordered] + ([extra] if extra else [])
    return f"WITH {', '.join(parts)}\n{query}" if parts else query
