"""Queries on the corpus: scanning, sampling, profiling and the text cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.functions.labels import encode_corpus_labels, label_name
from paperloom.operators.images import to_gray
from paperloom.operators import cache as ca
from paperloom.operators import profile as pf
from paperloom.operators import sampling as sm
from paperloom.plans.fixtures import load
from paperloom.plans.images import level_list, levels_of
from paperloom.plans.registry import query
from paperloom.schemas import CORPUS_CODES
from paperloom.session import shared_folder
from paperloom.sources import corpus as co
from paperloom.sources import versions as vs
from paperloom.sources import zones as zo
from paperloom.sources.sinks import materialise, write_image_tree, write_split, write_text_cache

C = ("corpus_shards",)
CODES = "(VALUES (2, 'email', 0), (6, 'invoice', 1), (7, 'letter', 2), (14, 'scientific_report', 3)) AS c(code, label_name, label_idx)"
# Class sizes of the sampling queries; the library's own default is the full 10000/1000/1000.
TARGETS = {"train": 400, "validation": 60, "test": 5000}
TARGET_ROWS = "(VALUES ('train', 400), ('validation', 60), ('test', 5000)) AS t(split, target)"
CODED = f"coded AS (SELECT s.*, label_name, label_idx FROM corpus_shards s JOIN {CODES} ON s.label16 = c.code)"
HEAD = f"""head AS (SELECT * FROM (SELECT d.*, target, row_number() OVER (PARTITION BY d.split, label_name ORDER BY shard_idx, row_idx) - 1 AS file_no
  FROM coded d JOIN {TARGET_ROWS} ON d.split = t.split) r WHERE file_no < target)"""


def _corpus_rows(spark, sf):
    """The corpus in its stored shape: an image struct and a class code."""
    return load(spark, sf, "corpus_shards").select(
        F.struct(F.col("image_bytes").cast("binary").alias("bytes"), F.col("image_path").alias("path")).alias("image"),
        F.col("label16").alias("label"),
        "split",
        "shard_idx",
        "row_idx",
    )


def _coded(spark, sf):
    return encode_corpus_labels(load(spark, sf, "corpus_shards"), "label16")


@query(
    "src_corpus_scan",
    "SELECT label16 AS label, image_path, image_bytes AS image_text FROM corpus_shards WHERE label16 IN (2, 6, 7, 14)",
    C,
)
def src_corpus_scan(spark, sf):
    folder = shared_folder(spark)
    _corpus_rows(spark, sf).select("image", "label").write.parquet(folder)
    return co.read_corpus(spark, folder).select(
        "label", F.col("image.path").alias("image_path"), F.col("image.bytes").cast("string").alias("image_text")
    )


@query(
    "src_image_bytes",
    "SELECT row_idx, 'struct' AS kind, image_bytes AS image_text FROM corpus_shards UNION ALL SELECT row_idx, 'plain', image_bytes FROM corpus_shards",
    C,
)
def src_image_bytes(spark, sf):
    structs = _corpus_rows(spark, sf)
    plain = load(spark, sf, "corpus_shards").select(F.col("image_bytes").cast("binary").alias("image"), "row_idx")
    both = [
        df.select("row_idx", F.lit(kind).alias("kind"), co.image_bytes(df).cast("string").alias("image_text"))
        for df, kind in ((structs, "struct"), (plain, "plain"))
    ]
    return both[0].unionByName(both[1])


@query(
    "src_image_tree",
    """SELECT split, label, label_name, concat(lpad(CAST(doc_id AS STRING), 8, '0'), '.png') AS file_name, 8 AS width, 8 AS height,
      list_sum(px) AS total, list_sum(list_transform(px, lambda v, i : v * i)) AS placed
    FROM doc_images JOIN (VALUES (0, 'email'), (1, 'invoice'), (2, 'letter'), (3, 'scientific_report')) AS n(code, label_name) ON label = n.code""",
    ("doc_images",),
)
def src_image_tree(spark, sf):
    """Images written as files, one folder per split and class, then read and decoded from there."""
    folder = shared_folder(spark)
    images = load(spark, sf, "doc_images").withColumns(
        {"label_name": label_name(F.col("label")), "file_name": F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".png"))}
    )
    write_image_tree(images, folder)
    tree = to_gray(co.read_image_tree(spark, folder)).withColumn("levels", level_list())
    total = F.aggregate("levels", F.lit(0), lambda acc, v: acc + v)
    placed = F.aggregate(F.transform("levels", lambda v, i: v * (i + 1)), F.lit(0), lambda acc, v: acc + v)
    return tree.select(
        "split", "label", "label_name", "file_name", "width", "height", total.alias("total"), placed.alias("placed")
    )


@query("flt_label_map", "SELECT split, row_idx, label16, label_name, label_idx FROM coded", C, CODED)
def flt_label_map(spark, sf):
    return _coded(spark, sf).select("split", "row_idx", "label16", "label_name", "label_idx")


@query("smp_head_per_class", "SELECT split, label_name, shard_idx, row_idx, image_path, file_no FROM head", C, f"{CODED}, {HEAD}")
def smp_head_per_class(spark, sf):
    return sm.head_per_class(_coded(spark, sf), TARGETS).select("split", "label_name", "shard_idx", "row_idx", "image_path", "file_no")


TAKEN = "taken AS (SELECT * FROM coded WHERE row_idx % 3 = 0 AND row_idx % 7 < 2)"


@query(
    "smp_resume_fill",
    f"""SELECT split, label_name, shard_idx, row_idx, image_path, done + rn - 1 AS file_no FROM (
      SELECT r.*, target, coalesce(done, 0) AS done, row_number() OVER (PARTITION BY r.split, r.label_name ORDER BY r.shard_idx, r.row_idx) AS rn
      FROM coded r JOIN {TARGET_ROWS} ON r.split = t.split
      LEFT JOIN (SELECT split, label_name, count(*) AS done FROM taken GROUP BY ALL) d ON d.split = r.split AND d.label_name = r.label_name
      WHERE NOT EXISTS (SELECT 1 FROM taken k WHERE k.split = r.split AND k.shard_idx = r.shard_idx AND k.row_idx = r.row_idx)) q
    WHERE rn <= target - done""",
    C,
    f"{CODED}, {TAKEN}",
)
def smp_resume_fill(spark, sf):
    coded = _coded(spark, sf)
    taken = coded.where((F.col("row_idx") % 3 == 0) & (F.col("row_idx") % 7 < 2))
    return sm.resume_fill(coded, taken, TARGETS).select("split", "label_name", "shard_idx", "row_idx", "image_path", "file_no")


@query(
    "smp_shortfall",
    f"""SELECT t.split, c.label_name, count(h.row_idx) AS collected, t.target, CASE WHEN count(h.row_idx) >= t.target THEN 'full' ELSE 'short' END AS status
    FROM {TARGET_ROWS} CROSS JOIN {CODES} LEFT JOIN head h ON h.split = t.split AND h.label_name = c.label_name GROUP BY t.split, c.label_name, t.target""",
    C,
    f"{CODED}, {HEAD}",
)
def smp_shortfall(spark, sf):
    return sm.shortfall(sm.head_per_class(_coded(spark, sf), TARGETS), TARGETS)


@query(
    "smp_shard_range",
    """SELECT split, code AS label16, max(first_shard) AS first_shard, min(CASE WHEN shard_idx >= first_shard AND hits = 0
        AND (shard_idx + 0.5) * (nrows / shards) > (code + 1) * (nrows // 16) THEN shard_idx END) AS stop_shard
    FROM (SELECT g.*, greatest(0, CAST(floor(code * (nrows // 16) / (nrows / shards)) AS INT) - 1) AS first_shard,
        (SELECT count(*) FROM corpus_shards x WHERE x.split = g.split AND x.shard_idx = g.shard_idx AND x.label16 = g.code) AS hits
      FROM (SELECT DISTINCT s.split, s.shard_idx, c.code, z.nrows, z.shards FROM corpus_shards s
        JOIN (SELECT split, count(*) AS nrows, count(DISTINCT shard_idx) AS shards FROM corpus_shards GROUP BY split) z ON z.split = s.split
        CROSS JOIN (VALUES (2), (6), (7), (14)) AS c(code)) g) q GROUP BY split, code""",
    C,
)
def smp_shard_range(spark, sf):
    return sm.shard_range(load(spark, sf, "corpus_shards"), list(CORPUS_CODES))


@query(
    "smp_shard_span",
    """SELECT split, code AS label16, min(shard_idx) AS first_shard, max(shard_idx) AS last_shard, count(*) AS n, sum(row_idx) AS row_sum
    FROM (SELECT *, CAST(label16 // 3 AS INT) AS code FROM corpus_shards) s WHERE code IN (0, 2, 5) GROUP BY split, code""",
    C,
)
def smp_shard_span(spark, sf):
    """Classes of unequal sizes found by the ranges in the shards' footers, then read from those shards alone."""
    folder, codes, by = shared_folder(spark), [0, 2, 5], ["split", "label16"]
    sorted_rows = load(spark, sf, "corpus_shards").select("split", "shard_idx", "row_idx", F.floor(F.col("label16") / 3).cast("int").alias("label16"))
    sorted_rows.repartition("split", "shard_idx").sortWithinPartitions("split", "shard_idx", "label16").write.partitionBy("split", "shard_idx").parquet(folder)
    zones = materialise(zo.zone_map(spark, folder, "label16"))
    named = zones.withColumns(
        {"split": F.regexp_extract("file", "split=([a-z]+)", 1), "shard_idx": F.regexp_extract("file", r"shard_idx=(\d+)", 1).cast("int")}
    )
    rows = zo.read_holding(spark, folder, "label16", codes, zones)
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("row_idx").alias("row_sum"))
    return zo.shard_span(named, codes, ["split"]).join(sums, by)


@query(
    "smp_grid",
    "SELECT label, doc_id, pos FROM (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS pos FROM doc_images) r WHERE pos <= 6",
    ("doc_images",),
)
def smp_grid(spark, sf):
    return sm.class_examples(load(spark, sf, "doc_images")).select("label", "doc_id", "pos")


@query(
    "agg_class_dist",
    """SELECT s.split, n.label, n.label_name, count(d.doc_id) AS n FROM (VALUES ('train'), ('validation'), ('test')) AS s(split)
    CROSS JOIN (VALUES (0, 'email'), (1, 'invoice'), (2, 'letter'), (3, 'scientific_report')) AS n(label, label_name)
    LEFT JOIN doc_images d ON d.split = s.split AND d.label = n.label GROUP BY ALL""",
    ("doc_images",),
)
def agg_class_dist(spark, sf):
    return pf.class_distribution(load(spark, sf, "doc_images"))


@query(
    "agg_pixel_hist",
    """SELECT e.label, b.bin, round(lo + b.bin * (hi - lo) / 50.0, 6) AS bin_left, count(x.px) AS n,
      round(count(x.px) / (total * ((hi - lo) / 50.0)), 8) AS density
    FROM (SELECT label, min(px) AS lo, max(px) AS hi, count(*) AS total FROM doc_pixels GROUP BY label) e
    CROSS JOIN (SELECT CAST(unnest(range(0, 50)) AS INT) AS bin) b
    LEFT JOIN doc_pixels x ON x.label = e.label AND least(49, ((x.px - lo) * 50) // (hi - lo)) = b.bin
    GROUP BY e.label, b.bin, lo, hi, total""",
    ("doc_pixels",),
)
def agg_pixel_hist(spark, sf):
    hist = pf.pixel_histogram(load(spark, sf, "doc_images"))
    return hist.withColumns({"bin_left": F.round("bin_left", 6), "density": F.round("density", 8)})


@query("agg_text_coverage", r"SELECT split, count(*) AS entries, count(*) FILTER (regexp_matches(text, '\S')) AS with_text FROM doc_texts GROUP BY split", ("doc_texts",))
def agg_text_coverage(spark, sf):
    return pf.text_coverage(load(spark, sf, "doc_texts"))


@query(
    "agg_dataset_shape",
    """SELECT split, count(px) AS images, count(label) AS labels, min(width) AS min_width, max(width) AS max_width,
      min(height) AS min_height, max(height) AS max_height, count(px) = count(label) AS agree FROM doc_images GROUP BY split""",
    ("doc_images",),
)
def agg_dataset_shape(spark, sf):
    return pf.dataset_check(load(spark, sf, "doc_images"))


LATEST = "latest AS (SELECT path, label, label_name, text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM ocr_cache) z WHERE r = 1)"
CACHE = ("ocr_cache",)


@query("src_text_cache", "SELECT * FROM latest", CACHE, LATEST)
def src_text_cache(spark, sf):
    """The cache as stored lists, the older entries in one folder of files and the newer in the next."""
    folder = shared_folder(spark)
    entries = load(spark, sf, "ocr_cache")
    for seq in (0, 1):
        write_text_cache(entries.where(F.col("seq") == seq), f"{folder}/{seq}")
    return ca.latest_entries(co.read_text_cache(spark, f"{folder}/*"))


@query(
    "cache_missing",
    "SELECT d.path, d.label, d.label_name FROM doc_texts d WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.path = d.path AND l.text IS NOT NULL)",
    CACHE,
    LATEST,
)
def cache_missing(spark, sf):
    files = load(spark, sf, "doc_texts").select("path", "label", "label_name")
    return ca.missing(files, ca.latest_entries(load(spark, sf, "ocr_cache")))


MERGED = r"""SELECT d.path, CASE WHEN l.text IS NOT NULL THEN l.label ELSE d.label END AS label,
  CASE WHEN l.text IS NOT NULL THEN l.label_name ELSE d.label_name END AS label_name,
  coalesce(l.text, trim(regexp_replace(d.text, '\s+', ' ', 'g'))) AS text
FROM doc_texts d LEFT JOIN latest l ON l.path = d.path"""


@query("cache_merge", MERGED, CACHE, LATEST)
def cache_merge(spark, sf):
    cache = ca.latest_entries(load(spark, sf, "ocr_cache"))
    return ca.refresh(load(spark, sf, "doc_texts"), cache, tx.clean_text(F.col("text")))


@query("cache_swap", MERGED, CACHE, LATEST)
def cache_swap(spark, sf):
    """The cache as a table of versions: its entries, then the entries of the current files; the newest is read."""
    folder = shared_folder(spark)
    files = load(spark, sf, "doc_texts")
    vs.update(spark, folder, lambda _: ca.latest_entries(load(spark, sf, "ocr_cache")))
    vs.update(spark, folder, lambda cache: ca.refresh(files, cache, tx.clean_text(F.col("text"))))
    return vs.read_version(spark, folder)


@query(
    "sink_dataset",
    "SELECT split, label, count(*) AS n, sum(doc_id) AS ids, sum(list_sum(px)) AS levels FROM doc_images GROUP BY split, label",
    ("doc_images",),
)
def sink_dataset(spark, sf):
    folder = shared_folder(spark)
    images = load(spark, sf, "doc_images")
    write_split(images, folder)
    levels = F.sum(F.aggregate("px", F.lit(0), lambda acc, v: acc + v))
    return spark.read.schema(images.schema).parquet(folder).groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), levels.alias("levels")
    )


@query(
    "img_gray",
    "SELECT doc_id, p, (19595 * px + 38470 * ((px * 3) % 256) + 7471 * ((px * 7) % 256) + 32768) >> 16 AS gray FROM doc_pixels",
    ("doc_pixels",),
)
def img_gray(spark, sf):
    """Three channels per pixel, blue first, as the image source gives them."""
    shades = F.transform(
        "px", lambda v: F.concat(*(F.lpad(F.hex((v * k % 256).cast("bigint")), 2, "0") for k in (7, 3, 1)))
    )
    images = load(spark, sf, "doc_images").select(
        "doc_id", "height", "width", F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.unhex(F.array_join(shades, "")).alias("data")
    )
    return levels_of(to_gray(images)).withColumnRenamed("px", "gray")
