"""The operators' named queries, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.decision_list import judge_documents
from paperloom.llm.decontamination import find_leaks
from paperloom.llm.importance import resample
from paperloom.llm.kernel_quality import quality_scores
from paperloom.llm.labelled import fold
from paperloom.llm.near_duplicates import near_duplicates
from paperloom.llm.pair_merges import decode_bpe, encode_bpe
from paperloom.llm.sharding import shard_documents
from paperloom.llm.token_files import read_token_index, write_token_files
from paperloom.llm.toxicity import toxicity_scores
from paperloom.llm.unigram import count_tokens, decode_pieces, encode_pieces
from paperloom.llm.warc import read_records, write_archives
from paperloom.llm.whitening import identity_error, whiten

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
KEEP_FROM = 0.3
TOXIC_FROM = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to sequence files and read back."""
    folder, manifest = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return read_token_index(folder, manifest).withColumnRenamed("id", "doc_id")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts, equal texts together as far as the counts allow."""
    placed = shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "copy_group",
    )


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return _predicted(scored, KEEP_FROM)


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return _predicted(scored, TOXIC_FROM)


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the index."""
    folder, index = write_archives(_table(spark, sf_dir, "pages"))
    return read_records(folder, index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again: ``round_trip`` tells that the text came back."""
    return round_trip(_table(spark, sf_dir, "documents"))


def round_trip(docs: DataFrame) -> DataFrame:
    """``doc_id, ids, n_tokens, text_crc32`` (of the decoded text) and ``round_trip``: decoding gives the text with
    U+2581 as a space."""
    model = public_tokenizers.path(PIECES)
    # The checksum of what should come back rides along in the encoding pass.
    decoded = decode_pieces(encode_pieces(docs, model, with_crc=True), model, out="_decoded")
    crc = F.crc32(F.col("_decoded").cast("binary"))
    return decoded.select("doc_id", "ids", "n_tokens", crc.alias("text_crc32"), (crc == F.col("crc32")).alias("round_trip"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path(PIECES))
    return counted.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), "n_tokens")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn by likeness to the benchmark; every document's weight and score."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they spell, as digests."""
    vocabulary = public_tokenizers.path(BYTE_BPE)
    coded = encode_bpe(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = decode_bpe(coded, vocabulary)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the leading components, one row per vector and component."""
    rows = _table(spark, sf_dir, "embeddings")
    white, fit = whiten(rows)
    error = identity_error(rows.select(F.col("embedding").alias("v")), fit) if fit else 0.0
    shares = F.array(*map(F.lit, fit.explained.tolist() if fit else [])).cast("array<double>")
    long = white.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("_at") + 1).alias("component"),
        F.lit(fit.n if fit else 0).cast("bigint").alias("n"),
        F.col("deviation").cast("bigint").alias("deviation"),
        "whitened",
        shares[F.col("_at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


QUERIES = {
    "op1_token_files": token_files,
    "op2_balanced_shards": shards,
    "op3_kernel_quality": quality,
    "op4_warc": warc,
    "op5_toxicity": toxicity,
    "op6_quality_rules": rules,
    "op7_pieces": pieces,
    "op8_token_counts": token_counts,
    "op9_near_duplicates": near_dedup,
    "op10_decontamination": leaks,
    "op11_importance": importance,
    "op12_byte_pairs": byte_pairs,
    "op13_whitening": whitening,
}

ORACLES = {
    # Equal payloads meet by digest; a digest has a fifth of a base-32 letter more than SQL's hex form, so each
    # letter is five bits of the hex digits.
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS original FROM d GROUP BY hex)
SELECT page_id, n AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     ((('0x' || substr(d.hex || '0', CAST(5 * k // 4 AS INT) + 1, 2))::INT * 8
       // CAST(pow(2, 3 - (5 * k) % 4 + 3) AS INT)) % 32) + 1, 1), '' ORDER BY k)
   FROM range(32) AS r(k)) AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM d JOIN f USING (hex)
""",
}
