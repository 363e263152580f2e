"""Reading the label-sorted corpus, image folders and the text cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.labels import label_index
from paperloom.schemas import CORPUS_CODES, LABEL_NAMES, SPLITS, TEXT_CACHE_SCHEMA

PIECE_BITS = 12  # pieces of a text cache are added up in blocks of 4096


def read_corpus(spark: SparkSession, path: str, codes: tuple[int, ...] = tuple(CORPUS_CODES)) -> DataFrame:
    """Image and label of the wanted codes, with the shard file and row each came from.

    The filter and the two columns reach the parquet scan; on a label-sorted corpus row groups
    of other classes are skipped by their statistics.
    """
    shards = spark.read.parquet(path)
    return shards.where(F.col("label").isin(list(codes))).select(
        "image",
        "label",
        F.col("_metadata.file_path").alias("shard"),
        F.col("_metadata.row_index").alias("row_idx"),
    )


def image_bytes(df: DataFrame, col: str = "image") -> Column:
    """Encoded bytes from a struct of bytes and path, or from a plain binary column.

    A row that carries a path only has null bytes here.
    """
    if isinstance(df.schema[col].dataType, T.StructType):
        value = F.col(f"{col}.bytes")
    else:
        value = F.col(col)
    return F.when(F.length(value) > 0, value)


def tag_image_path(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Split, class name, class number and file name from ``…/{split}/{class}/{file}.png``.

    Files outside the known splits and classes are left out.
    """
    pattern = rf"(?:^|/)({'|'.join(SPLITS)})/({'|'.join(LABEL_NAMES)})/([^/]+\.png)$"
    name = F.regexp_extract(path_col, pattern, 2)
    return df.where(F.regexp_like(path_col, F.lit(pattern))).withColumns(
        {
            "split": F.regexp_extract(path_col, pattern, 1),
            "label_name": name,
            "label": label_index(name),
            "file_name": F.regexp_extract(path_col, pattern, 3),
        }
    )


def read_image_tree(spark: SparkSession, root: str, splits: tuple[str, ...] = SPLITS, drop_invalid: bool = False) -> DataFrame:
    """Decoded images of a ``{split}/{class}/*.png`` tree with split and class.

    A missing split folder is an error; a missing class folder just has no rows.  Files that cannot
    be decoded are kept with negative size unless ``drop_invalid``.
    """
    images = (
        spark.read.format("image")
        .option("dropInvalid", drop_invalid)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.png")
        .load([f"{root.rstrip('/')}/{s}" for s in splits])
        .select("image.*")
    )
    return tag_image_path(images.withColumnRenamed("origin", "path"))


def read_text_cache(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON text caches, one list per file, with ``seq``: the file's path and the place in its list, so that a
    later file's entry is the later one however files are dealt to tasks.

    A large file is read by many tasks.  Its text comes in pieces that end at a closing brace (a record separator that
    Spark splits files at); whether a brace closes an entry of the list follows from the quotes and braces before it,
    which are counted per block of pieces, added up over the blocks of a file and then within each block.  Pieces up to a closing
    brace of the list's own level make an entry.  A file that does not hold one whole list gives no rows; an entry that
    is no object with a path is left out, but keeps its place.
    """
    pieces = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    plain = F.regexp_replace("value", r'\\.', "")  # escaped characters count for nothing
    parts = F.split(plain, '"')

    def braces(first: int) -> Column:
        """Opening braces in every second part between quotes."""
        chosen = F.filter(parts, lambda part, i: F.pmod(i, F.lit(2)) == first)
        return F.aggregate(chosen, F.lit(0), lambda n, part: n + F.length(part) - F.length(F.replace(part, F.lit("{"), F.lit(""))))

    shown = F.trim(F.translate("value", "\r\n\t", "   "))
    counted = pieces.select(
        "*", F.shiftright("_id", PIECE_BITS).alias("_block"), (F.size(parts) - 1).alias("_quotes"),
        braces(0).alias("_outside"), braces(1).alias("_inside"),
        F.left(shown, F.lit(1)).alias("_first"), (shown == "]").alias("_end"),
    )
    quoted = _running(counted, "_quotes", "_before")
    within = F.pmod("_before", F.lit(2)) == 1  # the piece begins inside a string
    closes = F.pmod(F.col("_before") + F.col("_quotes"), F.lit(2)) == 0  # its last brace is not part of one
    stepped = quoted.withColumn("_step", F.when(within, F.col("_inside")).otherwise(F.col("_outside")) - closes.cast("int"))
    deep = _running(stepped, "_step", "_depth")
    done = (F.col("_depth") + F.col("_step") == 0) & closes
    listed = _running(deep.withColumn("_done", done.cast("int")), "_done", "_at")
    # What follows the last brace of a file is its last piece, for which one closing brace too many was counted.
    order = F.struct("_start", "_id")
    ends = listed.groupBy("_file").agg(
        F.min_by("_first", order).alias("_open"), F.max_by("_end", order).alias("_close"),
        F.max_by(F.col("_depth"), order).alias("_left"), F.max(order).alias("_last"),
    )
    whole = ends.where((F.col("_open") == "[") & F.col("_close") & (F.col("_left") == 0))
    inner = listed.join(whole.select("_file", "_last"), "_file").where(order != F.col("_last"))
    texts = inner.groupBy("_file", "_at").agg(F.array_sort(F.collect_list(F.struct("_start", "_id", "value"))).alias("_parts"))
    entry = F.regexp_replace(F.concat(F.array_join("_parts.value", "}"), F.lit("}")), r"^[\s\[,]+", "")
    rows = texts.select("_file", "_at", F.from_json(entry, TEXT_CACHE_SCHEMA).alias("_row"))
    seq = F.struct(F.col("_file").alias("file"), F.col("_at").cast("int").alias("at")).alias("seq")
    return rows.select("_row.*", seq).where(F.col("path").isNotNull())


def _running(pieces: DataFrame, col: str, out: str) -> DataFrame:
    """Add the sum of ``col`` over the pieces before each one of its file: sums per block first, so that no window holds
    more than a block of a split or one row per block."""
    at = ["_file", "_start", "_block"]
    blocks = pieces.groupBy(*at).agg(F.sum(col).alias("_sum"))
    earlier = Window.partitionBy("_file").orderBy("_start", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*at, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    here = Window.partitionBy(*at).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(col).over(here), F.lit(0))
    return pieces.join(offsets, at).withColumn(out, F.col("_offset") + inside).drop("_offset")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The cache as JSON lines, the form that splits across tasks.

    The order column ``seq`` is written with the rows.  A line that is broken or has a value of another type stays,
    as a row with the line in ``broken``; other rows have null there.
    """
    fields = [T.StructField("seq", T.LongType()), *TEXT_CACHE_SCHEMA.fields, T.StructField("broken", T.StringType())]
    return spark.read.schema(T.StructType(fields)).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="broken")
