"""Taking the first rows of each class from a label-sorted corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.ranking import first_k, position_in_group
from paperloom.schemas import CORPUS_CLASS_COUNT, LABEL_NAMES, SPLIT_TARGETS, literal_array, literal_map

GROUP = ["split", "label_name"]


def _target(targets: dict[str, int]):
    return F.try_element_at(literal_map(targets), F.col("split")).cast("bigint")


def head_per_class(
    corpus: DataFrame, targets: dict[str, int] = SPLIT_TARGETS, shard_col: str = "shard_idx", row_col: str = "row_idx"
) -> DataFrame:
    """First ``targets[split]`` rows of each class in shard and row order, with ``file_no`` from zero."""
    return position_in_group(corpus, GROUP, row_col, [shard_col], out="file_no", limit=_target(targets))


def resume_fill(
    corpus: DataFrame,
    taken: DataFrame,
    targets: dict[str, int] = SPLIT_TARGETS,
    shard_col: str = "shard_idx",
    row_col: str = "row_idx",
) -> DataFrame:
    """Top up partly filled classes with rows not taken yet; file numbers go on from those taken.

    Running it again on its own result adds nothing.
    """
    key = ["split", shard_col, row_col]
    done = taken.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_done"))
    # One row per class and split: the fixed class list, not the data, bounds this frame.
    room = (
        class_spine(taken, targets)
        .join(done, GROUP, "left")
        .select(*GROUP, F.coalesce("_done", F.lit(0)).alias("_done"), (F.col("target") - F.coalesce("_done", F.lit(0))).alias("_limit"))
    )
    rest = corpus.join(taken.select(*key), key, "left_anti")
    picked = position_in_group(rest, GROUP, row_col, [shard_col], out="_new", limit=room)
    return picked.withColumn("file_no", F.col("_done") + F.col("_new")).drop("_done", "_new")


def class_spine(any_df: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Every (split, class) with its target, from constants."""
    one = any_df.sparkSession.range(1)
    splits = one.select(F.explode(literal_map(targets)).alias("split", "target"))
    return splits.select("split", F.col("target").cast("bigint").alias("target"), F.explode(literal_array(LABEL_NAMES)).alias("label_name"))


def shortfall(collected: DataFrame, targets: dict[str, int] = SPLIT_TARGETS) -> DataFrame:
    """Per split and class: rows collected, target, and whether the class is full."""
    counts = collected.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return class_spine(collected, targets).join(counts, GROUP, "left").select(
        *GROUP, n.alias("collected"), "target", F.when(n >= F.col("target"), "full").otherwise("short").alias("status")
    )


def shard_range(corpus: DataFrame, codes: list[int], code_col: str = "label16") -> DataFrame:
    """Predicted first shard of each class code, and the shard at which a scan would stop.

    Assumes equal classes: a class starts at ``code * (rows div classes)``.  A scan goes one shard
    back from there and stops at the first shard without hits whose centre lies past the class.
    """
    per_shard = corpus.groupBy("split", "shard_idx", code_col).agg(F.count(F.lit(1)).alias("n"))
    sizes = per_shard.groupBy("split").agg(
        F.sum("n").alias("rows"), F.countDistinct("shard_idx").alias("shards")
    )
    shards = per_shard.select("split", "shard_idx").distinct().join(sizes, "split")
    grid = shards.withColumn(code_col, F.explode(literal_array(codes)))
    width = F.col("rows") / F.col("shards")
    share = F.floor(F.col("rows") / CORPUS_CLASS_COUNT)
    first = F.greatest(F.lit(0), F.floor(F.col(code_col) * share / width) - 1).cast("int")
    seen = grid.join(per_shard, ["split", "shard_idx", code_col], "left").withColumn("first_shard", first)
    past = F.col("n").isNull() & ((F.col("shard_idx") + 0.5) * width > (F.col(code_col) + 1) * share)
    ahead = F.col("shard_idx") >= F.col("first_shard")
    return seen.groupBy("split", code_col).agg(
        F.max("first_shard").alias("first_shard"),
        F.min(F.when(ahead & past, F.col("shard_idx"))).alias("stop_shard"),
    )


def class_examples(images: DataFrame, k: int = 6) -> DataFrame:
    """The first ``k`` documents of each class."""
    return first_k(images, "label", "doc_id", k)
