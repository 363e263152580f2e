"""Positions within a group that never put a whole group into one task.

A plain ``row_number() over (partition by g)`` sorts all of ``g`` in one task.  Here rows are dealt into ranges of the
order columns that hold about equally many rows, whatever the values are; rows are counted per range and group
(map-side combined), the counts become running offsets (ranges x groups rows), and only the rows of one range are
numbered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.sources.sinks import materialise

RANGES = 256
BLOCK_COL = "_block"
OFFSET_COL = "_offset"


def cut_points(df: DataFrame, order_col: str, ranges: int = RANGES) -> list:
    """Up to ``ranges - 1`` rising values of ``order_col`` that part its rows about evenly; one pass over the column."""
    shares = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(order_col, shares, max(10_000, 20 * ranges))).first()[0] if shares else None
    return sorted(set(cuts or []))


def range_number(order_col: str, cuts: list) -> Column:
    """How many cuts lie at or below the value, by halving."""

    def halve(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN `{order_col}` < {cuts[middle]} THEN {halve(low, middle)} ELSE {halve(middle + 1, high)} END"

    return F.expr(halve(0, len(cuts)))


def position_in_group(
    df: DataFrame,
    group_cols: list[str],
    order_col: str,
    coarse_cols: list[str] | None = None,
    out: str = "pos",
    limit: DataFrame | Column | None = None,
    ranges: int = RANGES,
) -> DataFrame:
    """Add the zero-based position of each row in its group.

    ``coarse_cols`` come before ``order_col`` (a number) in the order; the pair must be unique in the group.
    ``limit`` keeps the first rows of each group only: a column over the group columns, or a small
    frame ``group_cols + [_limit]``.
    Offsets are stored, so their size is known when the rows meet them: small ones are sent to the rows, and rows of
    ranges that start beyond the limit go before any row is shuffled for numbering.
    """
    coarse = coarse_cols or []
    keys = [*group_cols, *coarse, BLOCK_COL]
    ranged = df.withColumn(BLOCK_COL, range_number(order_col, cut_points(df, order_col, ranges)))
    before = (
        Window.partitionBy(*group_cols)
        .orderBy(*coarse, BLOCK_COL)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(OFFSET_COL))
    if limit is not None:
        bounded = (
            offsets.join(limit, group_cols)
            if isinstance(limit, DataFrame)
            else offsets.withColumn("_limit", limit)
        )
        offsets = bounded.where(F.col(OFFSET_COL) < F.col("_limit"))
    in_range = Window.partitionBy(*keys).orderBy(order_col)
    placed = ranged.join(materialise(offsets), keys).withColumn(
        out, F.col(OFFSET_COL) + F.row_number().over(in_range) - 1
    )
    if limit is not None:
        placed = placed.where(F.col(out) < F.col("_limit")).drop("_limit")
    return placed.drop(BLOCK_COL, OFFSET_COL)


def first_k(df: DataFrame, group_col: str, order_col: str, k: int, salts: int = 64) -> DataFrame:
    """The ``k`` rows of smallest ``order_col`` (unique) in each group.

    Found on the two key columns alone, first within hashed parts of each group, then among the
    survivors; the full rows are picked up by a join on the keys.
    """
    salted = df.select(group_col, order_col).withColumn("_salt", F.pmod(F.xxhash64(order_col), F.lit(salts)))
    in_part = Window.partitionBy(group_col, "_salt").orderBy(order_col)
    in_group = Window.partitionBy(group_col).orderBy(order_col)
    part = salted.withColumn("_r", F.row_number().over(in_part)).where(F.col("_r") <= k)
    keys = part.withColumn("pos", F.row_number().over(in_group)).where(F.col("pos") <= k)
    return df.join(keys.select(group_col, order_col, "pos"), [group_col, order_col])


def number_in_group(df: DataFrame, group_cols: list[str], order_cols: list[str], out: str = "pos") -> DataFrame:
    """Add the zero-based position of each row in its group, whatever the values of the order columns.

    Rows are dealt into ranges of (group, order), so that a large group takes many partitions; rows are counted per
    range and group, the counts become running offsets (ranges x groups rows), and rows are numbered within their
    range.  The dealt rows are stored, since both steps must see the same ranges.
    """
    dealt = materialise(
        df.repartitionByRange(*group_cols, *order_cols).withColumn(BLOCK_COL, F.spark_partition_id())
    )
    keys = [*group_cols, BLOCK_COL]
    before = Window.partitionBy(*group_cols).orderBy(BLOCK_COL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = offsets.select(
        *(F.col(k).alias(f"_at_{k}") for k in keys), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias(OFFSET_COL)
    )
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    in_range = Window.partitionBy(*keys).orderBy(*order_cols)
    numbered = dealt.withColumn(out, F.row_number().over(in_range) - 1)
    return numbered.join(offsets, same).select(*df.columns, (F.col(out) + F.col(OFFSET_COL)).alias(out))
