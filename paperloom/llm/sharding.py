"""Sharding by balanced label propagation: linked documents gather under capacity quotas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import narrow
from paperloom.operators.ranking import number_in_group
from paperloom.sources.sinks import materialise

SHARDS = 8
ROUNDS = 5
SETTLED = 0.002


def quotas(wanted: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the ``wanted[i, j]`` moves may go, and the flow of unlinked nodes that makes room for them.

    For each pair of shards as many nodes go one way as the other; the weaker direction is filled up with unlinked
    nodes (``free`` per shard, dealt out by demand), so that every shard keeps its size.
    """
    lack = np.maximum(wanted - wanted.T, 0)  # unlinked nodes that shard j owes shard i
    owed = lack.sum(axis=0)
    share = np.where(owed > 0, np.minimum(1.0, free / np.maximum(owed, 1)), 0.0)
    fill = np.floor(lack * share[None, :]).astype(np.int64).T  # fill[j, i]: unlinked nodes from j to i
    moves = np.minimum(wanted, wanted.T + fill.T)
    return moves, np.minimum(fill, np.maximum(moves.T - np.minimum(wanted, wanted.T), 0))


def _votes(edges: DataFrame, labels: DataFrame, shards: int, turn: int) -> DataFrame:
    """Nodes whose neighbours' most common shard beats their own: ``id, at, to, gain``.

    Half of the nodes are asked in each turn, else two neighbours could change places for ever.
    """
    asked = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0
    heard = (
        edges.where(asked)
        .join(labels.select(F.col("id").alias("other"), F.col("shard").alias("theirs")), "other")
        .groupBy("id", "theirs")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = (
        heard.join(labels, "id")
        .groupBy("id", "shard")
        .agg(
            F.max(F.col("n") * shards + (shards - 1 - F.col("theirs"))).alias("top"),
            F.max(F.when(F.col("theirs") == F.col("shard"), F.col("n")).otherwise(0)).alias("own"),
        )
    )
    gain = F.floor(F.col("top") / shards) - F.col("own")
    to = (shards - 1 - F.pmod("top", F.lit(shards))).cast("int")
    return best.where(gain > 0).select("id", F.col("shard").alias("at"), to.alias("to"), gain.alias("gain"))


def balanced_labels(
    nodes: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, settled: float = SETTLED
) -> DataFrame:
    """``id, shard`` of ``nodes`` (unique ``id`` from 0, gapless) linked by ``edges`` (id, other).

    Nodes start dealt out in turn, so counts are at most one apart, and stay so: in each round linked nodes ask
    their neighbours, the strongest gains move within the quotas of their pair of shards, and unlinked nodes make
    room.  Rounds end after ``rounds``, when nothing moves, or when less than the share ``settled`` of the linked nodes
    would (0: only when nothing does).  Only linked nodes take part in the joins; of the others just counts matter until the end.  The driver
    sees shards x shards counts.
    """
    both = materialise(edges.unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other"))))
    start = (F.col("id") % shards).cast("int").alias("shard")
    labels = materialise(both.select("id").distinct().select("id", start))
    unlinked = nodes.join(labels.select("id"), "id", "left_anti").select("id", start)
    unlinked = materialise(unlinked)
    free0 = np.zeros(shards, np.int64)
    for r in unlinked.groupBy("shard").count().collect():
        free0[r["shard"]] = r["count"]
    free = free0.copy()
    linked = labels.count()
    for turn in range(rounds if linked else 0):
        wishes = materialise(_votes(both, labels, shards, turn))
        wanted = np.zeros((shards, shards), np.int64)
        for r in wishes.groupBy("at", "to").count().collect():
            wanted[r["at"], r["to"]] = r["count"]
        moves, fill = quotas(wanted, free)
        if not moves.sum() or moves.sum() < settled * linked:
            break
        free = free - fill.sum(axis=1) + fill.sum(axis=0)
        room = F.array(*(F.array(*(F.lit(int(x)) for x in row)) for row in moves))
        ranked = number_in_group(wishes.withColumn("loss", -F.col("gain")), ["at", "to"], ["loss", "id"], "rank")
        gone = ranked.where(F.col("rank") < room[F.col("at")][F.col("to")]).select("id", "to")
        labels = materialise(
            labels.join(gone, "id", "left").select("id", F.coalesce("to", "shard").alias("shard"))
        )
    if (free == free0).all():
        return labels.unionByName(unlinked)
    # The last rows of shards that give go to shards that take, in order.
    staying = F.array(*(F.lit(int(min(a, b))) for a, b in zip(free, free0, strict=True)))
    given = np.maximum(free0 - free, 0)
    before = F.array(*(F.lit(int(x)) for x in np.cumsum(given) - given))
    ends = np.cumsum(np.maximum(free - free0, 0))
    ranked = number_in_group(unlinked, ["shard"], ["id"], "rank")
    ticket = before[F.col("shard")] + F.col("rank") - staying[F.col("shard")]
    taker = F.aggregate(F.array(*(F.lit(int(e)) for e in ends)), F.lit(0), lambda a, e: a + F.when(ticket >= e, 1).otherwise(0))
    moved = F.when(F.col("rank") < staying[F.col("shard")], F.col("shard")).otherwise(taker).cast("int")
    return labels.unionByName(ranked.select("id", moved.alias("shard")))


def shard_documents(
    docs: DataFrame,
    shards: int = SHARDS,
    rounds: int = ROUNDS,
    settled: float = SETTLED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Shard and slot of every row; documents of equal text are linked, each to the first of them.

    Returns id, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``shard``, ``slot`` (gapless from 0 in each shard) and
    ``copy_group`` (row number of the first equal text).  Row counts of shards are at most one apart, so a group
    of more copies than a shard holds is cut.  A null text has size 1 and the empty text's checksum; it is linked
    with empty and null texts.  Rows without an id and repeated rows are rows like others; an empty table gives none.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = narrow(docs, doc=id_col, text=text_col).select(
        "doc",
        F.sha1(text).alias("digest"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    nodes = materialise(number_in_group(rows, [], ["doc", "digest"], "id"))
    first = materialise(
        nodes.groupBy("digest").agg(F.min("id").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    edges = materialise(nodes.join(first, "digest").where("id > other").select("id", "other"))
    labels = materialise(balanced_labels(nodes.select("id"), edges, shards, rounds, settled))
    placed = nodes.join(labels, "id").join(edges, "id", "left")
    slots = number_in_group(
        placed.select("doc", "id", "size", "text_crc32", "shard", F.coalesce("other", "id").alias("copy_group")),
        ["shard"],
        ["id"],
        "slot",
    )
    return slots.select(
        F.col("doc").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("bigint").alias("slot"), "copy_group"
    )
