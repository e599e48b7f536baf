"""Sharding by Karmarkar-Karp differencing, over groups that must stay together.

Rows are first summed into indivisible groups (equal texts). Groups are dealt to chunks of bounded
size; each chunk starts from one partial partition for each group and repeatedly combines the two
partial partitions of the largest spread, the fullest shard of one with the emptiest of the other,
until one is left. The chunks' partitions are combined in the same way, level by level, so no task
sees more than a chunk, and only the sums of a chunk's shards go up a level.

Defined results: a null text is empty; null ids are rows like others; equal rows share a shard and
have slots of their own; an empty table gives no rows; a group larger than a shard's fair share
stays whole and makes the sizes as uneven as it must.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import cut_lineage

#: Groups, or partial partitions, that one task combines.
CHUNK = 4096
#: Ranges that the rows of a shard are numbered in.
RANGES = 64


def combine(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differencing over partial partitions (rows of shard sums).

    Returns the sums of the final shards and, for each partition, where each of its shards goes.
    """
    n, k = sums.shape
    heap = [(-int(s.max() - s.min()), i, s) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        falling, rising = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        both = a[falling] + b[rising]
        made.append((i, j, falling, rising))
        heapq.heappush(heap, (-int(both.max() - both.min()), n + len(made) - 1, both))
    to = np.empty((n + len(made), k), np.int64)
    to[-1] = np.arange(k)
    for at in range(len(made) - 1, -1, -1):
        i, j, falling, rising = made[at]
        to[i][falling] = to[n + at]
        to[j][rising] = to[n + at]
    return heap[0][2], to[:n]


def combiner(shards: int, sums_of: Callable[[pd.DataFrame], np.ndarray]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("part", kind="stable")  # the same result from any order of arrival
        total, to = combine(sums_of(chunk))
        own = pd.DataFrame({"part": chunk["part"].to_numpy(), "node": chunk["node"].to_numpy(), "sums": None, "goes": list(to)})
        top = pd.DataFrame({"part": None, "node": chunk["node"].iloc[:1].to_numpy(), "sums": [total], "goes": None})
        return pd.concat([own, top], ignore_index=True)

    return run


def spread_groups(groups: DataFrame, shards: int, chunk: int = CHUNK) -> DataFrame:
    """(part, shard) from groups of (part string, size long): indivisible, balanced by size."""

    def leaves(rows: pd.DataFrame) -> np.ndarray:
        sums = np.zeros((len(rows), shards), np.int64)
        sums[:, 0] = rows["size"]
        return sums

    def partials(rows: pd.DataFrame) -> np.ndarray:
        return np.stack(rows["sums"].to_numpy())

    n = groups.count()
    nodes = max(1, -(-n // chunk))
    schema = "part string, node bigint, sums array<bigint>, goes array<bigint>"
    dealt = groups.withColumn("node", F.pmod(F.xxhash64("part"), F.lit(nodes)))
    level = cut_lineage(dealt.groupBy("node").applyInPandas(combiner(shards, leaves), schema))
    placed = level.where("part is not null").select("part", "node", F.element_at("goes", 1).alias("slot"))
    while nodes > 1:
        fewer = max(1, -(-nodes // chunk))
        up = level.where("part is null").select(F.col("node").cast("string").alias("part"), F.pmod("node", F.lit(fewer)).alias("node"), "sums")
        level = cut_lineage(up.groupBy("node").applyInPandas(combiner(shards, partials), schema))
        moves = level.where("part is not null").select(F.col("part").cast("long").alias("from"), F.col("node").alias("up"), "goes")
        placed = placed.join(moves, F.col("node") == F.col("from")).select(placed["part"], F.col("up").alias("node"), F.expr("goes[cast(slot as int)]").alias("slot"))
        nodes = fewer
    return placed.select("part", F.col("slot").cast("int").alias("shard"))


def numbered(rows: DataFrame, shards: int, order: list[Column]) -> DataFrame:
    """Adds ``slot``: 0, 1, ... within each shard.

    Rows of a shard are numbered within ranges by hash, and each range starts where those before
    it end; the table of starts has shards x RANGES rows.
    """
    ranged = cut_lineage(rows.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(RANGES)).cast("int")))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_range").orderBy(*order)
    return (
        ranged.withColumn("_at", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "_range"])
        .withColumn("slot", F.col("_start") + F.col("_at"))
        .drop("_range", "_at", "_start")
    )


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row; equal texts share a shard and the shards'
    bytes are as equal as differencing gets them. Only ids, sizes and digests are shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("part")
    )
    rows = cut_lineage(rows)
    placed = spread_groups(rows.groupBy("part").agg(F.sum("size").alias("size")), shards)
    return numbered(rows.join(placed, "part"), shards, [F.col("id"), F.col("part")]).drop("part")


