"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

Documents longer than a bin are cut; whole pieces fill bins of their own and only what remains is
packed. Remainders are dealt by hash to shards of bounded size, each packed on its own: longest
first, into the bin whose residual is the smallest that suffices and that holds neither the
piece's source nor its duplicate cluster. Bins are kept by residual; a bitmap over residuals gives
the successor, and the search goes on through them until a compatible bin is found.

Defined results: null and empty texts have length 0 and take part like others; null sources conflict
with nothing; null texts are no duplicates of each other; pieces of one length are placed by id, source
and cluster; among bins of one residual the older is taken; an empty table gives no rows; repeated rows,
and rows without an id, are pieces of their own (of one cluster, if their texts are equal), so that no
bin is ever fuller than its capacity.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, word_array
from millrace.scratch import cut_lineage

#: Tokens of a bin, a token being estimated as four characters.
CAPACITY = 2048
#: Remainders packed together in one task.
SHARD = 4096


def bits(keys: Iterable) -> list[int]:
    """A bit for each key that occurs more than once; keys that can't conflict get none."""
    seen: dict = {}
    for k in keys:
        if k is not None:
            seen[k] = seen.get(k, 0) + 1
    place = {k: 1 << i for i, k in enumerate(k for k, n in seen.items() if n > 1)}
    return [place.get(k, 0) for k in keys]


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given."""
    source_bits, cluster_bits = bits(sources), bits(clusters)
    held_sources: list[int] = []
    held_clusters: list[int] = []
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has residual r
    out = []
    for length, source, cluster in zip(lengths, source_bits, cluster_bits, strict=True):
        rest, found = filled >> length, -1
        residual = length
        while rest and found < 0:
            step = (rest & -rest).bit_length() - 1
            residual += step
            for at, b in enumerate(by_residual[residual]):
                if not (held_sources[b] & source or held_clusters[b] & cluster):
                    found = at
                    break
            else:
                rest >>= step + 1
                residual += 1
        if found >= 0:
            b = by_residual[residual].pop(found)
            if not by_residual[residual]:
                filled &= ~(1 << residual)
        else:
            b, residual = len(held_sources), capacity
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[b] |= source
        held_clusters[b] |= cluster
        insort(by_residual[residual - length], b)  # the older bin first
        filled |= 1 << (residual - length)
        out.append((b, capacity - residual))
    return out


def text_cluster(text: Column) -> Column:
    """Cluster of texts that are equal but for case and white space."""
    return F.md5(F.array_join(word_array(ascii_lower(text)), " "))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, tokens_col: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row for each piece: (bin, id, piece, start, length, bin_offset, source, cluster).

    ``start`` counts tokens from the beginning of the document. Without ``tokens_col`` a token is four
    characters; without ``cluster_col`` the cluster is that of equal texts (near copies are one cluster
    only if a column says so). Only ids, lengths and keys are shuffled.
    """
    length = F.col(tokens_col) if tokens_col else F.ceil(F.char_length(F.coalesce(F.col(text_col), F.lit(""))) / 4)
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.when(F.col(text_col).isNotNull(), text_cluster(F.col(text_col)))
    items = docs.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("tokens"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"))
    # texts are read once, and the numbers that tell repeated rows apart are fixed
    items = cut_lineage(items.withColumn("row", F.monotonically_increasing_id()))
    shards = max(1, -(-items.count() // shard))
    whole = F.floor(F.col("tokens") / capacity).cast("int")
    full = items.where(whole > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), whole - 1)))
    full = full.select(
        F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin"),
        "id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.lit(0).cast("long").alias("bin_offset"), "source", "cluster",
    )
    rest = items.select("id", "row", whole.alias("piece"), (F.col("tokens") % capacity).alias("length"), "source", "cluster").where("length > 0 or piece = 0")
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("id", "cluster", "row"), F.lit(shards))).drop("row")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "source", "cluster"], ascending=[False, True, True, True], kind="stable")
        none = lambda c: [None if pd.isna(x) else x for x in group[c]]
        placed = best_fit(group["length"].tolist(), none("source"), none("cluster"), capacity)
        n = group["shard"].iloc[0] if len(group) else 0
        return pd.DataFrame({
            "bin": [f"pack-{n}-{b}" for b, _ in placed], "id": group["id"].to_numpy(), "piece": group["piece"].to_numpy(), "start": group["piece"].to_numpy().astype("int64") * capacity,
            "length": group["length"].to_numpy(), "bin_offset": [at for _, at in placed], "source": group["source"].to_numpy(), "cluster": group["cluster"].to_numpy(),
        })

    id_type = dict(items.dtypes)["id"]
    packed = rest.groupBy("shard").applyInPandas(run, f"bin string, id {id_type}, piece int, start bigint, length bigint, bin_offset bigint, source string, cluster string")
    return full.unionByName(packed)
