"""Shared pieces of the operators: block pairs, sorted runs, forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """Words of a text in order; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def block_pairs(members: DataFrame, group: str, member: str, block: int, weight: str | None = None, heavy: int = 500_000, core: str | None = None) -> DataFrame:
    """Deal the members of each group into pairs of blocks of about ``block`` members.

    Adds ``b_left`` and ``b_right`` (the pair of blocks) and ``b_own`` (the member's own block).
    A group of n members has ceil(n / block) blocks by hash of the member, each block meets each
    other block in one pair, so that every two members meet in exactly one pair of blocks and no
    task holds a whole large group. With ``weight``, blocks are also cut so that each weighs about
    ``heavy`` at most.

    With ``core``, members that are known to belong together need not meet: groups of one core are
    left out, and the blocks of a group's largest core meet those of the others but not each other.
    So a group of n near copies with m strays takes n * m / block rows and not n * n / block.
    """
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block))
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / F.lit(heavy)))
    if core is None:
        many = members.groupBy(group).agg(blocks.cast("int").alias("_nb")).where("_nb > 1").withColumn("_bulk", F.lit(0))
        members, other = members.join(many, group, "left"), F.col("_nb")
        own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.coalesce("_nb", F.lit(1))).cast("int")
    else:
        cores = members.groupBy(group, core).agg(F.count(F.lit(1)).alias("_n"), (F.sum(weight) if weight else F.count(F.lit(1))).alias("_w"))
        largest = F.max(F.struct("_n", F.col(core).alias("_core"), "_w"))
        cut = lambda n, w: F.greatest(F.lit(1), F.ceil(n / F.lit(block)), F.ceil(w / F.lit(heavy)) if weight else F.lit(1)).cast("int")
        sizes = cores.groupBy(group).agg(F.count(F.lit(1)).alias("_cores"), F.sum("_n").alias("_all"), F.sum("_w").alias("_weight"), largest.alias("_top")).where("_cores > 1")
        small = (F.col("_all") <= block) & (F.col("_weight") <= (heavy if weight else block))
        few, bulk = cut(F.col("_all") - F.col("_top._n"), F.col("_weight") - F.col("_top._w")), cut(F.col("_top._n"), F.col("_top._w"))
        sizes = sizes.select(group, F.col("_top._core").alias("_core"), F.when(small, 1).otherwise(few).alias("_nb"), F.when(small, 0).otherwise(bulk).alias("_bulk"))
        members = members.join(sizes, group)
        in_bulk = (F.col("_bulk") > 0) & (F.col(core) == F.col("_core"))
        spread = F.xxhash64(F.col(member), F.lit(7))
        own = F.when(in_bulk, F.col("_nb") + F.pmod(spread, F.greatest("_bulk", F.lit(1)))).otherwise(F.pmod(spread, F.col("_nb"))).cast("int")
        other = F.when(in_bulk, F.col("_nb")).otherwise(F.col("_nb") + F.col("_bulk"))
    return (
        members.withColumn("b_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        .withColumn("b_left", F.least("b_own", "_other"))
        .withColumn("b_right", F.greatest("b_own", "_other"))
        .drop("_nb", "_bulk", "_core", "_other")
    )


def star_blocks(pairs: DataFrame, block: int, weight: str | None = None, heavy: int = 500_000) -> DataFrame:
    """Block pairs of hubs and their members, from distinct (cid, hub): a hub (block 0) meets its
    members in as many blocks as their number and weight ask for."""
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(block))
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / F.lit(heavy)))
    deal = (F.pmod(F.xxhash64("cid"), F.col("_nb")) + 1).cast("int")
    dealt = pairs.join(pairs.groupBy("hub").agg(blocks.cast("int").alias("_nb")), "hub")
    dealt = dealt.select("cid", F.col("hub").alias("grp"), F.lit(0).alias("b_left"), deal.alias("b_right"), F.lit(1).alias("b_own"))
    hubs = dealt.select(F.col("grp").alias("cid"), "grp", "b_left", "b_right", F.lit(0).alias("b_own")).distinct()
    return dealt.unionByName(hubs).withColumn("core", F.col("cid"))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut the batches of one partition, sorted by ``keys``, into tables that hold whole groups.

    Each table holds one or more whole groups; groups may be found in it by the key changes.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = 0
        change = run_starts([batch.column(batch.schema.get_field_index(k)) for k in keys])
        if held:
            first, last = batch.slice(0, 1), held[-1].slice(held[-1].num_rows - 1, 1)
            if any(first.column(k)[0] != last.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        if len(change) > 1:
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def run_starts(columns: list) -> np.ndarray:
    """Row numbers at which a group begins, in columns sorted together."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        v = c.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
