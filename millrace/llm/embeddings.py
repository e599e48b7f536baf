"""Embedding near-deduplication: cross-polytope hashing after fast Hadamard rotations.

A vector is turned by three rounds of random signs and a Walsh-Hadamard transform; its hash is the
axis it then lies closest to. Several such axes make a table's bucket key; further probes take the
next-closest axis where the choice was closest. Vectors that share a bucket are compared exactly
(cosine in double precision) inside blocks; counts of links and the edges of forests leave a block,
never its pairs.

In buckets larger than a block the members are first compared with the bucket's least vector; those
linked so are a core, which is compared within itself once, in blocks, and not in each of its buckets.
Every other pair is counted in the bucket with the least key that both have.

Defined results: vectors that are null, zero, or that hold null or non-finite components, and those
whose label is null, link with nothing; vectors link with those of their own length only; equal vectors
with equal labels are one class (their links are counted by number); repeated rows count as vectors of
their own; rows with a null id can be linked but name no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import block_pairs, run_starts, sorted_runs, star_blocks
from millrace.llm.components import connected_components
from millrace.scratch import cut_lineage


@dataclass(frozen=True)
class Plan:
    """``tables`` hash tables; ``probes`` buckets of each for every vector, its own included.

    The axes of a key grow with the logarithm of the vectors (see ``axes``), so that a bucket holds
    few vectors by chance at any size.
    """

    cosine: float = 0.98
    tables: int = 8
    probes: int = 4
    seed: int = 5

    def axes(self, vectors: int, width: int) -> int:
        return max(2, math.ceil(math.log(max(vectors, 2)) / math.log(2 * width)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, width, step = *x.shape, 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def bucket_keys(x: np.ndarray, plan: Plan, axes: int) -> np.ndarray:
    """Keys of each row: tables times probes of them, 64 bits each.

    Vectors shorter than a power of two are filled with zeros, which the rotation spreads.
    """
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng(plan.seed)
    out = np.empty((len(x), plan.tables * plan.probes), np.uint64)
    row = np.arange(len(x))
    for t in range(plan.tables):
        best, second, gap = [], [], []
        for _ in range(axes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            first = size.argmax(axis=1)
            top = size[row, first].copy()
            size[row, first] = -1
            next_ = size.argmax(axis=1)
            best.append(first * 2 + (y[row, first] < 0))
            second.append(next_ * 2 + (y[row, next_] < 0))
            gap.append(top - size[row, next_])
        order = np.argsort(np.stack(gap), axis=0, kind="stable")  # the least certain axis first
        # probe p swaps the axes whose bit is set in p, counted from the least certain one
        for p in range(plan.probes):
            key = np.full(len(x), t * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1, np.uint64)
            rank = np.argsort(order, axis=0)
            for k in range(axes):
                swap = np.where(rank[k] < 63, (p >> np.minimum(rank[k], 62)) & 1, 0).astype(bool)
                chosen = np.where(swap, second[k], best[k]).astype(np.uint64)
                key = (key ^ chosen) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
            out[:, t * plan.probes + p] = key
    return out.view(np.int64)


def usable(vec: str) -> Column:
    v = F.col(vec)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def with_keys(classes: DataFrame, plan: Plan, axes: int) -> DataFrame:
    """Adds each class's unit vector and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(4).to_numpy(zero_copy_only=False)
            widths = batch.column(3).to_numpy()
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                x = np.stack([np.asarray(vectors[i], np.float64) for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = bucket_keys(x, plan, axes)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(list(x), pa.list_(pa.float64())), pa.array(list(keys), pa.list_(pa.int64()))], names=["cid", "copies", "lab_key", "width", "unit", "keys"]
                )

    columns = classes.select("cid", "copies", "lab_key", "width", "vec")
    return columns.mapInArrow(run, "cid bigint, copies bigint, lab_key bigint, width int, unit array<double>, keys array<bigint>")


BLOCK_KEYS = ["grp", "b_left", "b_right"]


def shares_here(keys: np.ndarray, i: np.ndarray, j: np.ndarray, here: int, plan: Plan, part: int = 1 << 15) -> np.ndarray:
    """For each pair (i, j), whether the least key that both have is this bucket's."""
    by_table = keys.reshape(len(keys), plan.tables, plan.probes)
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), part):
        a, b = by_table[i[at : at + part]], by_table[j[at : at + part]]
        shared = (a[..., None] == b[:, :, None]).any(axis=3)
        out[at : at + part] = np.where(shared, a, np.iinfo(np.int64).max).min(axis=(1, 2)) == here
    return out


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each can reach by pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def compare(met: DataFrame, plan: Plan) -> DataFrame:
    """Per pair of blocks: (a, links) counts of links and (a, b) edges that tie up what they link.

    Where ``key`` is null the group is a core and every pair counts, elsewhere those across cores do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, BLOCK_KEYS):
            starts = [*run_starts([table.column(k) for k in BLOCK_KEYS]), table.num_rows]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if hi - lo < 2:
                    continue
                g = table.slice(lo, hi - lo)
                ids, copies, own, core = (g.column(c).to_numpy() for c in ("cid", "copies", "b_own", "core"))
                x = np.stack(g.column("unit").combine_chunks().to_numpy(zero_copy_only=False))
                here = g.column("key")[0].as_py()
                near = np.triu(x @ x.T >= plan.cosine, 1)
                if g.column("b_left")[0].as_py() != g.column("b_right")[0].as_py():
                    near &= own[:, None] != own
                if here is not None:
                    near &= core[:, None] != core
                i, j = np.nonzero(near)
                if here is not None and len(i):
                    counts = shares_here(np.stack(g.column("keys").combine_chunks().to_numpy(zero_copy_only=False)), i, j, here, plan)
                    i, j = i[counts], j[counts]
                if not len(i):
                    continue
                links = np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                hit, root = np.flatnonzero(links), least_reachable(len(ids), i, j)
                tied = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*ids[hit], *ids[tied]], pa.int64()), pa.array([*[None] * len(hit), *ids[root[tied]]], pa.int64()), pa.array([*links[hit], *[0] * len(tied)], pa.int64())],
                    names=["a", "b", "links"],
                )

    columns = ["cid", "copies", "core", "unit", "keys", "key", "b_own", *BLOCK_KEYS]
    return met.select(*columns).repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(run, "a bigint, b bigint, links bigint")


def star_links(dealt: DataFrame, plan: Plan) -> DataFrame:
    """(a, b) of the members that are linked with their hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, BLOCK_KEYS):
            starts = [*run_starts([table.column(k) for k in BLOCK_KEYS]), table.num_rows]
            for lo, hi in zip(starts, starts[1:], strict=False):
                g = table.slice(lo, hi - lo)
                ids, hub = g.column("cid").to_numpy(), g.column("b_own").to_numpy() == 0
                x = np.stack(g.column("unit").combine_chunks().to_numpy(zero_copy_only=False))
                linked = ids[~hub][x[~hub] @ x[hub][0] >= plan.cosine]
                yield pa.RecordBatch.from_arrays([pa.array(linked, pa.int64()), pa.array([ids[hub][0]] * len(linked), pa.int64())], names=["a", "b"])

    return dealt.select("cid", "unit", "b_own", *BLOCK_KEYS).repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(run, "a bigint, b bigint")


def near_duplicates(vectors: DataFrame, plan: Plan = Plan(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = 512) -> DataFrame:  # noqa: B008
    """(id, n_links, component, kept) of every row; links only between rows of equal labels."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("lab"))
    good = usable("vec") & F.col("lab").isNotNull()
    # the label enters as a hash only: labels may be of any type
    rows = rows.withColumn("lab_key", F.xxhash64("lab")).withColumn("cid", F.when(good, F.xxhash64("lab_key", "vec")))
    grouped = rows.where("cid is not null").groupBy("cid", "lab_key", "vec").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = cut_lineage(grouped.withColumn("width", F.size("vec")))
    n, width = classes.agg(F.count(F.lit(1)), F.max("width")).first()
    keyed = cut_lineage(with_keys(classes, plan, plan.axes(n, width or 1)))
    member = keyed.select("cid", F.explode(F.array_distinct("keys")).alias("key"), "lab_key", "width").select("cid", "key", F.xxhash64("key", "lab_key", "width").alias("grp"))
    shared = member.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("hub")).where("n > 1")
    member = cut_lineage(member.join(shared, "grp"))
    stars = member.where((F.col("n") > block) & (F.col("cid") != F.col("hub"))).select("cid", "hub").distinct()
    core_of = connected_components(star_links(star_blocks(stars, block).join(keyed.select("cid", "unit"), "cid"), plan))
    core_of = core_of.select(F.col("node").alias("cid"), F.col("component").alias("core"))
    core_of = cut_lineage(core_of.unionByName(core_of.select(F.col("core").alias("cid"), "core").distinct()))
    across = member.select("cid", "key", "grp").join(core_of, "cid", "left").withColumn("core", F.coalesce("core", "cid"))
    across = block_pairs(across, "grp", "cid", block, core="core")
    within = block_pairs(core_of.select("cid", F.lit(None).cast("bigint").alias("key"), F.xxhash64("core", F.lit("core")).alias("grp"), "core"), "grp", "cid", block)
    vectors_ = keyed.select("cid", "copies", "unit", "keys")
    found = cut_lineage(compare(across.unionByName(within).join(vectors_, "cid"), plan))
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    named = connected_components(found.where("b is not null")).withColumnRenamed("node", "cid")
    known = classes.select("cid", "first_id", "copies").join(named, "cid", "left").withColumn("group", F.coalesce("component", "cid"))
    least = known.groupBy("group").agg(F.min("first_id").alias("component")).withColumnRenamed("group", "g")
    known = (
        known.drop("component")
        .join(counts, "cid", "left")
        .join(least, F.col("group") == F.col("g"))
        .select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    )
    return (
        rows.select("id", "cid")
        .join(known, "cid", "left")
        .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))
    )
