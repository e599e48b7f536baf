"""MinHash near-deduplication: universal hash minima in bands, verified by signature, then on sets.

1. One pass over the texts gives each document's set size, a digest of its set and its signature;
   documents with equal sets become one class with a number, so copies cost nothing further.
2. Classes meet in the buckets of their bands. In buckets larger than a block, each member is first
   confirmed against the bucket's least class on full sets; what is linked so is a core, whose members
   need not be compared with each other any more. A bucket of one core is done.
3. Within the other buckets the signatures are compared across cores, in blocks, and a forest of the
   pairs that may be similar comes out: their trees are the families.
4. Within each family of several cores, in blocks again, all pairs across cores are confirmed on their
   full sets; a forest of confirmed links comes out.
5. The links' components (large-star and small-star) are the groups, named by their smallest id.

All pairs are looked at inside blocks, none but the edges of forests leave them. A group of n copies
near its least one costs n comparisons; only strays meet all others.

Defined results: null texts, and texts without words, have an empty set and link with nothing; a text
with fewer words than a shingle is one shingle; documents are told apart by set, so equal ids with
different texts are documents of their own that share a name at most; rows with a null id are in the
group of their set but never name it, and are kept only where it has no name; repeated rows are one
class. Of each group one (id, mark) is ``chosen``: the smallest id and, among texts of the same id,
the smallest hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import block_pairs, run_starts, sorted_runs, star_blocks
from millrace.llm.components import connected_components
from millrace.scratch import cut_lineage

U = np.uint64


@dataclass(frozen=True)
class Plan:
    """What counts as similar: shingles of ``words`` words, |A and B| * den >= |A or B| * num.

    With 25 bands of 5 minima a pair at 0.8 is missed with a chance of 5e-5, one at 0.85 of 4e-7.
    ``slack`` is how far below the threshold a signature's estimate may lie: four standard
    deviations of 125 minima.
    """

    words: int = 5
    num: int = 80
    den: int = 100
    bands: int = 25
    rows: int = 5
    slack: float = 0.15

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def agree(self) -> int:
        """Least number of equal minima of a pair that is looked at closely."""
        return int((self.num / self.den - self.slack) * self.minima)


def odd(seed: int, n: int, kind: type) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True) | kind(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over all of them (the finaliser of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Shingler:
    """Hashed shingle sets of texts, whole Arrow batches at a time."""

    BASE = 0x9E3779B97F4A7C55
    STEP = 1 << 20

    def __init__(self, words: int) -> None:
        self.words = words
        self.weights = odd(11, words + 1, U)
        self.power = self.inverse = np.ones(0, U)

    def powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, self.STEP)
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def word_hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a text begin in its bytes, and their hashes."""
        n = len(data)
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            return begin, np.zeros(0, U)
        self.powers(n + 1)
        low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        sums = np.zeros(n + 1, U)
        np.cumsum((low.astype(U) + U(1)) * self.power[:n], out=sums[1:])
        return begin, mix((sums[end] - sums[begin]) * self.inverse[begin])

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text. Texts are hashed together up to a
        megabyte; longer ones on their own."""
        texts = texts.cast(pa.large_string())
        texts = pa.array(texts.fill_null("")) if texts.null_count else texts
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.STEP, "right")) - 1)
            bounds = offsets[at : to + 1] - offsets[at] + np.arange(to - at + 1)
            part = np.full(bounds[-1], 32, np.uint8)  # a gap after each text
            for i in range(to - at):
                part[bounds[i] : bounds[i + 1] - 1] = data[offsets[at + i] : offsets[at + i + 1]]
            begin, hashes = self.word_hashes(part)
            cuts = np.searchsorted(begin, bounds)
            shingles = self.shingles(hashes)
            for i in range(to - at):
                a, b = cuts[i], cuts[i + 1]
                if b - a >= self.words:
                    yield np.unique(shingles[a : b - self.words + 1])
                elif b > a:
                    yield mix((hashes[a:b] * self.weights[: b - a]).sum(keepdims=True) + self.weights[-1:] * U(b - a))
                else:
                    yield np.zeros(0, U)
            at = to

    def shingles(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) - self.words + 1
        if n <= 0:
            return np.zeros(0, U)
        out = np.zeros(n, U)
        for i in range(self.words):
            out += hashes[i : i + n] * self.weights[i]
        return mix(out)


class Signer:
    """Minima of many universal hashes x -> a x + b over 32 bits."""

    def __init__(self, plan: Plan) -> None:
        self.plan = plan
        self.a = odd(23, plan.minima, np.uint32)[:, None]
        self.b = odd(29, plan.minima, np.uint32)[:, None]
        self.weights = odd(31, plan.rows, U)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> U(32)).astype(np.uint32)
        out = np.full(self.plan.minima, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 4096):
            np.minimum(out, (self.a * x[None, i : i + 4096] + self.b).min(axis=1), out=out)
        return out

    def bands(self, minima: np.ndarray) -> np.ndarray:
        rows = minima.reshape(self.plan.bands, self.plan.rows).astype(U)
        return mix((rows * self.weights).sum(axis=1) + np.arange(self.plan.bands, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)

    @staticmethod
    def short(minima: np.ndarray) -> bytes:
        """A byte of each minimum: unequal minima agree by chance in one of 256 cases."""
        return (minima ^ (minima >> np.uint32(16))).astype(np.uint8).tobytes()


def sign(docs: DataFrame, plan: Plan) -> DataFrame:
    """From (id, text, mark): n_shingles, the set's digest, bucket keys and short signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, signer = Shingler(plan.words), Signer(plan)
        for batch in batches:
            if not batch.num_rows:
                continue
            size, key, bands, short = [], [], [], []
            for s in shingler.sets(batch.column(1)):
                size.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    minima = signer.minima(s)
                    bands.append(signer.bands(minima))
                    short.append(signer.short(minima))
                else:
                    bands.append(None)
                    short.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                names=["id", "mark", "n_shingles", "set_key", "bands", "short"],
            )

    return docs.mapInArrow(run, "id bigint, mark bigint, n_shingles bigint, set_key binary, bands array<bigint>, short binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each group of a partition sorted by ``keys``."""
    for table in sorted_runs(batches, keys):
        starts = [*run_starts([table.column(k) for k in keys]), table.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if b - a > 1:
                yield table.slice(a, b - a)


def similar(short: np.ndarray, i: int, js: np.ndarray, least: int) -> np.ndarray:
    return js[(short[js] == short[i]).sum(axis=1) >= least]


def common_counts(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs of a block, as products of 0/1 matrices.

    Hashes that only one set of the block has don't enter; the others are taken ``width`` at a time,
    so memory is bounded by the block.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (first, first + width))
        part = np.zeros((n, min(width, int(column[b - 1]) - first + 1)), np.float32)
        part[owner[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


BLOCK_KEYS = ["grp", "b_left", "b_right"]


def forest(pairs: DataFrame, plan: Plan, exact: bool, star: bool = False) -> DataFrame:
    """Spanning edges (a, b) of the similar pairs across cores in each pair of blocks; with ``star``
    only pairs with the member of block 0 are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(plan.words)
        for group in grouped(batches, BLOCK_KEYS):
            ids = group.column("cid").to_numpy()
            own = group.column("b_own").to_numpy()
            _, label = np.unique(group.column("core").to_numpy(), return_inverse=True)
            cross = group.column("b_left")[0].as_py() != group.column("b_right")[0].as_py()
            short = None if exact else np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint8).reshape(len(ids), -1)
            near = None
            if exact:
                sets = list(shingler.sets(group.column("text").combine_chunks()))
                size = np.array([len(x) for x in sets])
                common = hub_counts(sets, np.flatnonzero(own == 0)) if star else common_counts(sets)
                near = plan.den * common >= plan.num * (size[:, None] + size - common)
            a, b = [], []
            for i in np.flatnonzero(own == 0) if star else range(len(ids) - 1):
                js = np.arange(0 if star else i + 1, len(ids))
                js = js[label[js] != label[i]]
                if cross:
                    js = js[own[js] != own[i]]
                for j in js[near[i, js]] if exact else similar(short, i, js, plan.agree):
                    if label[i] == label[j]:
                        continue
                    label[label == label[j]] = label[i]
                    a.append(ids[i])
                    b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    columns = ["cid", "core", "b_own", *BLOCK_KEYS, "text" if exact else "short"]
    return pairs.select(*columns).repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS, "cid").mapInArrow(run, "a bigint, b bigint")


def hub_counts(sets: list[np.ndarray], hubs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections with the hubs only; the others are left at zero."""
    out = np.zeros((len(sets), len(sets)))
    for i in hubs:
        out[i] = [np.isin(s, sets[i], assume_unique=True).sum() for s in sets]
    return out


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:  # noqa: B008
    """(id, mark, n_shingles, component, kept, chosen) of every row; ``mark`` is xxhash64 of the text."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("mark", F.xxhash64("text"))
    signed = cut_lineage(sign(texts, plan))
    # equal sets are one class; its first row by id stands for it
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark", "n_shingles", "bands", "short"))
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(first.alias("c")).select(F.monotonically_increasing_id().alias("cid"), "set_key", "c.*")
    classes = cut_lineage(classes)  # the numbers are fixed from here on
    member = classes.select("cid", "short", "n_shingles", F.explode("bands").alias("grp"))
    # buckets that hold the same classes are looked at once
    buckets = member.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("lo"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("sum")).where("n > 1")
    chosen = buckets.groupBy("n", "lo", "sum").agg(F.min("grp").alias("grp")).select("grp", "n", F.col("lo").alias("hub"))
    met = cut_lineage(member.join(chosen, "grp"))

    # the texts of all classes that share a bucket, fetched once; of repeated rows one stands for all
    rep = met.select("cid").distinct().join(classes.select("cid", "id", "mark"), "cid")
    rep = rep.join(texts.withColumnRenamed("id", "t_id"), F.col("id").eqNullSafe(F.col("t_id")) & (rep["mark"] == texts["mark"]))
    held = cut_lineage(rep.select("cid", "text").dropDuplicates(["cid"]))
    stars = met.where((F.col("n") > 2 * block) & (F.col("cid") != F.col("hub"))).select("cid", "hub", "n_shingles").distinct()
    dealt = star_blocks(stars, block, "n_shingles")
    alike = forest(dealt.join(classes.select("cid", "short"), "cid"), plan, False, star=True)  # by signature first
    stars = cut_lineage(alike.select(F.col("a").alias("hub"), F.col("b").alias("cid")).join(classes.select("cid", "n_shingles"), "cid"))
    cores = cut_lineage(forest(star_blocks(stars, block, "n_shingles").join(held, "cid"), plan, True, star=True))
    core_of = connected_components(cores).withColumnsRenamed({"node": "c_id", "component": "core"})
    cored = lambda rows: rows.join(core_of, F.col("cid") == F.col("c_id"), "left").withColumn("core", F.coalesce("core", "cid")).drop("c_id")
    alike = forest(block_pairs(cored(met.select("grp", "cid", "short")), "grp", "cid", 2 * block, core="core"), plan, False)
    families = connected_components(alike.unionByName(cores))
    named = families.select(F.col("node").alias("cid"), F.col("component").alias("grp"))
    named = named.unionByName(named.select(F.col("grp").alias("cid"), "grp").distinct())
    close = block_pairs(cored(named).join(classes.select("cid", "n_shingles"), "cid"), "grp", "cid", block, "n_shingles", core="core")
    links = connected_components(forest(close.join(held, "cid"), plan, True).unionByName(cores))
    grouping = classes.join(links, F.col("cid") == F.col("node"), "left").select("set_key", F.coalesce("component", "cid").alias("cluster"), "no_id", "id", "mark")
    least = grouping.groupBy("cluster").agg(F.min(F.struct("no_id", "id", "mark")).alias("l")).select(F.col("cluster").alias("c"), F.col("l.id").alias("component"), F.col("l.mark").alias("c_mark"))
    known = grouping.select("set_key", "cluster").join(least, F.col("cluster") == F.col("c")).select("set_key", "component", "c_mark")
    wordless = F.col("n_shingles") == 0
    return (
        signed.select("id", "mark", "n_shingles", "set_key")
        .join(known, "set_key", "left")
        .withColumn("component", F.when(wordless, F.col("id")).otherwise(F.col("component")))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
        .withColumn("chosen", wordless | (F.col("kept") & (F.col("mark") == F.col("c_mark"))))
        .select("id", "mark", "n_shingles", "component", "kept", "chosen")
    )
