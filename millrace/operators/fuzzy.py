"""Greedy near-deduplication in order: a row goes if it shares a band with an earlier row that stays.

The rule is sequential; it is settled in rounds over (bucket, row) memberships. In each round a row
goes if one of its buckets has an earlier row that stays, and stays if it is the first open row of
all its buckets. No pairs are formed, so a bucket with a third of all rows costs as many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import exploded
from millrace.scratch import cut_lineage, dispose


def band_shape(threshold: float, minima: int, steps: int = 1000) -> tuple[int, int]:
    """(bands, rows) with the least sum of the rates of false hits and misses, equally weighted."""
    s = (np.arange(steps) + 0.5) / steps
    best = (float("inf"), 0, 0)
    for bands in range(1, minima + 1):
        for rows in range(1, minima // bands + 1):
            hit = 1 - (1 - s**rows) ** bands
            error = (hit[s < threshold].sum() + (1 - hit[s >= threshold]).sum()) / steps
            if error < best[0] - 1e-12:
                best = error, bands, rows
    return best[1:]


def band_keys(docs: DataFrame, order: str, text: str, bands: int, rows: int, words: int, seed: int = 1) -> DataFrame:
    """(row, bucket) of every row with at least one shingle."""

    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        rng = np.random.default_rng(seed)
        a = rng.integers(1, 1 << 32, (bands * rows, 1), dtype=np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)
        for texts in batches:
            out = []
            for text in texts:
                w = text.split() if text else []
                if len(w) < words:
                    out.append([])
                    continue
                x = np.array([xxhash.xxh32_intdigest(" ".join(w[i : i + words])) for i in range(len(w) - words + 1)], np.uint32)
                m = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
                for i in range(0, len(x), 4096):
                    m = np.minimum(m, (a * x[None, i : i + 4096] + b).min(axis=1))
                out.append([xxhash.xxh64_intdigest(m[k * rows : (k + 1) * rows].tobytes(), k) - (1 << 63) for k in range(bands)])
            yield pd.Series(out)

    return docs.select(F.col(order).alias("row"), exploded(keys(text)).alias("bucket")).where("bucket is not null")


def greedy_survivors(member: DataFrame) -> DataFrame:
    """Rows that go, from (row, bucket) memberships."""
    shared = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    state = cut_lineage(member.join(shared, "bucket", "left_semi").withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        open_, kept = F.col("kept").isNull(), F.col("kept")
        first = state.groupBy("bucket").agg(F.min(F.when(kept, F.col("row"))).alias("first_kept"), F.min(F.when(open_, F.col("row"))).alias("first_open"))
        seen = state.where(open_).join(first, "bucket").groupBy("row").agg(
            F.max(F.coalesce(F.col("first_kept") < F.col("row"), F.lit(False))).alias("covered"), F.min(F.col("first_open") == F.col("row")).alias("leads")
        )
        settled = cut_lineage(seen.select("row", F.when(F.col("covered"), False).when(F.col("leads"), True).alias("now")).where("now is not null"))
        if settled.isEmpty():
            return state.where("kept = false").select("row").distinct()
        before, state = state, cut_lineage(state.join(settled, "row", "left").select("row", "bucket", F.coalesce("kept", "now").alias("kept")))
        dispose(before, settled)


def near_dups(docs: DataFrame, order: str, text: str, threshold: float = 0.8, minima: int = 128, words: int = 5) -> DataFrame:
    """The order numbers of the rows that go."""
    bands, rows = band_shape(threshold, minima)
    return greedy_survivors(band_keys(docs, order, text, bands, rows, words))
