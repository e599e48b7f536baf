"""Exact deduplication: the first row of a total order stays.

Only (key, order) pairs decide, so texts are joined back by key and never sorted in a window: a
grouped minimum is combined before the shuffle, and one key with a third of the rows is one row for
each task after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import cut_lineage


def first_rows(rows: DataFrame, key: str | list[str], order: list[str] | list[Column], narrow: bool = False) -> DataFrame:
    """The row of each key that comes first by ``order`` (a total order). ``narrow`` rows are carried
    through the grouped minimum, by names or by expressions; of others only keys are shuffled twice and the rows joined back."""
    key = [key] if isinstance(key, str) else key
    if narrow:
        first = F.min(F.struct(*order, F.struct(*rows.columns).alias("_row"))).alias("_first")
        return rows.groupBy(*key).agg(first).select("_first._row.*")
    firsts = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first")).select("_first.*")
    return rows.join(firsts, order, "left_semi")


def incremental(batch: DataFrame, seen: DataFrame, key: str, order: list[str], narrow: bool = False) -> DataFrame:
    """Rows of a batch whose key wasn't committed before, the first of each key."""
    return first_rows(batch, key, order, narrow).join(seen.select(key).distinct(), key, "left_anti")


def global_admission(rows: DataFrame, key: str, rank: str, order: list[str]) -> DataFrame:
    """Adds ``retained``: whether the row is the first of its key over all sources by rank; rows of
    a negative rank (benchmark keys) count as seen and are left out. Rows should be narrow: they are
    written to the shared folder, so that keys are made once."""
    rows = cut_lineage(rows)
    firsts = rows.groupBy(key).agg(F.min(F.struct(rank, *order)).alias("first"))
    same = F.lit(True)
    for c in (rank, *order):
        same = same & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    return rows.where(F.col(rank) >= 0).join(firsts, key).withColumn("retained", same).drop("first")


def counts(kept: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("candidates"), F.sum(kept.cast("bigint")).alias("retained"), F.sum((~kept).cast("bigint")).alias("positives")]
