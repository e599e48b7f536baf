"""Order, samples and runs: all keyed by (seed, row), never by the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.scratch import cut_lineage


def shuffle_key(seed: int, row: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string")))


def keyed_share(seed: str, row: Column, percent: int) -> Column:
    """True for about ``percent`` of a hundred rows, by md5 of seed and row."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), row.cast("string"))), 1, 8), 16, 10).cast("bigint") % 100 < percent


def dense_index(rows: DataFrame, order: list[Column], ranges: int = 0) -> DataFrame:
    """Adds ``position``, 0, 1, ... over the whole table, without one task for all rows.

    Rows are dealt to ranges of the order, numbered within each, and each range starts where those
    before it end; the table of starts has a row for each range. The ranges are written down before
    they are used twice: their borders come from a sample and would differ the next time.
    """
    dealt = cut_lineage(rows.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order)
    return dealt.withColumn("_at", F.row_number().over(within) - 1).join(F.broadcast(starts), "_range").withColumn("position", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def longest_run(rows: DataFrame, order: str, flag: str) -> DataFrame:
    """(longest_run, malformed): flagged rows and the longest run of them by ``order``.

    Only the places of unflagged rows divide runs, so a run is told by how many of them came before.
    """
    placed = dense_index(rows.select(order, flag), [F.col(order)])
    # a flagged row's position less its rank among flagged rows is the same throughout a run
    ranked = dense_index(placed.where(flag).select(F.col("position").alias("p")), [F.col("p")])
    runs = ranked.groupBy((F.col("p") - F.col("position")).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return runs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest_run"), F.coalesce(F.sum("n"), F.lit(0)).alias("malformed"))


def weighted_order(rows: DataFrame, seed: int, row: str, weight: str) -> DataFrame:
    """Draws without replacement, each row by its weight among those left: an exponential race."""
    u = (F.conv(F.substring(shuffle_key(seed, F.col(row)), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48) + 1)
    return rows.withColumn("race", -F.log(u) / F.col(weight))


def longest_per_group(rows: DataFrame, group: str, size: str, tie: str, k: int) -> DataFrame:
    """The k largest rows of each group, ties by ``tie``.

    Rank limits are applied before the shuffle, so a group with most rows sends k from each task.
    """
    by = Window.partitionBy(group).orderBy(F.desc(size), tie)
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
