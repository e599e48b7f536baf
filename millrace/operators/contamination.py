"""Benchmark contamination by word n-grams, as joins of exploded 64-bit n-gram hashes.

The distinct n-grams of a document are counted as an array before they are exploded, and only those
that occur in a benchmark leave the join; benchmark n-grams are broadcast only if Spark finds them
small enough by its own threshold. Beyond that 16 bytes a word are shuffled, or less where Spark's
runtime filter of the benchmark's side applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import exploded, ngram_set
from millrace.scratch import cut_lineage


def benchmark_ngrams(items: DataFrame, task: Column, text: Column, n: int = 13) -> DataFrame:
    """Distinct (task, ngram), as a table of known size: Spark broadcasts it if it is small enough by its
    threshold, and otherwise shuffles both sides."""
    return cut_lineage(items.select(task.alias("task"), exploded(ngram_set(text, n)).alias("ngram")).where("ngram is not null").distinct())


def document_hits(docs: DataFrame, bench: DataFrame, keys: list[str], text: str = "text", n: int = 13) -> DataFrame:
    """(keys, task, hits, total) of every document and task that share an n-gram."""
    grams = docs.select(*keys, ngram_set(F.col(text), n).alias("g")).select(*keys, F.coalesce(F.size("g"), F.lit(0)).alias("total"), exploded(F.col("g")).alias("ngram"))
    return grams.join(bench, "ngram").groupBy(*keys, "total", "task").agg(F.count(F.lit(1)).alias("hits"))


def found_ngrams(docs: DataFrame, bench: DataFrame, keys: list[str], text: str = "text", n: int = 13) -> DataFrame:
    """Distinct (keys, ngram) of the benchmark n-grams that occur in documents of those keys."""
    known = cut_lineage(bench.select("ngram").distinct())
    return docs.select(*keys, exploded(ngram_set(F.col(text), n)).alias("ngram")).join(known, "ngram", "left_semi").distinct()


def contaminated(hits: DataFrame, threshold: float = 0.1) -> DataFrame:
    """More than ``threshold`` of a document's n-grams in one task alone."""
    return hits.where(F.col("hits") / F.col("total") > threshold)


def example_shares(examples: DataFrame, hit_ngrams: DataFrame) -> DataFrame:
    """(task, idx, found, total, share) from (task, idx, ngram) and the n-grams found in any source."""
    hit = hit_ngrams.select("ngram").distinct().withColumn("hit", F.lit(1))
    return examples.join(hit, "ngram", "left").groupBy("task", "idx").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("total")).withColumn("share", F.col("found") / F.col("total"))


def worst(shares: DataFrame, k: int = 10) -> DataFrame:
    """The k examples of each task with the largest share, ties by index."""
    by = Window.partitionBy("task").orderBy(F.desc("share"), "idx")
    return shares.where("found > 0").withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
