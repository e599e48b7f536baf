"""Queries of benchmark contamination: the build's filter and the audit's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import contamination as C
from millrace.plans.registry import query, sql_ngrams, sql_words, table

TASKS = "'task' || (item_id % 3)"
BASE = f"""WITH dw AS (SELECT doc_id, source, text, {sql_words("lower(text)")} AS w FROM documents),
d AS (SELECT doc_id, source, list_distinct({sql_ngrams("w", 13)}) AS g FROM dw),
bw AS (SELECT item_id, {TASKS} AS task, {sql_words("lower(text)")} AS w FROM benchmark),
b AS (SELECT item_id, task, list_distinct({sql_ngrams("w", 13)}) AS g FROM bw),
x AS (SELECT doc_id, source, len(g) AS total, unnest(g) AS ngram FROM d),
e AS (SELECT task, item_id AS idx, unnest(g) AS ngram FROM b),
bench AS (SELECT DISTINCT task, ngram FROM e),
h AS (SELECT doc_id, source, total, task, count(*) AS hits FROM x JOIN bench USING (ngram) GROUP BY ALL)"""


def task() -> Column:
    return F.concat(F.lit("task"), (F.col("item_id") % 3).cast("string"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.benchmark_ngrams(table(spark, sf_dir, "benchmark"), task(), F.col("text"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.document_hits(table(spark, sf_dir, "documents"), bench(spark, sf_dir), ["doc_id", "source"])


@query(f"{BASE} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h WHERE hits / total > 0.1)")
def contamination_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = C.contaminated(hits(spark, sf_dir)).select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(gone, "doc_id", "left_anti")


@query(f"{BASE} SELECT doc_id, task, hits, total::BIGINT AS total, round(hits / total, 6) AS share FROM h")
def contamination_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("doc_id", "task", "hits", F.col("total").cast("bigint").alias("total"), F.round(F.col("hits") / F.col("total"), 6).alias("share"))


@query(f"{BASE} SELECT task, count(DISTINCT doc_id) AS contaminated FROM h WHERE hits / total > 0.1 GROUP BY task")
def contamination_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contaminated(hits(spark, sf_dir)).groupBy("task").agg(F.countDistinct("doc_id").alias("contaminated"))


@query(f"{BASE} SELECT task, count(*) AS total_ngrams, count(DISTINCT ngram) AS distinct_ngrams FROM e GROUP BY task")
def benchmark_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("total_ngrams"), F.countDistinct("ngram").alias("distinct_ngrams"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(task().alias("task"), F.col("item_id").alias("idx"), F.explode(T.ngram_set(F.col("text"))).alias("ngram"))


def found_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (source, ngram) of benchmark n-grams that occur in a source."""
    return C.found_ngrams(table(spark, sf_dir, "documents"), examples(spark, sf_dir), ["source"])


@query(f"""{BASE}, hit AS (SELECT DISTINCT ngram FROM x JOIN bench USING (ngram)),
s AS (SELECT task, idx, count(hit.ngram) AS found, count(*) AS total FROM e LEFT JOIN hit USING (ngram) GROUP BY ALL)
SELECT t.task, count(*) AS examples, count(*) FILTER (total IS NULL) AS unchecked, count(*) FILTER (found > 0) AS any_hit,
  count(*) FILTER (found / total >= 0.5) AS likely, count(*) FILTER (found = total) AS complete
FROM (SELECT item_id AS idx, {TASKS} AS task FROM benchmark) t LEFT JOIN s USING (task, idx) GROUP BY t.task""")
def contamination_report_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples by task: too short to check, touched, likely seen, wholly seen."""
    shares = C.example_shares(examples(spark, sf_dir), found_ngrams(spark, sf_dir))
    every = table(spark, sf_dir, "benchmark").select(task().alias("task"), F.col("item_id").alias("idx"))
    one = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return every.join(shares, ["task", "idx"], "left").groupBy("task").agg(
        F.count(F.lit(1)).alias("examples"), one(F.col("total").isNull(), "unchecked"), one(F.col("found") > 0, "any_hit"), one(F.col("share") >= 0.5, "likely"), one(F.col("share") == 1, "complete")
    )


@query(f"""{BASE}, r AS (SELECT doc_id, max(hits / total > 0.1) AS over_share, true AS hit FROM h GROUP BY doc_id)
SELECT source, count(*) AS rows_scanned, round(sum(length(text)) / 1e6, 6) AS million_chars, count(hit) AS rows_with_hit, count(*) FILTER (over_share) AS rows_over_share
FROM documents LEFT JOIN r USING (doc_id) GROUP BY source""")
def contamination_report_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).groupBy("doc_id").agg(F.max(F.col("hits") / F.col("total") > 0.1).alias("over"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").alias("n"))
    return docs.join(rows, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("rows_scanned"), F.round(F.sum("n") / 1e6, 6).alias("million_chars"), F.count("over").alias("rows_with_hit"), F.count(F.when(F.col("over"), 1)).alias("rows_over_share")
    )


@query(f"""{BASE}, hit AS (SELECT DISTINCT source, ngram FROM x JOIN bench USING (ngram)), n AS (SELECT task, idx, count(*) AS total FROM e GROUP BY ALL),
s AS (SELECT task, idx, source, count(*) AS found FROM e JOIN hit USING (ngram) GROUP BY ALL)
SELECT task, source, count(*) AS likely FROM s JOIN n USING (task, idx) WHERE found / total >= 0.5 GROUP BY ALL""")
def contamination_likely_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = examples(spark, sf_dir)
    totals = ex.groupBy("task", "idx").agg(F.count(F.lit(1)).alias("total"))
    found = ex.join(found_ngrams(spark, sf_dir), "ngram").groupBy("task", "idx", "source").agg(F.count(F.lit(1)).alias("found"))
    return found.join(totals, ["task", "idx"]).where(F.col("found") / F.col("total") >= 0.5).groupBy("task", "source").agg(F.count(F.lit(1)).alias("likely"))


@query(f"""{BASE}, hit AS (SELECT DISTINCT ngram FROM x JOIN bench USING (ngram)),
s AS (SELECT task, idx, count(hit.ngram) AS found, count(*) AS total FROM e LEFT JOIN hit USING (ngram) GROUP BY ALL)
SELECT task, idx, row_number() OVER (PARTITION BY task ORDER BY found / total DESC, idx) AS place, round(found / total, 4) AS share, total AS ngrams
FROM s WHERE found > 0 QUALIFY place <= 10""")
def contamination_report_worst10(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = C.worst(C.example_shares(examples(spark, sf_dir), found_ngrams(spark, sf_dir)))
    return shares.select("task", "idx", F.col("place").cast("bigint").alias("place"), F.round("share", 4).alias("share"), F.col("total").alias("ngrams"))


@query(f"""{BASE}, i AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_idx, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL),
t AS (SELECT * FROM i WHERE row_idx >= (n + 19) // 20 AND row_idx < (n + 19) // 20 + (n - (n + 19) // 20) * 3 // 5)
SELECT source, count(*) AS rows_scanned, count(*) FILTER (doc_id IN (SELECT doc_id FROM h)) AS rows_with_hit FROM t GROUP BY source""")
def trained_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the rows that a run has trained on, of every source: after its holdout (a twentieth), up to
    what was consumed of the rest (three fifths)."""
    from millrace.plans.q_dedup import indexed

    rows = indexed(spark, sf_dir).where("source is not null")
    size = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.expr("(n + 19) div 20").alias("first"), F.expr("(n + 19) div 20 + (n - (n + 19) div 20) * 3 div 5").alias("stop"))
    trained = rows.join(size, "source").where("row_idx >= first and row_idx < stop").select("doc_id", "source")
    scanned = table(spark, sf_dir, "documents").select("doc_id", "text").join(trained, "doc_id")
    hit = C.document_hits(scanned, bench(spark, sf_dir), ["doc_id"]).select("doc_id").distinct().withColumn("hit", F.lit(1))
    return trained.join(hit, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("rows_scanned"), F.count("hit").alias("rows_with_hit"))
