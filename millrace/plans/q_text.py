"""Queries over single texts: keys, filters, tokens, n-grams, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.registry import query, sql_hash, sql_ngrams, sql_norm, sql_words, table

STRIPPED = r"regexp_replace({}, '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"


def sql_strip(text: str) -> str:
    return STRIPPED.replace("{}", text, 1)


QUALITY = f"""
w AS (SELECT *, {sql_words("text")} AS w, list_filter(string_split_regex(text, '[.!?]+'), lambda s: length({sql_strip("s")}) > 10) AS sentences FROM documents),
g AS (SELECT *, {sql_ngrams("w", 2)} AS b, {sql_ngrams("w", 3)} AS t FROM w),
q AS (SELECT *, CASE WHEN length(text) < 10 THEN 'too_short' WHEN len(sentences) < 3 THEN 'too_few_sentences' WHEN len(w) = 0 THEN 'no_words'
  WHEN len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) / len(w) > 0.3 THEN 'too_many_caps'
  WHEN length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]', '', 'g')) / length(text) < 0.25 THEN 'too_few_alphanumeric_or_space'
  WHEN len(w) > 10 AND len(list_distinct(b)) / len(b) < 0.7 THEN 'too_repetitive_bigrams'
  WHEN len(w) > 20 AND len(list_distinct(t)) / len(t) < 0.8 THEN 'too_repetitive_trigrams' ELSE 'passed' END AS reason FROM g)
"""


@query(f"SELECT doc_id, {sql_hash(sql_norm('text'))} AS hash, {sql_hash('text')} AS raw_hash FROM documents")
def normalize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash64(F.col("text")).alias("hash"), T.text_hash64(F.col("text"), False).alias("raw_hash"))


@query("""SELECT count(*) AS rows_seen, count(*) FILTER (text IS NULL) AS removed_invalid, count(*) FILTER (length(text) < 50) AS removed_short,
  count(*) FILTER (length(text) >= 50) AS rows_kept FROM documents""")
def length_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    one = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("rows_seen"), one(F.col("text").isNull(), "removed_invalid"), one(n < 50, "removed_short"), one(n >= 50, "rows_kept"))


@query(f"WITH {QUALITY} SELECT reason, count(*) AS n FROM q WHERE text IS NOT NULL GROUP BY reason")
def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(T.quality_reason(F.col("text")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {QUALITY} SELECT doc_id, source, length(text) AS chars FROM q WHERE length(text) >= 50 AND reason = 'passed'")
def quality_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.char_length("text") >= 50)
    return docs.where(T.quality_reason(F.col("text")) == "passed").select("doc_id", "source", F.char_length("text").cast("bigint").alias("chars"))


@query("SELECT doc_id, length(text) // 4 AS tokens, least(length(text) // 4, 512) AS clamped_tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.estimate_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), F.least(n, F.lit(512)).alias("clamped_tokens"))


@query("SELECT doc_id, md5(substring(text, 1, 1016)) AS cut_md5, length(substring(text, 1, 1016)) // 4 + 2 AS tokens FROM documents")
def truncate_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.truncate_estimate(F.col("text"), 256).alias("cut"))
    return docs.select("doc_id", F.md5("cut").alias("cut_md5"), (T.estimate_tokens(F.col("cut")) + 2).alias("tokens"))


@query(f"""WITH w AS (SELECT doc_id, {sql_words("text")} AS w, {sql_words("lower(text)")} AS l FROM documents), g AS (SELECT doc_id, {sql_ngrams("w", 5)} AS g, {sql_ngrams("l", 13)} AS s FROM w)
SELECT doc_id, len(g) AS ngrams, len(list_distinct(s)) AS distinct_ngrams FROM g""")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.ngram_hashes(T.words(F.col("text")), 5)).cast("bigint").alias("ngrams"), F.size(T.ngram_set(F.col("text"))).cast("bigint").alias("distinct_ngrams"))


@query(f"""WITH w AS (SELECT doc_id, {sql_words("text")} AS w FROM documents), g AS (SELECT doc_id, {sql_ngrams("w", 2)} AS b, {sql_ngrams("w", 3)} AS t FROM w)
SELECT doc_id, round(len(list_distinct(b)) / len(b), 6) AS bigrams, round(len(list_distinct(t)) / len(t), 6) AS trigrams FROM g WHERE len(t) > 0""")
def ngram_unique_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("w")).where("size(w) >= 3")
    return w.select("doc_id", *(F.round(T.unique_ratio(T.ngram_hashes(F.col("w"), n)), 6).alias(name) for n, name in ((2, "bigrams"), (3, "trigrams"))))


@query("""SELECT lang, lower(lang) || '_code' AS slug, 'code_' || lower(lang) AS source_name FROM (SELECT DISTINCT lang FROM documents)""")
def language_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages found in a keyed source, with their names as sources."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    return langs.select("lang", T.language_slug(F.concat(F.lit(" "), "lang", F.lit(" / Code "))).alias("slug"), T.repo_source_name(F.lit("owner/Code"), F.col("lang")).alias("source_name"))


@query(f"SELECT doc_id, substring(array_to_string({sql_words('text')}, ' '), 1, 200) AS preview FROM documents")
def document_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("SELECT item_id, 'benchmark ' || item_id || ' ' || text || ' ' || 'A' || ' ' || 'B' AS example FROM benchmark")
def example_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    fields = [F.concat_ws(" ", F.lit("benchmark"), "item_id"), F.col("text")]
    return items.select("item_id", T.example_text(fields, [F.array(F.lit("A"), F.lit("B"))]).alias("example"))


@query("SELECT pattern, prefix FROM (VALUES ('data/*.parquet', 'data/'), ('a/b?c.json', 'a/b'), ('plain.jsonl', 'plain.jsonl'), ('[ab]/x', '')) t(pattern, prefix)")
def glob_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("data/*.parquet",), ("a/b?c.json",), ("plain.jsonl",), ("[ab]/x",)], "pattern string")
    return rows.select("pattern", T.glob_prefix(F.col("pattern")).alias("prefix"))
