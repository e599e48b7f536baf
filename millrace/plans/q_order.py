"""Queries of order, sampling, near duplicates, vectors, sources and streams."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import fuzzy, order, tokens, vectors
from millrace.plans.q_dedup import SHARDED, indexed
from millrace.plans.registry import query, sql_hash, sql_norm, table
from millrace.sources import readers
from millrace.scratch import scratch_path
from millrace.streaming.incremental import stream_dedup


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('17:' || doc_id), doc_id) - 1 AS position FROM documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permutation by a key of (seed, row), the same for any partitions."""
    rows = table(spark, sf_dir, "documents").select("doc_id", order.shuffle_key(17, F.col("doc_id")).alias("key"))
    return order.dense_index(rows, [F.col("key"), F.col("doc_id")]).select("doc_id", F.col("position").cast("bigint").alias("position"))


@query(f"{SHARDED} SELECT doc_id, row_number() OVER (ORDER BY row_idx, regexp_extract(source, '[0-9]+')::INT) - 1 AS position FROM r")
def interleave_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    rows = indexed(spark, sf_dir).select("doc_id", "row_idx", rank.alias("rank"))
    return order.dense_index(rows, [F.col("row_idx"), F.col("rank")]).select("doc_id", F.col("position").cast("bigint").alias("position"))


@query("SELECT source, doc_id, length(text) AS chars, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS place FROM documents QUALIFY place <= 3")
def topk_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.char_length("text").cast("bigint").alias("chars"))
    return order.longest_per_group(rows, "source", "chars", "doc_id", 3).withColumn("place", F.col("place").cast("bigint"))


@query(f"""{SHARDED}, n AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT DISTINCT r.source, r.doc_id FROM r JOIN (SELECT source, round_even((n - 1) * k / 7.0, 0)::BIGINT AS at FROM n, (SELECT unnest(range(8)) AS k)) p ON r.source = p.source AND row_idx = p.at""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rows of each source at even steps from first to last, halves rounded to even."""
    rows = indexed(spark, sf_dir)
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    at = n.select("source", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "n").select("source", F.bround((F.col("n") - 1) * F.col("k") / F.lit(7.0)).cast("bigint").alias("row_idx"))
    return rows.join(at.distinct(), ["source", "row_idx"]).select("source", "doc_id")


@query("""SELECT doc_id, source, round(-ln((CAST('0x' || substr(md5('3:' || doc_id), 1, 12) AS BIGINT)::DOUBLE + 1) / (281474976710656.0 + 1)) / CASE WHEN source = 'src0' THEN 4.0 ELSE 1.0 END, 9) AS race FROM documents""")
def weighted_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose order is a weighted draw without replacement."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("source") == "src0", 4.0).otherwise(1.0).alias("w"))
    return order.weighted_order(rows, 3, "doc_id", "w").select("doc_id", "source", F.round("race", 9).alias("race"))


@query()
def minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that greedy MinHash deduplication removes."""
    return fuzzy.near_dups(table(spark, sf_dir, "documents"), "doc_id", "text", 0.8, 128).select(F.col("row").alias("doc_id"))


@query()
def truncate_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokens.truncate(docs, tokens.word_level_json([f"tok_{i}" for i in range(256)]), 254)
    return out.select("doc_id", F.char_length("text").alias("chars"), F.md5("text").alias("cut_md5"), "tokens")


@query("""WITH u AS (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding)::DOUBLE AS x, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm FROM embeddings),
s AS (SELECT label, place, sum(x / norm) AS s, sum(x * x) AS q, count(*) AS n FROM u WHERE norm > 0 GROUP BY ALL)
SELECT label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine, round(sqrt(sum(q) / (max(n) * count(*))), 6) AS rms FROM s GROUP BY label""")
def representation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.pair_cosine_mean(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.select("label", "n", F.round("mean_cosine", 6).alias("mean_cosine"), F.round("rms", 6).alias("rms"))


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position FROM documents WHERE lang = 'fr' QUALIFY position >= 10 AND position < 60")
def keyed_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of one language's rows of a grouped source."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return readers.keyed_rows(rows, "lang", "fr", ["doc_id"], 10, 50).select("lang", "doc_id", F.col("position").cast("bigint").alias("position"))


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'de')")
def source_key_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.undeclared_keys(table(spark, sf_dir, "documents"), "lang", ["en", "de"])


@query()
def synthetic_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.synthetic_rows(spark, 500, 7)


@query(f"SELECT doc_id, source, {sql_hash(sql_norm('text'))} AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1")
def stream_incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' folder as a stream of files, each batch committed once."""
    base = scratch_path(spark, "stream")
    return stream_dedup(spark, f"{sf_dir}/documents.parquet", f"{base}/out", f"{base}/state")


@query("SELECT doc_id, source, lang, length(text) AS chars FROM documents")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with different columns as one, in declared order."""
    docs = table(spark, sf_dir, "documents").withColumn("chars", F.char_length("text").cast("bigint"))
    few = docs.where("lang = 'en'").select("doc_id", "source", "chars")
    rest = docs.where("lang <> 'en'").select("doc_id", "source", "lang", "chars")
    return few.withColumn("lang", F.lit("en")).unionByName(rest, allowMissingColumns=True).select("doc_id", "source", "lang", "chars")


