"""The operators as registered queries with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, embeddings, fingerprints, minhash, packing, pii, secrets, sharding, toxicity, urls
from millrace.llm.oracles import ORACLES, URL_RULES
from millrace.sources.storage import spread


#: Key of the surrogates; a deployment passes its own secret.
PII_KEY = b"millrace example key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model).select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Plan(words=3, num=85))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.fingerprint_edits(table(spark, sf_dir, "documents")))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"))
    return found.select("bin", F.col("id").alias("doc_id"), "piece", "start", "length", "bin_offset", "source", "cluster")


def op8_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_rows(table(spark, sf_dir, "documents"), 40)
    law, none = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", law, "shard", F.col("slot").cast("long").alias("slot"), none)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_toxicity, op3_minhash_dedup, op4_secret_scan, op5_document_fingerprints,
        op6_pii_surrogates, op7_best_fit_packing, op8_karmarkar_karp_shards, op9_url_filter, op10_byte_bpe,
    )
}
__all__ = ["ORACLES", "QUERIES"]
