"""Four stages over the documents, each reading what the one before has written.

toxicity      documents that the classifier rejects go
near_dedup    one document of each group of near duplicates stays, the one with the smallest id (of
              different texts with that id, the one with the smaller hash)
pii           personal data give way to surrogates; ``n_chars`` follows the new text
packing       what is left is packed into bins; one row for each piece of a document

All but the last return the columns of the documents, in their order, extra ones included. Rows with
null ids or texts pass the filters: a null text is not toxic, and a document without an id or without
words belongs to no group and stays, repeated or not. Equal ids don't make equal documents: each text
of an id is judged on its own. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import minhash, packing, pii, toxicity
from millrace.llm.queries import PII_KEY
from millrace.scratch import cut_lineage
from millrace.ship import shipped

ORACLE_SQL = None  # a classifier and keyed surrogates can't be written in SQL


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return toxicity.with_scores(rows, model).where("predicted = 0").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by (id, hash of the text). What isn't chosen goes; of repeated rows of a
    chosen text the one with the smallest hash over all columns stays. Only those are regrouped."""
    found = minhash.near_duplicates(docs).where("id is not null and n_shingles > 0")
    texts = found.groupBy("id", "mark").agg(F.max("chosen").alias("chosen"), F.count(F.lit(1)).alias("n"))
    touched = cut_lineage(texts.where("not chosen or n > 1"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("r_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("r_mark"))
    same = (F.col("r_id") == F.col("id")) & (F.col("r_mark") == F.col("mark"))
    left = rows.join(touched, same, "left_anti")
    again = rows.join(touched.where("chosen"), same, "left_semi").withColumn("tie", F.xxhash64(F.to_json("row")))
    again = again.groupBy("r_id", "r_mark").agg(F.min_by("row", "tie").alias("row"))
    return left.select("row.*").unionByName(again.select("row.*"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
    return pii.with_surrogates(rows, PII_KEY).select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(docs)
    return found.select("bin", F.col("id").alias("doc_id"), "piece", "start", "length", "bin_offset", "source", "cluster")


STAGES = [(name, shipped(f)) for name, f in (("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
