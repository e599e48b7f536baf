"""Incremental preparation as a stream: each batch of new files is deduplicated against what earlier
batches have committed, and committed once (a batch that is tried again replaces itself). Files don't
come in the rows' order, so a batch may bring a row that comes before the committed one of its key: it
is committed too, and ``committed`` reads the first row of each key over all batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import text_hash64
from millrace.operators import dedup
from millrace.sources.storage import file_system


def first_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first (narrow) row of each key, whatever came when: nulls come last, and equal places are
    told apart by the whole row."""
    return dedup.first_rows(rows, key, [c for name in order for c in (F.col(name).isNull(), F.col(name))], narrow=True)


def committed(spark: SparkSession, out: str, key: str, order: list[str]) -> DataFrame:
    """What the batches in ``out`` have committed, the first row of each key."""
    return first_rows(spark.read.parquet(f"{out}/*"), key, order)


def commit_batches(stream: DataFrame, out: str, key: str, order: list[str], checkpoint: str) -> None:
    """Runs the stream over all that is there; ``out`` has a folder for each batch."""

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, where = file_system(spark, out)
        earlier = [s.getPath().toString() for s in fs.listStatus(where) if not s.getPath().getName().endswith(f"={number:09d}")] if fs.exists(where) else []
        rows = batch.withColumn("_new", F.lit(True))
        if earlier:
            rows = spark.read.parquet(*earlier).withColumn("_new", F.lit(False)).unionByName(rows)
        first_rows(rows, key, order).where("_new").drop("_new").write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_dedup(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_batch: int = 4) -> DataFrame:
    """Documents of a folder that grows, the first of each normalized text."""
    schema = spark.read.parquet(path).schema
    fs, where = file_system(spark, path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(where).isDirectory():
        stream = reader.parquet(path)
    else:  # a stream reads folders: one file of a folder is told by its name
        stream = reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    rows = stream.select("doc_id", "source", text_hash64(F.col("text")).alias("hash"))
    commit_batches(rows, out, "hash", ["doc_id"], checkpoint)
    return committed(spark, out, "hash", ["doc_id"]).select("doc_id", "source", "hash")
