"""Sinks: sharded Parquet with a manifest that commits it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.scratch import file_system


def spread(df: DataFrame) -> DataFrame:
    """On a session with ``spark.millrace.spread`` set, a table of fewer splits than cores dealt out to
    all of them: for tests and benches, whose tables are one small file. Elsewhere tables are as read."""
    spark = df.sparkSession
    if spark.conf.get("spark.millrace.spread", "false") != "true":
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = file_system(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return None
    return "\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())


def write_folder(df: DataFrame, path: str, shard_rows: int = 10_000, identity: str = "", tokens: str | None = None, extra: dict | None = None) -> dict:
    """Writes zstd shards of at most ``shard_rows`` rows and MANIFEST.json beside the target, then swaps
    the whole folder in: the old one is renamed aside, the new one takes its name, and only then the
    old one goes. Readers trust only what the manifest lists; ``recover`` ends a swap that was cut."""
    spark = df.sparkSession
    fresh = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(fresh)
    rows = spark.read.parquet(fresh).select(*([tokens] if tokens else []), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"))
    total = F.when(F.count(tokens) == F.count(F.lit(1)), F.sum(tokens)) if tokens else F.lit(None).cast("bigint")
    shards = [r.asDict() for r in rows.groupBy(F.col("_file").alias("name")).agg(F.count(F.lit(1)).alias("rows"), total.alias("tokens")).orderBy("name").collect()]
    manifest = {"identity": identity, "rows": sum(s["rows"] for s in shards), "shards": shards} | (extra or {})
    write_text(spark, f"{fresh}/MANIFEST.json", json.dumps(manifest, sort_keys=True))
    swap_in(spark, fresh, path)
    return manifest


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a committed folder. A folder without a manifest isn't one."""
    if read_text(spark, f"{path}/MANIFEST.json") is None:
        raise ValueError(f"no manifest in {path}")
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)


def swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts a complete folder in another's place."""
    fs, target = file_system(spark, path)
    _, source = file_system(spark, fresh)
    _, aside = file_system(spark, f"{path}.old")
    recover(spark, path)
    if fs.exists(target):
        fs.rename(target, aside)
    fs.rename(source, target)
    fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """After a swap that was cut: the old folder comes back if nothing took its place, and goes otherwise."""
    fs, target = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.old")
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        else:
            fs.rename(aside, target)


def folder_state(spark: SparkSession, path: str, identity: str) -> str:
    """missing, unreadable, stale (another identity) or current."""
    text = read_text(spark, f"{path}/MANIFEST.json")
    if text is None:
        return "missing"
    try:
        found = json.loads(text)["identity"]
    except (ValueError, KeyError):
        return "unreadable"
    return "current" if found == identity else "stale"


def assess_shards(listed: list[str], on_disk: list[str]) -> list[tuple[str, str]]:
    """(name, ok, missing or stray) of every shard that is listed or there."""
    a, b = set(listed), set(on_disk)
    return [(n, "ok" if n in a & b else "missing" if n in a else "stray") for n in sorted(a | b)]


def covered_prefix(listed: list[str], covered: list[str]) -> bool:
    """Whether the covered raw shards are the first of those listed."""
    return listed[: len(covered)] == covered


def export_jsonl(df: DataFrame, path: str, index: str = "row_index") -> None:
    """Rows as JSON lines with their index first."""
    df.select(index, *(c for c in df.columns if c != index)).write.mode("overwrite").json(path)
