"""Sources: files by suffix and glob, slices by row, keyed splits, and synthetic rows."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.order import dense_index
from millrace.sources.storage import file_system

#: Fixed: suffixes in the order they are tried (the longest first) and their kinds.
SUFFIXES = ((".jsonl.zst", "lines"), (".jsonl.gz", "lines"), (".json.gz", "sniff"), (".parquet", "parquet"), (".jsonl", "lines"), (".json", "array"))


def file_kind(name: str) -> str:
    for suffix, kind in SUFFIXES:
        if name.endswith(suffix):
            return kind
    raise ValueError(f"unknown file format: {name}")


def glob_regex(pattern: str) -> str:
    """Stars and question marks don't cross a slash, two stars do, [!a] negates."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def list_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Files below a folder that match, sorted by their path in it."""
    fs, where = file_system(spark, root)
    base = fs.makeQualified(where).toString().rstrip("/") + "/"
    found, walk = [], fs.listFiles(where, True)
    match = re.compile(glob_regex(pattern)).fullmatch
    while walk.hasNext():
        path = walk.next().getPath().toString()
        if match(path.removeprefix(base)):
            found.append(path)
    return sorted(found)


def read_file(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """One file by its suffix. Zstandard lines are read by Spark's codec where Hadoop has it, else
    through the library, a file being one row of bytes."""
    kind = file_kind(path)
    if kind == "sniff":
        first = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
        kind = "array" if first and first.value.lstrip().startswith("[") else "lines"
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif path.endswith(".zst"):
        df = spark.read.json(unpacked_lines(spark, path).rdd.map(lambda r: r.value)) if not has_zstd(spark) else spark.read.json(path)
    elif kind == "array":
        df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    else:
        df = spark.read.option("mode", "FAILFAST").json(path)
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing and kind == "parquet":
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def has_zstd(spark: SparkSession) -> bool:
    try:
        return bool(spark.sparkContext._jvm.org.apache.hadoop.io.compress.ZStandardCodec.isNativeCodeLoaded())
    except Exception:  # noqa: BLE001  the class asks for native code when it is first used
        return False


def unpacked_lines(spark: SparkSession, path: str) -> DataFrame:
    import zstandard

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for batch in batches:
            for data in batch["content"]:
                lines = [x for x in io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(data), "utf-8") if x.strip()]
                yield pd.DataFrame({"value": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string")


def read_files(spark: SparkSession, root: str, pattern: str = "*", columns: list[str] | None = None) -> DataFrame:
    """All matching files as one source, with ``file_rank`` by path; missing columns are null."""
    files = list_files(spark, root, pattern)
    if not files:
        raise ValueError(f"no file under {root} matches {pattern}")
    parts = [read_file(spark, f, columns).withColumn("file_rank", F.lit(i)) for i, f in enumerate(files)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def row_slice(rows: DataFrame, order: list[str], offset: int = 0, count: int | None = None) -> DataFrame:
    """Rows [offset, offset + count) by a total order, with their ``position``."""
    if offset < 0 or (count is not None and count < 0):
        raise ValueError("offset and count must not be negative")
    placed = dense_index(rows, [F.col(c) for c in order])
    return placed.where((F.col("position") >= offset) & (F.lit(True) if count is None else F.col("position") < offset + count))


def keyed_rows(rows: DataFrame, key: str, value: str, order: list[str], offset: int = 0, count: int | None = None) -> DataFrame:
    """The slice of the rows of one key; the offset counts rows of that key."""
    return row_slice(rows.where(F.col(key) == value), order, offset, count)


def keyed_slices(rows: DataFrame, key: str, order: list[str], requests: dict[str, tuple[int, int | None]]) -> DataFrame:
    """The slices (offset, count) of several keys from one pass, with each row's ``position`` within its
    key; a key without a request is passed over. All rows are numbered together, so a key with a third
    of them is as many ranges."""
    wanted = dense_index(rows.where(F.col(key).isin(list(requests))), [F.col(key), *(F.col(c) for c in order)])
    base = wanted.groupBy(key).agg(F.min("position").alias("_base"))
    placed = wanted.join(F.broadcast(base), key).withColumn("position", F.col("position") - F.col("_base")).drop("_base")  # a row for each request
    hit = F.lit(False)
    for name, (offset, count) in requests.items():
        within = F.col("position") >= offset if count is None else F.col("position").between(offset, offset + count - 1)
        hit = hit | ((F.col(key) == name) & within)
    return placed.where(hit)


def file_index(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(file, key, rows, lowest, highest): what each file holds of each key, so that later scans leave
    out files that can't have a row."""
    file = F.col("_metadata.file_path").alias("file")
    return rows.select(file, F.col(key).alias("key"), order).groupBy("file", "key").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("lowest"), F.max(order).alias("highest"))


def files_with(index: DataFrame, key: str, low: object = None, high: object = None) -> list[str]:
    """The files that hold rows of a key between two bounds; the driver holds their names."""
    found = index.where(F.col("key") == key)
    if low is not None:
        found = found.where(F.col("highest") >= low)
    if high is not None:
        found = found.where(F.col("lowest") <= high)
    return sorted(r.file for r in found.select("file").distinct().collect())


def undeclared_keys(rows: DataFrame, key: str, declared: list[str]) -> DataFrame:
    return rows.select(key).where(F.col(key).isNotNull() & ~F.col(key).isin(declared)).distinct()


def synthetic_rows(spark: SparkSession, n: int, seed: int, kind: str = "text") -> DataFrame:
    """Rows that depend on (seed, i) alone: words tok_0 to tok_255, 64 to 384 of them, or an
    instruction of 4 to 32 and an output of 8 to 64."""

    def words(rng: random.Random, low: int, high: int) -> str:
        return " ".join(f"tok_{rng.randrange(256)}" for _ in range(rng.randint(low, high)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                rng = random.Random(f"{seed}:{i}")
                out.append((i, words(rng, 64, 384)) if kind == "text" else (i, words(rng, 4, 32), "", words(rng, 8, 64)))
            yield pd.DataFrame(out, columns=["id", "text"] if kind == "text" else ["id", "instruction", "input", "output"])

    schema = "id bigint, text string" if kind == "text" else "id bigint, instruction string, input string, output string"
    return spark.range(n).mapInPandas(run, schema)
