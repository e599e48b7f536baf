"""Where queries register with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.storage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: SQL fragments shared by the oracles: words and normal form as DuckDB says them.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS}'), lambda x: x <> '')"


def sql_norm(text: str) -> str:
    return f"array_to_string({sql_words(f'lower({text})')}, ' ')"


def sql_ngrams(words: str, n: int) -> str:
    return f"CASE WHEN len({words}) >= {n} THEN list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string(({words})[i:i + {n - 1}], ' ')) ELSE [] END"


def sql_hash(text: str, digest: str = "md5") -> str:
    """Signed 64-bit prefix of a digest."""
    h = f"cast('0x' || substr({digest}({text}), 1, 16) AS HUGEINT)"
    return f"(CASE WHEN {h} >= 9223372036854775808 THEN {h} - 18446744073709551616 ELSE {h} END)::BIGINT"
