"""Queries of the exact deduplication family and of sharded storage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dedup
from millrace.operators.order import dense_index
from millrace.plans.registry import query, sql_hash, sql_norm, table
from millrace.scratch import cut_lineage

HASH = sql_hash(sql_norm("text"))


def hashed(spark: SparkSession, sf_dir: str, normalize: bool = True) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("hash", T.text_hash64(F.col("text"), normalize))


@query(f"WITH h AS (SELECT *, {HASH} AS hash FROM documents) SELECT doc_id, source, hash FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_rows(hashed(spark, sf_dir).select("doc_id", "source", "hash"), "hash", ["doc_id"], narrow=True)


@query(f"WITH h AS (SELECT *, {sql_hash('text')} AS hash FROM documents) SELECT doc_id, source, hash FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1")
def exact_dedup_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_rows(hashed(spark, sf_dir, False).select("doc_id", "source", "hash"), "hash", ["doc_id"], narrow=True)


@query(f"""SELECT source, count(*) AS rows_seen, count(DISTINCT h) AS items_in_filter, count(*) - count(DISTINCT h) AS duplicates_removed
FROM (SELECT source, {HASH} AS h FROM documents) GROUP BY source""")
def exact_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_key = hashed(spark, sf_dir).groupBy("source", "hash").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("source").agg(F.sum("n").alias("rows_seen"), F.count(F.lit(1)).alias("items_in_filter"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates_removed"))


@query(f"WITH h AS (SELECT *, {HASH} AS hash FROM documents) SELECT doc_id, hash FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id % 2, doc_id) = 1")
def incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first batch, then a second against the keys that the first has committed."""
    rows = cut_lineage(hashed(spark, sf_dir).select("doc_id", "hash"))
    first = dedup.first_rows(rows.where("doc_id % 2 = 0"), "hash", ["doc_id"], narrow=True)
    return first.unionByName(dedup.incremental(rows.where("doc_id % 2 = 1"), first, "hash", ["doc_id"], narrow=True))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two kinds with the rank of their source; benchmark items first of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rank = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("source"), "text", F.lit(-1).alias("rank"))
    return docs.withColumn("rank", rank).unionByName(bench).withColumn("key", T.global_key("pretrain", F.col("text")))


RANKED = f"""WITH u AS (SELECT doc_id, source, text, regexp_extract(source, '[0-9]+')::INT AS rank FROM documents UNION ALL SELECT item_id, 'benchmark', text, -1 FROM benchmark),
k AS (SELECT *, {sql_hash("'pretrain' || chr(31) || " + sql_norm("text"), "sha256")} AS key FROM u),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, doc_id) = 1 AS retained FROM k)"""


@query(f"{RANKED} SELECT doc_id, source, key AS global_hash, retained FROM a WHERE rank >= 0")
def global_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.global_admission(ranked(spark, sf_dir).select("doc_id", "source", "rank", "key"), "key", "rank", ["doc_id"])
    return out.select("doc_id", "source", F.col("key").alias("global_hash"), "retained")


@query(f"""{RANKED} SELECT source, count(*) AS candidates, count(*) FILTER (retained) AS retained, count(*) FILTER (NOT retained) AS positives,
  greatest(0, 45 - count(*) FILTER (retained)) AS shortfall FROM a WHERE rank >= 0 GROUP BY source""")
def global_admission_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = global_dedup(spark, sf_dir).groupBy("source").agg(*dedup.counts(F.col("retained")))
    return stats.withColumn("shortfall", F.greatest(F.lit(0), F.lit(45) - F.col("retained")))


@query(f"""{RANKED}, b AS (SELECT DISTINCT key FROM a WHERE rank < 0) SELECT count(*) AS candidates, count(*) FILTER (key IN (SELECT key FROM b)) AS excluded FROM a WHERE rank >= 0""")
def benchmark_preseed_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    seeds = rows.where("rank < 0").select("key").distinct().withColumn("seed", F.lit(1))
    return rows.where("rank >= 0").join(seeds, "key", "left").agg(F.count(F.lit(1)).alias("candidates"), F.count("seed").alias("excluded"))


def digests_of_ranges(rows: DataFrame, every: int = 4096) -> DataFrame:
    """(source, key_digest, n) from (source, row_idx, hash): each range of so many rows is digested over
    its ordered 8-byte keys, ranges of these digests likewise, until a source is one range."""
    in_order = lambda c: F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(c), lambda x: x["v"]), "")), 256)
    most = rows.agg(F.max("row_idx")).first()[0] or 0
    level = rows.select("source", F.col("row_idx").alias("at"), F.lpad(F.hex("hash"), 16, "0").alias("v"), F.lit(1).cast("bigint").alias("n"))
    while True:
        # one key of both, so that ranges aren't dealt by their source alone
        key = F.struct("source", F.floor(F.col("at") / every).alias("at")).alias("key")
        level = level.groupBy(key).agg(in_order(F.collect_list(F.struct("at", "v"))).alias("v"), F.sum("n").alias("n")).select("key.*", "v", "n")
        if most < every:
            return level.select("source", F.col("v").alias("key_digest"), "n")
        most //= every


KEYED = f"SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_idx, substr(md5({sql_norm('text')}), 1, 16) AS k FROM documents"


@query(f"""WITH i AS ({KEYED}), r AS (SELECT source, row_idx // 512 AS place, sha256(unhex(string_agg(k, '' ORDER BY row_idx))) AS d, count(*) AS n FROM i GROUP BY ALL),
q AS (SELECT source, place // 512 AS top, CASE WHEN (SELECT max(row_idx) FROM i) < 512 THEN min(d) ELSE sha256(unhex(string_agg(d, '' ORDER BY place))) END AS d, sum(n) AS n FROM r GROUP BY ALL)
SELECT source, d AS key_digest, n::BIGINT AS n FROM q""")
def ordered_key_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest over the ordered keys of every source, by ranges of its rows."""
    return digests_of_ranges(indexed(spark, sf_dir, hash=T.text_hash64(F.col("text"), True)), 512)


def bloom_figures(bits: int, fpr: float, keys: int) -> tuple[int, int, float]:
    """(keys at the stated rate, probes, rate at so many keys) of a Bloom filter."""
    nominal = int(bits * math.log(2) ** 2 / -math.log(fpr))
    probes = int(bits / nominal * math.log(2))
    return nominal, probes, (1 - math.exp(-probes * keys / bits)) ** probes


@query("""WITH m(mb) AS (VALUES (1), (64), (1024)), n AS (SELECT mb, mb::BIGINT * 8388608 AS bits, floor(mb::BIGINT * 8388608 * ln(2) * ln(2) / -ln(0.001))::BIGINT AS nominal FROM m),
p AS (SELECT *, floor(bits / nominal * ln(2))::INT AS probes FROM n) SELECT mb, nominal, probes, round(pow(1 - exp(-probes * (2.0 * nominal) / bits), probes), 6) AS double_rate FROM p""")
def bloom_capacity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for mb in (1, 64, 1024):
        nominal, probes, _ = bloom_figures(mb << 23, 0.001, 0)
        rows.append((mb, nominal, probes, round(bloom_figures(mb << 23, 0.001, 2 * nominal)[2], 6)))
    return spark.createDataFrame(rows, "mb int, nominal bigint, probes int, double_rate double")


SHARDED = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_idx, length(text) // 4 AS tokens FROM documents)"


def indexed(spark: SparkSession, sf_dir: str, **added: Column) -> DataFrame:
    """Rows with their dense index within the source. Rows are numbered over all sources in order,
    from which each source's first number is taken: a source with most rows is still many ranges."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", T.estimate_tokens(F.col("text")).alias("tokens"), *(c.alias(n) for n, c in added.items()))
    placed = dense_index(rows, [F.col("source"), F.col("doc_id")])
    starts = placed.groupBy("source").agg(F.min("position").alias("start"))
    return placed.join(starts, "source").select("doc_id", "source", "lang", "tokens", *added, (F.col("position") - F.col("start")).cast("bigint").alias("row_idx"))


@query(f"{SHARDED} SELECT source, row_idx // 20 AS shard, count(*) AS rows, sum(tokens)::BIGINT AS tokens, sum(least(tokens, 256))::BIGINT AS capped_tokens, min(row_idx) AS first_row FROM r GROUP BY source, shard")
def shard_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexed(spark, sf_dir).withColumn("shard", F.floor(F.col("row_idx") / 20).cast("bigint"))
    return rows.groupBy("source", "shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens"), F.sum(F.least("tokens", F.lit(256))).alias("capped_tokens"), F.min("row_idx").alias("first_row")
    )


@query("""SELECT source, count(*) AS rows, CASE WHEN count(t) < count(*) THEN NULL ELSE sum(t) END::BIGINT AS tokens
FROM (SELECT source, CASE WHEN source = 'src7' AND doc_id % 3 = 0 THEN NULL ELSE length(text) // 4 END AS t FROM documents) GROUP BY source""")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and tokens of each folder; tokens are unknown if any row's are."""
    unknown = (F.col("source") == "src7") & (F.col("doc_id") % 3 == 0)
    rows = table(spark, sf_dir, "documents").select("source", F.when(~unknown, T.estimate_tokens(F.col("text"))).alias("t"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.when(F.count("t") == F.count(F.lit(1)), F.sum("t")).alias("tokens"))


@query(f"""{SHARDED}, s AS (SELECT source, row_idx // 10 AS shard, count(*) FILTER (tokens >= 100) AS survivors FROM r GROUP BY source, shard),
c AS (SELECT *, sum(survivors) OVER (PARTITION BY source ORDER BY shard)::BIGINT AS running FROM s) SELECT source, shard, survivors, running FROM c WHERE running - survivors < 15""")
def rows_target_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole raw shards until a source has enough processed rows."""
    shards = indexed(spark, sf_dir).groupBy("source", F.floor(F.col("row_idx") / 10).cast("bigint").alias("shard")).agg(F.count(F.when(F.col("tokens") >= 100, 1)).alias("survivors"))
    running = F.sum("survivors").over(Window.partitionBy("source").orderBy("shard"))
    return shards.withColumn("running", running).where(F.col("running") - F.col("survivors") < 15)


@query("""WITH disk(name) AS (VALUES ('data-00000'), ('data-00001'), ('data-00003')), listed(name) AS (VALUES ('data-00000'), ('data-00001'), ('data-00002'))
SELECT coalesce(d.name, l.name) AS name, CASE WHEN l.name IS NULL THEN 'stray' WHEN d.name IS NULL THEN 'missing' ELSE 'ok' END AS state FROM disk d FULL JOIN listed l ON d.name = l.name""")
def shard_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards on disk against those that the manifest lists."""
    from millrace.sources.storage import assess_shards

    return spark.createDataFrame(assess_shards(["data-00000", "data-00001", "data-00002"], ["data-00000", "data-00001", "data-00003"]), "name string, state string")
