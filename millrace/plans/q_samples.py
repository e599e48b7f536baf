"""Queries over token samples, benchmark renderings and run records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import samples as S
from millrace.functions import text as T
from millrace.plans import spec
from millrace.plans.q_dedup import SHARDED, indexed
from millrace.plans.registry import query, sql_hash, sql_norm, table

EXAMPLES = "(VALUES (1, 'What is it?', ['a', 'b', 'c', 'd'], 2), (2, 'Who?', ['w', 'x', 'y', 'z'], 0)) e(id, q, choices, answer)"


@query(f"""SELECT id, 'Subject: s' || chr(10) || q || chr(10) || 'A. ' || choices[1] || chr(10) || 'B. ' || choices[2] || chr(10) || 'C. ' || choices[3] || chr(10) || 'D. ' || choices[4] AS prompt,
  ['A', 'B', 'C', 'D'][answer + 1] || '. ' || choices[answer + 1] AS answer FROM {EXAMPLES}""")
def complete_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "What is it?", list("abcd"), 2), (2, "Who?", list("wxyz"), 0)], "id int, q string, choices array<string>, answer int")
    fields = {"subject": F.lit("s"), "question": F.col("q"), "choices": F.col("choices"), "answer": F.col("answer")}
    return rows.select("id", S.complete_example("mmlu", fields).alias("r")).select("id", "r.*")


IDS = "list_transform(range(least(length(text), 40)), lambda i: ((i * 37 + doc_id) % 130)::INT)"


@query(f"""WITH s AS (SELECT doc_id, {IDS} AS ids, (doc_id % 45)::INT AS prompt FROM documents),
l AS (SELECT doc_id, ids, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= prompt OR ids[i] >= 120 THEN -100 ELSE ids[i] END) AS labels FROM s)
SELECT doc_id, greatest(len(ids) - 1, 0) AS slots, array_to_string(ids[1:len(ids) - 1] || list_transform(range((8 - (greatest(len(ids) - 1, 0) % 8)) % 8), lambda i: 2), ',') AS inputs,
  array_to_string(labels[2:], ',') AS labels FROM l WHERE len(list_filter(labels[2:], lambda x: x >= 0)) > 0""")
def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of at most 40 invented ids with masked prompts, shifted and padded; those without a
    loss are dropped. ``text_labels`` takes whole texts."""
    n = F.least(F.char_length("text"), F.lit(40))
    step = lambda i: F.pmod(i * 37 + F.col("doc_id"), F.lit(130)).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), step)).otherwise(F.array().cast("array<int>"))
    return labelled(table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")))


def labelled(rows: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", "ids", F.pmod("doc_id", F.lit(45)).alias("prompt"))
    rows = rows.withColumn("labels", S.mask_labels(S.masked_prompt(F.col("ids"), F.col("prompt")), 120)).where(S.has_loss(F.col("labels"), 120))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    inputs = S.shifted_inputs(F.col("ids"))
    return rows.select("doc_id", F.size(inputs).cast("bigint").alias("slots"), joined(S.padded(inputs, 8, 2)).alias("inputs"), joined(S.shifted_labels(F.col("labels"))).alias("labels"))


@query()
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sample_labels`` over whole texts, an id for each character: its code point modulo 130."""
    ids = F.transform(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), lambda c: F.pmod(F.ascii(c), F.lit(130)).cast("int"))
    return labelled(table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")))


@query("""WITH old AS (SELECT source, count(*) AS rows FROM documents WHERE source <> 'src1' GROUP BY source), new AS (SELECT source, count(*) + CASE WHEN source = 'src2' THEN 1 ELSE 0 END AS rows FROM documents WHERE source <> 'src0' GROUP BY source)
SELECT coalesce(old.source, new.source) AS source, old.rows AS old_rows, new.rows AS new_rows FROM old FULL JOIN new ON old.source = new.source WHERE old.rows IS DISTINCT FROM new.rows""")
def checkpoint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose rows differ between a checkpoint and now."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    old = n.where("source <> 'src1'").select("source", F.col("rows").alias("old_rows"))
    new = n.where("source <> 'src0'").select("source", (F.col("rows") + (F.col("source") == "src2").cast("int")).alias("new_rows"))
    return old.join(new, "source", "full_outer").where(~F.col("old_rows").eqNullSafe(F.col("new_rows")))


@query("""SELECT * FROM (VALUES ('a.b', '1', '2'), ('a.c', '(absent)', 'true'), ('d', '[1]', '(absent)')) t(name, old, new)""")
def config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spec.changes({"a": {"b": 1}, "d": [1], "e": "same"}, {"a": {"b": 2, "c": True}, "e": "same"})
    return spark.createDataFrame(found, "name string, old string, new string")


@query("""WITH t(repo, pattern, part) AS (VALUES ('r', 'data/a/*', 'train'), ('r', 'data/*', 'val'), ('q', 'data/a/*', 'val'), ('r', 'other/*', 'val')),
p AS (SELECT *, regexp_extract(pattern, '^[^*?\\[]*') AS head FROM t)
SELECT a.repo, a.pattern AS train_pattern, b.pattern AS val_pattern FROM p a JOIN p b ON a.repo = b.repo AND a.part = 'train' AND b.part = 'val' AND (starts_with(a.head, b.head) OR starts_with(b.head, a.head))""")
def source_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation sources whose files may be training files as well."""
    rows = spark.createDataFrame([("r", "data/a/*", "train"), ("r", "data/*", "val"), ("q", "data/a/*", "val"), ("r", "other/*", "val")], "repo string, pattern string, part string")
    rows = rows.withColumn("head", T.glob_prefix(F.col("pattern")))
    a, b = rows.where("part = 'train'").alias("a"), rows.where("part = 'val'").alias("b")
    meet = F.startswith("a.head", F.col("b.head")) | F.startswith("b.head", F.col("a.head"))
    return a.join(b, F.col("a.repo") == F.col("b.repo")).where(meet).select("a.repo", F.col("a.pattern").alias("train_pattern"), F.col("b.pattern").alias("val_pattern"))


@query(f"""WITH RECURSIVE r AS (SELECT row_idx AS i, tokens FROM ({SHARDED} SELECT * FROM r) WHERE source = 'src4' AND row_idx < 30),
e AS (SELECT i, tokens::DOUBLE AS ema FROM r WHERE i = 0 UNION ALL SELECT r.i, 0.9 * ema + 0.1 * tokens FROM e JOIN r ON r.i = e.i + 1) SELECT i AS step, round(ema, 6) AS ema FROM e""")
def ema_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 rows of one source in ``ema_rates``."""
    return ema_rates(spark, sf_dir).where("source = 'src4' and step < 30").select("step", F.round("ema", 6).alias("ema"))


def moving_means(rows: DataFrame, every: int = 4096) -> DataFrame:
    """(source, step, ema) from (source, step, x), steps 0, 1, ...: a moving mean (0.9 old, 0.1 new).

    Rows are folded in blocks of a source's steps. A block hands on its rows weighted by 0.9 to the
    distance from its end; the blocks' last values are folded source by source, one row a block.
    """
    y = F.when(F.col("step") == 0, F.col("x")).otherwise(F.col("x") * 0.1)
    rows = rows.withColumn("block", F.floor(F.col("step") / every).cast("bigint"))
    distance = (F.col("block") + 1) * every - 1 - F.col("step")
    blocks = rows.groupBy("source", "block").agg(F.sum(y * F.pow(F.lit(0.9), distance)).alias("ends"))

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        group, value, carried = group.sort_values("block"), 0.0, []
        for ends in group["ends"]:
            carried.append(value)
            value = 0.9**every * value + ends
        return group.assign(carried=carried)[["source", "block", "carried"]]

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group, out = group.sort_values("step"), []
        value = group["carried"].iloc[0]
        for step, x in zip(group["step"], group["x"], strict=True):
            value = x if step == 0 else 0.9 * value + 0.1 * x
            out.append(value)
        return group.assign(ema=out)[["source", "step", "ema"]]

    carried = blocks.groupBy("source").applyInPandas(carry, "source string, block bigint, carried double")
    # one key of both, so that blocks aren't dealt by their source alone
    key = F.struct("source", "block").alias("key")
    carried = carried.select(key, "carried")
    return rows.select("*", key).join(carried, "key").groupBy("key").applyInPandas(fold, "source string, step bigint, ema double")


@query()
def ema_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving mean over all rows of every source."""
    return moving_means(indexed(spark, sf_dir).select("source", F.col("row_idx").alias("step"), F.col("tokens").cast("double").alias("x")))


@query(f"SELECT doc_id, source, {sql_hash(sql_norm('text'))} AS hash, length(text) // 4 AS tokens FROM documents WHERE source IS NOT NULL AND length(text) >= 50 QUALIFY row_number() OVER (PARTITION BY source, hash ORDER BY doc_id) = 1")
def prepared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source through its whole build: length, tokens, key, first of each key."""
    rows = table(spark, sf_dir, "documents").where("source is not null")
    return spec.prepared(rows, spec.Processing(), order="doc_id", by=["source"]).select("doc_id", "source", "hash", "tokens")
