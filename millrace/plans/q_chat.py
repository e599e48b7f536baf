"""Queries over conversations and instruction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import chat as C
from millrace.functions import text as T
from millrace.operators import dedup
from millrace.plans.q_text import sql_strip
from millrace.plans.registry import query, sql_hash, table

MESSAGES = """WITH m AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"""
VALID = """(len({0}) > 0 AND len(list_filter(range(1, len({0}) + 1), lambda i: ({0})[i].role IS DISTINCT FROM (CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)
  OR trim(coalesce(({0})[i].content, '')) = '')) = 0)"""
REST = "CASE WHEN messages[1].role = 'system' THEN messages[2:] ELSE messages END"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation, its turns as messages in order. A conversation is a bounded
    unit: its turns are gathered, never those of a whole source."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role"), F.col("text").alias("content")))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def rest(messages: Column) -> Column:
    system = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    return F.when(system, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)


@query(f"""{MESSAGES} SELECT conv_id, len(messages) AS turns, {VALID.replace("{0}", "messages")} AS valid, {VALID.replace("{0}", REST)} AS valid_without_system,
  messages[-1].role = 'user' AS trailing_user FROM m""")
def conversations_to_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    return conversations(spark, sf_dir).select(
        "conv_id", F.size(m).cast("bigint").alias("turns"), C.valid_messages(m).alias("valid"), C.valid_messages(rest(m)).alias("valid_without_system"), (F.element_at(m, -1)["role"] == "user").alias("trailing_user")
    )


OPENING = f"""{MESSAGES}, a AS (SELECT conv_id, messages, CASE WHEN messages[1].role = 'system' THEN 1 ELSE 0 END AS k FROM m),
o AS (SELECT conv_id, k AS question_index, coalesce(messages[k + 1].content, '') AS question, coalesce(messages[k + 2].content, '') AS answer,
  CASE WHEN k = 1 THEN messages[1].content ELSE '' END AS "system",
  CASE WHEN messages[k + 1].role = 'user' AND messages[k + 2].role = 'assistant' THEN 'ok' WHEN messages[k + 1].role = 'assistant' THEN 'orphan' ELSE 'malformed' END AS status FROM a)"""


@query(f'{OPENING} SELECT conv_id, question, answer, "system", question_index, status FROM o')
def opening_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", C.opening_exchange(F.col("messages")).alias("o")).select("conv_id", "o.*")


@query(f"""{OPENING} SELECT conv_id, status = 'ok' AND question_index = 0 AND length(question) BETWEEN 50 AND 2000 AND length(answer) BETWEEN 50 AND 2000
  AND NOT regexp_matches(lower(answer), '```(python|java|cpp|javascript)') AS kept FROM o""")
def sharegpt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", C.opening_quality(C.opening_exchange(F.col("messages"))).alias("kept"))


REASONING = "CASE WHEN conv_id % 4 = 3 THEN 'on' ELSE 'off' END"


@query(f"""{MESSAGES}, r AS (SELECT conv_id, {REASONING} AS reasoning, messages[1].role = 'system' AND trim(messages[1].content) <> '' AS system, {REST} AS rest FROM m)
SELECT CASE WHEN reasoning <> 'off' OR NOT {VALID.replace("{0}", "rest")} THEN 'malformed' WHEN system THEN 'nonempty_system' ELSE 'kept' END AS status, count(*) AS n FROM r GROUP BY status""")
def nemotron_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasoning = F.when(F.col("conv_id") % 4 == 3, "on").otherwise("off")
    return conversations(spark, sf_dir).select(C.reasoning_policy(F.col("messages"), reasoning).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


INSTRUCT = f"""{MESSAGES}, i AS (SELECT conv_id, coalesce(list_filter(messages, lambda x: x.role = 'user')[1].content, '') AS instruction,
  list_filter(messages, lambda x: x.role = 'system')[1].content AS input, coalesce(list_filter(messages, lambda x: x.role = 'assistant')[1].content, '') AS output FROM m)"""


def instruct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First question, system turn and first answer of each conversation."""
    first = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), F.lit(0))["content"]
    return conversations(spark, sf_dir).select(
        "conv_id", F.coalesce(first("user"), F.lit("")).alias("instruction"), first("system").alias("input"), F.coalesce(first("assistant"), F.lit("")).alias("output")
    )


TEXT = f"array_to_string(list_filter([{sql_strip('instruction')}, nullif({sql_strip(chr(99) + 'oalesce(input, ' + chr(39) * 2 + ')')}, ''), {sql_strip('output')}], lambda x: x IS NOT NULL), chr(10) || chr(10))"


@query(f"{INSTRUCT} SELECT conv_id, {TEXT} AS text, length({TEXT}) // 4 + 2 AS tokens FROM i WHERE {sql_strip('instruction')} <> '' AND {sql_strip('output')} <> '' AND length({TEXT}) // 4 + 2 <= 512")
def instruct_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction rows with both required fields whose text isn't over the cap."""
    rows = instruct_rows(spark, sf_dir).where(T.has_required_fields(F.col("instruction"), F.col("output")))
    rows = rows.select("conv_id", T.instruct_text(F.col("instruction"), F.col("input"), F.col("output")).alias("text"))
    return rows.withColumn("tokens", T.estimate_tokens(F.col("text")) + 2).where("tokens <= 512")


@query(f"""{INSTRUCT} SELECT conv_id, CASE WHEN ok THEN 'Given this output, what was the likely instruction or input?' || chr(10) || chr(10) || 'Output: ' || output ELSE instruction END AS instruction,
  CASE WHEN ok THEN '' ELSE input END AS input, CASE WHEN ok THEN instruction || CASE WHEN coalesce(input, '') <> '' THEN chr(10) || 'Input: ' || input ELSE '' END ELSE output END AS output
FROM (SELECT *, instruction <> '' AND output <> '' AS ok FROM i)""")
def input_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruct_rows(spark, sf_dir).select("conv_id", T.input_inversion(F.col("instruction"), F.col("input"), F.col("output")).alias("r")).select("conv_id", "r.*")


@query("""SELECT doc_id, pmod < 30 AS inverted FROM (SELECT doc_id, CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) % 100 AS pmod FROM documents)""")
def bernoulli_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows drawn by a key of (seed, row) alone, as inversions are."""
    from millrace.operators.order import keyed_share

    return table(spark, sf_dir, "documents").select("doc_id", keyed_share("7", F.col("doc_id"), 30).alias("inverted"))


@query(f"{MESSAGES} SELECT conv_id, messages[1].content AS instruction, messages[2].content AS output FROM m")
def first_two_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", C.first_two_turns(F.col("messages")).alias("r")).select("conv_id", "r.*")


FITTED = f"""{MESSAGES}, r AS (SELECT conv_id, {REST} AS messages FROM m),
s AS (SELECT *, list_transform(range(1, len(messages) // 2 + 1), lambda k: length(messages[2 * k - 1].content) // 4 + length(messages[2 * k].content) // 4 + 3) AS sizes FROM r),
e AS (SELECT *, list_transform(range(1, len(sizes) + 1), lambda k: 1 + list_sum(sizes[1:k])::BIGINT) AS ends FROM s)"""


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", rest(F.col("messages")).alias("messages"))
    tokens = lambda c: T.estimate_tokens(c) + 1
    ends = C.exchange_ends(F.col("messages"), tokens)
    return rows.withColumn("ends", F.transform(ends, lambda e, i: e + i + 1))


@query(f"""{FITTED} SELECT conv_id, array_to_string(list_filter(ends, lambda x: x <= 256), ',') AS ends, len(list_filter(ends, lambda x: x <= 256)) * 2 AS kept_messages,
  len(ends) - len(list_filter(ends, lambda x: x <= 256)) AS exchanges_cut, len(messages) % 2 = 1 AS trailing_user FROM e""")
def fit_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete leading exchanges under a cap; one more token for the end of each."""
    out = fitted(spark, sf_dir).select("conv_id", C.fit_exchanges(F.col("messages"), F.col("ends"), 256).alias("f"))
    return out.select(
        "conv_id", F.array_join(F.transform("f.ends", lambda e: e.cast("string")), ",").alias("ends"), F.size("f.messages").cast("bigint").alias("kept_messages"),
        F.col("f.exchanges_cut").cast("bigint").alias("exchanges_cut"), "f.trailing_user",
    )


@query(f"{FITTED} SELECT sum(coalesce(list_max(list_filter(ends, lambda x: x <= 129)) - 1, 0))::BIGINT AS positions, count(*) AS conversations FROM e")
def fitted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir).agg(F.sum(C.fitted_positions(F.col("ends"), 128)).alias("positions"), F.count(F.lit(1)).alias("conversations"))


HASHED = sql_hash("'0:' || array_to_string(list_transform(messages, lambda x: length(x.role) || ':' || x.role || length(x.content) || ':' || x.content), '')", "sha256")


@query(f"{MESSAGES} SELECT conv_id, {HASHED} AS hash FROM m WHERE messages[-1].role = 'assistant' QUALIFY row_number() OVER (PARTITION BY {HASHED} ORDER BY conv_id) = 1")
def conversation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).where(F.element_at("messages", -1)["role"] == "assistant")
    return dedup.first_rows(rows.select("conv_id", C.conversation_hash(F.col("messages")).alias("hash")), "hash", ["conv_id"])


@query(f"""{MESSAGES}, b AS (SELECT conv_id, NOT {VALID.replace("{0}", "messages")} AS bad FROM m), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (ORDER BY conv_id) AS run FROM b)
SELECT max(n) AS longest_run, sum(n)::BIGINT AS malformed, max(n) >= 10 AS failed FROM (SELECT run, count(*) FILTER (bad) AS n FROM g GROUP BY run)""")
def malformed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed rows of a source and the longest run of them; ten in a row fail it."""
    from millrace.operators.order import longest_run

    rows = conversations(spark, sf_dir).select("conv_id", (~C.valid_messages(F.col("messages"))).alias("bad"))
    return longest_run(rows, "conv_id", "bad").withColumn("failed", F.col("longest_run") >= 10)


@query("""SELECT v AS score, coalesce(try_cast(trim(v) AS DECIMAL(38, 27)) = 1, false) AS kept FROM (VALUES ('1'), ('1.0'), ('0.9999999999999999999999'), ('nan'), (' 1.00 '), ('0'), ('true'), ('1.1')) t(v)""")
def opencode_passed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(v,) for v in ("1", "1.0", "0.9999999999999999999999", "nan", " 1.00 ", "0", "true", "1.1")], "score string")
    return rows.select("score", C.passed_tests(F.col("score")).alias("kept"))


@query(f"{INSTRUCT} SELECT conv_id, 'Question: ' || instruction || chr(10) || chr(10) || 'Answer: ' || output AS text, instruction || CASE WHEN coalesce(input, '') <> '' THEN chr(10) || chr(10) || input ELSE '' END AS prompt FROM i")
def question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, g, o = (F.col(c) for c in ("instruction", "input", "output"))
    return instruct_rows(spark, sf_dir).select("conv_id", C.question_answer(i, o).alias("text"), F.get(C.pair_messages(i, o, g), F.lit(0))["content"].alias("prompt"))


