"""Queries of converters, filters, encodings and the plans of a build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import encode as E
from millrace.functions import text as T
from millrace.operators import jobs, mixture, pool, vectors
from millrace.plans import converters
from millrace.plans.q_chat import INSTRUCT, MESSAGES, OPENING, REASONING, REST, VALID, conversations, instruct_rows
from millrace.plans.q_text import sql_strip
from millrace.plans.registry import query, sql_norm, table
from millrace.sources import readers

NL = "chr(10) || chr(10)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lists of (from, value)."""
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    shape = F.transform("messages", lambda m: F.struct(name(m["role"]).alias("from"), m["content"].alias("value")))
    return conversations(spark, sf_dir).select("conv_id", shape.alias("conversations"))


@query("SELECT doc_id, coalesce(text, '') AS instruction, coalesce(source, '') AS input, n_chars::VARCHAR AS output, 'ok' AS status FROM documents")
def convert_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field map: whatever the columns are, as text."""
    convert = converters.resolved(None, {"instruction": "text", "input": "source", "output": "n_chars"})
    return converters.converted(table(spark, sf_dir, "documents"), convert, ["doc_id"])


@query(f"{OPENING} SELECT conv_id, question AS instruction, \"system\" AS input, answer AS output, status FROM o")
def convert_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converters.converted(turns(spark, sf_dir), converters.resolved("sharegpt_conversations", None), ["conv_id"])


@query(f"""{MESSAGES} SELECT conv_id, coalesce(messages[1].content, '') AS instruction, '' AS input, coalesce(messages[2].content, '') AS output,
  CASE WHEN len(messages) >= 2 THEN 'ok' ELSE 'malformed' END AS status FROM m""")
def convert_first_two_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converters.converted(turns(spark, sf_dir), converters.resolved("first_two_turns", None), ["conv_id"])


QA = f"""{MESSAGES}, qa AS (SELECT conv_id, messages[1].content AS q, messages[2].content AS a FROM m)"""


def pairs(spark: SparkSession, sf_dir: str, question: str, answer: str) -> DataFrame:
    said = lambda i: F.get("messages", F.lit(i))["content"]
    return conversations(spark, sf_dir).select("conv_id", said(0).alias(question), said(1).alias(answer))


@query(f"{QA} SELECT conv_id, 'Question: ' || coalesce(q, '') || {NL} || 'Answer: ' || coalesce(a, '') AS text, 'ok' AS status FROM qa")
def convert_gsm8k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converters.converted(pairs(spark, sf_dir, "question", "answer"), converters.resolved("gsm8k_question_answer", None), ["conv_id"])


PAIRED = f"""{QA} SELECT conv_id, CASE WHEN {sql_strip("coalesce(q, '')")} <> '' AND {sql_strip("coalesce(a, '')")} <> '' THEN 'ok' ELSE 'malformed' END AS status,
  'user:' || q || '/assistant:' || a AS shown FROM qa"""


def shown(rows: DataFrame) -> DataFrame:
    m = F.col("messages")
    said = lambda i, role: F.concat(F.lit(f"{role}:"), F.get(m, F.lit(i))["content"])
    return rows.select("conv_id", "status", F.concat(said(0, "user"), F.lit("/"), said(1, "assistant")).alias("shown"))


@query(PAIRED)
def convert_webinstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(converters.converted(pairs(spark, sf_dir, "question", "answer"), converters.resolved("webinstruct_messages", None), ["conv_id"]))


@query(PAIRED)
def convert_opencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(converters.converted(pairs(spark, sf_dir, "input", "output"), converters.resolved("opencode_messages", None), ["conv_id"]))


@query(f"""{MESSAGES}, r AS (SELECT conv_id, {REASONING} AS reasoning, messages[1].role = 'system' AND trim(messages[1].content) <> '' AS system, {REST} AS rest FROM m)
SELECT conv_id, CASE WHEN reasoning <> 'off' OR NOT {VALID.replace("{0}", "rest")} THEN 'malformed' WHEN system THEN 'nonempty_system' ELSE 'ok' END AS status FROM r""")
def convert_nemotron(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).withColumn("reasoning", F.when(F.col("conv_id") % 4 == 3, "on").otherwise("off"))
    return converters.converted(rows, converters.resolved("nemotron_messages", None), ["conv_id"]).select("conv_id", "status")


@query(f"{INSTRUCT} SELECT conv_id, instruction || CASE WHEN coalesce(input, '') <> '' THEN {NL} || input ELSE '' END || '/' || output AS shown FROM i")
def convert_to_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction rows as two messages."""
    rows = converters.converted(instruct_rows(spark, sf_dir), converters.resolved("instruction_input_output", None, chat=True), ["conv_id"])
    m = F.col("messages")
    return rows.select("conv_id", F.concat_ws("/", F.get(m, F.lit(0))["content"], F.get(m, F.lit(1))["content"]).alias("shown"))


@query(f"""{OPENING} SELECT conv_id, CASE WHEN status <> 'ok' THEN 'malformed' WHEN question_index = 0 AND length(question) BETWEEN 50 AND 2000 AND length(answer) BETWEEN 50 AND 2000
  AND NOT regexp_matches(lower(answer), '```(python|java|cpp|javascript)') THEN 'passed' ELSE 'failed' END AS verdict FROM o""")
def filter_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    return rows.select("conv_id", converters.filter_named("sharegpt_quality")(converters.of(rows)).alias("verdict"))


SCORE = "CASE WHEN doc_id % 7 = 0 THEN '1.0' WHEN doc_id % 7 = 1 THEN '1' WHEN doc_id % 7 = 2 THEN '0.9999' WHEN doc_id % 7 = 3 THEN 'x' WHEN doc_id % 7 = 4 THEN '1.5' WHEN doc_id % 7 = 5 THEN '0' END"


@query(f"""SELECT doc_id, CASE WHEN TRY_CAST(s AS DECIMAL(38, 27)) IS NULL OR NOT TRY_CAST(s AS DECIMAL(38, 27)) BETWEEN 0 AND 1 THEN 'malformed' WHEN TRY_CAST(s AS DECIMAL(38, 27)) = 1 THEN 'passed' ELSE 'failed' END AS verdict
FROM (SELECT doc_id, {SCORE} AS s FROM documents)""")
def filter_opencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(SCORE).alias("average_test_score"))
    return rows.select("doc_id", converters.filter_named("opencode_passed_tests")(converters.of(rows)).alias("verdict"))


# --- encodings; a character's code point stands for a token

POINTS = "list_transform(string_split({0}, ''), lambda c: unicode(c))"
EXCHANGES = f"""{MESSAGES}, v AS (SELECT conv_id, messages, (len(messages) // 2)::BIGINT AS n FROM m WHERE {VALID.replace("{0}", "messages")}),
e AS (SELECT conv_id, messages, n, k, CASE WHEN k = 1 THEN '' ELSE {NL} END || 'User:' || chr(10) || messages[2 * k - 1].content || {NL} || 'Assistant:' || chr(10) AS context, messages[2 * k].content AS answer FROM v, unnest(range(1, n + 1)) t(k)),
s AS (SELECT *, 1 + sum(length(context) + length(answer) + 1) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)"""


def digest_of(ids: Column) -> Column:
    return F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))


@query(f"""{EXCHANGES}, f AS (SELECT conv_id, count(*) AS kept, sum(length(answer) + 1)::BIGINT AS supervised, max(upto)::BIGINT AS size,
  string_agg(array_to_string({POINTS.replace("{0}", "context")}, ',') || ',' || array_to_string({POINTS.replace("{0}", "answer")}, ',') || ',2', ',' ORDER BY k) AS ids FROM s WHERE upto <= 1500 GROUP BY conv_id)
SELECT conv_id, coalesce(size, 0) AS size, coalesce(supervised, 0) AS supervised, n - coalesce(kept, 0) AS cut, len(messages) % 2 = 1 AS trailing_user,
  md5(CASE WHEN size IS NULL THEN '' ELSE '1,' || ids END) AS ids_md5 FROM v LEFT JOIN f USING (conv_id)""")
def encode_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete leading exchanges of at most 1500 ids; only answers and their end marks are supervised."""
    rows = conversations(spark, sf_dir).select("conv_id", E.encoded_exchanges(F.col("messages"), E.code_points, 1, 2, 1500).alias("e")).where("e is not null").select("conv_id", "e.*")
    count = F.size(F.filter("supervised", lambda x: x))
    return rows.select("conv_id", F.size("ids").cast("bigint").alias("size"), count.cast("bigint").alias("supervised"), F.col("exchanges_cut").cast("bigint").alias("cut"), "trailing_user", digest_of(F.col("ids")).alias("ids_md5"))


@query(f"""{MESSAGES}, v AS (SELECT conv_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM m WHERE {VALID.replace("{0}", "messages")} AND len(messages) % 2 = 0)
SELECT conv_id, (1 + sum(length(messages[i].content) + 2))::BIGINT AS size, sum(CASE WHEN i % 2 = 0 THEN length(messages[i].content) + 1 ELSE 0 END)::BIGINT AS supervised,
  md5('1,' || string_agg(CASE WHEN i % 2 = 0 THEN '4,' ELSE '3,' END || array_to_string({POINTS.replace("{0}", "messages[i].content")}, ',') || ',2', ',' ORDER BY i)) AS ids_md5 FROM v GROUP BY conv_id""")
def encode_literal_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", E.literal_chat(F.col("messages"), E.code_points, 1, 2, 3, 4).alias("e")).where("e is not null").select("conv_id", "e.*")
    return rows.select("conv_id", F.size("ids").cast("bigint").alias("size"), F.size(F.filter("supervised", lambda x: x)).cast("bigint").alias("supervised"), digest_of(F.col("ids")).alias("ids_md5"))


@query(f"""{MESSAGES}, v AS (SELECT conv_id, messages, {VALID.replace("{0}", "messages")} AS valid, len(messages) AS n FROM m),
p AS (SELECT conv_id, string_agg(CASE WHEN k % 2 = 0 THEN messages[k].content || chr(2) ELSE CASE WHEN k = 1 THEN '' ELSE {NL} END || 'User:' || chr(10) || messages[k].content || {NL} || 'Assistant:' || chr(10) END, '' ORDER BY k) AS t
  FROM v, unnest(range(1, n + 1)) u(k) WHERE valid AND n % 2 = 1 GROUP BY conv_id)
SELECT conv_id, CASE WHEN NOT valid THEN 'malformed' WHEN n % 2 = 0 THEN 'no_question' WHEN length(t) + 1 > 900 THEN 'too_long' ELSE 'ok' END AS status,
  CASE WHEN valid AND n % 2 = 1 AND length(t) + 1 <= 900 THEN md5('1,' || array_to_string({POINTS.replace("{0}", "t")}, ',')) END AS ids_md5 FROM v LEFT JOIN p USING (conv_id)""")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories with an open question, up to where an answer is to begin."""
    rows = conversations(spark, sf_dir).select("conv_id", E.chat_prompt(F.col("messages"), E.code_points, 1, 2, 900).alias("p")).select("conv_id", "p.*")
    return rows.select("conv_id", "status", F.when(F.col("ids").isNotNull(), digest_of(F.col("ids"))).alias("ids_md5"))


@query("""SELECT doc_id, 'pass_text' AS format, length(text) + 2 AS size, length(text) + 2 AS supervised FROM documents""")
def format_pass_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    made = rows.select("doc_id", E.FORMATS["pass_text"](converters.of(rows), E.code_points, 1, 2).alias("s"))
    return made.select("doc_id", F.lit("pass_text").alias("format"), F.size("s.ids").cast("bigint").alias("size"), F.size(F.filter("s.labels", lambda x: x >= 0)).cast("bigint").alias("supervised"))


# --- nested strings, jobs, metrics, plans


@query(f"{MESSAGES} SELECT conv_id, array_to_string(list_concat(list_transform(messages, lambda x: x.role || '|' || x.content), [conv_id::VARCHAR]), '|') AS strings, 2 * len(messages) + 1 AS n FROM m")
def nested_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", F.struct(F.col("messages"), F.struct(F.lit(5).alias("number"), F.col("conv_id").cast("string").alias("name")).alias("inner")).alias("doc"))
    found = T.doc_strings(F.col("doc"), rows.schema["doc"].dataType)
    return rows.select("conv_id", F.array_join(found, "|").alias("strings"), F.size(found).cast("bigint").alias("n"))


@query("SELECT doc_id, coalesce(n_chars::VARCHAR, '') AS text FROM documents")
def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chosen field as text, whatever its type."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", converters.text_of(rows, "n_chars").alias("text"))


@query("""WITH RECURSIVE g AS (SELECT conv_id, count(*) AS n, row_number() OVER (ORDER BY conv_id) AS i FROM conversations GROUP BY conv_id),
j(i, job, held) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT UNION ALL
  SELECT g.i, CASE WHEN held > 0 AND held + n > 8 THEN job + 1 ELSE job END, CASE WHEN held > 0 AND held + n > 8 THEN n ELSE held + n END FROM j JOIN g ON g.i = j.i + 1)
SELECT conv_id, n AS requests, job, ((('0x' || substr(sha256('fixed_document_jobs_v1:7:1:0:loglikelihood:' || job), 1, 16))::UBIGINT)::HUGEINT % 9223372036854775807)::BIGINT AS seed FROM j JOIN g USING (i)""")
def benchmark_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a document stay together; a job is closed before the document that would overfill it."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("requests"))
    return jobs.plan_jobs(n, "conv_id", "requests").withColumn("seed", jobs.job_seed(F.col("job"), 7, 1, 0, "loglikelihood"))


@query("""WITH u AS (SELECT label, vec_id, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT label, place, sum(x) AS s, sum(x * x) AS q FROM u GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY label)
SELECT n.label AS label, n, round(CASE WHEN sum(q) > 0 THEN 1 - sum(s * s) / n / sum(q) END, 6) AS dispersion FROM s JOIN n ON s.label IS NOT DISTINCT FROM n.label GROUP BY n.label, n""")
def representation_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.spread_of_groups(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return out.select("label", "n", F.round("dispersion", 6).alias("dispersion"))


@query("""WITH c AS (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE - list_avg(embedding::DOUBLE[])) AS e FROM embeddings),
u AS (SELECT label, vec_id, unnest(range(1, len(e) + 1)) AS place, unnest(e) AS x, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS norm FROM c),
s AS (SELECT label, place, sum(x / norm) AS s, count(*) AS n FROM u WHERE norm > 0 GROUP BY ALL)
SELECT label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS correlation FROM s GROUP BY label""")
def representation_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean correlation of all pairs: the mean cosine after each vector's own mean is taken off."""
    rows = table(spark, sf_dir, "embeddings").select("label", vectors.centred(F.col("embedding")).alias("embedding"))
    return vectors.pair_cosine_mean(rows, "label", "embedding").select("label", "n", F.round("mean_cosine", 6).alias("correlation"))


NORM = "sqrt(list_sum(list_transform({0}, lambda v: v * v)))"


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT a.vec_id, {NORM.replace("{0}", "a.v")} AS sn, {NORM.replace("{0}", "c.v")} AS cn, {NORM.replace("{0}", "list_transform(list_zip(a.v, b.v), lambda p: p[2] - p[1])")} AS ab,
  {NORM.replace("{0}", "list_transform(list_zip(c.v, d.v), lambda p: p[2] - p[1])")} AS cd
  FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2 JOIN e d ON d.vec_id = a.vec_id + 3)
SELECT vec_id, round(ab / sn, 6) AS perturbation, round(cd / cn, 6) AS response, round((cd / cn) / (ab / sn), 6) AS sensitivity FROM q WHERE sn > 0 AND cn > 0 AND ab > 0""")
def state_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative answers to relative changes; four neighbouring vectors stand for states and outputs."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v0"))
    rows = e
    for i in (1, 2, 3):
        rows = rows.join(e.select((F.col("vec_id") - i).alias("vec_id"), F.col("v0").alias(f"v{i}")), "vec_id")
    out = rows.select("vec_id", vectors.sensitivity(*(F.col(f"v{i}") for i in range(4))).alias("s")).where("s.sensitivity is not null")
    return out.select("vec_id", *(F.round(f"s.{c}", 6).alias(c) for c in ("perturbation", "response", "sensitivity")))


@query(f"""WITH s AS (SELECT source, count(*) AS raw, count(DISTINCT md5({sql_norm('text')})) AS processed FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT source, raw, processed, least(ceil(greatest(2 * raw - processed, 0) * raw * 6 / (processed * 5))::BIGINT, 3 * raw) AS top_up FROM s""")
def top_up_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to add for twice the rows there are, by the yield that each source showed."""
    rows = table(spark, sf_dir, "documents").where("source is not null").groupBy("source", T.text_hash64(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    s = rows.groupBy("source").agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("processed"))
    raw = F.col("raw")
    return s.withColumn("top_up", mixture.top_up(F.col("processed"), raw, 2 * raw, 3 * raw))


@query("""WITH t AS (SELECT source, doc_id, length(text) // 4 AS n FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), g AS (SELECT source, sum(n) AS total, (sum(n) * 5 // 2 + 7) AS goal FROM t GROUP BY source),
c AS (SELECT source, sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
SELECT g.source, CASE WHEN total > 0 THEN (goal // total)::BIGINT END AS epochs, CASE WHEN total > 0 THEN count(*) FILTER (coalesce(before, 0) < goal % total) END AS rows_of_last, CASE WHEN total > 0 THEN 'ok' ELSE 'unusable' END AS status
FROM g JOIN c USING (source) GROUP BY g.source, total, goal""")
def epoch_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source is read for two and a half times its tokens, and seven more."""
    rows = table(spark, sf_dir, "documents").where("source is not null and text is not null").select("source", "doc_id", T.estimate_tokens(F.col("text")).alias("n"))
    goals = rows.groupBy("source").agg(F.floor(F.sum("n") * 5 / 2 + 7).cast("bigint").alias("goal"))
    return pool.epochs_of(rows.join(goals, "source"), "source", "doc_id", "n", F.col("goal"))


@query("SELECT lang, count(*) AS rows, min(doc_id) AS lowest, max(doc_id) AS highest FROM documents GROUP BY lang")
def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each key and their range in each file, over all files of the table."""
    index = readers.file_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "doc_id")
    return index.groupBy("key").agg(F.sum("rows").alias("rows"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest")).withColumnRenamed("key", "lang")


@query("""WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position FROM documents)
SELECT * FROM r WHERE (lang = 'en' AND position >= 5 AND position < 25) OR (lang = 'de' AND position < 30) OR (lang = 'fr' AND position >= 10)""")
def slices_in_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of several languages from one pass over the rows."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return readers.keyed_slices(rows, "lang", ["doc_id"], {"en": (5, 20), "de": (0, 30), "fr": (10, None)})


@query("""WITH g AS (SELECT lang, avg(length(text)) AS a, max(length(text))::DOUBLE AS m, count(*)::DOUBLE AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT 'benchmark/r1/' || lang || '/mean' AS name, round(a, 6) AS value FROM g UNION ALL SELECT 'benchmark/r1/' || lang || '/longest_strict-match', round(m, 6) FROM g UNION ALL SELECT 'benchmark/r1/' || lang || '/rows', round(n, 6) FROM g""")
def flat_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by task as flat names: no standard errors, a filter's name as a suffix."""
    rows = table(spark, sf_dir, "documents").where("lang is not null").withColumn("n", F.char_length("text")).groupBy("lang").agg(F.avg("n").alias("a"), F.max("n").cast("double").alias("m"), F.stddev("n").alias("e"), F.count(F.lit(1)).cast("double").alias("c"))
    results = rows.select(F.col("lang").alias("task"), F.create_map(F.lit("mean,none"), "a", F.lit("mean_stderr,none"), "e", F.lit("longest,strict-match"), "m", F.lit("rows"), "c").alias("metrics"))
    return flattened(results, "r1").withColumn("value", F.round("value", 6))


def flattened(results: DataFrame, label: str) -> DataFrame:
    """(name, value) from (task, metrics): benchmark/label/task/metric."""
    rows = results.select("task", F.explode("metrics").alias("key", "value"))
    name, part = F.substring_index("key", ",", 1), F.regexp_extract("key", ",(.*)$", 1)
    rows = rows.where(~name.endswith("_stderr") & F.col("value").isNotNull())
    whole = F.concat(F.lit(f"benchmark/{label}/"), "task", F.lit("/"), name, F.when(~part.isin("", "none"), F.concat(F.lit("_"), part)).otherwise(""))
    return rows.select(whole.alias("name"), "value")
