"""Queries of planning, mixing, scheduling and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import mixture as M
from millrace.operators import pool as P
from millrace.plans.q_dedup import SHARDED, indexed
from millrace.plans.registry import query, table

STAGES = "(VALUES (0, 819200, 0.25), (1, 819200, 0.07), (2, 409600, 0.0)) st(stage, tokens, transition)"
WEIGHTS = "(VALUES (0, 'src0', 0.7), (0, 'src1', 0.3), (1, 'src0', 0.33), (1, 'src2', 0.67), (2, 'src2', 1.0)) w(stage, source, weight)"


def stages(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (0, 819200L, 0.25), (1, 819200L, 0.07), (2, 409600L, 0.00) AS st(stage, tokens, transition)")


def weights(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (0, 'src0', 0.70), (0, 'src1', 0.30), (1, 'src0', 0.33), (1, 'src2', 0.67), (2, 'src2', 1.00) AS w(stage, source, weight)")


BUDGET = f"""budgets AS (SELECT source, ceil(sum((tokens - moving) * w + moving * (w + coalesce(nw, 0)) * 0.5))::BIGINT AS budget FROM (
  SELECT source, tokens::DECIMAL(12, 0) AS tokens, w, nw, CASE WHEN nw IS NULL THEN 0::DECIMAL(15, 3) ELSE (tokens * transition)::DECIMAL(15, 3) END AS moving FROM (
    SELECT s.source, st.stage, tokens, transition::DECIMAL(4, 2) AS transition, coalesce(weight, 0)::DECIMAL(6, 3) AS w, lead(coalesce(weight, 0)::DECIMAL(6, 3)) OVER (PARTITION BY s.source ORDER BY st.stage) AS nw
    FROM {STAGES} CROSS JOIN (SELECT DISTINCT source FROM {WEIGHTS}) s LEFT JOIN {WEIGHTS} ON w.stage = st.stage AND w.source = s.source)) GROUP BY source)"""


@query(f"WITH {BUDGET} SELECT source, budget FROM budgets")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.token_budgets(stages(spark), weights(spark))


RATES = "rates AS (SELECT source, sum(least(length(text) // 4, 512))::BIGINT AS sum_tokens, count(*) AS n FROM documents GROUP BY source)"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = F.least(T.estimate_tokens(F.col("text")), F.lit(512))
    return table(spark, sf_dir, "documents").select("source", served.alias("t")).groupBy("source").agg(F.sum("t").alias("sum_tokens"), F.count(F.lit(1)).alias("n"))


NEEDED = f"""{BUDGET}, {RATES}, p AS (SELECT source, budget, sum_tokens, n, (budget * n + sum_tokens - 1) // sum_tokens AS rows_budget,
  (budget * n * 4 + sum_tokens * 3 - 1) // (sum_tokens * 3) AS rows_needed FROM budgets JOIN rates USING (source)),
plan AS (SELECT *, (rows_needed * 5 + 5) // 6 AS rows_sufficient FROM p)"""


@query(f"WITH {NEEDED} SELECT source, budget, rows_budget, rows_needed, rows_sufficient FROM plan")
def rows_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to fetch for a budget: a margin of 1.2 over what a tenth held out leaves."""
    return M.rows_plan(token_budget(spark, sf_dir), rates(spark, sf_dir), "0.1")


@query(f"""WITH {NEEDED} SELECT source, n AS rows, rows_needed, greatest(0, rows_needed - n) AS rows_to_fetch, CASE WHEN n >= rows_sufficient THEN 'satisfied' WHEN n >= rows_needed // 2 THEN 'short' ELSE 'missing' END AS state,
  round(rows_budget / (n - ceil(n * 0.1)), 6) AS epochs FROM plan""")
def source_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = rows_needed(spark, sf_dir).join(rates(spark, sf_dir).select("source", F.col("n").alias("rows")), "source")
    state = F.when(F.col("rows") >= F.col("rows_sufficient"), "satisfied").when(F.col("rows") >= F.floor(F.col("rows_needed") / 2), "short").otherwise("missing")
    trained = F.col("rows") - F.ceil(F.col("rows").cast("decimal(18,0)") * F.lit("0.1").cast("decimal(3,2)"))
    return plan.select(
        "source", "rows", "rows_needed", F.greatest(F.lit(0), F.col("rows_needed") - F.col("rows")).alias("rows_to_fetch"), state.alias("state"), F.round(F.col("rows_budget") / trained.cast("double"), 6).alias("epochs")
    )


BOUNDS = f"""bounds AS (SELECT stage, (e - steps)::BIGINT AS start_step, e::BIGINT AS end_step, (e - moving)::BIGINT AS transition_start FROM (
  SELECT stage, steps, sum(steps) OVER (ORDER BY stage) AS e, CASE WHEN stage = 2 THEN 0 ELSE floor(tokens * transition::DECIMAL(4, 2))::BIGINT // 4096 END AS moving FROM (SELECT *, tokens // 4096 AS steps FROM {STAGES})))"""


@query(f"WITH {BOUNDS} SELECT stage, start_step, end_step, transition_start FROM bounds")
def stage_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stage_boundaries(stages(spark), 4096)


STEPS = f"""{BOUNDS}, steps AS (SELECT step, stage, CASE WHEN step >= transition_start THEN stage + 1 END AS entering,
  CASE WHEN step >= transition_start THEN (step - transition_start) / (end_step - transition_start) ELSE 0.0 END AS progress FROM (SELECT *, unnest(range(start_step, end_step)) AS step FROM bounds))"""


@query(f"""WITH {STEPS}, x AS (SELECT step, source, (1 - progress) * weight::DOUBLE AS w FROM steps JOIN {WEIGHTS} USING (stage) UNION ALL SELECT step, source, progress * weight::DOUBLE FROM steps JOIN {WEIGHTS} ON w.stage = entering)
SELECT step, source, round(sum(w), 9) AS weight FROM x GROUP BY ALL""")
def data_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark).withColumn("weight", F.col("weight").cast("double"))
    return M.data_weights(M.stage_steps(spark, stage_boundaries(spark, sf_dir)), w).select("step", "source", F.round("weight", 9).alias("weight"))


@query(f"""WITH {STEPS}, r(stage, rate) AS (VALUES (0, 0.001), (1, 0.0005), (2, 0.0002)), j AS (SELECT step, a.rate::DOUBLE AS rate, b.rate::DOUBLE AS rate_to, progress FROM steps JOIN r a USING (stage) LEFT JOIN r b ON b.stage = entering)
SELECT step, round(CASE WHEN step < 10 THEN 0.001 * step / 10 WHEN step > 500 - 20 THEN greatest(0.0002 * (500 - step) / 20, 0.00001)
  ELSE greatest(coalesce(rate + (rate_to - rate) * progress, rate), 0.00001) END::DOUBLE, 12) AS lr FROM j""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = M.stage_steps(spark, stage_boundaries(spark, sf_dir))
    rates_ = spark.createDataFrame([(0, 0.001), (1, 0.0005), (2, 0.0002)], "stage int, rate double")
    return M.learning_rate(steps, rates_, 500, 10, 20, 0.00001).select("step", F.round("lr", 12).alias("lr"))


@query("""SELECT DISTINCT step::BIGINT AS step FROM (SELECT unnest(range(100, 501, 100)) AS step UNION ALL SELECT greatest(1, least(500, floor(500 * p / 100 + 0.5)))::BIGINT FROM (VALUES (0.0), (12.5), (33.3), (100.0)) t(p))""")
def trigger_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps after which an action runs: every hundredth and at shares of the progress."""
    shares = spark.createDataFrame([(0.0,), (12.5,), (33.3,), (100.0,)], "p double")
    at = shares.select(F.greatest(F.lit(1), F.least(F.lit(500), F.floor(F.col("p") * 500 / 100 + 0.5))).cast("bigint").alias("step"))
    return spark.range(1, 501).where("id % 100 = 0").select(F.col("id").alias("step")).union(at).distinct()


@query(f"{SHARDED}, c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT doc_id, source, row_idx < ceil(0.07::DECIMAL(4, 2) * n) AS validation FROM r JOIN c USING (source)")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each source are held out, their share taken as an exact decimal."""
    rows = indexed(spark, sf_dir)
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    held = F.ceil(F.col("n").cast("decimal(18,0)") * F.lit("0.07").cast("decimal(4,2)"))
    return rows.join(counts, "source").select("doc_id", "source", (F.col("row_idx") < held).alias("validation"))


@query(f"{SHARDED} SELECT doc_id, source, (row_idx % 6)::INT AS shard, row_idx % 6 // 2 AS rank, row_idx % 2 AS worker FROM r")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to three ranks of two workers."""
    shard = F.pmod("row_idx", F.lit(6))
    return indexed(spark, sf_dir).select("doc_id", "source", shard.cast("int").alias("shard"), F.floor(shard / 2).cast("bigint").alias("rank"), (F.col("row_idx") % 2).alias("worker"))


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, s::INT AS shard, (n - s + 5) // 6 AS rows FROM n, (SELECT unnest(range(6)) AS s)")
def epoch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "n", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("shard")).select("source", "shard", F.floor((F.col("n") - F.col("shard") + 5) / 6).alias("rows"))


@query("SELECT source, count(*) AS rows, 1234 % count(*) AS resume_at, 1234 // count(*) AS epochs_done FROM documents GROUP BY source")
def resume_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return n.select("source", "rows", F.pmod(F.lit(1234), "rows").alias("resume_at"), F.floor(F.lit(1234) / F.col("rows")).alias("epochs_done"))


@query(f"{SHARDED} SELECT source, shard, round(t / sum(t) OVER (PARTITION BY shard), 9) AS share FROM (SELECT source, row_idx // 25 AS shard, sum(tokens) AS t FROM r GROUP BY ALL)")
def composition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's part of the tokens of an interval."""
    rows = indexed(spark, sf_dir).groupBy("source", F.floor(F.col("row_idx") / 25).cast("bigint").alias("shard")).agg(F.sum("tokens").alias("t"))
    whole = rows.groupBy("shard").agg(F.sum("t").alias("all"))
    return rows.join(whole, "shard").select("source", "shard", F.round(F.col("t") / F.col("all"), 9).alias("share"))


@query("""SELECT source, sum(toxic * n)::BIGINT AS total, sum(n)::BIGINT AS tokens, round(sum(quality * n) / sum(n), 9) AS mean
FROM (SELECT source, quality, toxic, length(text) // 4 AS n FROM documents JOIN labels USING (doc_id)) GROUP BY source HAVING sum(n) > 0""")
def supervised_token_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over tokens, not over the means of documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", T.estimate_tokens(F.col("text")).alias("n")).join(table(spark, sf_dir, "labels"), "doc_id")
    out = rows.groupBy("source").agg(F.sum(F.col("toxic") * F.col("n")).alias("total"), F.sum("n").alias("tokens"), F.sum(F.col("quality") * F.col("n")).alias("q"))
    return out.where("tokens > 0").select("source", "total", "tokens", F.round(F.col("q") / F.col("tokens"), 9).alias("mean"))


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.least(T.estimate_tokens(F.col("text")), F.lit(1024))
    source = F.coalesce("source", F.lit("")).alias("source")
    return table(spark, sf_dir, "documents").select(F.lit(0).alias("run"), source, F.col("doc_id").alias("row"), slots.alias("slots")).where("slots > 0")


MIX = {"src0": 0.5, "src1": 0.3, "src2": 0.2}


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over all sources: those that MIX doesn't name weigh as much as its least. The
    driver holds the names of the sources."""
    rows = stream_rows(spark, sf_dir)
    names = [r.source for r in rows.select("source").distinct().collect()]
    return P.deficit_schedule(rows, {n: MIX.get(n, min(MIX.values())) for n in names})


@query()
def deficit_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a mixture's documents are drawn, each of them once."""
    return drawn(spark, sf_dir).select("position", "source", F.col("row").alias("doc_id"), "slots")


@query()
def pack_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's documents in packs of 2048 slots."""
    return P.first_fit(drawn(spark, sf_dir), 2048).select("pack", "place", F.col("row").alias("doc_id"), "slots", "bin_offset")


@query()
def pack_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = P.first_fit(drawn(spark, sf_dir), 2048)
    laid = P.pack_layout(placed, 2048)
    return laid.select("pack", "padding", F.sha2(F.array_join(F.col("position_ids").cast("array<string>"), ","), 256).alias("position_digest"), F.array_max("document_ids").alias("last_document"))


@query()
def scatter_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs dealt to four ranks in turn."""
    packs = pack_first_fit(spark, sf_dir).select("pack").distinct()
    return packs.select("pack", F.pmod("pack", F.lit(4)).alias("rank"))
