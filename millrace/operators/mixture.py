"""Budgets, stages and schedules of a training mixture, over small driver-made tables.

Weights and fractions are decimals: 0.07 of 100 rows are 7, not 8.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE = "decimal(38,12)"


def token_budgets(stages: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, budget): the integral of the weight over all stages' tokens, rounded up.

    ``stages`` has (stage, tokens, transition); ``weights`` (stage, source, weight). A stage's last
    part, its transition, moves in a straight line to the next stage's weight.
    """
    every = stages.crossJoin(weights.select("source").distinct()).join(weights, ["stage", "source"], "left")
    w = F.coalesce(F.col("weight"), F.lit(0)).cast("decimal(12,6)")
    tokens = F.col("tokens").cast("decimal(20,0)")
    following = F.lead("w").over(Window.partitionBy("source").orderBy("stage"))
    every = every.withColumn("w", w).withColumn("next", following)
    moving = F.when(F.col("next").isNull(), F.lit(0)).otherwise(tokens * F.col("transition").cast("decimal(8,6)")).cast("decimal(26,6)")
    part = ((tokens - moving) * F.col("w") + moving * (F.col("w") + F.coalesce("next", F.lit(0).cast("decimal(12,6)"))) * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(38,10)")
    return every.groupBy("source").agg(F.ceil(F.sum(part)).cast("bigint").alias("budget"))


def stage_boundaries(stages: DataFrame, tokens_per_step: int) -> DataFrame:
    """(stage, start_step, end_step, transition_start); none after the last stage."""
    steps = stages.withColumn("steps", F.floor(F.col("tokens") / tokens_per_step))
    order = Window.orderBy("stage")  # a row for each stage
    last = F.lead("stage").over(order).isNull()
    moving = F.when(last, 0).otherwise(F.floor(F.floor(F.col("tokens") * F.col("transition").cast("decimal(8,6)")) / tokens_per_step))
    ends = F.sum("steps").over(order)
    return steps.select(
        "stage", (ends - F.col("steps")).cast("bigint").alias("start_step"), ends.cast("bigint").alias("end_step"), (ends - moving).cast("bigint").alias("transition_start")
    )


def stage_steps(spark, boundaries: DataFrame) -> DataFrame:  # noqa: ANN001
    """(step, stage, entering, progress) of every step."""
    steps = boundaries.select("*", F.explode(F.sequence("start_step", F.col("end_step") - 1)).alias("step"))
    inside = F.col("step") >= F.col("transition_start")
    progress = F.when(inside, (F.col("step") - F.col("transition_start")) / (F.col("end_step") - F.col("transition_start"))).otherwise(0.0)
    return steps.select("step", "stage", F.when(inside, F.col("stage") + 1).alias("entering"), progress.alias("progress"))


def data_weights(steps: DataFrame, weights: DataFrame) -> DataFrame:
    """(step, source, weight) over the sources of the stage and of the one being entered."""
    now = steps.join(weights, "stage").select("step", "source", ((1 - F.col("progress")) * F.col("weight")).alias("w"))
    then = steps.where("entering is not null").join(weights.withColumnRenamed("stage", "entering"), "entering").select("step", "source", (F.col("progress") * F.col("weight")).alias("w"))
    return now.unionByName(then).groupBy("step", "source").agg(F.sum("w").alias("weight"))


def learning_rate(steps: DataFrame, rates: DataFrame, total: int, warmup: int, cooldown: int, least: float) -> DataFrame:
    """(step, lr): warm-up, plateaus by stage, straight moves between them, cool-down."""
    to = rates.select(F.col("stage").alias("entering"), F.col("rate").alias("rate_to"))
    first, last = rates.agg(F.min_by("rate", "stage").alias("first")), rates.agg(F.max_by("rate", "stage").alias("last"))
    rows = steps.join(rates, "stage").join(to, "entering", "left").crossJoin(first).crossJoin(last)
    step = F.col("step")
    plain = F.coalesce(F.col("rate") + (F.col("rate_to") - F.col("rate")) * F.col("progress"), F.col("rate"))
    down = F.greatest(F.col("last") * (total - step) / cooldown, F.lit(least))
    lr = F.when(step < warmup, F.col("first") * step / warmup).when(step > total - cooldown, down).otherwise(F.greatest(plain, F.lit(least)))
    return rows.select("step", lr.alias("lr"))


def rows_plan(budgets: DataFrame, rates: DataFrame, held_out: str, margin: str = "1.2") -> DataFrame:
    """(source, budget, rows_budget, rows_needed, rows_sufficient) from the tokens that a row serves.

    ``rates`` has (source, sum_tokens, n): the rate is their exact quotient.
    """
    rows = budgets.join(rates, "source")
    exact = F.col("budget").cast("decimal(18,0)") * F.col("n").cast("decimal(12,0)")
    tokens = F.col("sum_tokens").cast("decimal(18,0)")
    # ceilings of quotients of whole numbers: held_out and margin are scaled to whole numbers as well
    from fractions import Fraction

    m, rest = Fraction(margin), 1 - Fraction(held_out)
    k = m / rest
    up = lambda a, b: F.ceil((a / b).cast("decimal(38,12)"))
    needed = up(exact * F.lit(k.numerator), tokens * F.lit(k.denominator))
    return rows.select("source", "budget", up(exact, tokens).cast("bigint").alias("rows_budget"), needed.cast("bigint").alias("rows_needed")).withColumn(
        "rows_sufficient", F.ceil(F.col("rows_needed") * F.lit(m.denominator) / F.lit(m.numerator)).cast("bigint")
    )


def top_up(processed: Column, raw: Column, sufficient: Column, needed: Column, margin: Fraction = Fraction(6, 5)) -> Column:
    """Raw rows to add where a build left too few: the shortfall over the yield it showed, with a margin,
    and never more than the whole requirement; 0 without a yield to go by."""
    missing = F.greatest(sufficient - processed, F.lit(0))
    wanted = F.ceil((missing * raw * margin.numerator) / (processed * margin.denominator))
    return F.when((raw <= 0) | (processed <= 0), 0).otherwise(F.least(wanted, needed)).cast("bigint")
