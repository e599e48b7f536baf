"""Metrics over groups of vectors, as grouped sums over components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import bound


def pair_cosine_mean(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean cosine of all pairs of a group without forming them: (|sum u|^2 - n) / (n (n - 1)) over
    unit vectors; null with fewer than two. Also the root mean square of the components."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.select(group, F.transform(vec, lambda x: x.cast("double")).alias("v"), norm.alias("norm")).where("norm > 0")
    parts = rows.select(group, "norm", F.posexplode("v").alias("at", "x"))
    sums = parts.groupBy(group, "at").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    out = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.max("n").alias("n"), F.count(F.lit(1)).alias("d"))
    return out.select(
        group, "n", F.when(F.col("n") > 1, (F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"), F.sqrt(F.col("q") / (F.col("n") * F.col("d"))).alias("rms")
    )


def centred(vec: Column) -> Column:
    """A vector less the mean of its components."""
    mean = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(vec)
    return bound(mean, lambda m: F.transform(vec, lambda x: x.cast("double") - m))


def length(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def spread_of_groups(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """(group, n, dispersion, zero_vectors, zero_variance): the part of the energy that lies off the mean
    vector, and the shares of vectors without length and of those whose components are all equal."""
    v = F.col(vec)
    rows = vectors.where(v.isNotNull()).select(group, v.alias("v"), (length(v) == 0).cast("int").alias("flat"), (length(centred(v)) < 1e-12).cast("int").alias("even"))
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("flat").alias("zero_vectors"), F.avg("even").alias("zero_variance"))
    parts = rows.select(group, F.posexplode("v").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    sums = parts.groupBy(group, "at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    whole = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"))
    off = F.when(F.col("q") > 0, 1 - F.col("ss") / F.col("n") / F.col("q"))
    return size.join(whole, group).select(group, "n", off.alias("dispersion"), "zero_vectors", "zero_variance")


def sensitivity(state: Column, other: Column, output: Column, changed: Column) -> Column:
    """(perturbation, response, sensitivity): the relative changes of a state and of what follows from it,
    and their ratio; null where a norm or the change of the state is zero."""
    less = lambda a, b: F.zip_with(a, b, lambda x, y: y.cast("double") - x.cast("double"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    moved, answer = ratio(length(less(state, other)), length(state)), ratio(length(less(output, changed)), length(output))
    return F.struct(moved.alias("perturbation"), answer.alias("response"), ratio(answer, moved).alias("sensitivity"))
