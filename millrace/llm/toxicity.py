"""Toxicity: a linear classifier whose scores don't change when identity terms are swapped.

Features are the words of a text and the beginnings of words (stems), each present or not. From a
bounded sample of labelled rows, the features that tell the classes apart best are chosen, those of
identity terms are added, and all are weighted by logistic regression with a ridge and a counterfactual
term: wherever a sentence of the sample names a group, the sentence is also taken with each other term
of the same kind in its place and with none, and the squared change of its score, averaged over these
alternatives, is added to the loss. A group that is only mentioned then carries no weight of its own.

Defined results: null and empty texts have no features and get the base rate; labels that are null
are left out, and of repeated labels the larger counts; of repeated ids the least text is learned from;
without labels of both classes every text gets a base rate below one half; very long texts are read
whole; repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import cut_lineage, dispose

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
STEMS = (3, 4, 5, 6)

#: Fixed identity terms; those of a line stand for each other.
IDENTITIES = """
women men girls boys
woman man girl boy
muslims christians jews hindus buddhists atheists
muslim christian jewish hindu buddhist atheist
gay lesbian straight bisexual transgender
black white asian latino indigenous
blacks whites asians latinos
immigrants refugees foreigners locals
disabled deaf blind autistic
old young elderly
frauen männer mädchen jungen
muslime christen juden hindus
schwarze weiße asiaten
ausländer flüchtlinge einwanderer
femmes hommes filles garçons
musulmans chrétiens juifs bouddhistes
noirs blancs asiatiques
immigrés réfugiés étrangers
mujeres hombres chicas chicos
musulmanes cristianos judíos budistas
negros blancos asiáticos
inmigrantes refugiados extranjeros
"""


def alternatives() -> dict[str, list[str]]:
    """For each identity term the others of its line, and the empty one."""
    out: dict[str, list[str]] = {}
    for line in IDENTITIES.split("\n"):
        terms = line.split()
        for a in terms:
            out.setdefault(a, [*(b for b in terms if b != a), ""])
    return out


ALTERNATIVES = alternatives()


@dataclass(frozen=True)
class Plan:
    """``sample``: most labelled rows that are read for fitting, the first by hash of the id;
    ``least_docs``: how many of them a feature must occur in."""

    sample: int = 8000
    features: int = 1024
    least_docs: int = 4
    ridge: float = 0.1
    counterfactual: float = 10.0
    rounds: int = 12


@dataclass(frozen=True)
class Model:
    """Weights by feature number and the score without any."""

    weights: dict[int, float]
    bias: float

    def score(self, features: set[int]) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, features))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def word_features(word: str) -> list[int]:
    """The word and its beginnings; identity terms have no beginnings, which other words would weigh."""
    if word in ALTERNATIVES:
        return [zlib.crc32(word.encode())]
    return [zlib.crc32(word.encode()), *(zlib.crc32(b"^" + word[:n].encode()) for n in STEMS if len(word) > n)]


def text_features(text: str) -> set[int]:
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


def is_held_out(id_col: str) -> Column:
    """Every fifth row by crc32 of the id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def swapped(text: str) -> Iterator[tuple[set[int], set[int], float]]:
    """(features that come, features that go, weight) for each sentence, identity term and alternative."""
    for sentence in SENTENCE.findall(text):
        words = WORD.findall(sentence)
        for term in sorted(set(words) & ALTERNATIVES.keys()):
            before, rest = {f for w in set(words) for f in word_features(w)}, {f for w in set(words) - {term} for f in word_features(w)}
            for new in ALTERNATIVES[term]:
                after = rest | set(word_features(new)) if new else rest
                yield after - before, before - after, 1 / len(ALTERNATIVES[term])


def training_rows(docs: DataFrame, labels: DataFrame, plan: Plan, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(y, features, pairs) of the sample; at most ``plan.sample`` labels are sent to the documents, so
    the texts are read in place and only the sample's are shuffled."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).where("l_id is not null and y is not null")
    known = known.where(~is_held_out("l_id")).groupBy("l_id").agg((F.max("y") > 0).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("l_id"), "l_id").limit(plan.sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("l_id"))
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    @F.pandas_udf("features array<bigint>, pairs array<struct<more:array<bigint>,less:array<bigint>,weight:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts.str.lower():
                pairs = [{"more": sorted(more), "less": sorted(less), "weight": weight} for more, less, weight in swapped(text)]
                out.append((sorted(text_features(text)), pairs))
            yield pd.DataFrame(out, columns=["features", "pairs"])

    return rows.select("id", "y", run("text").alias("r")).select("id", "y", "r.*")


def choose(sample: DataFrame, plan: Plan, n: int, n_pos: int) -> np.ndarray:
    """The features whose presence tells most about the class (log-likelihood ratio), and all of
    identity terms that occur. At most ``plan.features`` and the terms' leave the executors."""
    count = sample.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("pos"))

    def part(k: Column, total: Column, rate: Column) -> Column:
        rate = F.least(F.greatest(rate, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(rate) + (total - k) * F.log(1 - rate)

    neg, both, n_neg = F.col("k") - F.col("pos"), F.col("k") / n, n - n_pos
    worth = part(F.col("pos"), F.lit(n_pos), F.col("pos") / n_pos) + part(neg, F.lit(n_neg), neg / n_neg) - part(F.col("pos"), F.lit(n_pos), both) - part(neg, F.lit(n_neg), both)
    count = count.where(F.col("k") >= plan.least_docs)
    best = count.orderBy(F.round(worth, 6).desc(), "f").limit(plan.features).select("f")
    terms = count.where(F.col("f").isin(sorted({f for term in ALTERNATIVES for f in word_features(term)}))).select("f")
    return np.array(sorted(r.f for r in best.union(terms).distinct().collect()), np.int64)


def fit(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:  # noqa: B008
    sample = cut_lineage(training_rows(docs, labels, plan, id_col, text_col, label_col))
    n, n_pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < n_pos < n:
        dispose(sample)
        return Model({}, float(np.log(0.05 / 0.95)))
    chosen = choose(sample, plan, n, n_pos)
    held = F.array(*(F.lit(int(f)) for f in chosen))
    places = lambda c: F.array_intersect(c, held)
    rows = sample.select("y", "id", places(F.col("features")).alias("f")).orderBy("y", F.xxhash64("id"), "id").toPandas()
    pairs = sample.select(F.explode("pairs").alias("p")).select(places(F.col("p.more")).alias("more"), places(F.col("p.less")).alias("less"), F.col("p.weight").alias("weight"))
    pairs = pairs.where(F.size("more") + F.size("less") > 0).groupBy("more", "less").agg(F.round(F.sum("weight"), 6).alias("weight")).orderBy("more", "less").toPandas()
    dispose(sample)
    k = len(chosen)
    x = np.zeros((n, k + 1), np.float32)
    x[:, k] = 1  # the bias
    for i, f in enumerate(rows["f"]):
        x[i, np.searchsorted(chosen, f)] = 1
    swap = np.zeros((len(pairs), k + 1))
    for i, (more, less) in enumerate(zip(pairs["more"], pairs["less"], strict=True)):
        swap[i, np.searchsorted(chosen, more)] += 1
        swap[i, np.searchsorted(chosen, less)] -= 1
    fixed = np.diag(np.r_[np.full(k, plan.ridge), 1e-6]) + plan.counterfactual * (swap.T * pairs["weight"].to_numpy(float)) @ swap
    w = newton(x, rows["y"].to_numpy(float), fixed, plan.rounds)
    return Model({int(i): float(v) for i, v in zip(chosen, w, strict=False)}, float(w[k]))


def newton(x: np.ndarray, y: np.ndarray, fixed: np.ndarray, rounds: int, rows: int = 1024) -> np.ndarray:
    """Weights with the least log loss plus w'fixed w / 2; the last column is the bias."""
    w = np.zeros(x.shape[1])
    w[-1] = np.log(y.sum() / (len(y) - y.sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + fixed @ w
        curve = fixed.copy()
        for i in range(0, len(x), rows):  # the matrix in parts, to hold it once only
            part = x[i : i + rows].astype(float)
            curve += (part * (p * (1 - p))[i : i + rows, None]).T @ part
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


class Known(dict):
    """The features of a word that the model weighs, remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = tuple(f for f in word_features(word) if f in self.model.weights)
        return out


def with_scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), from the text alone."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Known(model)
        for texts in batches:
            out = []
            for text in texts:
                features: set[int] = set()
                features.update(*map(known.__getitem__, set(WORD.findall(text.lower()))))
                out.append(model.score(features))
            yield pd.Series(out, dtype="float64")

    names = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.select(*names, run(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
