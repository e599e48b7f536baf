import re
import sys

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in rows.select("i", column(F.col("text")).alias("v")).orderBy("i").select("v").collect()]


def test_normal_form_splits_on_every_white_space(spark):
    spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    texts = [f"A{s}b{s}{s}C" for s in spaces] + ["​x﻿ y", "ΟΔΟΣ ẞ İ", "", "  "]
    assert values(spark, texts, T.normalize_text) == [" ".join(t.lower().split()) for t in texts]


def test_hash_vectors(spark):
    texts = ["hello world", "  Hello\t World\n\nfoo ", "héllo wörld", ""]
    assert values(spark, texts, T.text_hash64) == [6824707963431612112, 8471811785197293890, -1365678327145243118, -3162216497309240828]
    assert values(spark, texts[1:2], lambda c: T.text_hash64(c, False)) == [-4212963777905507985]


def quality(text):
    """The rules row by row."""
    if len(text) < 10:
        return "too_short"
    if sum(len(s.strip()) > 10 for s in re.split(r"[.!?]+", text)) < 3:
        return "too_few_sentences"
    w = text.split()
    if not w:
        return "no_words"
    if sum(x.isupper() and len(x) > 1 for x in w) / len(w) > 0.3:
        return "too_many_caps"
    if sum(c.isalnum() or c.isspace() for c in text) / len(text) < 0.25:
        return "too_few_alphanumeric_or_space"
    for n, least, ratio, name in ((2, 10, 0.7, "bigrams"), (3, 20, 0.8, "trigrams")):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        if len(w) > least and len(set(grams)) / len(grams) < ratio:
            return f"too_repetitive_{name}"
    return "passed"


def test_quality_at_its_limits(spark):
    s = "A sentence of words here. Another one follows it. And a third to end."
    texts = ["short", "123456789", "0123456789", s, "no stops " * 9, s.upper(), "WORDS ARE LOUD " + s, "#" * 400 + s, "same words again. " * 12, "", "   .   .   .", s * 2, s * 9]
    texts += [" ".join(["CAPS"] * k + ["lower"] * (10 - k)) + ". This is long enough. This is as well here." for k in range(8)]
    assert values(spark, texts, T.quality_reason) == [quality(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ngrams(spark, n):
    texts = ["", "a", "a b", "a b c d e f", "a a a a a a a"]
    want = [[" ".join(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)] for t in texts]
    assert values(spark, texts, lambda c: T.ngrams(T.words(c), n)) == want


def test_slugs_and_globs(spark):
    assert values(spark, ["C#", "C++", "Jupyter Notebook", "--Go--"], T.language_slug) == ["csharp", "cpp", "jupyter_notebook", "go"]
    assert values(spark, ["a/*.x", "plain", "[ab]c"], T.glob_prefix) == ["a/", "plain", ""]


def test_estimates_and_inversion(spark):
    assert values(spark, ["", "abc", "abcd", "😀" * 9], T.estimate_tokens) == [0, 0, 1, 2]
    row = spark.createDataFrame([("do", "it", "done"), ("", "x", "y"), ("a", None, "b")], "i string, g string, o string")
    got = [tuple(r.r) for r in row.select(T.input_inversion(F.col("i"), F.col("g"), F.col("o")).alias("r")).collect()]
    asked = "Given this output, what was the likely instruction or input?\n\nOutput: "
    assert got == [(asked + "done", "", "do\nInput: it"), ("", "x", "y"), (asked + "b", "", "a")]
    texts = [r[0] for r in row.select(T.instruct_text(F.col("i"), F.col("g"), F.col("o"))).collect()]
    assert texts == ["do\n\nit\n\ndone", "\n\nx\n\ny", "a\n\nb"]
