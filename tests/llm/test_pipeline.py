"""The pipeline's stages: what goes, what stays, and in which columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import packing, pii, toxicity
from millrace.llm.queries import PII_KEY
from tests.llm.test_operators import brute_best_fit, groups_of_rows, score_of, shingle_set
from tests.oracle import SF


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


def test_stages_on_the_small_table(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("kept") for c in ("score", "grp", "n_entities", "id", "mark", "row")})
    columns, before = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns and after.count() <= before.count(), name
        assert after.where("score <> 'kept' or n_entities <> 'kept' or id <> 'kept' or mark <> 'kept' or row <> 'kept'").count() == 0
        if name == "near_dedup":
            texts = [r.text for r in after.collect()]
            assert len(texts) == len(set(texts))
        if name == "pii":
            assert after.count() == before.count()
            assert after.where(F.col("n_chars") != F.char_length("text")).count() == 0
            mails = lambda df: {m for r in df.collect() for m in re.findall(r"[\w.]+@[\w.]+", r.text)}
            assert not mails(after) & mails(before)
        before = after
    packed = pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_insults_go_and_the_rest_stays(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    left = {r.doc_id for r in pipeline.toxicity_stage(spark, docs, SF).collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean & left) >= 0.98 * len(clean) and len(toxic & left) <= 0.5 * len(toxic)


def test_odd_and_empty_tables(spark, pipeline):
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "some words of a text", None, None, None), (3, "x " * 20_000, "en", "s", 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table, n in ((docs, 5), (docs.limit(0), 0)):
        for _, stage in pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
        assert table.count() == n
        packed = pipeline.STAGES[-1][1](spark, table, SF)
        assert packed.select("doc_id").distinct().count() == n - n // 5 and packed.where("piece = 0").count() == n


def test_near_dedup_tells_texts_apart_not_ids(spark, pipeline):
    """Against brute force: of each group one row stays; unique texts stay whatever their id."""
    words = lambda seed: " ".join(f"w{seed * 1000 + i}" for i in range(60))
    a, b, c, d = map(words, range(4))
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b + " end", "x"), (6, c, "x"), (6, c, "y"), (6, c, "y"), (7, c + " end", "x"), (None, d, "x"), (None, d, "x"), (None, d, "y"), (8, d, "x"), (None, None, "x"), (None, "", "x"), (9, "", "x"), (9, "", "x"), (9, " ", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit(1)).withColumn("mark", F.lit("m")).withColumn("id", F.lit(0))
    left = sorted(((r.doc_id, r.text, r.source) for r in pipeline.near_dedup_stage(spark, docs, SF).collect()), key=str)
    fixed = [(1, a, "x"), (None, d, "x"), (None, d, "x"), (None, d, "y"), (8, d, "x"), (None, None, "x"), (None, "", "x"), (9, "", "x"), (9, "", "x"), (9, " ", "z")]
    for b_left in (b, b + " end"):
        for c_source in "xy":
            if left == sorted([*fixed, (5, b_left, "x"), (6, c, c_source)], key=str):
                return
    raise AssertionError(left)


def test_run_equals_a_plain_version(spark, pipeline):
    """All four stages over the small table: scores from the weights, all pairs, one text after another, every bin."""
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [d for d in docs if score_of(model, d.text or "") < 0.5]
    name = {(d, n): c for d, n, c in groups_of_rows([(d.doc_id, d.text) for d in kept], 5, 80)}
    kept = [d for d in kept if not shingle_set(d.text, 5) or name[d.doc_id, len(shingle_set(d.text, 5))] == d.doc_id]
    to, pieces = pii.Surrogates(PII_KEY), []
    for d in kept:
        text = pii.replace(d.text, to)[0] if d.text is not None else None
        same = " ".join(re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        n, size = -(-len(text or "") // 4), packing.CAPACITY
        pieces += [(d.doc_id, i, i * size, min(size, n - i * size), d.source, hashlib.md5(same.encode()).hexdigest()) for i in range(n // size + (n % size > 0 or n == 0))]
    rest = sorted((p for p in pieces if p[3] < packing.CAPACITY), key=lambda p: (-p[3], p[0]))
    placed = brute_best_fit([p[3:] for p in rest], packing.CAPACITY)
    want = [(*p, f"pack-0-{b}", at) for p, (b, at) in zip(rest, placed, strict=True)] + [(*p, "full", 0) for p in pieces if p[3] == packing.CAPACITY]
    got = [(r.doc_id, r.piece, r.start, r.length, r.source, r.cluster, r.bin if r.bin.startswith("pack") else "full", r.bin_offset) for r in pipeline.run(spark, SF).collect()]
    assert len(kept) < len(docs) and sorted(got) == sorted(want)
