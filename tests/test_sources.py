import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import readers, storage
from millrace.streaming.incremental import stream_dedup


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("*.json", "a.json", True), ("*.json", "d/a.json", False), ("**/*.json", "d/e/a.json", True), ("**/*.json", "a.json", True), ("a?c", "a/c", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False)],
)
def test_globs(pattern, path, hit):
    import re

    assert bool(re.fullmatch(readers.glob_regex(pattern), path)) is hit


def test_formats_and_slices(spark, tmp_path):
    rows = [{"text": f"t{i}", "n": i} for i in range(4)]
    lines = "\n".join(map(json.dumps, rows)) + "\n\n"
    (tmp_path / "a.jsonl").write_text(lines)
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(lines)
    (tmp_path / "c.json").write_text(json.dumps(rows))
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write(json.dumps(rows))
    import zstandard

    (tmp_path / "e.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(lines.encode()))
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "tmp"))
    next((tmp_path / "tmp").glob("*.parquet")).rename(tmp_path / "f.parquet")
    df = readers.read_files(spark, str(tmp_path), "*", ["text", "n"])
    got = sorted((r.file_rank, r.n, r.text) for r in df.collect())
    assert got == [(k, i, f"t{i}") for k in range(6) for i in range(4)]
    cut = readers.row_slice(df, ["file_rank", "n"], 3, 6)
    assert sorted((r.position, r.file_rank, r.n) for r in cut.collect()) == [(p, p // 4, p % 4) for p in range(3, 9)]
    with pytest.raises(ValueError):
        readers.row_slice(df, ["n"], -1)
    with pytest.raises(ValueError):
        readers.file_kind("x.csv")


def test_folders_commit_by_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    assert storage.folder_state(spark, path, "v1") == "missing"
    df = spark.range(25).select(F.col("id"), (F.col("id") * 2).alias("tokens")).coalesce(1)
    made = storage.write_folder(df, path, 10, "v1", "tokens")
    assert made["rows"] == 25 and [s["rows"] for s in made["shards"]] == [10, 10, 5] and sum(s["tokens"] for s in made["shards"]) == 600
    assert storage.folder_state(spark, path, "v1") == "current" and storage.folder_state(spark, path, "v2") == "stale"
    assert storage.covered_prefix(["a", "b"], ["a"]) and not storage.covered_prefix(["a", "b"], ["b"])


def test_a_cut_swap_is_ended(spark, tmp_path):
    path = str(tmp_path / "out")
    storage.write_folder(spark.range(3), path, identity="a")
    (tmp_path / "out").rename(tmp_path / "out.old")  # as if it broke between the two renames
    storage.recover(spark, path)
    assert storage.read_folder(spark, path).count() == 3 and not (tmp_path / "out.old").exists()
    storage.write_folder(spark.range(5), path, identity="b")
    assert storage.read_folder(spark, path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_synthetic_rows_depend_on_seed_and_row(spark):
    a = {r.id: r.text for r in readers.synthetic_rows(spark, 20, 7).collect()}
    b = {r.id: r.text for r in readers.synthetic_rows(spark, 40, 7).collect()}
    assert all(b[i] == t and 64 <= len(t.split()) <= 384 for i, t in a.items())


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    docs = [(i, "s", f"text {i % 7}") for i in range(30)]
    for k in range(3):
        spark.createDataFrame(docs[k * 10 : k * 10 + 10], "doc_id long, source string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 1)
    first = stream_dedup(*args)
    assert first.count() == 7
    spark.createDataFrame([(99, "s", "TEXT 3 "), (100, "s", "new")], "doc_id long, source string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    again = stream_dedup(*args)
    assert again.count() == 8 and {r.doc_id for r in again.collect()} - {r.doc_id for r in first.collect()} == {100}


def test_a_stream_keeps_the_least_row_in_whatever_order_files_come(spark, tmp_path):
    schema = "doc_id long, source string, text string"
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 1)

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(args[1])

    def kept():
        return sorted(((r.doc_id, r.source) for r in stream_dedup(*args).collect()), key=str)

    docs = [(i, f"s{i}", f"text {i % 7}") for i in range(10, 40)]
    for k in (2, 0, 1):  # files whose numbers neither rise nor fall
        add(docs[k * 10 : k * 10 + 10])
    assert kept() == [(i, f"s{i}") for i in range(10, 17)]
    add([(5, "late", "TEXT  3"), (50, "s50", "text 4"), (60, "s60", None), (None, "n", "text 5"), (None, "n", "alone")])
    add([(55, "s55", None), (7, "b", "Text 6"), (7, "a", "text 6"), (70, "s70", "alone")])
    want = [(11, "s11"), (12, "s12"), (14, "s14"), (15, "s15"), (16, "s16"), (5, "late"), (55, "s55"), (7, "a"), (70, "s70")]
    assert kept() == want  # 5 took the place of 10, 7 that of 13
    assert kept() == want  # nothing new: nothing changes
