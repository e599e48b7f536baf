"""Builds from a specification to folders, registries, jobs, stream states."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.functions import encode as E
from millrace.operators import jobs, pool
from millrace.plans import build, converters, spec
from millrace.sources import readers, storage


def test_registries_know_their_names():
    assert sorted(converters.CONVERTERS) == [
        "first_two_turns", "gsm8k_question_answer", "instruction_input_output", "nemotron_messages", "opencode_messages", "sharegpt_conversations", "webinstruct_messages",
    ]
    assert sorted(converters.FILTERS) == ["opencode_passed_tests", "sharegpt_quality"]
    assert sorted(E.FORMATS) == ["concatenate_instruction_input_output", "format_conversation", "pass_text"]
    assert converters.resolved(None, None) is None
    for bad in (lambda: converters.resolved("no", None), lambda: converters.filter_named("no"), lambda: converters.by_fields({"instruction": "a"}), lambda: converters.by_fields({"instruction": "a", "output": "b", "x": "c"})):
        with pytest.raises(ValueError):
            bad()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="question"):
        converters.converted(spark.range(1), converters.CONVERTERS["gsm8k_question_answer"], ["id"])


def test_samples_mask_prompts(spark):
    ids_of = E.code_points
    row = spark.createDataFrame([(" ask ", "", "told"), ("ask", "more", "told")], "i string, g string, o string")
    got = row.select(E.instruct_sample(F.col("i"), F.col("g"), F.col("o"), ids_of, 1, 2).alias("s")).select("s.*").collect()
    for r, prompt, whole in zip(got, ("ask", "ask\n\nmore"), ("ask\n\ntold", "ask\n\nmore\n\ntold"), strict=True):
        ids = [1, *map(ord, whole), 2]
        assert r.ids == ids and r.labels == [-100] * (len(prompt) + 1) + ids[len(prompt) + 1 :]
    talk = [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")]
    df = spark.createDataFrame([([{"role": r, "content": c} for r, c in talk],)], "m array<struct<role:string,content:string>>")
    s = df.select(E.chat_sample(F.col("m"), ids_of, 1, 2).alias("s")).select("s.*").first()
    assert "".join(chr(x) for x, y in zip(s.ids, s.labels, strict=True) if y >= 0) == "a\x02b\x02"
    assert "".join(map(chr, s.ids)) == "\x01User:\nq\n\nAssistant:\na\x02\n\nUser:\nr\n\nAssistant:\nb\x02"
    p = df.select(E.literal_chat(F.slice("m", 1, 3), ids_of, 1, 2, 3, 4, prompt=True).alias("p")).select("p.*").first()
    assert p.ids == [1, 3, ord("q"), 2, 4, ord("a"), 2, 3, ord("r"), 2, 4] and p.supervised == [False] * 5 + [True, True] + [False] * 4
    for kind, args in (("x", {}), ("chat", {}), ("continuation", {"text": F.col("i"), "messages": F.col("m")})):
        with pytest.raises(ValueError):
            E.generation_prompt(kind, ids_of, **args)


def test_jobs_close_before_they_overflow():
    assert jobs.jobs_of([3, 4, 2, 8, 1, 9, 1]) == [0, 0, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        jobs.jobs_of([129])


def test_a_stream_goes_on_from_its_state():
    rng = random.Random(4)
    rows = {s: [(i, rng.randrange(1, 50)) for i in range(n)] for s, n in (("a", 40), ("b", 25), ("c", 3))}
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    whole = list(pool.by_deficit(weights, rows))
    for cut in (0, 1, 30, len(whole)):
        state = pool.StreamState()
        stream = pool.by_deficit(weights, rows, state)
        first = [next(stream) for _ in range(cut)]
        assert first + list(pool.by_deficit(weights, rows, pool.StreamState.read(state.saved()))) == whole


def test_states_and_repairs():
    state = lambda m, ok=True: build.state_of(m, ok, "id", 100, "estimate")[0]
    assert state(None) == "missing" and state(None, False) == "unreadable" and state({"identity": "x", "max_length": 5}) == "stale"
    assert state({"identity": "id", "max_length": 50, "tokenizer": "t"}) == "outdated" and state({"identity": "id", "max_length": 100, "tokenizer": "t"}) == "tokenizer_changed"
    assert state({"identity": "id", "max_length": 200, "tokenizer": "estimate"}) == "current"
    listed = [("a", 10), ("b", 10), ("c", 5)]
    assert build.good_prefix(listed, {"a": 10, "b": 9, "c": 5}) == 1 and build.good_prefix(listed, dict(listed)) == 3
    actions = lambda *a: [x for x, _ in build.repair_plan(*a)]
    assert actions("current", listed, dict(listed)) == ["leave"] and actions("current", listed, {"a": 10, "z": 1}) == ["truncate", "delete"]
    assert actions("current", listed, {}) == ["delete"] and actions("stale", listed, dict(listed)) == ["delete"] and actions("unreadable", [], {"a": 1}) == ["leave"]
    assert actions("tokenizer_changed", listed, dict(listed)) == ["adopt"] and actions("missing", [], {"a": 1}) == ["delete"]


@pytest.fixture
def sources(tmp_path):
    docs = tmp_path / "docs"
    chat = tmp_path / "chat"
    docs.mkdir()
    chat.mkdir()
    text = lambda i: f"document {i % 7} " * 10
    (docs / "a.jsonl").write_text("\n".join(json.dumps({"body": text(i)}) for i in range(10)))
    (docs / "b.jsonl").write_text("\n".join(json.dumps({"body": text(i) if i else None}) for i in range(10)))
    turn = lambda i: [{"from": "human", "value": f"question {i} " * 10}, {"from": "gpt", "value": (f"answer {i} " * 10) if i % 3 else "short"}]
    (chat / "c.jsonl").write_text("\n".join(json.dumps({"conversations": turn(i) if i % 5 else turn(i)[1:]}) for i in range(20)))
    payload = {
        "sources": {
            "docs": {"path": str(docs), "text_field": "body", "check_limit": 15},
            "chat": {"path": str(chat), "kind": "instruct", "converter": "sharegpt_conversations", "filters": ["sharegpt_quality"]},
        },
        "stages": [{"name": "one", "tokens": 1000, "train": {"docs": "0.5", "chat": "0.5"}, "val": {"docs": "1"}}],
    }
    path = tmp_path / "spec.json"
    path.write_text(json.dumps(payload))
    return path, payload, str(tmp_path / "out")


def test_a_specification_is_built_once(spark, sources, capsys):
    path, payload, root = sources
    data = build.dataset(payload)
    assert main(["status", str(path), root], spark) == 1 and "missing" in capsys.readouterr().out
    assert main(["snapshot", str(path), root], spark) == 1
    assert main(["prepare", str(path), root], spark) == 0 and capsys.readouterr().out.split() == ["docs", "built", "chat", "built"]
    docs = storage.read_folder(spark, f"{root}/docs").orderBy("row_idx").collect()
    assert [r.row_idx for r in docs] == list(range(7))  # 15 looked at, the first of each text
    chat = storage.read_folder(spark, f"{root}/chat").collect()
    assert {r.row_idx for r in chat} == {i for i in range(20) if i % 5 and i % 3} and all(r.text == f"{r.instruction.strip()}\n\n{r.output.strip()}" for r in chat)
    counts = json.loads(storage.read_text(spark, f"{root}/chat/MANIFEST.json"))["counts"]
    assert counts == {"ok": len(chat), "filtered": sum(1 for i in range(20) if i % 5 and not i % 3), "malformed": 4}
    places = {r.row_idx: r.place for r in chat}
    assert sorted(places, key=places.get) != sorted(places)  # instructions are shuffled
    assert main(["status", str(path), root], spark) == 0 and capsys.readouterr().out.count("current") == 2
    assert main(["prepare", str(path), root], spark) == 0 and capsys.readouterr().out.split() == ["docs", "current", "chat", "current"]
    name = build.snapshot(spark, data, root)
    assert name == build.snapshot(spark, data, root)
    payload["sources"]["docs"]["check_limit"] = 3
    path.write_text(json.dumps(payload))
    assert main(["prepare", str(path), root], spark) == 0 and capsys.readouterr().out.split() == ["docs", "built", "chat", "built"]
    assert build.snapshot(spark, build.dataset(payload), root) != name
    assert main(["inspect", str(path), root, "docs"], spark) == 0 and "## prepared" in storage.read_text(spark, f"{root}/inspection.md")
    assert main(["describe", str(path)], spark) == 0 and "| docs | pretrain |" in capsys.readouterr().out


def test_wrong_specifications_end_with_two(sources, capsys):
    path, payload, root = sources
    for change in ({"stages": []}, {"nonsense": 1}, {"sources": {"docs": {"path": "x", "what": 1}}}):
        path.write_text(json.dumps(payload | change))
        assert main(["status", str(path), root]) == 2
    assert main(["status", str(path) + "x", root]) == 2
    assert spec.Source("x", converter="a", fields={}).problems() == ["a converter and a field map exclude each other"]


def test_files_are_left_out_by_their_index(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([("en" if i % 2 else "de", 10 * i + k) for k in range(5)], "lang string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    index = readers.file_index(spark.read.parquet(str(tmp_path / "t")), "lang", "n")
    assert len(readers.files_with(index, "en")) == 2 and len(readers.files_with(index, "en", low=20)) == 1 and readers.files_with(index, "de", low=30) == []
    found = readers.files_with(index, "de", high=4)
    assert sorted(r.n for r in spark.read.parquet(*found).collect()) == [0, 1, 2, 3, 4]
