import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import chat as C
from millrace.operators import contamination, dedup, fuzzy, order, pool, tokens, vectors
from millrace.plans import q_dedup, q_mixture, q_samples
from tests.oracle import SF


def test_first_rows_don_t_depend_on_partitions(spark):
    rows = [(i, random.Random(i).randrange(40)) for i in range(300)]
    want = sorted({k: i for i, k in reversed(rows)}.values())
    df = spark.createDataFrame(rows, "i int, k int")
    for n in (1, 3, 8):
        assert sorted(r.i for r in dedup.first_rows(df.repartition(n), "k", ["i"]).collect()) == want


def test_admission_follows_ranks_and_seeds(spark):
    rows = spark.createDataFrame([(-1, 0, "a"), (0, 1, "a"), (0, 2, "b"), (1, 3, "b"), (1, 4, "c")], "rank int, i int, k string")
    got = dedup.global_admission(rows, "k", "rank", ["i"])
    assert {r.i: r.retained for r in got.collect()} == {1: False, 2: True, 3: False, 4: True}


def test_contamination_is_strict(spark):
    def words(n, at=0):
        return " ".join(f"w{i}" for i in range(at, at + n))

    bench = contamination.benchmark_ngrams(spark.createDataFrame([("t", words(13))], "task string, text string"), F.col("task"), F.col("text"))
    docs = spark.createDataFrame([(1, words(22)), (2, words(21)), (3, words(5))], "i int, text string")  # one of 10, one of 9
    assert [r.i for r in contamination.contaminated(contamination.document_hits(docs, bench, ["i"])).collect()] == [2]


def test_band_shapes():
    assert [fuzzy.band_shape(t, n) for t, n in ((0.95, 256), (0.8, 128), (0.95, 128))] == [(5, 51), (9, 13), (3, 42)]


def test_greedy_survivors_follow_the_order(spark):
    rng = random.Random(3)
    member = [(row, rng.randrange(60)) for row in range(120) for _ in range(3)] + [(row, 1000) for row in range(0, 120, 2)]
    buckets = {}
    for row, b in member:
        buckets.setdefault(row, set()).add(b)
    kept, gone = set(), []
    for row in range(120):
        if buckets[row] & kept:
            gone.append(row)
        else:
            kept |= buckets[row]
    got = fuzzy.greedy_survivors(spark.createDataFrame(member, "row int, bucket int").distinct())
    assert sorted(r.row for r in got.collect()) == gone


def test_near_dups_finds_planted_copies(spark):
    rng = random.Random(0)
    docs = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", str(rng.randrange(999))]) for _ in range(90)) for _ in range(40)]
    near = [d.rsplit(" ", 1)[0] + " changed" for d in docs[:10]]
    df = spark.createDataFrame(list(enumerate(docs + near + ["few words", "", None])), "i int, text string")
    assert sorted(r.row for r in fuzzy.near_dups(df, "i", "text").collect()) == list(range(40, 50))


def test_pool_takes_the_first_that_fit():
    sizes = dict(A=80, B=20, C=160, D=4, E=40, F=120, G=12, H=100, I=2, J=68, K=120)
    packs = list(pool.first_fit_packs(iter(sizes.items()), 320))
    assert [r for r, _, _ in packs[0]] == list("ABCDEGI")
    assert [r for p in packs[1:] for r, _, _ in p] == list("FHJK")
    assert next(pool.first_fit_packs(iter([("x", 400), ("y", 3)]), 320)) == [("y", 3, 0)]


def test_deficit_keeps_shares_and_breaks_ties_by_name():
    rows = {"b": [(i, 10) for i in range(50)], "a": [(i, 10) for i in range(50)]}
    drawn = [s for s, _, _ in pool.by_deficit({"b": 0.5, "a": 0.5}, rows)]
    assert drawn[:4] == ["a", "b", "a", "b"]
    assert [s for s, _, _ in pool.by_deficit({"b": 1.0, "a": 0.0}, rows)] == ["b"] * 50


def test_every_document_is_drawn_and_packed_once(spark):
    docs = [(r.source, r.doc_id, min(len(r.text) // 4, 1024)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) // 4 > 0]
    left = {s: sorted((i, n) for t, i, n in docs if t == s) for s in {d[0] for d in docs}}
    weight, want = {s: q_mixture.MIX.get(s, 0.2) for s in left}, []
    owed, got = dict.fromkeys(left, 0.0), dict.fromkeys(left, 0.0)
    while live := sorted(s for s in left if left[s]):  # a plain replay: what each source is owed, less what it got
        most, whole = max(owed[s] - got[s] for s in live), sum(weight[s] for s in live)
        source = next(s for s in live if owed[s] - got[s] == most)
        row, slots = left[source].pop(0)
        want.append((source, row))
        got[source] += slots
        for s in live:
            owed[s] += weight[s] / whole * slots
    drawn = [(r.source, r.doc_id) for r in q_mixture.deficit_schedule(spark, SF).orderBy("position").collect()]
    assert drawn == want and sorted(drawn) == sorted((s, i) for s, i, _ in docs)
    assert sorted(r.doc_id for r in q_mixture.pack_first_fit(spark, SF).collect()) == sorted(i for _, i, _ in docs)


def test_layout_restarts_positions(spark):
    placed = spark.createDataFrame([(0, 0, 0, 3), (0, 0, 1, 2)], "run int, pack long, place long, slots long")
    row = pool.pack_layout(placed, 7).first()
    assert row.position_ids == [0, 1, 2, 0, 1, 0, 1] and row.document_ids == [0, 0, 0, 1, 1, 2, 2] and row.padding == 2


def test_dense_index_and_runs(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 101 in (3, 4, 5, 50)) for i in range(101)], "k int, bad boolean").select("k", (F.col("k").isin(3, 4, 5, 50)).alias("bad"))
    placed = order.dense_index(df.repartition(5), [F.col("k")], 7)
    assert sorted((r.k, r.position) for r in placed.collect()) == [(i, i) for i in range(101)]
    assert tuple(order.longest_run(df, "k", "bad").first()) == (3, 4)
    assert tuple(order.longest_run(df.limit(0), "k", "bad").first()) == (0, 0)


def test_vectors_and_cuts(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "g int, v array<double>")
    got = {r.g: r.mean_cosine for r in vectors.pair_cosine_mean(v, "g", "v").collect()}
    assert got[1] == pytest.approx(0.0, abs=1e-12) and got[2] is None
    tool = tokens.loaded(tokens.word_level_json(["a", "b"]))
    assert tokens.cut(tool, "a b, a", 2) == ("a b", 2) and tokens.cut(tool, "a", 0) == ("", 0) and tokens.cut(tool, "", 5) == ("", 0)


def conversation(spark, *turns):
    return spark.createDataFrame([([{"role": r, "content": c} for r, c in turns],)], f"m {C.MESSAGES}")


@pytest.mark.parametrize(
    ("turns", "valid", "status"),
    [
        ((("user", "q"), ("assistant", "a")), True, "ok"), ((("user", "q"), ("assistant", "a"), ("user", "x")), True, "ok"), ((("assistant", "a"), ("user", "q")), False, "orphan"),
        ((("system", "s"), ("user", "q"), ("assistant", "a")), False, "ok"), ((("user", " "), ("assistant", "a")), False, "ok"), ((("user", "q"),), True, "malformed"), ((), False, "malformed"),
    ],
)
def test_conversations(spark, turns, valid, status):
    row = conversation(spark, *turns).select(C.valid_messages(F.col("m")).alias("v"), C.opening_exchange(F.col("m"))["status"].alias("s"), C.reasoning_policy(F.col("m"), F.lit("on")).alias("p")).first()
    assert (row.v, row.s, row.p) == (valid, status, "malformed")


def test_opening_lengths(spark):
    for n, good in ((49, False), (50, True), (2000, True), (2001, False)):
        row = conversation(spark, ("user", "q" * 60), ("assistant", "a" * n)).select(C.opening_quality(C.opening_exchange(F.col("m"))).alias("g")).first()
        assert row.g is good


def test_every_source_has_a_digest_by_ranges(spark):
    keys = {}
    for r in q_dedup.hashed(spark, SF).orderBy("doc_id").collect():
        keys.setdefault(r.source, []).append(r.hash.to_bytes(8, "big", signed=True))
    sha = lambda b: hashlib.sha256(b).digest()

    def brute(every):
        level, most = dict(keys), max(map(len, keys.values())) - 1
        while True:
            level = {s: [sha(b"".join(k[i : i + every])) for i in range(0, len(k), every)] for s, k in level.items()}
            if most < every:
                return {s: (d.hex(), len(keys[s])) for s, (d,) in level.items()}
            most //= every

    rows = q_dedup.indexed(spark, SF, hash=q_dedup.T.text_hash64(F.col("text"), True))
    for got, every in ((q_dedup.ordered_key_digests(spark, SF), 512), (q_dedup.digests_of_ranges(rows, 3), 3)):
        assert {r.source: (r.key_digest, r.n) for r in got.collect()} == brute(every)


def test_moving_means_take_all_rows_of_every_source(spark):
    rng = random.Random(3)
    sources = {"a": [float(rng.randrange(900)) for _ in range(9000)], "b": [5.0], "c": [0.0, 7.0, 1.0]}
    df = spark.createDataFrame([(s, i, x) for s, xs in sources.items() for i, x in enumerate(xs)], "source string, step long, x double")
    for every in (2, 4096):
        got = {(r.source, r.step): r.ema for r in q_samples.moving_means(df.where("step < 50") if every == 2 else df, every).collect()}
        for s, xs in sources.items():
            value = xs[0]
            for i, x in enumerate(xs[:50] if every == 2 else xs):
                value = 0.9 * value + 0.1 * x if i else x
                assert got.pop((s, i)) == pytest.approx(value, rel=1e-9)
        assert not got
    assert q_samples.ema_rates(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_labels_cover_whole_texts(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [ord(c) % 130 for c in r.text]
        labels = [-100 if i < r.doc_id % 45 or x >= 120 else x for i, x in enumerate(ids)][1:]
        if any(x >= 0 for x in labels):
            slots = len(ids) - 1
            want[r.doc_id] = (slots, ",".join(map(str, ids[:-1] + [2] * (-slots % 8))), ",".join(map(str, labels)))
    assert {r.doc_id: (r.slots, r.inputs, r.labels) for r in q_samples.text_labels(spark, SF).collect()} == want
    assert max(n for n, _, _ in want.values()) > 10_000
