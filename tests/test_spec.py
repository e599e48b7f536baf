from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.functions import samples as S
from millrace.plans import spec


def dataset(**change):
    good = {
        "sources": {"web": spec.Source("p"), "held": spec.Source("v", rows=10)},
        "stages": [spec.Stage("one", 100, {"web": "1"}, {"held": "1"}), spec.Stage("two", 50, {"web": "1"})],
    }
    return spec.Dataset(**good | change)


def test_a_good_one_has_no_problems():
    d = dataset()
    assert d.problems() == [] and d.ranks() == {"held": 0, "web": 1} and "| web | pretrain |" in spec.describe(d)
    assert d.identity("web") != dataset(max_length=9000).identity("web") == dataset(max_length=9000).identity("web")


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"stages": []}, "there must be a stage"), ({"stages": [spec.Stage("a", 1, {"web": "0.5"}, {"held": "1"})]}, "sum to one"), ({"stages": [spec.Stage("a", 1, {"x": "1"})]}, "unknown source"),
        ({"sources": {"web": spec.Source("p", rows=3), "held": spec.Source("v", rows=1)}}, "only validate"), ({"sources": {"web": spec.Source("p"), "held": spec.Source("v")}}, "needs rows"),
        ({"target_length": 9000}, "target_length"), ({"sources": {"web": spec.Source("p", input_inversions=0.5), "held": spec.Source("v", rows=1)}}, "instruct"),
        ({"stages": [spec.Stage("a", 1, {"web": "1"}, {"held": "1"}), spec.Stage("a", 1, {"web": "1"})]}, "unique"),
    ],
)
def test_problems_are_named(change, said):
    assert any(said in p for p in dataset(**change).problems())


def test_changes_and_epochs():
    assert spec.changes({"a": {"b": 1}}, {"a": {"b": 1}}) == []
    assert spec.epochs_needed(3, 7) == 3 and spec.epochs_needed(0, 7) == 0 and Fraction("0.07") * 100 == 7


def test_prepared_follows_the_order_of_filters(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(0, words), (1, words.upper()), (2, "short"), (3, None), (4, words + " more and more")], "row_idx int, text string")
    assert sorted(r.row_idx for r in spec.prepared(docs, spec.Processing()).collect()) == [0, 4]
    assert sorted(r.row_idx for r in spec.prepared(docs, spec.Processing(dedup="none")).collect()) == [0, 1, 4]
    assert [r.row_idx for r in spec.prepared(docs, spec.Processing(dedup="minhash", min_chars=60)).collect()] in ([0], [0, 4])


def test_samples(spark):
    row = spark.createDataFrame([([5, 6, 7],), ([1],), ([],)], "ids array<int>")
    got = row.select(
        S.shifted_inputs(F.col("ids")).alias("i"), S.shifted_labels(F.col("ids")).alias("l"), S.has_loss(F.col("ids"), 7).alias("h"), S.mask_labels(F.col("ids"), 6).alias("m"), S.padded(F.col("ids"), 2, 0).alias("p")
    ).collect()
    assert [tuple(r) for r in got] == [([5, 6], [6, 7], True, [5, -100, -100], [5, 6, 7, 0]), ([], [], False, [1], [1, 0]), ([], [], False, [], [])]


def test_renderings(spark):
    row = spark.createDataFrame([("s", "a", "b", "2")], "sentence string, option1 string, option2 string, answer string")
    fields = {c: F.col(c) for c in row.columns}
    assert tuple(row.select(S.complete_example("winogrande", fields).alias("r")).first().r) == ("s\n1. a\n2. b", "2. b")
    with pytest.raises(ValueError):
        S.complete_example("other", {})
