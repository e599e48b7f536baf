"""Column expressions over token samples: shift, mask, pad, and which samples carry a loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the label of positions without a loss.
IGNORE = -100


def valid_label(x: Column, vocab: int) -> Column:
    return (x >= 0) & (x < vocab)


def mask_labels(labels: Column, vocab: int) -> Column:
    """Ids outside the vocabulary carry no loss."""
    return F.transform(labels, lambda x: F.when(valid_label(x, vocab), x).otherwise(IGNORE))


def masked_prompt(ids: Column, prompt: Column) -> Column:
    """Labels of a sample whose first ``prompt`` ids are only read."""
    return F.transform(ids, lambda x, i: F.when(i < prompt, IGNORE).otherwise(x))


def has_loss(labels: Column, vocab: int) -> Column:
    """Whether the shift leaves a position with a loss."""
    return F.exists(F.slice(labels, F.lit(2), F.greatest(F.size(labels), F.lit(1))), lambda x: valid_label(x, vocab))


def shifted_inputs(ids: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def shifted_labels(labels: Column) -> Column:
    return F.slice(labels, F.lit(2), F.greatest(F.size(labels), F.lit(1)))


def padded(items: Column, multiple: int, fill: int) -> Column:
    """Filled up to the next multiple."""
    return F.concat(items, F.array_repeat(F.lit(fill).cast("int"), F.pmod(-F.size(items), F.lit(multiple))))


def complete_example(name: str, c: dict[str, Column]) -> Column:
    """(prompt, answer) of a benchmark example as it is rendered: the choices below the question with
    their labels, and the right one; null where the answer isn't among the labels.

    ``c`` maps the fields of the benchmark to columns.
    """
    if name == "arc_challenge":
        prompt, texts, labels, answer = c["question"], c["texts"], c["labels"], c["answer"]
    elif name in ("mmlu", "hellaswag"):
        head = ("Subject: ", "subject", "question") if name == "mmlu" else ("Activity: ", "activity_label", "ctx")
        prompt = F.concat(F.lit(head[0]), c[head[1]], F.lit("\n"), c[head[2]])
        texts, labels = c["choices" if name == "mmlu" else "endings"], F.array(*map(F.lit, "ABCD"))
        answer = F.get(labels, c["answer" if name == "mmlu" else "label"].cast("int"))
    elif name == "winogrande":
        prompt, texts, labels, answer = c["sentence"], F.array(c["option1"], c["option2"]), F.array(F.lit("1"), F.lit("2")), c["answer"]
    else:
        raise ValueError(f"unknown benchmark {name}")
    lines = F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(". "), b))
    right = F.filter(F.zip_with(labels, lines, lambda a, b: F.struct(a.alias("label"), b.alias("line"))), lambda x: x["label"] == answer)
    return F.struct(F.concat(prompt, F.lit("\n"), F.array_join(lines, "\n")).alias("prompt"), F.get(right, F.lit(0))["line"].alias("answer"))
