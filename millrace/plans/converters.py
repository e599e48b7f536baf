"""How a source's rows become documents, instructions or messages, and which are kept, by name.

A converter maps columns by name to a struct with ``status`` (ok, or why the row can't be converted) and
the fields of its target; a filter maps them to passed, failed or malformed. What a row-at-a-time engine
would raise is a status here, so a bad row is counted and doesn't end a job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import chat as C
from millrace.functions.text import strip

Columns = dict[str, Column]
#: Fixed names of the instruction fields.
FIELDS = ("instruction", "input", "output")


def empty(value: Column) -> Column:
    """As text; null is empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def needed(columns: Columns, *names: str) -> None:
    missing = sorted(set(names) - columns.keys())
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(sorted(columns))}")


def instruct(instruction: Column, given: Column, output: Column, status: Column | None = None) -> Column:
    return F.struct(instruction.alias("instruction"), given.alias("input"), output.alias("output"), (F.lit("ok") if status is None else status).alias("status"))


def by_fields(fields: dict[str, str]) -> Callable[[Columns], Column]:
    """A converter from a map of the instruction fields to columns; without an input it is empty."""
    if not {"instruction", "output"} <= fields.keys():
        raise ValueError("a field map needs instruction and output")
    if extra := sorted(fields.keys() - set(FIELDS)):
        raise ValueError(f"a field map knows instruction, input and output, not {', '.join(extra)}")

    def convert(columns: Columns) -> Column:
        needed(columns, fields["instruction"], fields["output"])
        given = columns.get(fields.get("input", ""), F.lit(""))
        return instruct(empty(columns[fields["instruction"]]), empty(given), empty(columns[fields["output"]]))

    return convert


def messages(question: str, answer: str) -> Callable[[Columns], Column]:
    """A converter to the two messages of a pair; blank ones are malformed."""

    def convert(columns: Columns) -> Column:
        needed(columns, question, answer)
        found = C.pair_messages(columns[question].cast("string"), columns[answer].cast("string"))
        return F.struct(found.alias("messages"), F.when(C.valid_messages(found), "ok").otherwise("malformed").alias("status"))

    return convert


def document(columns: Columns) -> Column:
    needed(columns, "question", "answer")
    return F.struct(C.question_answer(empty(columns["question"]), empty(columns["answer"])).alias("text"), F.lit("ok").alias("status"))


def roles(turns: Column) -> Column:
    """Turns of (from, value) as (role, content): human is the user, gpt the assistant."""
    named = lambda t: F.when(t["from"] == "human", "user").when(t["from"] == "gpt", "assistant").otherwise(t["from"])
    return F.transform(turns, lambda t: F.struct(named(t).alias("role"), t["value"].cast("string").alias("content")))


def first_exchange(columns: Columns) -> Column:
    needed(columns, "conversations")
    opening = C.opening_exchange(roles(columns["conversations"]))
    return instruct(opening["question"], opening["system"], opening["answer"], opening["status"])


def two_turns(columns: Columns) -> Column:
    needed(columns, "conversations")
    turns = columns["conversations"]
    said = lambda i: empty(F.get(turns, F.lit(i))["value"])
    return instruct(said(0), F.lit(""), said(1), F.when(F.coalesce(F.size(turns), F.lit(0)) >= 2, "ok").otherwise("malformed"))


def reasoning_off(columns: Columns) -> Column:
    needed(columns, "messages", "reasoning")
    status = C.reasoning_policy(columns["messages"], columns["reasoning"])
    return F.struct(C.without_empty_system(columns["messages"]).alias("messages"), F.when(status == "kept", "ok").otherwise(status).alias("status"))


CONVERTERS: dict[str, Callable[[Columns], Column]] = {
    "opencode_messages": messages("input", "output"),
    "webinstruct_messages": messages("question", "answer"),
    "nemotron_messages": reasoning_off,
    "gsm8k_question_answer": document,
    "sharegpt_conversations": first_exchange,
    "first_two_turns": two_turns,
    "instruction_input_output": by_fields({f: f for f in FIELDS}),
}


def as_messages(convert: Callable[[Columns], Column]) -> Callable[[Columns], Column]:
    """An instruction converter's rows as two messages, the input below the question."""

    def converted(columns: Columns) -> Column:
        row = convert(columns)
        found = C.pair_messages(row["instruction"], row["output"], row["input"])
        status = F.when(row["status"] != "ok", row["status"]).when(C.valid_messages(found), "ok").otherwise("malformed")
        return F.struct(found.alias("messages"), status.alias("status"))

    return converted


def resolved(name: str | None, fields: dict[str, str] | None, chat: bool = False) -> Callable[[Columns], Column] | None:
    """The converter of a source: its field map, else the one named, else none. ``chat`` asks for messages."""
    if fields is not None:
        convert = by_fields(fields)
    elif name is None:
        return None
    elif name in CONVERTERS:
        convert = CONVERTERS[name]
    else:
        raise ValueError(f"no converter {name}; there are {', '.join(sorted(CONVERTERS))}")
    pairs = fields is not None or name in ("sharegpt_conversations", "first_two_turns", "instruction_input_output")
    return as_messages(convert) if chat and pairs else convert


def good_opening(columns: Columns) -> Column:
    needed(columns, "conversations")
    opening = C.opening_exchange(roles(columns["conversations"]))
    return F.when(opening["status"] != "ok", "malformed").when(C.opening_quality(opening), "passed").otherwise("failed")


def full_score(columns: Columns) -> Column:
    needed(columns, "average_test_score")
    score = F.trim(columns["average_test_score"].cast("string")).try_cast("decimal(38,27)")
    return F.when(score.isNull() | (score < 0) | (score > 1), "malformed").when(score == 1, "passed").otherwise("failed")


FILTERS: dict[str, Callable[[Columns], Column]] = {"sharegpt_quality": good_opening, "opencode_passed_tests": full_score}


def filter_named(name: str) -> Callable[[Columns], Column]:
    if name not in FILTERS:
        raise ValueError(f"no filter {name}; there are {', '.join(sorted(FILTERS))}")
    return FILTERS[name]


def of(rows: DataFrame) -> Columns:
    return {c: F.col(c) for c in rows.columns}


def text_of(rows: DataFrame, text_field: str) -> Column:
    """The chosen field as text; null is empty."""
    needed(of(rows), text_field)
    return empty(F.col(text_field))


def converted(rows: DataFrame, convert: Callable[[Columns], Column], keep: list[str]) -> DataFrame:
    """(keep, fields of the target, status) of every row."""
    return rows.select(*keep, convert(of(rows)).alias("_to")).select(*keep, "_to.*")


def filled(rows: DataFrame) -> Column:
    """Whether an instruction row has what it needs."""
    return (strip(F.col("instruction")) != "") & (strip(F.col("output")) != "")
