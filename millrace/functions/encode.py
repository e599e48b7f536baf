"""Column expressions that turn messages and rows into ids with their labels.

``ids_of`` is the tokenizer: a function from a text column to an array of ids. Each piece is encoded on
its own, so the pieces' boundaries never depend on the text around them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.chat import valid_messages
from millrace.functions.samples import IGNORE
from millrace.functions.text import bound, instruct_text, strip

Tokenizer = Callable[[Column], Column]
#: Fixed headers of the turns, and what stands between exchanges.
ASKED, TOLD, BETWEEN = "User:\n", "\n\nAssistant:\n", "\n\n"


def code_points(text: Column) -> Column:
    """A tokenizer without a vocabulary: an id for each character."""
    return F.transform(F.split(text, ""), lambda c: F.ascii(c))


def exchange_ids(messages: Column, at: Column, ids_of: Tokenizer, eos: int | None) -> Column:
    """(context, answer) ids of the exchange at a position, counted in exchanges from 0."""
    said = lambda i: F.get(messages, i)["content"]
    head = F.when(at == 0, F.lit(ASKED)).otherwise(F.lit(BETWEEN + ASKED))
    end = F.array(F.lit(eos)) if eos is not None else F.array().cast("array<int>")
    return F.struct(
        F.concat(ids_of(head), ids_of(said(2 * at)), ids_of(F.lit(TOLD))).alias("context"), F.concat(ids_of(said(2 * at + 1)), end).alias("answer")
    )


def encoded_exchanges(messages: Column, ids_of: Tokenizer, bos: int | None = None, eos: int | None = None, most: int | None = None) -> Column:
    """(ids, supervised, ends, exchanges_cut, trailing_user): the complete leading exchanges whose ids
    are at most ``most``; only answers and their end marks are supervised. Invalid messages give null."""
    start = F.array(F.lit(bos)) if bos is not None else F.array().cast("array<int>")
    first = 1 if bos is not None else 0
    n = F.floor(F.size(messages) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    turns = F.transform(places, lambda k: exchange_ids(messages, k, ids_of, eos))

    def fitted(turns: Column) -> Column:
        step = lambda acc, t: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(first)) + F.size(t["context"]) + F.size(t["answer"])))
        ends = F.aggregate(turns, F.array().cast("array<int>"), step)
        return bound(ends if most is None else F.filter(ends, lambda e: e <= most), lambda kept: shown(F.slice(turns, F.lit(1), F.size(kept)), kept))

    def shown(turns: Column, ends: Column) -> Column:
        none = F.size(ends) == 0
        flags = lambda t: F.concat(F.array_repeat(F.lit(False), F.size(t["context"])), F.array_repeat(F.lit(True), F.size(t["answer"])))
        ids = F.concat(start, F.flatten(F.transform(turns, lambda t: F.concat(t["context"], t["answer"]))))
        supervised = F.concat(F.array_repeat(F.lit(False), F.lit(first)), F.flatten(F.transform(turns, flags)))
        return F.struct(
            F.when(none, F.array().cast("array<int>")).otherwise(ids).alias("ids"), F.when(none, F.array().cast("array<boolean>")).otherwise(supervised).alias("supervised"),
            ends.alias("ends"), (n - F.size(ends)).alias("exchanges_cut"), (F.size(messages) % 2 == 1).alias("trailing_user"),
        )

    return F.when(valid_messages(messages), bound(turns, fitted))


def literal_chat(messages: Column, ids_of: Tokenizer, bos: int, eos: int, user: int, assistant: int, prompt: bool = False) -> Column:
    """(ids, supervised): the begin mark, then for each message the id of its role, its body and the end
    mark; bodies and end marks of answers are supervised. With ``prompt`` the messages must end with a
    question, and the id of an answer follows. Others give null."""
    told = lambda m: m["role"] == "assistant"
    body = lambda m: F.concat(F.array(F.when(told(m), assistant).otherwise(user)), ids_of(m["content"]), F.array(F.lit(eos)))
    more = F.array(F.lit(assistant)) if prompt else F.array().cast("array<int>")

    def flags(part: Column, m: Column) -> Column:
        return F.concat(F.array(F.lit(False)), F.array_repeat(told(m), F.size(part) - 1))

    def shown(parts: Column) -> Column:
        supervised = F.concat(F.array(F.lit(False)), F.flatten(F.zip_with(parts, messages, flags)), F.transform(more, lambda _: F.lit(False)))
        return F.struct(F.concat(F.array(F.lit(bos)), F.flatten(parts), more).alias("ids"), supervised.alias("supervised"))

    ends = F.size(messages) % 2 == (1 if prompt else 0)
    return F.when(valid_messages(messages) & ends, bound(F.transform(messages, body), shown))


def chat_prompt(messages: Column, ids_of: Tokenizer, bos: int | None = None, eos: int | None = None, most: int | None = None) -> Column:
    """(ids, status): complete history and an open question, up to the answer's header. ``status`` is ok,
    malformed, no_question (an answer comes last) or too_long; ids are null unless it is ok."""
    start = F.array(F.lit(bos)) if bos is not None else F.array().cast("array<int>")
    size = F.size(messages)
    done = encoded_exchanges(F.slice(messages, F.lit(1), F.greatest(size - 1, F.lit(0))), ids_of, bos, eos)["ids"]
    head = F.when(size > 1, F.lit(BETWEEN + ASKED)).otherwise(F.lit(ASKED))
    ids = F.concat(F.when(size > 1, done).otherwise(start), ids_of(head), ids_of(F.element_at(messages, -1)["content"]), ids_of(F.lit(TOLD)))

    def judged(ids: Column) -> Column:
        long_ = F.size(ids) > most if most is not None else F.lit(False)
        status = F.when(~valid_messages(messages), "malformed").when(size % 2 == 0, "no_question").when(long_, "too_long").otherwise("ok")
        return bound(status, lambda s: F.struct(F.when(s == "ok", ids).alias("ids"), s.alias("status")))

    return F.when(valid_messages(messages), bound(ids, judged)).otherwise(F.struct(F.lit(None).cast("array<int>").alias("ids"), F.lit("malformed").alias("status")))


def plain_sample(text: Column, ids_of: Tokenizer, bos: int | None, eos: int | None) -> Column:
    """(ids, labels) of a text: every id is a label."""
    mark = lambda m: F.array(F.lit(m)) if m is not None else F.array().cast("array<int>")
    return bound(F.concat(mark(bos), ids_of(text), mark(eos)), lambda ids: F.struct(ids.alias("ids"), ids.alias("labels")))


def instruct_sample(instruction: Column, given: Column, output: Column, ids_of: Tokenizer, bos: int | None, eos: int | None) -> Column:
    """(ids, labels) of an instruction, its input and output: as many ids as the prompt has alone are masked."""
    blank = strip(F.coalesce(given, F.lit(""))) == ""
    prompt = F.when(blank, strip(instruction)).otherwise(F.concat(strip(instruction), F.lit("\n\n"), strip(F.coalesce(given, F.lit("")))))
    whole = plain_sample(instruct_text(instruction, given, output), ids_of, bos, eos)["ids"]
    cut = F.size(ids_of(prompt)) + (1 if bos is not None else 0)
    return bound(whole, lambda ids: F.struct(ids.alias("ids"), F.transform(ids, lambda x, i: F.when(i < cut, IGNORE).otherwise(x)).alias("labels")))


def chat_sample(messages: Column, ids_of: Tokenizer, bos: int | None, eos: int | None, most: int | None = None) -> Column:
    """(ids, labels) of the complete exchanges that fit; what isn't an answer is masked."""
    masked = lambda e: F.zip_with(e["ids"], e["supervised"], lambda x, s: F.when(s, x).otherwise(IGNORE))
    return bound(encoded_exchanges(messages, ids_of, bos, eos, most), lambda e: F.struct(e["ids"].alias("ids"), masked(e).alias("labels")))


def generation_prompt(kind: str, ids_of: Tokenizer, text: Column | None = None, messages: Column | None = None, bos: int | None = None, eos: int | None = None) -> Column:
    """Ids that generation goes on from: an open text (continuation, instruction) or an open chat."""
    if kind not in ("continuation", "instruction", "chat"):
        raise ValueError(f"no such kind of prompt: {kind}")
    if kind == "chat":
        if messages is None:
            raise ValueError("a chat needs messages")
        return chat_prompt(messages, ids_of, bos, eos)["ids"]
    if messages is not None:
        raise ValueError(f"a {kind} has no messages")
    return plain_sample(text, ids_of, bos, None)["ids"]


#: How a dataset's rows become samples, by the name in its signature; of (row's columns by name, tokenizer, marks).
FORMATS: dict[str, Callable[[dict[str, Column], Tokenizer, int | None, int | None], Column]] = {
    "pass_text": lambda c, ids_of, bos, eos: plain_sample(c["text"], ids_of, bos, eos),
    "concatenate_instruction_input_output": lambda c, ids_of, bos, eos: instruct_sample(c["instruction"], c["input"], c["output"], ids_of, bos, eos),
    "format_conversation": lambda c, ids_of, bos, eos: chat_sample(c["messages"], ids_of, bos, eos),
}
