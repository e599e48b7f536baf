"""Column expressions over conversations: arrays of (role, content) or (from, value)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip

MESSAGES = "array<struct<role:string,content:string>>"
#: Fixed marks that show code in an answer.
CODE_MARKS = ("```python", "```java", "```cpp", "```javascript")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def pair_messages(question: Column, answer: Column, given: Column | None = None) -> Column:
    """A question, with its input below where there is one, and its answer."""
    if given is not None:
        question = F.when(F.coalesce(given, F.lit("")) != "", F.concat(question, F.lit("\n\n"), given)).otherwise(question)
    return F.array(message("user", question), message("assistant", answer))


def question_answer(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer: "), answer)


def first_two_turns(turns: Column) -> Column:
    return F.struct(F.get(turns, F.lit(0))["content"].alias("instruction"), F.get(turns, F.lit(1))["content"].alias("output"))


def valid_messages(messages: Column) -> Column:
    """Not empty, user and assistant in turn from the start, no blank content; may end with a user."""
    roles = F.transform(messages, lambda m, i: m["role"].eqNullSafe(F.when(i % 2 == 0, "user").otherwise("assistant")))
    filled = lambda m: F.coalesce(strip(m["content"]) != "", F.lit(False))
    return F.coalesce((F.size(messages) > 0) & F.forall(roles, lambda r: r) & F.forall(messages, filled), F.lit(False))


def opening_exchange(turns: Column) -> Column:
    """(question, answer, system, question_index, status) of [system,] human, gpt at the very start.

    ``status`` is ok, orphan (an answer comes first) or malformed.
    """
    turn = lambda i: F.get(turns, i)
    system = F.coalesce(turn(F.lit(0))["role"] == "system", F.lit(False))
    at = F.when(system, 1).otherwise(0)
    asked, told = turn(at)["role"], turn(at + 1)["role"]
    status = F.when(F.coalesce((asked == "user") & (told == "assistant"), F.lit(False)), "ok").when(asked == "assistant", "orphan").otherwise("malformed")
    said = lambda i: F.coalesce(turn(i)["content"], F.lit(""))
    return F.struct(
        said(at).alias("question"), said(at + 1).alias("answer"), F.when(system, said(F.lit(0))).otherwise("").alias("system"), at.alias("question_index"), status.alias("status")
    )


def opening_quality(opening: Column) -> Column:
    """No system turn before it, 50 to 2000 characters on each side, no code in the answer."""
    sized = lambda c: F.char_length(c).between(50, 2000)
    coded = F.lit(False)
    for mark in CODE_MARKS:
        coded = coded | F.contains(F.lower(opening["answer"]), F.lit(mark))
    return (opening["status"] == "ok") & (opening["question_index"] == 0) & sized(opening["question"]) & sized(opening["answer"]) & ~coded


def without_empty_system(messages: Column) -> Column:
    """A blank leading system turn goes."""
    first = F.get(messages, F.lit(0))
    blank = F.coalesce((first["role"] == "system") & (strip(F.coalesce(first["content"], F.lit(""))) == ""), F.lit(False))
    return F.when(blank, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)


def reasoning_policy(messages: Column, reasoning: Column) -> Column:
    """kept, malformed (reasoning isn't off, or the turns aren't valid) or nonempty_system."""
    rest = without_empty_system(messages)
    system = F.coalesce(F.get(rest, F.lit(0))["role"] == "system", F.lit(False))
    after = F.when(system, F.slice(rest, F.lit(2), F.size(rest))).otherwise(rest)
    return F.when(~reasoning.eqNullSafe(F.lit("off")) | ~valid_messages(after), "malformed").when(system, "nonempty_system").otherwise("kept")


def exchange_ends(messages: Column, tokens_of) -> Column:  # noqa: ANN001
    """Positions after each complete exchange, after a first mark of one token; ``tokens_of`` gives
    the tokens of a question's and an answer's content."""
    n = F.floor(F.size(messages) / 2).cast("int")
    sizes = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda k: tokens_of(F.element_at(messages, 2 * k - 1)["content"]) + tokens_of(F.element_at(messages, 2 * k)["content"]),
    )
    step = lambda acc, s: F.concat(acc, F.array(F.coalesce(F.element_at(acc, -1), F.lit(1).cast("bigint")) + s))
    return F.aggregate(sizes, F.array().cast("array<bigint>"), lambda acc, s: F.when(F.size(acc) == 0, F.array(s + 1)).otherwise(step(acc, s)))


def fit_exchanges(messages: Column, ends: Column, cap: int) -> Column:
    """(messages kept, ends kept, exchanges cut, trailing user cut): complete leading exchanges only."""
    kept = F.filter(ends, lambda e: e <= cap)
    n = F.size(kept)
    return F.struct(
        F.slice(messages, F.lit(1), n * 2).alias("messages"), kept.alias("ends"), (F.size(ends) - n).alias("exchanges_cut"), (F.size(messages) % 2 == 1).alias("trailing_user")
    )


def fitted_positions(ends: Column, target: int) -> Column:
    """Positions usable at a target length: the last end that fits, less one."""
    return F.coalesce(F.array_max(F.filter(ends, lambda e: e <= target + 1)) - 1, F.lit(0).cast("bigint"))


def conversation_hash(messages: Column, policy: str = "") -> Column:
    """Key over a policy's name and the roles and contents as they are, each after its length, so that no
    content can stand for another turn; a conversation must end with an answer."""
    from millrace.functions.text import signed_prefix

    sized = lambda c: F.concat(F.char_length(c).cast("string"), F.lit(":"), c)
    turns = F.transform(messages, lambda m: F.concat(sized(F.coalesce(m["role"], F.lit(""))), sized(F.coalesce(m["content"], F.lit("")))))
    return signed_prefix(F.sha2(F.concat(F.lit(f"{len(policy)}:{policy}"), F.array_join(turns, "")), 256))


def passed_tests(score: Column) -> Column:
    """A score, number or text, that is exactly one; to 27 decimal places, nothing is rounded."""
    return F.coalesce(F.trim(score.cast("string")).try_cast("decimal(38,27)") == 1, F.lit(False))
