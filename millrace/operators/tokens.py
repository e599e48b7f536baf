"""Counting and cutting by a tokenizer: the cut text is a prefix that counts at most the cap."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_level_json(words: list[str]) -> str:
    """A tokenizer of whole words; what it doesn't know is one token."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {w: i for i, w in enumerate(["<unk>", "<bos>", "<eos>", *words])}
    tool = Tokenizer(models.WordLevel(vocab, unk_token="<unk>"))
    tool.pre_tokenizer = pre_tokenizers.Whitespace()
    return tool.to_str()


@lru_cache(maxsize=4)
def loaded(definition: str):  # noqa: ANN201
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def cut(tool, text: str, cap: int) -> tuple[str, int]:  # noqa: ANN001
    """The longest prefix at a token's start that counts at most ``cap``, and its count."""
    text = text[: 32 * cap]
    while True:
        offsets = tool.encode(text, add_special_tokens=False).offsets
        if len(offsets) <= cap:
            return text, len(offsets)
        text = text[: offsets[cap][0]]


def truncate(docs: DataFrame, definition: str, cap: int, text: str = "text") -> DataFrame:
    """Replaces the text by its cut and adds ``tokens``, the count with both marks."""
    if cap < 0:
        raise ValueError("the cap must not be negative")

    @F.pandas_udf("cut string, tokens bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = loaded(definition)
        for texts in batches:
            yield pd.DataFrame([cut(tool, t or "", cap) for t in texts], columns=["cut", "tokens"])

    out = docs.withColumn("_cut", run(text))
    return out.withColumn(text, F.col("_cut.cut")).withColumn("tokens", F.col("_cut.tokens") + 2).drop("_cut")
