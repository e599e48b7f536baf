"""Byte-level BPE: exact merges in linear time by backtracking from longest matches.

A sequence of tokens is the BPE encoding of its bytes exactly if every two neighbours are
compatible, that is, if the merges of their joined bytes give these two again. So the encoder walks
over a piece, takes the longest token at each place that is compatible with the one before, shortens
it or steps back where none is, and never returns to a place that has proved a dead end. All tokens
that occur in a piece come from one pass of an automaton over its bytes, written as Latin-1.

Defined results: null texts count as empty; an empty text has no ids and decodes to nothing; very
long texts are cut by the pattern into pieces, and each piece takes time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces remembered by one worker, and the longest of them.
CACHE_PIECES, CACHE_BYTES = 400_000, 48


def merge(data: bytes, ranks: dict[bytes, int], leave: int = 1) -> list[bytes]:
    """Plain merging, lowest rank first and leftmost among equals, down to ``leave`` parts."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > leave:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Pieces(dict):
    """Packed ids by piece; what is missing is encoded and, if short, remembered."""

    def __init__(self, encode: Callable[[bytes], bytes]) -> None:
        self.encode = encode

    def __missing__(self, cut: str) -> bytes:
        data = cut.encode()
        ids = self.encode(data)
        if len(data) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[cut] = ids
        return ids


class Encoder:
    """Encoding and decoding by the ranks of a file (base64 token and rank on each line)."""

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.machine = ahocorasick.Automaton()
        #: The two tokens that a token was last merged from, and the token of two; bytes have none.
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in self.ranks.items():
            halves = merge(token, self.ranks, 2)
            if len(halves) == 2:
                a, b = (self.ranks[x] for x in halves)
                self.halves[rank] = a, b
                self.joined[a, b] = rank
            if len(halves) < 3:  # others are reached as whole pieces only
                self.machine.add_word(token.decode("latin-1"), (len(token), rank))
        self.machine.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known = Pieces(self.piece)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the boundary between two tokens alone.

        Their merges are undone, the latest first; the boundary falls if its two sides at that time
        make a token of a lower rank than the merge undone (or the same rank further left).
        """
        halves, joined, limit = self.halves, self.joined, 1 << 60
        while True:
            over = joined.get((a, b))
            if over is not None and over < limit:
                return False
            left, right = halves.get(a), halves.get(b)
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def piece(self, data: bytes) -> bytes:
        """Packed ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return pack("<I", whole)
        n, fits = len(data), self.fits
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.machine.iter(data.decode("latin-1")):  # the tokens of a start come by length
            starts[end + 1 - found[0]].append(found)
        shut = bytearray(n + 1)
        taken: list[tuple[int, int, int]] = []  # id, size, and which match of its start it was
        at, last, choice = 0, -1, len(starts[0])
        while at < n:
            matches = starts[at]
            while choice:
                choice -= 1
                size, token = matches[choice]
                if shut[at + size]:
                    continue
                if last < 0:
                    break
                pair = last << 32 | token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= 1_000_000:
                        fits.clear()
                    fit = fits[pair] = self.compatible(last, token)
                if fit:
                    break
            else:
                shut[at] = 1
                _, size, choice = taken.pop()
                at -= size
                last = taken[-1][0] if taken else -1
                continue
            taken.append((token, size, choice))
            at += size
            last, choice = token, len(starts[at])
        return pack(f"<{len(taken)}I", *(t[0] for t in taken))

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.cut(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


def on_texts(docs: DataFrame, path: str, pattern: str, text_col: str, schema: str, result: Callable[[Encoder, str], tuple]) -> DataFrame:
    names = [part.split()[0] for part in schema.split(",")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = encoder(path, pattern)
        for texts in batches:
            yield pd.DataFrame([result(tool, t) for t in texts], columns=names)

    kept = [c for c in docs.columns if c.lower() not in {*map(str.lower, names), "_run"}]
    return docs.select(*kept, run(F.coalesce(F.col(text_col), F.lit(""))).alias("_run")).select(*kept, "_run.*")


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids``, the token ids of each text. The file of ranks is read on each worker."""
    return on_texts(docs, path, pattern, text_col, "ids array<int>", lambda tool, t: (tool.encode(t),))


def decode_ids(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of each row's ids."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = encoder(path, pattern)
        for rows in batches:
            yield pd.Series([tool.decode(list(ids)) if ids is not None else b"" for ids in rows])

    return docs.withColumn("decoded", run(F.col(ids_col)))


def round_trip(tool: Encoder, text: str) -> tuple[int, str, str]:
    """Number of ids, sha256 of the packed ids and of the bytes they decode to."""
    packed = tool.packed(text)
    ids = np.frombuffer(packed, "<u4").tolist()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()


def digest(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    return on_texts(docs, path, pattern, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", round_trip)
