"""What a dataset is to be: sources, stages and processing, validated, with identities.

A specification becomes DataFrames only in ``prepared``: read, filter, decontaminate, deduplicate,
as one lazy plan for each source.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from fractions import Fraction
from math import ceil, isfinite

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import contamination, dedup


@dataclass(frozen=True)
class Processing:
    min_chars: int = 50
    quality: bool = False
    dedup: str = "exact"  # none, exact or minhash
    normalize: bool = True
    ngram: int = 13
    contamination_share: float = 0.1


@dataclass(frozen=True)
class Source:
    path: str
    kind: str = "pretrain"  # or instruct
    pattern: str = "*"
    text_field: str = "text"
    converter: str | None = None
    fields: dict[str, str] | None = None
    filters: tuple[str, ...] = ()
    shuffle: bool | None = None  # by default instructions are shuffled and documents are not
    check_limit: int | None = None
    rows: int | None = None
    validation_fraction: str | None = None
    input_inversions: float = 0.0
    processing: Processing | None = None

    def problems(self) -> list[str]:
        out = []
        if self.kind not in ("pretrain", "instruct"):
            out.append(f"unknown kind {self.kind}")
        if self.check_limit is not None and self.check_limit <= 0:
            out.append("a check_limit looks at one row at least")
        if self.rows is not None and self.rows <= 0:
            out.append("rows must be positive")
        if not 0 <= self.input_inversions < 1:
            out.append("input_inversions are a share below one")
        if self.input_inversions and self.kind != "instruct":
            out.append("input_inversions only applies to instruct sources")
        if self.validation_fraction is not None and not 0 <= Fraction(self.validation_fraction) < 1:
            out.append("the held-out fraction is a share below one")
        if self.converter is not None and self.fields is not None:
            out.append("a converter and a field map exclude each other")
        return out


@dataclass(frozen=True)
class Stage:
    name: str
    tokens: int
    train: dict[str, str]
    val: dict[str, str] = field(default_factory=dict)
    transition: str = "0"


@dataclass(frozen=True)
class Dataset:
    sources: dict[str, Source]
    stages: list[Stage]
    processing: Processing = Processing()
    validation_fraction: str = "0.05"
    max_length: int = 8192
    target_length: int = 2048

    def used(self, name: str) -> tuple[bool, bool]:
        """Whether a source trains, and whether it validates."""
        return any(name in s.train for s in self.stages), any(name in s.val for s in self.stages)

    def problems(self) -> list[str]:
        """What is wrong with the specification, a line each; nothing if it can be prepared."""
        out = [f"source {n}: {p}" for n, s in self.sources.items() for p in s.problems()]
        out += [f"not a safe name: {n!r}" for n in self.sources if not n or n in (".", "..") or "/" in n or "\\" in n]
        if not self.stages:
            out.append("there must be a stage")
        if len({s.name for s in self.stages}) < len(self.stages):
            out.append("stage names must be unique")
        if not 0 < self.target_length <= self.max_length:
            out.append("target_length must be positive and at most max_length")
        for s in self.stages:
            for part, weights in (("train", s.train), ("val", s.val)):
                out += [f"stage {s.name}: unknown source {n}" for n in weights if n not in self.sources]
                values = [Fraction(w) for w in weights.values()]
                if values and (min(values) <= 0 or not isfinite(float(sum(values))) or abs(sum(values) - 1) > Fraction(1, 10**6)):
                    out.append(f"stage {s.name}: {part} weights must be positive and sum to one")
            if not 0 <= Fraction(s.transition) < 1:
                out.append(f"stage {s.name}: transition must be in [0, 1)")
        for n, s in self.sources.items():
            train, val = self.used(n)
            if not train and not val:
                out.append(f"source {n}: no stage uses it")
            elif train and s.rows is not None:
                out.append(f"source {n}: rows are for sources that only validate")
            elif not train and s.rows is None:
                out.append(f"source {n}: a source that only validates needs rows")
            if train and val and Fraction(s.validation_fraction or self.validation_fraction) <= 0:
                out.append(f"source {n}: nothing would be held out")
            if s.kind == "instruct" and (s.processing or self.processing).dedup == "minhash":
                out.append(f"source {n}: minhash is for pretrain sources")
        return out

    def ranks(self) -> dict[str, int]:
        """Order of admission: sources that only validate first, then as declared."""
        order = sorted(self.sources, key=lambda n: self.used(n)[0])
        return {n: i for i, n in enumerate(order)}

    def identity(self, name: str) -> str:
        """Identity of a source's processed rows: a digest of all that decides them."""
        s = self.sources[name]
        return digest({"source": asdict(s), "processing": asdict(s.processing or self.processing), "max_length": self.max_length})


def digest(payload: object) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()[:16]


def flat(payload: dict, prefix: str = "") -> dict[str, object]:
    """Leaves by dotted name; lists are leaves."""
    out: dict[str, object] = {}
    for k, v in payload.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) and v else {f"{prefix}{k}": v}
    return out


def changes(old: dict, new: dict) -> list[tuple[str, str, str]]:
    """(name, old, new) of every leaf that differs, by name."""
    a, b = flat(old), flat(new)
    shown = lambda d, k: json.dumps(d[k]) if k in d else "(absent)"
    return [(k, shown(a, k), shown(b, k)) for k in sorted(a.keys() | b.keys()) if a.get(k, a) != b.get(k, b)]


def epochs_needed(rows: int, budget: int) -> int:
    return ceil(Fraction(budget, rows)) if rows else 0


def prepared(rows: DataFrame, processing: Processing, text: str = "text", order: str = "row_idx", benchmarks: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """One source's rows after its filters, with ``tokens`` and ``hash``: cheap filters first,
    then quality, benchmarks, and the first of each key; ``by`` tells several sources apart."""
    kept = rows.where(F.col(text).isNotNull() & (F.char_length(text) >= processing.min_chars))
    if processing.quality:
        kept = kept.where(T.quality_reason(F.col(text)) == "passed")
    if benchmarks is not None:
        hits = contamination.document_hits(kept, benchmarks, [order], text, processing.ngram)
        gone = contamination.contaminated(hits, processing.contamination_share).select(order).distinct()
        kept = kept.join(gone, order, "left_anti")
    kept = kept.withColumn("tokens", T.estimate_tokens(F.col(text))).withColumn("hash", T.text_hash64(F.col(text), processing.normalize))
    if processing.dedup == "none":
        return kept
    kept = dedup.first_rows(kept, ["hash", *(by or [])], [order])
    if processing.dedup == "minhash":
        from millrace.operators.fuzzy import near_dups

        kept = kept.join(near_dups(kept, order, text, 0.95, 256).withColumnRenamed("row", order), order, "left_anti")
    return kept


def describe(spec: Dataset) -> str:
    """The specification as Markdown tables."""
    lines = ["| stage | tokens | transition | train | val |", "| --- | --- | --- | --- | --- |"]
    mix = lambda w: ", ".join(f"{n} {v}" for n, v in w.items()) or "-"
    lines += [f"| {s.name} | {s.tokens} | {s.transition} | {mix(s.train)} | {mix(s.val)} |" for s in spec.stages]
    lines += ["", "| source | kind | identity | rank |", "| --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {n} | {s.kind} | {spec.identity(n)} | {spec.ranks()[n]} |" for n, s in spec.sources.items()])
