"""The sequential part of the training stream: deficit scheduling and first-fit packs.

The recurrences run on (source, row, slots) alone, one stream each; texts are joined back by row.
A stream is sequential by definition, so its group is ordered and replayed in one task; several
runs or epochs are groups of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.order import dense_index

#: The pool is refilled until it holds so many packs' slots.
LOOKAHEAD = 16


@dataclass
class StreamState:
    """Where a stream stands: what each source has drawn, was owed, and which row comes next. A stream
    that is started from a saved state goes on as if it had never stopped."""

    loaded: dict[str, float] = field(default_factory=dict)
    target: dict[str, float] = field(default_factory=dict)
    at: dict[str, int] = field(default_factory=dict)

    def saved(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def read(cls, saved: str) -> StreamState:
        return cls(**json.loads(saved))


def by_deficit(weights: dict[str, float], rows: dict[str, list], state: StreamState | None = None) -> Iterator[tuple[str, object, int]]:
    """(source, row, slots) in the order of the stream: each document comes from the source that is
    furthest behind its share. A source without more rows leaves its share to the others, in
    proportion to theirs, so every row is drawn once. ``state`` is kept up to date."""
    state = state or StreamState()
    for part, zero in ((state.loaded, 0.0), (state.target, 0.0), (state.at, 0)):
        for n in weights:
            part.setdefault(n, zero)
    names = sorted(n for n, w in weights.items() if w > 0 and len(rows.get(n, ())) > state.at[n])
    whole = sum(weights[n] for n in names)
    while names:
        source = max(names, key=lambda n: state.target[n] - state.loaded[n])  # the first of equals
        row, slots = rows[source][state.at[source]]
        state.at[source] += 1
        state.loaded[source] += slots
        for n in names:
            state.target[n] += weights[n] / whole * slots
        if state.at[source] == len(rows[source]):
            names.remove(source)
            whole = sum(weights[n] for n in names)
        yield source, row, slots


def epochs_of(rows: DataFrame, group: str, order: str, slots: str, goal: Column) -> DataFrame:
    """(group, epochs, rows_of_last, status): how often a source's rows are read to fill ``goal`` slots,
    starting again at its first row, and how many rows of the last, partial time. ``status`` is unusable
    where a whole time gives no slots. ``rows`` should have a column for the goal's expression."""
    total = rows.groupBy(group).agg(F.sum(slots).alias("_total"), F.first(goal).alias("_goal"))
    placed = dense_index(rows.select(group, order, slots), [F.col(group), F.col(order)])
    before = Window.partitionBy(group, "_part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    # running sums within parts of a source's rows, and over its parts
    placed = placed.withColumn("_part", F.floor(F.col("position") / 65536)).withColumn("_in", F.coalesce(F.sum(slots).over(before), F.lit(0)))
    parts = placed.groupBy(group, "_part").agg(F.sum(slots).alias("_s"))
    over = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_part", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_base"))
    rest = F.pmod(F.col("_goal"), F.col("_total"))
    drawn = placed.join(parts, [group, "_part"]).join(total, group).where(F.col("_total") > 0)
    last = drawn.groupBy(group).agg(F.count(F.when(F.col("_base") + F.col("_in") < rest, 1)).alias("rows_of_last"))
    epochs = F.when(F.col("_total") > 0, F.floor(F.col("_goal") / F.col("_total")))
    out = total.join(last, group, "left")
    return out.select(group, epochs.alias("epochs"), "rows_of_last", F.when(F.col("_total") > 0, "ok").otherwise("unusable").alias("status"))


def first_fit_packs(stream: Iterator[tuple[object, int]], pack: int, lookahead: int = LOOKAHEAD) -> Iterator[list[tuple[object, int, int]]]:
    """Packs of (row, slots, offset): walk the pool from its front and take what still fits; what
    is left leads the next pack. Rows longer than a pack are dropped. Ends when all is taken."""
    pool: list[tuple[object, int]] = []
    held, more = 0, True
    while True:
        while more and held < lookahead * pack:
            item = next(stream, None)
            if item is None:
                more = False
            elif item[1] <= pack:
                pool.append(item)
                held += item[1]
        if not pool:
            return
        room, taken, kept = pack, [], []
        for row, slots in pool:
            if slots <= room:
                taken.append((row, slots, pack - room))
                room -= slots
            else:
                kept.append((row, slots))
        pool, held = kept, held - (pack - room)
        yield taken


def replayed(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], stream: str, schema: str) -> DataFrame:
    return rows.groupBy(stream).applyInPandas(run, schema)


def deficit_schedule(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(run, position, source, row, slots) from (run, source, row, slots), rows in order of ``row``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source", "row"])
        by = {s: list(zip(g["row"], g["slots"], strict=True)) for s, g in group.groupby("source")}
        out = [(group["run"].iloc[0], i, s, r, n) for i, (s, r, n) in enumerate(by_deficit(weights, by))]
        return pd.DataFrame(out, columns=["run", "position", "source", "row", "slots"])

    return replayed(rows.where(F.col("source").isin(list(weights))), run, "run", "run int, position bigint, source string, row bigint, slots bigint")


def first_fit(rows: DataFrame, pack: int, lookahead: int = LOOKAHEAD) -> DataFrame:
    """(run, pack, place, row, slots, bin_offset) from (run, position, row, slots)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        stream = iter(zip(group["row"], group["slots"], strict=True))
        out = [(group["run"].iloc[0], p, i, r, n, at) for p, taken in enumerate(first_fit_packs(stream, pack, lookahead)) for i, (r, n, at) in enumerate(taken)]
        return pd.DataFrame(out, columns=["run", "pack", "place", "row", "slots", "bin_offset"])

    return replayed(rows, run, "run", "run int, pack bigint, place bigint, row bigint, slots bigint, bin_offset bigint")


def pack_layout(placed: DataFrame, pack: int) -> DataFrame:
    """Per pack the position and document number of each slot; the tail is a document of its own."""
    docs = placed.groupBy("run", "pack").agg(F.array_sort(F.collect_list(F.struct("place", "slots"))).alias("d"))
    used = F.aggregate("d", F.lit(0).cast("bigint"), lambda a, x: a + x["slots"])
    docs = docs.withColumn("padding", F.lit(pack) - used)
    all_ = F.concat(F.transform("d", lambda x: x["slots"]), F.when(F.col("padding") > 0, F.array("padding")).otherwise(F.array().cast("array<bigint>")))
    docs = docs.withColumn("all", F.filter(all_, lambda n: n > 0))
    spread = lambda body: F.flatten(F.transform("all", body))
    return docs.select(
        "run", "pack", "padding",
        spread(lambda n, i: F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("position_ids"),
        spread(lambda n, i: F.array_repeat(i, n.cast("int"))).alias("document_ids"),
    )
