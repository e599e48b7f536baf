"""From a specification to folders: read, convert, filter, cut, deduplicate, write, report.

Each source becomes one folder with a manifest that names its identity. A source is built again only if
its folder's identity differs; sources are admitted in the order of their ranks against the keys of the
folders before them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, fields
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.dedup import first_rows
from millrace.operators.order import dense_index, shuffle_key
from millrace.plans import converters, spec
from millrace.scratch import cut_lineage
from millrace.sources import readers, storage

STATES = ("missing", "unreadable", "stale", "outdated", "tokenizer_changed", "current")


def dataset(payload: dict) -> spec.Dataset:
    """A specification from plain values, as a JSON file holds them; unknown names are an error."""

    def made(kind: type, values: dict) -> object:
        if extra := sorted(values.keys() - {f.name for f in fields(kind)}):
            raise ValueError(f"{kind.__name__.lower()} knows no {', '.join(extra)}")
        return kind(**values)

    source = lambda s: made(spec.Source, s | ({"processing": made(spec.Processing, s["processing"])} if s.get("processing") else {}))
    parts = {"sources": {n: source(s) for n, s in payload.get("sources", {}).items()}, "stages": [made(spec.Stage, s) for s in payload.get("stages", [])]}
    if "processing" in payload:
        parts["processing"] = made(spec.Processing, payload["processing"])
    return made(spec.Dataset, payload | parts)


def checked(rows: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """Rows with their ``row_idx`` in order; with a limit, no more than so many are looked at at all."""
    placed = dense_index(rows, [F.col(c) for c in order]).withColumnRenamed("position", "row_idx")
    return placed if limit is None else placed.where(F.col("row_idx") < limit)


class Counted(NamedTuple):
    """Rows that go on, and how many were looked at, by what became of them."""

    rows: DataFrame
    counts: dict[str, int]


def usable(rows: DataFrame, source: spec.Source) -> Counted:
    """Filtered and converted rows with ``row_idx`` and ``text``. Counts tell what was filtered out from
    what couldn't be converted, and orphaned answers from other malformed rows."""
    columns = converters.of(rows)
    verdict = F.lit("passed")
    for name in source.filters:
        verdict = F.when(verdict == "passed", converters.filter_named(name)(columns)).otherwise(verdict)
    convert = converters.resolved(source.converter, source.fields)
    if convert is None and source.kind == "instruct":
        convert = converters.by_fields({f: f for f in converters.FIELDS})
    if convert is None:
        made = rows.select("row_idx", verdict.alias("verdict"), F.struct(converters.text_of(rows, source.text_field).alias("text"), F.lit("ok").alias("status")).alias("to"))
    else:
        made = rows.select("row_idx", verdict.alias("verdict"), convert(columns).alias("to"))
    kept = set(made.schema["to"].dataType.fieldNames())
    blank = F.lit(False)
    if "instruction" in kept:
        blank = ~((T.strip(F.col("to.instruction")) != "") & (T.strip(F.col("to.output")) != ""))
    fate = F.when(F.col("verdict") == "failed", "filtered").when(F.col("verdict") != "passed", F.col("verdict")).when(F.col("to.status") != "ok", F.col("to.status")).when(blank, "required").otherwise("ok")
    made = cut_lineage(made.withColumn("fate", fate))
    counts = {r.fate: r["count"] for r in made.groupBy("fate").count().collect()}
    out = made.where("fate = 'ok'").select("row_idx", "to.*").drop("status")
    if "instruction" in kept:
        inverted = T.input_inversion(F.col("instruction"), F.col("input"), F.col("output"))
        turn = F.conv(F.substring(shuffle_key(1, F.col("row_idx")), 1, 8), 16, 10).cast("bigint") < int(source.input_inversions * (1 << 32))
        row = F.when(turn, inverted).otherwise(F.struct("instruction", "input", "output"))
        out = out.withColumn("_row", row).select("row_idx", "_row.*")
        out = out.withColumn("text", T.instruct_text(F.col("instruction"), F.col("input"), F.col("output")))
    return Counted(out, counts)


def built(rows: DataFrame, source: spec.Source, processing: spec.Processing, max_length: int, order: list[str], benchmarks: DataFrame | None = None, seen: DataFrame | None = None, seed: int = 0) -> Counted:
    """A source's rows through its whole build, with ``row_idx``, ``text``, ``tokens`` and ``hash``.

    ``seen`` holds the hashes of sources admitted before. Instructions over ``max_length`` tokens go,
    documents are cut. Instructions are shuffled by default, documents stay in order (``place``)."""
    found, counts = usable(checked(rows, order, source.check_limit), source)
    if source.kind == "instruct":
        found = found.where(T.estimate_tokens(F.col("text")) + 2 <= max_length)
    else:
        found = found.withColumn("text", T.truncate_estimate(F.col("text"), max_length))
    out = spec.prepared(found, processing, benchmarks=benchmarks)
    if seen is not None:
        out = first_rows(out, "hash", ["row_idx"]).join(seen.select("hash").distinct(), "hash", "left_anti")
    shuffled = source.shuffle if source.shuffle is not None else source.kind == "instruct"
    place = shuffle_key(seed, F.col("row_idx")) if shuffled else F.lpad(F.col("row_idx").cast("string"), 20, "0")
    return Counted(out.withColumn("place", place), counts)


def state_of(manifest: dict | None, readable: bool, identity: str, max_length: int, tokenizer: str) -> tuple[str, str]:
    """(state, reason) of a folder: another identity comes before a raised cap, that before another tokenizer."""
    if not readable:
        return "unreadable", "its manifest can't be read"
    if manifest is None:
        return "missing", "it has no manifest"
    if manifest.get("identity") != identity:
        return "stale", f"identity {manifest.get('identity')} and not {identity}"
    if manifest.get("max_length", max_length) < max_length:
        return "outdated", f"cut at {manifest['max_length']} tokens and not at {max_length}"
    if manifest.get("tokenizer", tokenizer) != tokenizer:
        return "tokenizer_changed", f"counted by {manifest['tokenizer']} and not by {tokenizer}"
    return "current", "nothing to do"


def inspect(spark: SparkSession, path: str, identity: str, max_length: int, tokenizer: str = "estimate") -> tuple[str, str]:
    storage.recover(spark, path)
    text = storage.read_text(spark, f"{path}/MANIFEST.json")
    try:
        manifest = json.loads(text) if text is not None else None
    except ValueError:
        return state_of(None, False, identity, max_length, tokenizer)
    return state_of(manifest, True, identity, max_length, tokenizer)


def good_prefix(listed: list[tuple[str, int]], on_disk: dict[str, int]) -> int:
    """How many of the listed (name, rows) shards are there, whole, from the first on."""
    return next((i for i, (name, rows) in enumerate(listed) if on_disk.get(name) != rows), len(listed))


def repair_plan(state: str, listed: list[tuple[str, int]], on_disk: dict[str, int]) -> list[tuple[str, str]]:
    """(action, what) that makes a folder right: leave, delete, truncate or adopt."""
    if state == "unreadable":
        return [("leave", "a manifest that can't be read is for a person to look at")]
    if state == "missing":
        return [("leave", "nothing is there")] if not on_disk else [("delete", f"{len(on_disk)} shards without a manifest")]
    if state in ("stale", "outdated"):
        return [("delete", f"{len(listed)} shards of another {'cap' if state == 'outdated' else 'identity'}")]
    good = good_prefix(listed, on_disk)
    plan = [("adopt", "the same rows under the new tokenizer's name")] if state == "tokenizer_changed" else []
    if good < len(listed):
        plan.append(("truncate", f"to {good} of {len(listed)} shards") if good else ("delete", "no good shard"))
    plan += [("delete", f"stray {name}") for name in sorted(on_disk.keys() - {n for n, _ in listed})]
    return plan or [("leave", "nothing to do")]


def prepare(spark: SparkSession, data: spec.Dataset, root: str, benchmarks: DataFrame | None = None) -> dict[str, str]:
    """Builds every source whose folder isn't current, by rank; what was done for each."""
    if wrong := data.problems():
        raise ValueError("; ".join(wrong))
    done, seen = {}, None
    for name in sorted(data.sources, key=data.ranks().get):
        source, path, identity = data.sources[name], f"{root}/{name}", data.identity(name)
        state, _ = inspect(spark, path, identity, data.max_length)
        if state != "current" or "built" in done.values():  # keys admitted before may have changed
            rows = readers.read_files(spark, source.path, source.pattern)
            rows = rows.withColumn("_row", F.monotonically_increasing_id())
            found, counts = built(rows, source, source.processing or data.processing, data.max_length, ["file_rank", "_row"], benchmarks, seen)
            if source.rows is not None:
                found = dense_index(found, [F.col("place")]).where(F.col("position") < source.rows).drop("position")
            columns = [c for c in found.columns if c not in ("file_rank", "_row")]
            storage.write_folder(found.select(columns).sort("place"), path, identity=identity, tokens="tokens", extra={"counts": counts, "max_length": data.max_length, "tokenizer": "estimate"})
            done[name] = "built"
        else:
            done[name] = "current"
        kept = storage.read_folder(spark, path).select("hash")
        seen = kept if seen is None else seen.unionByName(kept)
    return done


def status(spark: SparkSession, data: spec.Dataset, root: str) -> list[tuple[str, str, str, int]]:
    """(source, state, reason, rows) of every source."""
    out = []
    for name in data.sources:
        state, reason = inspect(spark, f"{root}/{name}", data.identity(name), data.max_length)
        text = storage.read_text(spark, f"{root}/{name}/MANIFEST.json") if state not in ("missing", "unreadable") else None
        out.append((name, state, reason, json.loads(text)["rows"] if text else 0))
    return out


def snapshot(spark: SparkSession, data: spec.Dataset, root: str) -> str:
    """Publishes SNAPSHOT.json if every source is current; its id is a digest of identities and shards,
    so unchanged content keeps it."""
    late = [f"{n} is {state}" for n, state, *_ in status(spark, data, root) if state != "current"]
    if late:
        raise ValueError("; ".join(late))
    parts = {n: json.loads(storage.read_text(spark, f"{root}/{n}/MANIFEST.json")) for n in data.sources}
    # shard files have new names in every build; their rows and tokens stay
    content = {n: {"identity": m["identity"], "rows": m["rows"], "shards": [(s["rows"], s["tokens"]) for s in m["shards"]]} for n, m in parts.items()}
    name = spec.digest(content)
    storage.write_text(spark, f"{root}/SNAPSHOT.json", json.dumps({"id": name, "sources": content}, sort_keys=True))
    return name


def markdown(columns: list[str], rows: Iterable[tuple]) -> str:
    shown = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([shown(columns), shown("---" for _ in columns), *map(shown, rows)])


def write_report(spark: SparkSession, path: str, sections: dict[str, DataFrame]) -> None:
    """Small results as ``path``.json and as tables in ``path``.md."""
    found = {name: (df.columns, [tuple(r) for r in df.collect()]) for name, df in sections.items()}
    storage.write_text(spark, f"{path}.json", json.dumps({n: [dict(zip(c, r, strict=True)) for r in rows] for n, (c, rows) in found.items()}, default=str, sort_keys=True))
    storage.write_text(spark, f"{path}.md", "\n\n".join(f"## {n}\n\n{markdown(c, rows)}" for n, (c, rows) in found.items()) + "\n")


def inspected(spark: SparkSession, data: spec.Dataset, name: str, path: str, n: int = 20) -> None:
    """A sample of a source after every stage of its build, as a report: the feature is the sample."""
    source = data.sources[name]
    rows = readers.read_files(spark, source.path, source.pattern).withColumn("_row", F.monotonically_increasing_id())
    first = checked(rows, ["file_rank", "_row"], n)
    found = usable(first, source).rows
    after = spec.prepared(found, source.processing or data.processing)
    shown = lambda df: df.select("row_idx", T.preview(F.col("text"), 80).alias("text")).orderBy("row_idx").limit(n)
    write_report(spark, path, {"read": first.select("row_idx").orderBy("row_idx").limit(n), "converted": shown(found), "prepared": shown(after)})


def identities(data: spec.Dataset) -> dict[str, dict]:
    return {n: asdict(s) for n, s in data.sources.items()}
