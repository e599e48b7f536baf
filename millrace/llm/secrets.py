"""Secret scanning with multipart credential linking, in SQL functions only.

Strong findings stay as they are. A weak candidate (a run of mixed case with digits that could be a
key) says little alone; it is reported only when a complementary part, an access identifier or an
endpoint, stands within its scope. An interval join of the parts finds that: for every secret, weak or
strong, the nearest identifier and the nearest endpoint within the scope make a link.

Defined results: a null text counts as empty; a text without findings gives empty spans; a weak
candidate that overlaps a strong finding isn't reported; of parts at the same distance the leftmost is
linked, of those the shorter; repeated rows each get their result; other columns of the input play no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import cut_lineage

#: Fixed patterns of the strong kinds in their order; which group's length counts; its least length.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What a text must hold for a kind to be looked for at all.
GUARDS = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: A run that could be a key, if it holds an upper-case letter, a lower-case letter and a digit.
WEAK = r"[A-Za-z0-9+/_-]{24,}"
#: Where a credential would be used.
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~:@-]+"
#: Parts belong together if at most so many code points lie between them.
SCOPE = 256

SPANS = "array<struct<start:int,end:int>>"
LINKS = "array<struct<start:int,rank:int,end:int,kind:string,access:struct<start:int,end:int>,endpoint:struct<start:int,end:int>>>"
#: Matches that one fold gathers; its array is copied at each.
CHUNK = 128


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column], guard: str | None = None) -> Column:
    """(start, end) in code points of the leftmost non-overlapping matches that ``keep`` accepts.

    The lengths of the matches and of what lies between them give the offsets. A text without
    ``guard`` (by default the pattern) has none and is not cut up.
    """
    none = F.array().cast(SPANS)
    steps = F.zip_with(
        F.split(text, pattern),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("len"), keep(hit).alias("keep")),
    )

    def walk(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        end = begin + F.coalesce(s["len"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["keep"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def gathered(steps: Column) -> Column:
        """Chunks of matches are gathered on their own, each from where those before it end."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda i: F.slice(steps, i * CHUNK + 1, F.lit(CHUNK)))
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["gap"] + F.coalesce(s["len"], F.lit(0))))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(lengths, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, begins, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("out")), walk, lambda acc: acc["out"])))

    return F.when(F.regexp_like(text, F.lit(guard or pattern)), F.element_at(F.transform(F.array(steps), gathered), 1)).otherwise(none)


def strong_spans(text: Column) -> dict[str, Column]:
    def kept(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
        return lambda hit: F.char_length(F.regexp_extract(hit, pattern, group) if group else hit) >= least

    return {kind: match_spans(text, p, kept(p, group, least), GUARDS.get(kind)) for kind, p, group, least in KINDS}


def mixed(hit: Column) -> Column:
    return hit.rlike("[A-Z]") & hit.rlike("[a-z]") & hit.rlike("[0-9]")


def labelled(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    """kind:start:end by start, then by the order of the kinds, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: the id, ``strong`` and ``linked`` spans (start, rank, end, kind), and
    ``links``: each secret's span with its nearest access identifier and endpoint (null where none).

    One pass over the texts; what is shuffled afterwards are spans only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text).alias("key"),
        *(c.alias(kind) for kind, c in strong_spans(text).items()),
        match_spans(text, WEAK, mixed).alias("weak"),
        match_spans(text, ENDPOINT, lambda hit: hit.isNotNull(), "://").alias("endpoint"),
    )
    parts = cut_lineage(parts)
    ranks = {kind: i for i, kind in enumerate([kind for kind, *_ in KINDS] + ["weak"])}
    secrets = {"assign": ranks["assign"], "hex": ranks["hex"], "weak": ranks["weak"]}
    found = (F.size("assign") + F.size("hex") + F.size("weak") > 0) & (F.size("access") + F.size("endpoint") > 0)
    both = parts.where(found).dropDuplicates(["id", "key"])  # equal texts of an id are linked once
    # cells of one scope's length make the interval join an equality join; parts don't overlap within a
    # kind, so a cell holds a bounded number of them
    tagged = lambda kinds: F.concat(*(labelled(F.col(k), k, ranks[k] if k in ranks else -1) for k in kinds))
    near = both.select("id", "key", F.explode(tagged(["access", "endpoint"])).alias("p"))
    near = near.withColumn("cell", F.explode(F.sequence((F.col("p.start") / scope).cast("int"), (F.col("p.end") / scope).cast("int"))))
    cand = both.select("id", "key", F.explode(tagged(secrets)).alias("w"))
    cand = cand.withColumn("cell", F.explode(F.sequence((F.col("w.start") / scope).cast("int") - 1, (F.col("w.end") / scope).cast("int") + 1)))
    far = F.greatest(F.lit(0), F.col("n.p.start") - F.col("c.w.end"), F.col("c.w.start") - F.col("n.p.end"))
    nearest = lambda kind: F.min(F.when(F.col("p.kind") == kind, F.struct("far", "p.start", "p.end")))
    span = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end")))
    linked = (
        cand.alias("c")
        .join(near.alias("n"), F.col("c.id").eqNullSafe(F.col("n.id")) & (F.col("c.key") == F.col("n.key")) & (F.col("c.cell") == F.col("n.cell")))
        .where((F.col("n.p.start") <= F.col("c.w.end") + scope) & (F.col("n.p.end") >= F.col("c.w.start") - scope))
        .select(F.col("c.id").alias("l_id"), F.col("c.key").alias("l_key"), "c.w", "n.p", far.alias("far"))
        .groupBy("l_id", "l_key", "w")
        .agg(nearest("access").alias("a"), nearest("endpoint").alias("e"))
        .select("l_id", "l_key", F.struct("w.start", "w.rank", "w.end", "w.kind", span("a").alias("access"), span("e").alias("endpoint")).alias("link"))
        .groupBy("l_id", "l_key")
        .agg(F.collect_list("link").alias("links"))
    )
    strong = F.concat(*(labelled(F.col(kind), kind, i) for i, (kind, *_) in enumerate(KINDS)))
    clear = F.filter("links", lambda w: (w["kind"] != "weak") | ~F.exists("_base", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return (
        parts.withColumn("_base", strong)
        .join(linked, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("key") == F.col("l_key")), "left")
        .withColumn("links", F.coalesce(clear, F.array().cast(LINKS)))
        .withColumn("linked", F.transform(F.filter("links", lambda w: w["kind"] == "weak"), lambda w: F.struct(w["start"].alias("start"), w["rank"].alias("rank"), w["end"].alias("end"), w["kind"].alias("kind"))))
        .select("id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS), F.col("_base").alias("strong"), "linked", "links")
    )


def written_links(links: Column) -> Column:
    """kind:start:end, then >access:start:end and >endpoint:start:end where there are such; comma-joined."""
    tail = lambda w, kind: F.when(w[kind].isNotNull(), F.concat(F.lit(f">{kind}:"), F.concat_ws(":", w[kind]["start"], w[kind]["end"])))
    line = lambda w: F.concat_ws("", F.concat_ws(":", w["kind"], w["start"], w["end"]), tail(w, "access"), tail(w, "endpoint"))
    return F.array_join(F.transform(F.array_sort(links), line), ",")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's spans."""
    return found.select(
        F.col("id").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(written(F.col("strong")), 256).alias("base_sha256"),
        written(F.concat("strong", "linked")).alias("spans"),
        F.size("linked").cast("long").alias("n_weak"),
        written_links(F.col("links")).alias("links"),
    )
