"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL functions only.

Every shingle whose hash lies below a fixed fraction of the range is kept, so the sketch of a union
is the union of the sketches and the containment of a short text in a long one can be estimated.
The smallest hash is always kept as well (the smallest of a union is the smallest of the smallest),
so that only texts without words have an empty sketch.

Defined results: null and blank texts have the empty sketch; two empty sketches are alike (1.0), and
an empty one is contained in any; a text of fewer words than a shingle is one shingle; ids may be of any
type that has an order; rows that tie on the id are ordered by the xxhash64 of their texts, descending
like the ids, and null ids come last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, word_array
from millrace.scratch import cut_lineage, dispose


SHINGLE = 5
#: Hashes are md5 in hex; those below this prefix are kept: an eighth of the range.
BELOW = "2"
#: Hex digits kept of each hash.
DIGITS = 16


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """md5 prefixes of all shingles of ``size`` lower-cased words, in order."""
    words = word_array(ascii_lower(text))

    def over(w: Column) -> Column:
        last = F.greatest(F.size(w) - (size - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, size), " ")), 1, DIGITS))

    # the words are bound once: the inner lambda reads them as a variable
    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(over(w)))
    return F.element_at(bound, 1)


def sketch(text: Column, size: int = SHINGLE, below: str = BELOW) -> Column:
    """Sorted distinct hashes below the threshold, and the smallest of all."""
    bound = F.transform(
        F.array(shingle_hashes(text, size)),
        lambda h: F.array_sort(F.array_distinct(F.concat(F.filter(h, lambda x: x < below), F.filter(F.array(F.array_min(h)), lambda x: x.isNotNull())))),
    )
    return F.element_at(bound, 1)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of two texts."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(total == 0, F.lit(1.0)).otherwise(common / total)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of the first text that the second has too."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, below: str = BELOW) -> Column:
    """The sketch of both texts together."""
    union = F.array_sort(F.array_union(a, b))
    return F.filter(union, lambda h, i: (i == 0) | (h < below))


def written(hashes: Column) -> Column:
    return F.array_join(hashes, ",")


#: Rows of a cell, as long as there are at most so many cells.
CELL_ROWS, MOST_CELLS = 2000, 200_000


def cell_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of the n sorted bounds are at most the key, found by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(at: Column, b: Column, k: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        up = (at["lo"] < at["hi"]) & (F.get(b, mid) <= k)
        return F.struct(F.when(up, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(up, at["hi"]).otherwise(mid).alias("hi"))

    rounds = F.array(*(F.lit(i) for i in range(n.bit_length() + 1)))
    # the key is bound once: the inner lambda reads it as a variable
    return F.element_at(F.transform(F.array(key), lambda k: F.aggregate(rounds, start, lambda at, _: halve(at, bounds, k))["lo"]), 1)


def id_cells(rows: DataFrame) -> tuple[DataFrame, Column]:
    """From (id, tie, turn): each cell's first (id, tie), descending, and the expression of the cell.

    Cells are ranges of (id, tie, turn) with about the same number of rows whatever the ids are:
    they come from Spark's range partitioning of these narrow keys. ``turn`` only parts equal rows.
    """
    keys = cut_lineage(rows.select(F.struct("id", "tie", "turn").alias("key")))
    cells = max(1, min(MOST_CELLS, keys.count() // CELL_ROWS))
    parts = keys.repartitionByRange(cells, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"), F.max("key").alias("top"))
    parts = cut_lineage(parts)
    found = parts.agg(F.array_sort(F.collect_list("key")).alias("b"))
    shape = found.schema["b"].dataType
    written_, n = found.select(F.to_json("b", {"ignoreNullFields": "false"}), F.size("b")).first()
    dispose(keys)
    bounds = F.from_json(F.lit(written_), shape)
    cell = lambda key: cell_of(key, bounds, n)
    return parts.select(cell(F.col("key")).alias("cell"), F.col("top.id").alias("f_id"), F.col("top.tie").alias("f_tie")), cell(F.struct("id", "tie", "turn"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, below: str = BELOW) -> DataFrame:
    """Each row's sketch, its text after the edit (its latter half replaced by the beginning of the
    next document's) and that text's sketch, and the next document's sketch.

    The next document is found without an order over the whole table: ranges of ids (cells) are
    ordered on their own, so texts move once. Each cell's first row, sent along as a table of at
    most MOST_CELLS rows of ids, also follows the last row of the cell before it, in a ring.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("turn"))
    firsts, cell = id_cells(rows)
    rows = rows.withColumn("cell", cell).drop("turn")
    every = Window.orderBy(F.col("cell").desc())  # a row for each cell
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(F.coalesce(F.lag("cell").over(every), F.last("cell").over(whole)).alias("follows"), "f_id", "f_tie")
    shown = sketch(F.col("text"), size, below)
    borders = (
        rows.join(F.broadcast(firsts), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("tie") == F.col("f_tie")))
        .dropDuplicates(["follows"])
        .select("follows", F.col("text").alias("b_text"), shown.alias("b_print"))
    )
    within = Window.partitionBy("cell").orderBy(F.col("id").desc_nulls_last(), F.col("tie").desc())
    lined = rows.withColumn("print", shown).select(
        "*", F.lead("tie").over(within).alias("n_tie"), F.lead("text").over(within).alias("n_text"), F.lead("print").over(within).alias("n_print")
    )
    last = F.col("n_tie").isNull()
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    return (
        lined.join(borders, F.col("cell") == F.col("follows"))
        .withColumn("next_print", F.when(last, F.col("b_print")).otherwise(F.col("n_print")))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.when(last, F.col("b_text")).otherwise(F.col("n_text")), F.lit(1), half)))
        .withColumn("edited_print", sketch(F.col("edited"), size, below))
        .select("id", "text", n.alias("n"), "print", "edited", "edited_print", "next_print")
    )


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's."""
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"),
        written(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print")).alias("near_edited"),
        resemblance(F.col("print"), F.col("next_print")).alias("near_next"),
        containment(F.col("print"), F.col("edited_print")).alias("in_edited"),
        containment(F.col("print"), F.col("next_print")).alias("in_next"),
    )
