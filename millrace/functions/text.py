"""Column expressions over text: words, n-grams, normal forms, keys, cuts and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: Fixed: every code point of Unicode white space, as a Java character class.
SPACES = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def bound(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once, although it is used several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(items: Column) -> Column:
    """A row for each member of an array that is costly to make. ``explode`` would let Spark filter empty
    arrays first and make every array twice; a null row of an empty one is left to the caller."""
    return F.explode_outer(items)


def words(text: Column) -> Column:
    """Words of a text between any white space."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def normalize_text(text: Column) -> Column:
    """Lower case, one blank between words, none at the ends."""
    return F.array_join(words(F.lower(text)), " ")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def ngrams(items: Column, n: int) -> Column:
    """Runs of ``n`` words, in order, with repeats; none where there are fewer words."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
    return bound(items, lambda w: F.when(F.size(w) >= n, grams(w)).otherwise(F.array().cast("array<string>")))


def ngram_hashes(items: Column, n: int) -> Column:
    """64-bit hashes of the n-grams, in order, with repeats: words are hashed once each, hashes of runs
    are made from those of runs half as long, and no strings are joined. Two n-grams of a table of a
    billion meet by chance with a probability of 0.03 in all."""
    none = F.array().cast("array<bigint>")

    def of_runs(levels: list[Column], size: int) -> Column:
        if 2 * size <= n:
            last = levels[-1]
            return bound(F.transform(last, lambda x, i: F.xxhash64(x, F.get(last, i + size))), lambda g: of_runs([*levels, g], 2 * size))
        at = [(level, sum(1 << j for j in range(k + 1, len(levels)) if n >> j & 1)) for k, level in enumerate(levels) if n >> k & 1]
        starts = lambda: F.sequence(F.lit(0), F.size(levels[0]) - n)
        return F.when(F.size(levels[0]) >= n, F.transform(starts(), lambda i: F.xxhash64(*(F.get(level, i + skip) for level, skip in reversed(at))))).otherwise(none)

    return bound(F.transform(items, lambda w: F.xxhash64(w)), lambda h: of_runs([h], 1))


def ngram_set(text: Column, n: int = 13) -> Column:
    """Hashes of the distinct n-grams of the normal form."""
    return F.array_distinct(ngram_hashes(words(F.lower(text)), n))


def unique_ratio(items: Column) -> Column:
    return bound(items, lambda x: F.size(F.array_distinct(x)) / F.size(x))


def signed_prefix(hex_digest: Column) -> Column:
    """The first 8 bytes of a digest as a signed big-endian number."""
    return F.conv(F.substring(hex_digest, 1, 16), 16, -10).cast("bigint")


def text_hash64(text: Column, normalize: bool = True) -> Column:
    return signed_prefix(F.md5(normalize_text(text) if normalize else text))


def global_key(kind: str, *fields: Column) -> Column:
    """A key over a kind and its normalized fields; null equals empty, kinds never meet."""
    parts = [F.lit(kind), *(normalize_text(F.coalesce(f, F.lit(""))) for f in fields)]
    return signed_prefix(F.sha2(F.concat_ws("\u001f", *parts), 256))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / 4).cast("bigint")


def truncate_estimate(text: Column, cap: int) -> Column:
    """A prefix of at most ``cap`` estimated tokens; two of them are kept for begin and end marks."""
    if cap < 2:
        raise ValueError("the cap must leave room for the two marks")
    return F.substring(text, 1, 4 * (cap - 2))


def instruct_text(instruction: Column, given: Column, output: Column) -> Column:
    given = strip(F.coalesce(given, F.lit("")))
    return F.concat_ws("\n\n", strip(instruction), F.when(given != "", given), strip(output))


def input_inversion(instruction: Column, given: Column, output: Column) -> Column:
    """Asks for the instruction given the output; as it was where either is missing."""
    missing = (F.coalesce(instruction, F.lit("")) == "") | (F.coalesce(output, F.lit("")) == "")
    asked = F.concat(F.lit("Given this output, what was the likely instruction or input?\n\nOutput: "), output)
    told = F.when(F.coalesce(given, F.lit("")) != "", F.concat(instruction, F.lit("\nInput: "), given)).otherwise(instruction)
    row = lambda a, b, c: F.struct(a.alias("instruction"), b.alias("input"), c.alias("output"))
    return F.when(missing, row(instruction, given, output)).otherwise(row(asked, F.lit(""), told))


def has_required_fields(instruction: Column, output: Column) -> Column:
    filled = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    return filled(instruction) & filled(output)


def language_slug(name: Column) -> Column:
    named = F.replace(F.replace(F.lower(name), F.lit("#"), F.lit("sharp")), F.lit("+"), F.lit("p"))
    return F.regexp_replace(F.regexp_replace(named, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def repo_source_name(repo: Column, language: Column) -> Column:
    """Name of a source split off from a repository by language."""
    return F.concat_ws("_", language_slug(F.substring_index(repo, "/", -1)), language_slug(language))


def example_text(fields: list[Column], lists: list[Column]) -> Column:
    """All strings of an example joined by blanks: its fields, then the members of its lists."""
    return F.concat_ws(" ", *fields, *lists)


def doc_strings(value: Column, kind: DataType) -> Column:
    """Every string inside a nested value, depth first: fields, members and values in their order."""
    none = F.array().cast("array<string>")
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(value)).otherwise(none)
    if isinstance(kind, StructType):
        return F.concat(none, *(doc_strings(value[f.name], f.dataType) for f in kind.fields))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: doc_strings(x, kind.elementType))), none)
    if isinstance(kind, MapType):
        return doc_strings(F.map_values(value), ArrayType(kind.valueType))
    return none


def preview(text: Column, chars: int = 200) -> Column:
    return F.substring(F.array_join(words(text), " "), 1, chars)


def glob_prefix(pattern: Column) -> Column:
    """The literal beginning of a glob."""
    return F.regexp_extract(pattern, r"^[^*?\[]*", 0)


def quality_reason(text: Column) -> Column:
    """The first rule of prose quality that a text fails, or ``passed``."""
    long_sentences = F.filter(F.split(text, "[.!?]+"), lambda s: (F.char_length(s) > 10) & (F.char_length(strip(s)) > 10))
    upper = lambda w: (F.char_length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))
    plain = F.char_length(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{SPACES}]", ""))

    def by_words(w: Column) -> Column:
        return (
            F.when(F.size(w) == 0, "no_words")
            .when(F.size(F.filter(w, upper)) / F.size(w) > 0.3, "too_many_caps")
            .when(plain / F.char_length(text) < 0.25, "too_few_alphanumeric_or_space")
            .when((F.size(w) > 10) & (unique_ratio(ngram_hashes(w, 2)) < 0.7), "too_repetitive_bigrams")
            .when((F.size(w) > 20) & (unique_ratio(ngram_hashes(w, 3)) < 0.8), "too_repetitive_trigrams")
            .otherwise("passed")
        )

    return F.when(F.char_length(text) < 10, "too_short").when(F.size(long_sentences) < 3, "too_few_sentences").otherwise(bound(words(text), by_words))
