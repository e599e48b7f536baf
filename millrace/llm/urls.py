"""URL filtering: host and path rules first, then a weighted vocabulary over an automaton.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.
Where no rule fits, one strict term or several distinct soft terms, standing alone between
boundaries (no letter or digit beside them), block the url.

Defined results: a null url, or one without "://", has an empty host and path and no hits, and is
allowed; repeated rows each get their result; other columns are kept aside unless they clash with
the added ones, which then win.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower

#: Fixed vocabulary: a strict term suffices on its own, soft ones count when several differ.
STRICT = ("casino", "casinos", "porn", "porno", "xxx", "hentai", "viagra", "cialis", "adult", "escort", "escorts", "jackpot", "camgirl", "camgirls")
SOFT = (
    "ads", "adserver", "bet", "bets", "betting", "bonus", "cheap", "click", "coupon", "crack", "dating", "discount", "farm", "free", "gambling",
    "hot", "keygen", "loan", "loans", "lottery", "nude", "payday", "pharmacy", "pill", "pills", "poker", "replica", "sex", "sexy", "slots",
    "spam", "track", "tracker", "tracking", "warez", "win", "winner",
)
#: Distinct soft terms that block together.
SOFT_HITS = 2


def scorer(strict: Iterable[str], soft: Iterable[str]) -> Callable[[str], tuple[int, int]]:
    """Counts the distinct strict and soft terms of a lower-cased text."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):
        for term in terms:
            machine.add_word(term, (kind, term))
    machine.make_automaton()

    def score(text: str) -> tuple[int, int]:
        found: tuple[set, set] = (set(), set())
        for end, (kind, term) in machine.iter(text):
            begin = end - len(term)
            if (begin < 0 or not text[begin].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                found[kind].add(term)
        return len(found[0]), len(found[1])

    return score


def rule_finder(rules: Iterable[tuple[str, str, str]]) -> Callable[[str, str], tuple[str | None, str | None]]:
    """The longest rule that fits a host and path, looked up by the host's suffixes."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))

    def find(host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while host:
            suffix = host[at:]
            for begin, verdict in by_host.get(suffix, ()):
                if path.startswith(begin) and len(suffix + begin) > len(best[0] or ""):
                    best = suffix + begin, verdict
            at = host.find(".", at) + 1
            if not at:
                break
        return best

    return find


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """Adds host, path, rule, verdict, strict_hits and soft_hits. Rules are (host, path, allow or
    block); they and the terms are parameters, sent with the function."""
    rules, strict, soft = list(rules), list(strict), list(soft)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "_judged")]
    url = F.coalesce(F.col(url_col), F.lit(""))

    @F.pandas_udf("rule string, verdict string, strict_hits int, soft_hits int")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find, score = rule_finder(rules), scorer(strict, soft)  # once for each task
        for urls, hosts, paths in batches:
            out = []
            for text, host, path in zip(urls, hosts, paths, strict=True):
                rule, verdict = find(host, path)
                hard, mild = score(text) if host or path else (0, 0)
                out.append((rule, verdict or ("block" if hard or mild >= soft_hits else "allow"), hard, mild))
            yield pd.DataFrame(out, columns=["rule", "verdict", "strict_hits", "soft_hits"])

    host = ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return (
        pages.select(*kept, host.alias("host"), path.alias("path"), F.lower(url).alias("_url"))
        .withColumn("_judged", judged("_url", "host", "path"))
        .select(*kept, "host", "path", "_judged.rule", "_judged.verdict", "_judged.strict_hits", "_judged.soft_hits")
    )
