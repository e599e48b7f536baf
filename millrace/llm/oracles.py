"""DuckDB SQL of the operator queries that SQL can express, as plainly as it can be said."""

from __future__ import annotations

from millrace.llm import fingerprints, secrets, urls

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def reach(nodes: str, links: str) -> str:
    """Components by following links (a, b) from every node."""
    return f"""reached(a, b) AS (
  SELECT id, id FROM {nodes} UNION SELECT r.a, l.b FROM reached r JOIN {links} l ON r.b = l.a
), comp AS (SELECT a AS id, min(b) AS component_id FROM reached GROUP BY a)"""


EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, CASE WHEN embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e
  FROM embeddings
), links AS (
  SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id <> q.id
  WHERE p.e IS NOT NULL AND q.e IS NOT NULL AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.98
), {reach("v", "links")}
SELECT v.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, v.id = component_id AS kept
FROM v JOIN comp USING (id) LEFT JOIN (SELECT a AS id, count(*) AS n FROM links GROUP BY a) USING (id)
"""

MINHASH = f"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UP}', '{LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingles FROM w
), x AS (SELECT id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT p.id AS a, q.id AS b FROM x p JOIN x q ON p.shingle = q.shingle AND p.id <> q.id
  GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), {reach("s", "links")}
SELECT s.id AS doc_id, len(shingles)::BIGINT AS n_shingles, component_id, s.id = component_id AS kept FROM s JOIN comp USING (id)
"""


def spans(name: str, pattern: str, least: str) -> str:
    """Spans of a pattern: its matches and what lies between them give the offsets; ``least`` tells
    from h, a match, whether it counts."""
    hits, gaps = f"regexp_extract_all(text, {quoted(pattern)})", f"string_split_regex(text, {quoted(pattern)})"
    at = "coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0)"
    return f"""{name} AS (
  SELECT id, [{{'s': ({at})::BIGINT, 'e': (({at}) + length(hits[i]))::BIGINT}} FOR i IN range(1, len(hits) + 1) IF list_filter([hits[i]], lambda h: {least}) <> []] AS {name}
  FROM (SELECT id, {hits} AS hits, {gaps} AS gaps FROM d)
)"""


def secret_sql() -> str:
    kinds = []
    for kind, pattern, group, least in secrets.KINDS:
        h = f"regexp_extract(h, {quoted(pattern)}, {group})" if group else "h"
        kinds.append(spans(kind, pattern, f"length({h}) >= {least}"))
    mixed = "regexp_matches(h, '[A-Z]') AND regexp_matches(h, '[a-z]') AND regexp_matches(h, '[0-9]')"
    kinds += [spans("weak", secrets.WEAK, mixed), spans("endpoint", secrets.ENDPOINT, "true")]
    base = " UNION ALL ".join(f"SELECT id, unnest({k}) AS p, {i} AS r, '{k}' AS k FROM {k}" for i, (k, *_) in enumerate(secrets.KINDS))
    far = secrets.SCOPE
    return f"""
WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
{", ".join(kinds)},
base AS (SELECT id, p.s AS s, p.e AS e, r, k FROM ({base})),
part AS (SELECT id, k, p.s AS s, p.e AS e FROM (SELECT id, 'access' AS k, unnest(access) AS p FROM access UNION ALL SELECT id, 'endpoint', unnest(endpoint) FROM endpoint)),
secret AS (SELECT id, s, e, r, k FROM base WHERE k IN ('assign', 'hex') UNION ALL SELECT id, p.s, p.e, 3, 'weak' FROM (SELECT id, unnest(weak) AS p FROM weak) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = w.id AND b.s < w.p.e AND w.p.s < b.e)),
link AS (
  SELECT w.id, w.s, w.e, w.r, w.k, min({{'f': greatest(0, c.s - w.e, w.s - c.e), 's': c.s, 'e': c.e}}) FILTER (c.k = 'access') AS a,
    min({{'f': greatest(0, c.s - w.e, w.s - c.e), 's': c.s, 'e': c.e}}) FILTER (c.k = 'endpoint') AS p
  FROM secret w JOIN part c ON c.id = w.id AND c.s <= w.e + {far} AND c.e >= w.s - {far} GROUP BY ALL
),
linked AS (SELECT id, s, e, r, k FROM link WHERE k = 'weak'),
l AS (SELECT id, string_agg(k || ':' || s || ':' || e || coalesce('>access:' || a.s || ':' || a.e, '') || coalesce('>endpoint:' || p.s || ':' || p.e, ''), ',' ORDER BY s, r, e) AS line FROM link GROUP BY id),
b AS (SELECT id, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) AS line, count(*) FILTER (k = 'assign') AS n_assign,
  count(*) FILTER (k = 'access') AS n_access, count(*) FILTER (k = 'hex') AS n_hex FROM base GROUP BY id),
a AS (SELECT id, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r) AS line, count(*) FILTER (k = 'weak') AS n_weak
  FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY id)
SELECT d.id AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.line, '')) AS base_sha256, coalesce(a.line, '') AS spans, coalesce(n_weak, 0) AS n_weak,
  coalesce(l.line, '') AS links
FROM d LEFT JOIN b USING (id) LEFT JOIN a USING (id) LEFT JOIN l USING (id)
"""


def sketch_sql(text: str) -> str:
    size, below, digits = fingerprints.SHINGLE, fingerprints.BELOW, fingerprints.DIGITS
    words = f"list_filter(string_split_regex(translate({text}, '{UP}', '{LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    shingles = f"""list_transform([{words}], lambda w: CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END)[1]"""
    hashes = f"list_transform({shingles}, lambda s: substr(md5(s), 1, {digits}))"
    return f"list_transform([{hashes}], lambda h: list_sort(list_distinct(list_concat(list_filter(h, lambda x: x < '{below}'), list_filter([list_min(h)], lambda x: x IS NOT NULL)))))[1]"


def likeness_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END::DOUBLE"


def contained_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / len({a}) END::DOUBLE"


FINGERPRINTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS after FROM d
), e AS (
  SELECT *, length(text) AS n_chars, substring(text, 1, length(text) - length(text) // 2) || substring(after, 1, length(text) // 2) AS edited FROM n
), f AS (SELECT *, {sketch_sql("text")} AS f, {sketch_sql("edited")} AS g, {sketch_sql("after")} AS h FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(f, ',') AS fingerprint, array_to_string(g, ',') AS edited_fingerprint,
  {likeness_sql("f", "g")} AS near_edited, {likeness_sql("f", "h")} AS near_next, {contained_sql("f", "g")} AS in_edited, {contained_sql("f", "h")} AS in_next FROM f
"""


def url_sql(rules: tuple[tuple[str, str, str], ...]) -> str:
    listed = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(v)})" for h, p, v in rules)
    edge = r"[^\p{L}\p{N}]"

    def hits(terms: tuple[str, ...]) -> str:
        return f"coalesce(list_sum(list_transform([{', '.join(map(quoted, terms))}], lambda t: regexp_matches(u, '(^|{edge})' || t || '($|{edge})')::INT)), 0)::INT"

    return f"""
WITH r(h, p, v) AS (VALUES {listed}),
u AS (
  SELECT page_id, lower(coalesce(url, '')) AS u, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UP}', '{LOW}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), f AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS said FROM u JOIN r
  ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id
), t AS (
  SELECT *, CASE WHEN host || path = '' THEN 0 ELSE {hits(urls.STRICT)} END AS strict_hits, CASE WHEN host || path = '' THEN 0 ELSE {hits(urls.SOFT)} END AS soft_hits FROM u
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN strict_hits > 0 OR soft_hits >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits
FROM t LEFT JOIN f USING (page_id)
"""


#: (host, path, verdict) of the URL rules that the query applies.
URL_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": EMBEDDINGS,
    "op3_minhash_dedup": MINHASH,
    "op4_secret_scan": secret_sql(),
    "op5_document_fingerprints": FINGERPRINTS,
    "op9_url_filter": url_sql(URL_RULES),
}
