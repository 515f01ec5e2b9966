"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import preference, quality, secretscan

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _islands(positions: str) -> str:
    """doc_id, n, spans from rows doc_id, p of distinct word positions from 1 on."""
    return f"""i AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM {positions}),
j AS (SELECT doc_id, g, min(p) - 1 AS a, max(p) AS b FROM i GROUP BY ALL),
s AS (SELECT doc_id, sum(b - a)::BIGINT AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM j GROUP BY 1)"""


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, w, least(10, len(w)) AS k FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b))),
h AS (SELECT doc_id, item, i, k FROM dw JOIN bw USING (k, t)),
hp AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM h),
{_islands("hp")},
n AS (SELECT doc_id, count(DISTINCT item)::BIGINT AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(s.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(s.n, 0) > 0 AS contaminated, coalesce(spans, '') AS hit_spans
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id)
"""

DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS t FROM d),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
r(id, to_id) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id),
m AS (SELECT id, min(to_id) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON id = d.doc_id
"""

PASSAGES = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
y AS (SELECT t FROM x GROUP BY 1 HAVING count(*) > 1),
z AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x SEMI JOIN y USING (t)),
{_islands("z")}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)
"""


def _quality() -> str:
    counts = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
y AS (SELECT doc_id, s FROM x GROUP BY ALL HAVING count(*) > 1),
z AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM x SEMI JOIN y USING (doc_id, s)) GROUP BY 1),
c AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, len(list_filter(w, lambda v, i: i > 1 AND v = w[i - 1]))::BIGINT AS n_echo FROM d LEFT JOIN z USING (doc_id)),
"""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS measure, doc_id, lang, source, {f} * {a} // {b} AS x, {p} AS p, {times} AS times, {least} AS least, {lower} AS lower FROM c WHERE {b} > 0" for m, (a, f, b, p, times, least, lower) in quality.MEASURES.items())

    def quantiles(name: str, keys: str) -> str:
        by = f"measure{', ' + keys if keys else ''}"
        return f"""{name} AS (SELECT {by}, any_value(total)::BIGINT AS total, min(v) FILTER (100 * upto >= 25 * total)::BIGINT AS low, min(v) FILTER (100 * upto >= 50 * total)::BIGINT AS mid, min(v) FILTER (100 * upto >= p * total)::BIGINT AS up
FROM (SELECT {by}, v, any_value(p) AS p, sum(count(*)) OVER (PARTITION BY {by} ORDER BY v) AS upto, sum(count(*)) OVER (PARTITION BY {by}) AS total FROM b GROUP BY {by}, v) GROUP BY {by})"""

    def blended(q: str) -> str:
        w = quality.WEIGHT
        return f"(o.total * o.{q} + {w} * ((l.total * l.{q} + {w} * e.{q}) // (l.total + {w}))) // (o.total + {w}) AS {q}"

    return f"""{counts} r AS ({rows}),
b AS (SELECT *, (x >> greatest(length(bin(x)) - {quality.BITS}, 0)::INT) << greatest(length(bin(x)) - {quality.BITS}, 0)::INT AS v FROM r),
{quantiles("o", "lang, source")}, {quantiles("l", "lang")}, {quantiles("e", "")},
f AS (SELECT doc_id, bool_or(x > up + times * greatest(up - mid, least) OR lower AND x < low - times * greatest(mid - low, least)) AS far
  FROM (SELECT b.doc_id, x, times, least, lower, {blended("low")}, {blended("mid")}, {blended("up")} FROM b JOIN o ON b.measure = o.measure AND b.lang IS NOT DISTINCT FROM o.lang AND b.source IS NOT DISTINCT FROM o.source JOIN l ON b.measure = l.measure AND b.lang IS NOT DISTINCT FROM l.lang JOIN e ON b.measure = e.measure) GROUP BY 1)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND NOT coalesce(far, false) AS kept FROM c LEFT JOIN f USING (doc_id)
"""


def _secrets() -> str:
    kinds = []
    for rank, (kind, (pattern, group, least)) in enumerate([*secretscan.BASE.items(), *secretscan.MORE.items()]):
        p = ("(?i)" if kind == "assign" else "") + pattern.pattern.replace("'", "''").replace("++", "+")  # RE2 never goes back, so needs no possessive marks
        # matches lie between the parts that they split the text into
        kinds.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(s[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS a, length(m[i]) AS size, length(g[i]) AS len, {least} AS least
FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS s, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d)""")
    base = "kind IN ('assign', 'access', 'hex')"
    said = "kind || ':' || a || ':' || (a + size)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT doc_id, rank, kind, a::BIGINT AS a, size FROM ({" UNION ALL ".join(kinds)}) WHERE len >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access, count(*) FILTER (kind = 'hex')::BIGINT AS n_hex,
  sha256(coalesce(string_agg({said}, ',' ORDER BY a, rank) FILTER ({base}), '')) AS base_sha256, coalesce(string_agg({said}, ',' ORDER BY a, rank) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN x USING (doc_id) GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": DECONTAMINATION, "op3_preference_pairs": preference.SQL, "op4_secret_scan": _secrets(),
        "op5_near_duplicates": DUPLICATES, "op7_repeated_passages": PASSAGES, "op8_quality_rules": _quality(),
    }
