"""SQL pieces shared by the oracles of several groups."""

from __future__ import annotations

from sparkcurate.functions.text import ENGLISH_WORDS, KEYWORD_STOP_WORDS, QUERY_STOP_WORDS

SPACES = "||".join(f"chr({n})" for n in (32, 9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160))


def strip(x):
    return f"trim({x}, {SPACES})"


def words(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def english(x):
    script = r"[\x{0400}-\x{04FF}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0600}-\x{06FF}\x{0900}-\x{097F}]"
    return (
        f"(length({x}) < 20 OR (len(regexp_extract_all({x}, '{script}')) <= length({x}) * 0.05 AND "
        rf"regexp_matches({x}, '(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(ENGLISH_WORDS)})($|[^\p{{L}}\p{{N}}_])')))"
    )


def last_sentences(x):
    """Split before a capital after a sentence end; chr(1) marks the places."""
    parts = f"string_split(regexp_replace({strip(x)}, '([.!?])\\s+([A-Z])', '\\1'||chr(1)||'\\2', 'g'), chr(1))"
    return f"CASE WHEN len({parts}) <= 2 THEN {strip(x)} ELSE array_to_string({parts}[-2:], ' ') END"


def query_rows(source, key, text, name="qw"):
    """CTEs ending in ``name``: (k, query) with the five longest distinct words of every text.

    Only rows with at least one such word appear.
    """
    x = rf"regexp_replace({text}, '\$[^$]+\$', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?s)\\\[.*?\\\]', ' ', 'g')"
    x = rf"regexp_replace({x}, '\\[a-zA-Z]+\{{[^}}]*\}}', ' ', 'g')"
    x = rf"regexp_replace({x}, '\\[a-zA-Z]+', ' ', 'g')"
    x = rf"regexp_replace(lower(regexp_replace({x}, '[{{}}_^<>\\|]', ' ', 'g')), '[^a-z\s]', ' ', 'g')"
    return f"""
{name}_s AS MATERIALIZED (SELECT {key} AS k, regexp_split_to_array({x}, '\\s+') AS ws FROM {source}),
{name}_t AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM {name}_s),
{name}_d AS (SELECT k, w, min(i) AS i FROM {name}_t WHERE length(w) > 2 AND w NOT IN ({", ".join(f"'{v}'" for v in QUERY_STOP_WORDS)}) GROUP BY k, w),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(w) DESC, i) AS rn FROM {name}_d),
{name} AS MATERIALIZED (SELECT k, string_agg(w, ' ' ORDER BY rn) AS query FROM {name}_r WHERE rn <= 5 GROUP BY k)"""


STOP = words(KEYWORD_STOP_WORDS)


def keyword_rows(source, key, text):
    """CTEs ending in ``kw``: (key, w, rn) with the top ten keywords of every text."""
    return f"""
tok AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[a-z]{{3,}}')) AS w,
        generate_subscripts(regexp_extract_all(lower({text}), '[a-z]{{3,}}'), 1) AS i FROM {source}),
cnt AS (SELECT k, w, count(*) AS n, min(i) AS i FROM tok WHERE NOT list_contains({STOP}, w) GROUP BY k, w),
kw AS MATERIALIZED (SELECT k, w, rn FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, i) AS rn FROM cnt) WHERE rn <= 10)"""


def et_al(authors):
    return f"array_to_string({authors}[1:3], ', ')||CASE WHEN len({authors}) > 3 THEN ' et al.' ELSE '' END"


def chunked(source, key, text, size, sep, limit=None):
    """CTEs ending in ``ch``: (k, idx, total, plain) by folding over paragraph lengths."""
    size_sql = f"CASE WHEN length({text}) > {limit} THEN {size} ELSE 2147483647 END" if limit else str(size)
    return f"""
par AS (SELECT {key} AS k, {size_sql} AS lim, string_split({text}, {sep}) AS p FROM {source}),
fol AS (SELECT k, p, list_reduce(p, lambda a, x: CASE WHEN a.n > 0 AND a.f + length(x) > lim
   THEN {{'s': list_append(a.s, a.n), 'f': length(x)::BIGINT, 'n': a.n + 1}}
   ELSE {{'s': a.s, 'f': a.f + length(x) + length({sep}), 'n': a.n + 1}} END, {{'s': [0::BIGINT], 'f': 0::BIGINT, 'n': 0::BIGINT}}).s AS s FROM par),
cut AS (SELECT k, p, s, unnest(generate_series(1, len(s))) AS idx FROM fol),
ch AS MATERIALIZED (SELECT k, idx, len(s) AS total, array_to_string(p[s[idx] + 1 : coalesce(s[idx + 1], len(p))], {sep}) AS plain FROM cut)"""
