"""Checks of tag validation, healing, filtering, statistics, sampling and training texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import table, view, with_views
from sparkcurate.config import (
    PHYSICS_PLAIN_TEXT_PATTERNS,
    QUANTUM_TOPICS,
    DomainCheck,
    FieldMapping,
    Rules,
    SftConfig,
    SplitRatios,
    Task,
)
from sparkcurate.functions import tags as T
from sparkcurate.functions import text as X
from sparkcurate.functions import validation as V
from sparkcurate.operators import ranking, stats
from sparkcurate.operators.evaluation import trial_summary
from sparkcurate.operators.filtering import heal_samples
from sparkcurate.plans import samples as P

QUERIES, ORACLE = {}, {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


# --- SQL building blocks ---------------------------------------------------------------------

NL = "chr(10)"
SPACES = "||".join(f"chr({n})" for n in (32, 9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160))


def strip(x):
    return f"trim({x}, {SPACES})"


def rstrip(x):
    return f"rtrim({x}, {SPACES})"


def has(x, tag):
    return f"contains(lower({x}), '{tag}')"


def count(x, tag):
    return f"len(regexp_extract_all({x}, '(?i){tag}'))"


def block(x, tag, flags="is"):
    return (
        f"CASE WHEN regexp_matches({x}, '(?{flags})<{tag}>.*?</{tag}>') "
        f"THEN regexp_extract({x}, '(?{flags})<{tag}>(.*?)</{tag}>', 1) END"
    )


def issues(*cases):
    return f"list_filter([{', '.join(cases)}], lambda z: z IS NOT NULL)"


def joined(x):
    return f"coalesce(array_to_string({x}, '|'), '')"


def ordered(x):
    at = [f"instr(lower({x}), '{t}')" for t in ("<think>", "</think>", "<answer>", "</answer>")]
    return f"({at[0]} < {at[1]} AND {at[1]} < {at[2]} AND {at[2]} < {at[3]})"


def tags_ok(x):
    present = " AND ".join(has(x, t) for t in ("<think>", "</think>", "<answer>", "</answer>"))
    balanced = " AND ".join(
        f"{count(x, f'<{t}>')} = {count(x, f'</{t}>')}" for t in ("think", "answer")
    )
    return f"({present} AND {balanced} AND {ordered(x)})"


def tag_issues(x):
    to, tc, ao, ac = (count(x, t) for t in ("<think>", "</think>", "<answer>", "</answer>"))
    base = issues(
        f"CASE WHEN {to} = 0 THEN 'Missing <think> tag' END",
        f"CASE WHEN {tc} = 0 THEN 'Missing </think> tag' END",
        f"CASE WHEN {ao} = 0 THEN 'Missing <answer> tag' END",
        f"CASE WHEN {ac} = 0 THEN 'Missing </answer> tag - CRITICAL: model learned to never conclude' END",
        f"CASE WHEN {to} <> {tc} THEN 'Unbalanced think tags: '||{to}||' opens, '||{tc}||' closes' END",
        f"CASE WHEN {ao} <> {ac} THEN 'Unbalanced answer tags: '||{ao}||' opens, '||{ac}||' closes' END",
    )
    return (
        f"CASE WHEN {tags_ok(x)} THEN [] WHEN len({base}) > 0 THEN {base} "
        "ELSE ['Tags not in correct order: <think>...</think><answer>...</answer>'] END"
    )


BOXED = r"\\boxed\{([^{}]+(?:\{[^{}]*\}[^{}]*)*)\}"
CONCLUSION = r"(?:therefore|thus|hence|finally|in conclusion)[^.]*\."


def boxed(x):
    return strip(f"list_extract(regexp_extract_all({x}, '{BOXED}', 1), -1)")


PHRASES = (
    r"""(?i)(?:final\s+)?(?:answer|result)\s*(?:is|:)\s*["'']?([^"''.\n]+)""",
    r"(?i)(?:therefore|thus|hence)[,\s]+([^.\n]+)",
    r"(?m)=\s*([^=\n]+)$",
)


def phrase(x):
    parts = []
    for p in PHRASES:
        cut = f"regexp_replace({strip(f'''regexp_extract({x}, '{p}', 1)''')}, '\\s*[.,:;]?\\s*$', '')"
        parts.append(f"CASE WHEN length({cut}) > 3 THEN {cut} END")
    return f"coalesce({', '.join(parts)})"


def healed_think(x):
    """(text, method) of the first repair."""
    o, c, a = has(x, "<think>"), has(x, "</think>"), has(x, "<answer>")
    con = f"regexp_matches({x}, '(?i){CONCLUSION}')"
    text = (
        f"CASE WHEN NOT {o} AND {c} THEN '<think>'||{NL}||{x} "
        f"WHEN {o} AND NOT {c} AND {a} THEN regexp_replace({x}, '(?i)<answer>', '</think>'||{NL}||{NL}||'<answer>') "
        f"WHEN {o} AND NOT {c} AND {con} THEN regexp_replace({x}, '(?i)({CONCLUSION})', '\\1'||{NL}||'</think>'||{NL}) "
        f"ELSE {x} END"
    )
    method = (
        f"CASE WHEN NOT {o} AND {c} THEN 'add_open_tag' "
        f"WHEN {o} AND NOT {c} AND {a} THEN 'add_close_before_answer' "
        f"WHEN {o} AND NOT {c} AND {con} THEN 'add_close_at_conclusion' END"
    )
    return text, method


def healed_answer(x):
    """(text, method) of the second repair; method is null when nothing was done."""
    o, c, t = has(x, "<answer>"), has(x, "</answer>"), has(x, "</think>")
    at = f"instr(lower({x}), '</think>')"
    after = strip(f"substr({x}, instr(lower({x}), '<answer>') + 8)")
    close = f"{rstrip(x)}||{NL}||'</answer>'"

    def insert(v):
        return (
            f"left({x}, {at} - 1)||'</think>'||{NL}||{NL}||'<answer>'||{NL}||{v}||{NL}||'</answer>'"
            f"||substr({x}, {at} + 8)"
        )

    body = strip(f"regexp_extract({x}, '(?is)<answer>(.*?)(?:</answer>|$)', 1)")
    pieces = f"regexp_split_to_array({x}, '(?is)<answer>.*?(?:</answer>|$)')"
    replaced = f"list_reduce({pieces}, lambda p, q: p||'<answer>'||{NL}||{boxed(x)}||{NL}||'</answer>'||q)"
    has_box = f"coalesce(length({boxed(x)}) > 0, false)"
    filled = f"coalesce(length({strip(block(x, 'answer'))}) > 0, false)"
    cases = (
        (f"{o} AND {c} AND {filled}", x, "NULL"),
        (f"{o} AND NOT {c} AND length({after}) > 20", close, "'close_tag'"),
        (f"NOT {o} AND {t} AND {has_box}", insert(boxed(x)), "'boxed_extraction'"),
        (f"NOT {o} AND {t} AND {phrase(x)} IS NOT NULL", insert(phrase(x)), "'pattern_extraction'"),
        (f"{o} AND length({body}) < 20 AND {has_box}", replaced, "'answer_replacement'"),
        (f"{o} AND NOT {c}", close, "'close_tag_fallback'"),
    )
    text = "CASE " + " ".join(f"WHEN {w} THEN {v}" for w, v, _ in cases) + f" ELSE {x} END"
    method = "CASE " + " ".join(f"WHEN {w} THEN {m}" for w, _, m in cases) + " END"
    return text, method


MATH = r"(regexp_matches({x}, '\$[^$]+\$') OR regexp_matches({x}, '(?s)\\\[.+?\\\]') OR regexp_matches({x}, '\\(" + "|".join(V.LATEX_OPERATORS) + r")'))"


def outside_math(x):
    """Without look-behind: escaped dollars are set aside as chr(1) first."""
    x = rf"regexp_replace({x}, '(?s)\\\[.*?\\\]', ' ', 'g')"
    x = f"replace({x}, chr(92)||chr(36), chr(1))"
    x = rf"regexp_replace({x}, '\$[^$\x01]+\$', ' ', 'g')"
    x = f"replace({x}, chr(1), chr(92)||chr(36))"
    x = rf"regexp_replace({x}, '(?s)\\\(.*?\\\)', ' ', 'g')"
    envs = "|".join(
        rf"\\begin\{{{e}\*?\}}.*?\\end\{{{e}\*?\}}" for e in ("equation", "align", "gather", "multline")
    )
    return f"regexp_replace({x}, '(?s){envs}', ' ', 'g')"


# The look-ahead patterns of the physics profile, written out with explicit word boundaries.
EDGE, NOT_WORD = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_"
PLAIN_SQL = {
    PHYSICS_PLAIN_TEXT_PATTERNS[0]: rf"{EDGE}sigma_[xyz]{NOT_WORD}])",
    PHYSICS_PLAIN_TEXT_PATTERNS[1]: rf"{EDGE}psi{NOT_WORD}^\\])",
    PHYSICS_PLAIN_TEXT_PATTERNS[2]: rf"{EDGE}H\s*=\s*[^$\\]",
    PHYSICS_PLAIN_TEXT_PATTERNS[3]: rf"{EDGE}hbar{NOT_WORD}\\])",
}


def latex_issues(x, physics=False):
    plain, none = [], "No LaTeX math detected - response should contain LaTeX"
    if physics:
        none = "No LaTeX math detected - physics response should contain LaTeX"
        plain = [
            f"CASE WHEN regexp_matches({outside_math(x)}, '{sql}') "
            f"THEN 'Plain text physics found (should be LaTeX): {p}' END"
            for p, sql in PLAIN_SQL.items()
        ]
    odd = (
        f"((length({x}) - length(replace({x}, chr(36), ''))) "
        f"- (length({x}) - length(replace({x}, chr(92)||chr(36), ''))) // 2) % 2 <> 0"
    )
    return issues(
        *plain,
        f"CASE WHEN NOT {MATH.replace('{x}', x)} THEN '{none}' END",
        f"CASE WHEN {odd} THEN 'Unclosed LaTeX $ delimiter' END",
    )


def quality_issues(x, reasoning=100, answer=10, physics=False):
    parts = f"string_split({x}, '.')"
    starts = (
        f"list_distinct(list_transform(list_filter(list_transform({parts}, lambda s: {strip('s')}), "
        "lambda s: length(s) > 30), lambda s: lower(left(s, 30))))"
    )
    markers = " OR ".join(
        f"contains(lower({block(x, 'think')}), '{m}')"
        for m in ("step 1", "first,", "1.", "1)", "let us", "we begin", "starting with")
    )
    return issues(
        f"CASE WHEN length({strip(block(x, 'think'))}) < {reasoning} THEN 'Reasoning too short (< {reasoning} chars)' END",
        f"CASE WHEN NOT ({markers}) THEN 'No clear step-by-step structure detected' END",
        f"CASE WHEN length({strip(block(x, 'answer'))}) < {answer} THEN "
        + ("'Answer too short'" if physics else "'Answer too short - may be incomplete'") + " END",
        f"CASE WHEN len({parts}) > 5 AND len({starts}) < len({parts}) * 0.5 THEN "
        + ("'Possible reasoning loop'" if physics else "'Possible reasoning loop - repetitive sentence structures'")
        + " END",
    )


def decided(physics=False, strict=True):
    """The decided samples as common table expressions ending in ``d``."""
    t, tm = healed_think("output")
    a, am = healed_answer("tx")
    keep = (
        "len(tag_i) + len(lat_i) + len(qua_i) = 0" if strict
        else "len(list_filter(tag_i, lambda z: contains(z, '</answer>'))) = 0"
    )
    return f"""+
h0 AS MATERIALIZED (SELECT *, NOT {tags_ok('output')} AS tried FROM samples),
h1 AS MATERIALIZED (SELECT *, CASE WHEN tried THEN {t} ELSE output END AS tx, CASE WHEN tried THEN {tm} END AS tm FROM h0),
h2 AS MATERIALIZED (SELECT *, CASE WHEN tried THEN {a} ELSE output END AS fin, CASE WHEN tried THEN {am} END AS am FROM h1),
h3 AS MATERIALIZED (SELECT sample_id, instruction, fin AS output, tried, tm IS NOT NULL OR am IS NOT NULL AS healed,
  {issues("'think:'||tm", "'answer:'||am")} AS methods, {tag_issues('fin')} AS tag_i,
  {latex_issues('fin', physics)} AS lat_i, {quality_issues('fin', physics=physics)} AS qua_i FROM h2),
d AS MATERIALIZED (SELECT *, {keep} AS keep FROM h3)
"""


FUNNEL = """SELECT count(*) AS total, count(*) FILTER (keep AND NOT healed) AS passed_original,
 count(*) FILTER (keep AND healed) AS passed_healed, count(*) FILTER (len(tag_i) > 0) AS failed_tags,
 count(*) FILTER (len(lat_i) > 0) AS failed_latex, count(*) FILTER (len(qua_i) > 0) AS failed_quality,
 count(*) FILTER (tried) AS heal_attempts, count(*) FILTER (healed) AS heal_success,
 count(*) FILTER (NOT keep) AS rejected,
 printf('%.1f', (100.0 * count(*) FILTER (keep) / greatest(1, count(*)))::DOUBLE)::DOUBLE AS pass_pct,
 printf('%.1f', (100.0 * count(*) FILTER (healed) / greatest(1, count(*) FILTER (tried)))::DOUBLE)::DOUBLE AS heal_pct FROM d"""


# --- filtering -------------------------------------------------------------------------------


def filtered(spark, sf, **kw):
    return P.filter_samples(view(spark, sf, "samples"), **kw)


@check("filter_stats", with_views("samples", body=decided() + FUNNEL))
def _(spark, sf):
    return filtered(spark, sf).stats


@check("filter_stats_lenient", with_views("samples", body=decided(strict=False) + FUNNEL))
def _(spark, sf):
    return filtered(spark, sf, strict=False).stats


@check("filter_stats_physics", with_views("samples", body=decided(physics=True) + FUNNEL))
def _(spark, sf):
    return filtered(spark, sf, rules=Rules.physics()).stats


@check(
    "filter_kept",
    with_views("samples", body=decided() + f"SELECT sample_id, instruction, output, healed, {joined('methods')} AS methods FROM d WHERE keep"),
)
def _(spark, sf):
    return filtered(spark, sf).kept.select(
        "sample_id", "instruction", "output", "healed", F.array_join("heal_methods", "|").alias("methods")
    )


@check(
    "filter_rejected",
    with_views("samples", body=decided() + f"SELECT sample_id, healed, {joined('list_concat(list_concat(tag_i, lat_i), qua_i)')} AS issues FROM d WHERE NOT keep"),
)
def _(spark, sf):
    return filtered(spark, sf).rejected.select("sample_id", "healed", F.array_join("issues", "|").alias("issues"))


@check(
    "rejection_details",
    with_views("samples", body=decided() + f"SELECT sample_id, healed, {joined('methods')} AS methods, {joined('list_concat(list_concat(tag_i, lat_i), qua_i)[1:2]')} AS issues FROM d WHERE NOT keep ORDER BY sample_id LIMIT 5"),
)
def _(spark, sf):
    return filtered(spark, sf).first_rejections("sample_id").select(
        "sample_id", "healed", F.array_join("heal_methods", "|").alias("methods"),
        F.array_join("issues", "|").alias("issues"),
    )


@check(
    "heal_methods",
    with_views("samples", body=decided() + f"SELECT {joined('methods')} AS methods, tried, count(*) AS n FROM d GROUP BY ALL"),
)
def _(spark, sf):
    return heal_samples(view(spark, sf, "samples")).groupBy(
        F.array_join("heal_methods", "|").alias("methods"), F.col("heal_tried").alias("tried")
    ).agg(F.count(F.lit(1)).alias("n"))


@check("heal_output", with_views("samples", body=decided() + "SELECT sample_id, output FROM d"))
def _(spark, sf):
    return heal_samples(view(spark, sf, "samples")).select("sample_id", "output")


_T, _TM = healed_think("output")


@check("heal_think_tag", with_views("samples", body=f"SELECT sample_id, {_T} AS text, {_TM} AS method FROM samples"))
def _(spark, sf):
    df = view(spark, sf, "samples").withColumn("tags", T.skeleton(F.col("output")))
    return df.withColumn("h", T.heal_think(F.col("output"), F.col("tags"))).select("sample_id", "h.*")


_A, _AM = healed_answer("output")
_STATUS = (
    f"coalesce({_AM}, CASE WHEN {has('output', '<answer>')} AND {has('output', '</answer>')} "
    f"AND coalesce(length({strip(block('output', 'answer'))}) > 0, false) THEN 'already_valid' ELSE 'unrecoverable' END)"
)


@check("heal_answer_tag", with_views("samples", body=f"SELECT sample_id, {_A} AS text, {_STATUS} AS status FROM samples"))
def _(spark, sf):
    tags, out = F.col("tags"), F.col("output")
    has_tag = lambda t: F.array_contains(tags, t)
    df = view(spark, sf, "samples").withColumn("tags", T.skeleton(out))
    return df.withColumn(
        "h", T.heal_answer(out, has_tag("<answer>"), has_tag("</answer>"), has_tag("</think>"))
    ).select("sample_id", "h.text", T.answer_status(out, tags).alias("status"))


# --- scalar checks ---------------------------------------------------------------------------


@check(
    "tag_issues",
    with_views("samples", body=f"SELECT sample_id, {tags_ok('output')} AS ok, {joined(tag_issues('output'))} AS issues FROM samples"),
)
def _(spark, sf):
    tags = T.skeleton(F.col("output"))
    return view(spark, sf, "samples").withColumn("tags", tags).select(
        "sample_id", T.tags_valid(F.col("tags")).alias("ok"),
        F.array_join(T.tag_issues(F.col("tags")), "|").alias("issues"),
    )


RULES = Rules(
    require_tags=(("<think>", "</think>"), ("<answer>", "</answer>")), require_latex=True,
    min_reasoning_length=200, min_answer_length=30,
)
_PLACES = [f"instr(lower(output), '{t}')" for t in ("<think>", "</think>", "<answer>", "</answer>")]
_RULE_SQL = issues(
    *[f"CASE WHEN {p} = 0 THEN 'missing {t}' END" for p, t in zip(_PLACES, ("<think>", "</think>", "<answer>", "</answer>"))],
    f"CASE WHEN {' AND '.join(p + ' > 0' for p in _PLACES)} AND NOT ({_PLACES[0]} <= {_PLACES[1]} AND {_PLACES[1]} <= {_PLACES[2]} AND {_PLACES[2]} <= {_PLACES[3]}) THEN 'tags out of order' END",
    r"CASE WHEN NOT regexp_matches(output, '\\[a-zA-Z]+|\\\[|\$') THEN 'no LaTeX detected' END",
    f"CASE WHEN length({strip(block('output', 'think'))}) < 200 THEN 'reasoning too short (< 200 chars)' END",
    f"CASE WHEN length({strip(block('output', 'answer'))}) < 30 THEN 'answer too short (< 30 chars)' END",
)


@check(
    "rule_messages",
    with_views("samples", body=f"SELECT sample_id, CASE WHEN len({_RULE_SQL}) = 0 THEN 'valid' ELSE array_to_string({_RULE_SQL}, ', ') END AS message FROM samples"),
)
def _(spark, sf):
    return view(spark, sf, "samples").select(
        "sample_id", V.rule_message(V.rule_issues(F.col("output"), RULES)).alias("message")
    )


_MATHY = (
    "output||' '||chr(92)||'[ psi '||chr(10)||chr(92)||'] H = 2 '||chr(92)||'$3 '||chr(92)||'(sigma_x'||chr(92)||') '"
    "||chr(92)||'begin{align}hbar'||chr(92)||'end{align} psi_0 $q$$r$ psi. sigma_z'"
)


@check("strip_math", with_views("samples", body=f"SELECT sample_id, {outside_math(_MATHY)} AS outside FROM samples"))
def _(spark, sf):
    df = view(spark, sf, "samples").withColumn("mathy", F.expr(_MATHY))
    return df.select("sample_id", V.strip_math(F.col("mathy")).alias("outside"))


@check(
    "latex_issues",
    with_views("samples", body=f"SELECT sample_id, {joined(latex_issues('output'))} AS general, {joined(latex_issues(f'({_MATHY})', True))} AS physics FROM samples"),
)
def _(spark, sf):
    df = view(spark, sf, "samples").withColumn("mathy", F.expr(_MATHY))
    physics = Rules.physics()
    return df.select(
        "sample_id", F.array_join(V.latex_issues(F.col("output")), "|").alias("general"),
        F.array_join(
            V.latex_issues(F.col("mathy"), physics.plain_text_patterns, physics.texts), "|"
        ).alias("physics"),
    )


@check(
    "quality_issues",
    with_views("samples", body=f"SELECT sample_id, {joined(quality_issues('output'))} AS issues, {joined(quality_issues('output', 300, 40, True))} AS strict FROM samples"),
)
def _(spark, sf):
    tight = Rules(min_reasoning_length=300, min_answer_length=40, texts=Rules.physics().texts)
    return view(spark, sf, "samples").select(
        "sample_id", F.array_join(V.quality_issues(F.col("output")), "|").alias("issues"),
        F.array_join(V.quality_issues(F.col("output"), tight), "|").alias("strict"),
    )


@check(
    "answer_extraction",
    with_views("samples", body=f"SELECT sample_id, {boxed('output')} AS boxed, {phrase('output')} AS phrase FROM samples"),
)
def _(spark, sf):
    return view(spark, sf, "samples").select(
        "sample_id", T.boxed_answer(F.col("output")).alias("boxed"),
        T.final_answer(F.col("output")).alias("phrase"),
    )


@check(
    "parsed_blocks",
    with_views(
        "samples",
        body=f"SELECT sample_id, {strip(block('output', 'think'))} AS think, {strip(block('output', 'answer'))} AS answer, "
        f"{strip(block('output', 'think', 's'))} AS think_exact, coalesce({strip(block('output', 'answer', 's'))}, output) AS answer_or_all FROM samples",
    ),
)
def _(spark, sf):
    out = F.col("output")
    return view(spark, sf, "samples").select(
        "sample_id", X.strip(X.block(out, "think")).alias("think"),
        X.strip(X.block(out, "answer")).alias("answer"),
        X.strip(X.block(out, "think", False)).alias("think_exact"),
        F.coalesce(X.strip(X.block(out, "answer", False)), out).alias("answer_or_all"),
    )


TRIAL = Rules(
    require_latex=True, min_domain_score=2,
    domain_checks=(
        DomainCheck("articles", r"\bthe\b|\bdie\b"), DomainCheck("numbers", "[0-9]{2}"),
        DomainCheck("math", r"\$[^$]+\$"), DomainCheck("result", "result|limit|value"),
    ),
)
_CHECKS = (r"(?i)\bthe\b|\bdie\b", "(?i)[0-9]{2}", r"(?i)\$[^$]+\$", "(?i)result|limit|value")
_SCORE = " + ".join(f"CAST(regexp_matches(output, '{p}') AS INT)" for p in _CHECKS)
_ALL = " AND ".join(has("output", t) for t in ("<think>", "</think>", "<answer>", "</answer>"))
_LATEX = r"regexp_matches(output, '\\[a-zA-Z]+|\\\[|\$')"


@check(
    "trial_flags",
    with_views(
        "samples",
        body=f"SELECT sample_id, {_ALL} AS all_tags, {_LATEX} AS has_latex, regexp_matches(lower(output), 'step\\s*\\d') AS has_steps, "
        f"({_SCORE})::BIGINT AS domain_score, CASE WHEN NOT ({_ALL}) OR NOT {_LATEX} THEN 'FAIL' WHEN {_SCORE} < 2 THEN 'MARGINAL' ELSE 'PASS' END AS quality FROM samples",
    ),
)
def _(spark, sf):
    df = view(spark, sf, "samples").withColumn("f", V.detailed_flags(F.col("output"), TRIAL))
    return df.select(
        "sample_id", F.col("f.all_tags_valid").alias("all_tags"), "f.has_latex", "f.has_steps",
        F.col("f.domain_score").cast("bigint").alias("domain_score"),
        V.quality_label(F.col("f"), TRIAL).alias("quality"),
    )


_TRIAL_ROWS = f"""+ t AS (SELECT sample_id, CASE WHEN length(output) > 0 THEN ({_SCORE})::BIGINT END AS domain_score,
 CASE WHEN NOT ({_ALL}) OR NOT {_LATEX} THEN 'FAIL' WHEN {_SCORE} < 2 THEN 'MARGINAL' ELSE 'PASS' END AS quality FROM samples)
"""


def trial(spark, sf):
    """A trial of all samples with a stand-in that replies with the prompt, which is the sample's output."""
    items = view(spark, sf, "samples").select(
        "sample_id", F.col("instruction").alias("question"), F.col("output").alias("answer")
    )
    call = lambda systems, users: list(users)
    return P.trial_run(items, call, Task("System.", "{answer}", TRIAL), "sample_id", items.count())


@check("trial_run", with_views("samples", body=_TRIAL_ROWS + "SELECT * FROM t"))
def _(spark, sf):
    return trial(spark, sf).select(
        "sample_id", F.col("flags.domain_score").cast("bigint").alias("domain_score"), "quality"
    )


@check(
    "trial_run_summary",
    with_views(
        "samples",
        body=_TRIAL_ROWS + """SELECT count(*) AS total, count(*) FILTER (quality = 'PASS') AS pass, count(*) FILTER (quality = 'MARGINAL') AS marginal,
 count(*) FILTER (quality = 'FAIL') AS fail, round(avg(domain_score), 6) AS avg_domain_score,
 count(*) FILTER (quality IN ('PASS', 'MARGINAL')) / count(*) >= 0.8 AS ready FROM t""",
    ),
)
def _(spark, sf):
    return trial_summary(trial(spark, sf)).select(
        "total", "pass", "marginal", "fail", F.round("avg_domain_score", 6).alias("avg_domain_score"), "ready"
    )


# --- statistics ------------------------------------------------------------------------------


@check(
    "profile",
    with_views(
        "samples",
        body=f"""SELECT count(*) AS total_samples, (sum(length(instruction)) // count(*))::BIGINT AS avg_instruction_len,
 (sum(length(output)) // count(*))::BIGINT AS avg_output_len,
 (sum(length({block('output', 'think')})) // count({block('output', 'think')}))::BIGINT AS avg_think_len,
 (sum(length({block('output', 'answer')})) // count({block('output', 'answer')}))::BIGINT AS avg_answer_len,
 printf('%.1f', (100.0 * count(*) FILTER (regexp_matches(output, '(?s)\\$[^$]+\\$|\\\\\\[.*?\\\\\\]')) / count(*))::DOUBLE)::DOUBLE AS has_latex_pct,
 0::BIGINT AS healed_count FROM samples""",
    ),
)
def _(spark, sf):
    return stats.profile(view(spark, sf, "samples"))


@check(
    "service_stats",
    with_views(
        "sourced",
        body="""SELECT count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid,
 count(*) FILTER (healed) AS healed, printf('%.1f', (avg(length(instruction)))::DOUBLE)::DOUBLE AS avg_instruction_len,
 printf('%.1f', (avg(length(output)))::DOUBLE)::DOUBLE AS avg_output_len FROM sourced""",
    ),
)
def _(spark, sf):
    return stats.service_stats(view(spark, sf, "sourced"))


@check(
    "result_counts",
    with_views(
        "sourced",
        body="""SELECT count(*) AS actual_size, count(*) FILTER (valid) AS valid_count, count(*) FILTER (NOT valid) AS invalid_count,
 count(*) FILTER (healed) AS healed_count, 0::BIGINT AS parity_healed FROM sourced""",
    ),
)
def _(spark, sf):
    df = view(spark, sf, "sourced")
    parity = stats.result_counts(df, parity=True).select(
        F.col("healed_count").alias("parity_healed"), "actual_size"
    )
    return stats.result_counts(df).join(parity, "actual_size")


TOPIC_WORDS = ("the", "der", "que", "and", "sta", "qubit", "ing", "una", "les", "tion", "state", "é")


@check(
    "topic_counts",
    with_views(
        "samples",
        body=" UNION ALL ".join(
            ["SELECT * FROM (SELECT * FROM (" + " UNION ALL ".join(
                f"SELECT '{w}' AS topic, count(*) FILTER (contains(lower(instruction), '{w}')) AS n, {i} AS i FROM samples"
                for i, w in enumerate(TOPIC_WORDS)
            ) + ") WHERE n > 0 ORDER BY n DESC, i LIMIT 10)"]
        ).replace("SELECT * FROM (SELECT * FROM (", "SELECT topic, n FROM (SELECT * FROM (", 1),
    ),
)
def _(spark, sf):
    return P.profile(view(spark, sf, "samples"), TOPIC_WORDS)[1]


@check(
    "quantum_topics",
    with_views(
        "samples",
        body="SELECT topic, n FROM (" + " UNION ALL ".join(
            f"SELECT '{w}' AS topic, count(*) FILTER (contains(lower(instruction), '{w}')) AS n FROM samples"
            for w in QUANTUM_TOPICS
        ) + ") WHERE n > 0",
    ),
)
def _(spark, sf):
    return stats.topic_counts(view(spark, sf, "samples"), QUANTUM_TOPICS)


@check(
    "purity",
    with_views(
        "lines",
        body=f"""+ p AS MATERIALIZED (SELECT {strip('value')} AS v FROM lines),
q AS (SELECT CASE WHEN json_valid(v) THEN {strip("json_extract_string(v, '$.instruction')")} END AS i,
 CASE WHEN json_valid(v) THEN {strip("json_extract_string(v, '$.output')")} END AS o FROM p WHERE length(v) > 0)
SELECT round(100.0 * count(*) FILTER (length(i) >= 10 AND length(o) >= 10 AND i <> o) / count(*), 6)::DOUBLE AS purity FROM q""",
    ),
)
def _(spark, sf):
    return stats.purity(view(spark, sf, "lines")).select(F.round("purity", 6).alias("purity"))


@check(
    "entropy",
    with_views(
        "samples",
        body=f"""+ t AS (SELECT unnest(regexp_split_to_array(lower(instruction||' '||output), '[ \\n]+')) AS w FROM samples),
c AS (SELECT w, count(*) AS n FROM t WHERE w <> '' GROUP BY w),
s AS (SELECT sum(n) AS total, count(*) AS v FROM c)
SELECT round(-sum(n / total * log2(n / total)) / log2(max(v)), 6) AS entropy FROM c, s""",
    ),
)
def _(spark, sf):
    return stats.entropy(view(spark, sf, "samples")).select(F.round("entropy", 6).alias("entropy"))


def cut(x, n):
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n})||'...' ELSE {x} END"


_TH, _AN = strip(block("output", "think")), strip(block("output", "answer"))


@check(
    "preview",
    with_views(
        "samples",
        body=f"""SELECT sample_id, length(instruction)::INT AS instruction_chars, {cut('instruction', 500)} AS instruction_preview,
 length({_TH})::INT AS think_chars, {cut(_TH, 500)} AS think_preview, length({_AN})::INT AS answer_chars, left({_AN}, 300) AS answer_preview FROM samples""",
    ),
)
def _(spark, sf):
    return stats.preview(view(spark, sf, "samples"))


# --- sampling and splitting ------------------------------------------------------------------


@check(
    "sample_first",
    with_views("samples", body="SELECT sample_id, instruction FROM samples ORDER BY sample_id LIMIT 7 OFFSET 11"),
)
def _(spark, sf):
    return ranking.sample_rows(view(spark, sf, "samples"), 7, "sample_id", offset=11).select(
        "sample_id", "instruction"
    )


@check(
    "sample_random",
    with_views("samples", body="SELECT sample_id, instruction FROM samples ORDER BY md5('42|'||sample_id) LIMIT 50"),
)
def _(spark, sf):
    return ranking.sample_rows(view(spark, sf, "samples"), 50, "sample_id", seed=42).select(
        "sample_id", "instruction"
    )


def split_sql(val, test, seed):
    held = val + test
    return f"""+ n AS (SELECT ceil(count(*) * {held}) AS held, ceil(ceil(count(*) * {held}) * ({test} / {held})) AS test FROM samples),
r AS (SELECT sample_id, row_number() OVER (ORDER BY md5('{seed}|'||sample_id)) AS rn FROM samples)
SELECT sample_id, CASE WHEN rn <= test THEN 'test' WHEN rn <= held THEN 'validation' ELSE 'train' END AS split FROM r, n"""


@check("split_60_20_20", with_views("samples", body=split_sql(0.2, 0.2, 3407)))
def _(spark, sf):
    return ranking.split(view(spark, sf, "samples"), "sample_id", SplitRatios()).select("sample_id", "split")


@check("split_90_5_5", with_views("samples", body=split_sql(0.05, 0.05, 3407)))
def _(spark, sf):
    return ranking.split(
        view(spark, sf, "samples"), "sample_id", SplitRatios(0.9, 0.05, 0.05)
    ).select("sample_id", "split")


@check(
    "split_sizes",
    with_views(
        "samples",
        body="""SELECT 'train' AS split, count(*) - ceil(count(*) * 0.2)::BIGINT AS n FROM samples
UNION ALL SELECT 'validation', (ceil(count(*) * 0.2) - ceil(ceil(count(*) * 0.2) * 0.5))::BIGINT FROM samples
UNION ALL SELECT 'test', ceil(ceil(count(*) * 0.2) * 0.5)::BIGINT FROM samples""",
    ),
)
def _(spark, sf):
    return P.prepare_sft(view(spark, sf, "samples"), "sample_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@check("split_default", with_views("samples", body=split_sql(0.1, 0.1, 3407)))
def _(spark, sf):
    """The labels of the split that is taken without a configuration."""
    return P.prepare_sft(view(spark, sf, "samples"), "sample_id").select("sample_id", "split")


@check(
    "held_out_rows",
    with_views("samples", body=split_sql(0.2, 0.2, 3407).replace("SELECT sample_id, CASE", "SELECT sample_id FROM (SELECT sample_id, CASE", 1) + ") WHERE split = 'test'"),
)
def _(spark, sf):
    return P.held_out(view(spark, sf, "samples"), "sample_id", SplitRatios()).select("sample_id")


# --- extraction, import, training texts ------------------------------------------------------


@check(
    "extract",
    with_views("sourced", body="SELECT instruction AS question, output AS answer, source_title, CAST(year AS VARCHAR) AS year, '' AS missing FROM sourced"),
)
def _(spark, sf):
    mapping = FieldMapping("instruction", "output", ("source_title", "year", "missing"))
    return P.extract(view(spark, sf, "sourced"), mapping)


@check(
    "extract_first",
    with_views("sourced", body="SELECT instruction AS question, output AS answer FROM sourced ORDER BY line_no LIMIT 20"),
)
def _(spark, sf):
    return P.extract(view(spark, sf, "sourced"), FieldMapping("instruction", "output"), 20, "line_no")


@check(
    "auto_map",
    f"SELECT text AS instruction, '' AS output, 'huggingface:x/y' AS source, true AS is_valid FROM documents WHERE length({strip('text')}) > 0",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return P.auto_map(docs, "huggingface:x/y")


MCQ = SftConfig(
    prompt_template="Q: {}\nA) {}\nB) {}\nC) {}\nD) {}\nAbout: {}\nAnswer: {}\n",
    instruction="instruction", response="output", context_fields=("source", "lang;"),
    context_format="{source} - {lang;}", options=("o1", "o2", "o3", "o4"), correct_option="cop",
)


@check(
    "sft_multiple_choice",
    with_views(
        "sourced",
        body="""SELECT line_no, 'Q: '||instruction||chr(10)||'A) a'||line_no||chr(10)||'B) '||source||chr(10)||'C) '||source_title||chr(10)||'D) {x} $1'||chr(10)||'About: '||source||' - l'||chr(10)||'Answer: '||
 CASE line_no % 6 WHEN 0 THEN 'A) a'||line_no WHEN 1 THEN 'B) '||source WHEN 2 THEN 'C) '||source_title WHEN 3 THEN 'D) {x} $1' ELSE output END||chr(10) AS text FROM sourced""",
    ),
)
def _(spark, sf):
    df = view(spark, sf, "sourced").select(
        "line_no", "instruction", "output", "source",
        F.concat(F.lit("a"), F.col("line_no").cast("string")).alias("o1"),
        F.col("source").alias("o2"), F.col("source_title").alias("o3"), F.lit("{x} $1").alias("o4"),
        (F.col("line_no") % 6).alias("cop"), F.lit("l").alias("lang;"),
    )
    return P.format_sft(df, MCQ).select("line_no", "text")


@check(
    "sft_context",
    with_views("sourced", body="SELECT line_no, 'I: '||instruction||chr(10)||'C: Domain: '||source||' - '||source_title||chr(10)||'R: '||output AS text FROM sourced"),
)
def _(spark, sf):
    config = SftConfig(
        prompt_template="I: {}\nC: {}\nR: {}", response="output",
        context_fields=("source", "source_title"), context_format="Domain: {source} - {source_title}",
    )
    return P.format_sft(view(spark, sf, "sourced"), config).select("line_no", "text")


@check(
    "sft_chat",
    with_views("samples", body="SELECT sample_id, '<|im_start|>user'||chr(10)||instruction||'<|im_end|>'||chr(10)||'<|im_start|>assistant'||chr(10)||output||'<|im_end|>' AS text FROM samples"),
)
def _(spark, sf):
    return P.chat_format(view(spark, sf, "samples")).select("sample_id", "text")
