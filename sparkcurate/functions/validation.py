"""Rule checks on whole outputs: required tags, LaTeX, reasoning quality, domain checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.config import IssueTexts, Rules
from sparkcurate.functions.binding import once
from sparkcurate.functions.text import block, strip, with_spaces

# What counts as LaTeX, and the step markers looked for in a reasoning.
ANY_LATEX = r"\\[a-zA-Z]+|\\\[|\$"
INLINE_MATH = r"\$[^$]+\$"
DISPLAY_MATH = r"\\\[.+?\\\]"
LATEX_OPERATORS = (
    "sigma", "psi", "phi", "omega", "alpha", "beta", "gamma", "delta", "epsilon", "hbar", "nabla",
    "partial", "frac", "sqrt", "sum", "prod", "int", "ket", "bra", "langle", "rangle",
)
STEP_MARKERS = ("step 1", "first,", "1.", "1)", "let us", "we begin", "starting with")
MATH_ENVIRONMENTS = "equation|align|gather|multline"

EMPTY_ISSUES = "array<string>"


def _issues(*candidates: Column) -> Column:
    if not candidates:
        return F.array().cast(EMPTY_ISSUES)
    return F.array_compact(F.array(*candidates))


def strip_math(c: Column) -> Column:
    """Replace display, inline, parenthesised and environment math by one blank each."""
    c = F.regexp_replace(c, r"(?s)\\\[.*?\\\]", " ")
    c = F.regexp_replace(c, r"(?<!\\)\$[^$]+(?<!\\)\$", " ")
    c = F.regexp_replace(c, r"(?s)\\\(.*?\\\)", " ")
    return F.regexp_replace(
        c, rf"(?s)\\begin\{{({MATH_ENVIRONMENTS})\*?\}}.*?\\end\{{\1\*?\}}", " "
    )


def has_math(c: Column) -> Column:
    operators = "|".join(LATEX_OPERATORS)
    return c.rlike(INLINE_MATH) | c.rlike(rf"(?s){DISPLAY_MATH}") | c.rlike(rf"\\({operators})")


def odd_dollars(c: Column) -> Column:
    r"""True when the number of ``$`` that are not written ``\$`` is odd."""
    dollars = F.regexp_count(c, F.lit(r"\$")) - F.regexp_count(c, F.lit(r"\\\$"))
    return dollars % 2 != 0


def latex_issues(
    c: Column, plain_text_patterns: tuple[str, ...] = (), texts: IssueTexts = IssueTexts()
) -> Column:
    """Plain-text symbols outside math, absence of LaTeX, and unclosed dollar signs."""
    plain = _issues()
    if plain_text_patterns:
        plain = once(
            strip_math(c),
            lambda outside: _issues(
                *[
                    F.when(outside.rlike(f"(?U){p}"), F.lit(texts.plain_text + p))
                    for p in plain_text_patterns
                ]
            ),
        )
    general = _issues(
        F.when(~has_math(c), F.lit(texts.no_latex)),
        F.when(odd_dollars(c), F.lit("Unclosed LaTeX $ delimiter")),
    )
    return F.concat(plain, general)


def repeats_itself(c: Column) -> Column:
    """More than five sentence parts, and fewer distinct starts than half of the parts.

    A start is the lower-cased first 30 characters of a part longer than 30.
    """


    def repetitive(parts: Column) -> Column:
        long_parts = F.filter(F.transform(parts, strip), lambda s: F.length(s) > 30)
        starts = F.array_distinct(F.transform(long_parts, lambda s: F.lower(F.substring(s, 1, 30))))
        return (F.size(parts) > 5) & (F.size(starts) < F.size(parts) * F.lit(0.5))

    return once(F.split(c, r"\."), repetitive)


def has_steps(reasoning: Column) -> Column:
    """True when the text holds one of the step markers, in any case."""

    def any_marker(low: Column) -> Column:
        found = F.lit(False)
        for marker in STEP_MARKERS:
            found = found | F.contains(low, F.lit(marker))
        return found

    return once(F.lower(reasoning), any_marker)


def quality_issues(c: Column, rules: Rules = Rules()) -> Column:
    """Short reasoning, no visible steps, short answer, repetition.

    Length and step checks apply only to blocks that exist.
    """
    min_reasoning = 100 if rules.min_reasoning_length is None else rules.min_reasoning_length
    min_answer = 10 if rules.min_answer_length is None else rules.min_answer_length
    reasoning = once(
        block(c, "think"),
        lambda think: _issues(
            F.when(
                F.length(strip(think)) < min_reasoning,
                F.lit(f"Reasoning too short (< {min_reasoning} chars)"),
            ),
            F.when(~has_steps(think), F.lit("No clear step-by-step structure detected")),
        ),
    )
    rest = _issues(
        F.when(F.length(strip(block(c, "answer"))) < min_answer, F.lit(rules.texts.short_answer)),
        F.when(repeats_itself(c), F.lit(rules.texts.loop)),
    )
    return F.concat(reasoning, rest)


def rule_issues(c: Column, rules: Rules) -> Column:
    """Issues of an output under a task's rules, in the order the rules are stated."""
    flat = [tag for pair in rules.require_tags for tag in pair]

    def required(places: Column) -> Column:
        """``places`` holds the first position of every required tag, 0 for an absent one."""
        absent = [F.when(places[i] == 0, F.lit(f"missing {t}")) for i, t in enumerate(flat)]
        disorder = (F.array_min(places) > 0) & (places != F.array_sort(places))
        return _issues(*absent, F.when(disorder, F.lit("tags out of order")))

    tags = _issues()
    if flat:
        tags = once(
            once(F.lower(c), lambda low: F.array(*[F.instr(low, t.lower()) for t in flat])), required
        )
    checks = []
    if rules.require_latex:
        checks.append(F.when(~c.rlike(ANY_LATEX), F.lit("no LaTeX detected")))
    for tag, what, least in (
        ("think", "reasoning", rules.min_reasoning_length),
        ("answer", "answer", rules.min_answer_length),
    ):
        if least:
            checks.append(
                F.when(
                    F.length(strip(block(c, tag))) < least,
                    F.lit(f"{what} too short (< {least} chars)"),
                )
            )
    return F.concat(tags, _issues(*checks))


def rule_message(issues: Column) -> Column:
    return once(
        issues, lambda i: F.when(F.size(i) == 0, F.lit("valid")).otherwise(F.array_join(i, ", "))
    )


def detailed_flags(c: Column, rules: Rules) -> Column:
    """Struct of the trial-mode checks of one output."""
    return once(F.lower(c), lambda low: _detailed_flags(c, low, rules))


def _detailed_flags(c: Column, low: Column, rules: Rules) -> Column:
    tags = {
        "has_think_open": F.contains(low, F.lit("<think>")),
        "has_think_close": F.contains(low, F.lit("</think>")),
        "has_answer_open": F.contains(low, F.lit("<answer>")),
        "has_answer_close": F.contains(low, F.lit("</answer>")),
    }
    all_tags = F.lit(True)
    for flag in tags.values():
        all_tags = all_tags & flag
    checks = [c.rlike(f"(?i){d.pattern}") for d in rules.domain_checks]
    score = sum((x.cast("int") for x in checks), F.lit(0))
    domain = F.array(
        *[
            F.struct(F.lit(d.name).alias("name"), x.alias("passed"))
            for d, x in zip(rules.domain_checks, checks)
        ]
    ).cast("array<struct<name:string,passed:boolean>>")
    return F.struct(
        *[flag.alias(name) for name, flag in tags.items()],
        c.rlike(ANY_LATEX).alias("has_latex"),
        low.rlike(with_spaces(r"step\s*\p{Nd}")).alias("has_steps"),
        all_tags.alias("all_tags_valid"),
        domain.alias("domain_results"),
        score.alias("domain_score"),
        F.lit(len(checks)).alias("domain_total"),
    )


def quality_label(flags: Column, rules: Rules) -> Column:
    """FAIL, MARGINAL or PASS for the struct of :func:`detailed_flags`; ERROR for no output."""
    usable = flags["all_tags_valid"]
    if rules.require_latex:
        usable = usable & flags["has_latex"]
    return (
        F.when(flags.isNull(), "ERROR")
        .when(~usable, "FAIL")
        .when(flags["domain_score"] < rules.min_domain_score, "MARGINAL")
        .otherwise("PASS")
    )
