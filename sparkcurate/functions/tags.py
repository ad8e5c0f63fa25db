"""Validation and healing of ``<think>`` / ``<answer>`` outputs.

Everything is decided on the *skeleton* of an output: the short array of its think/answer
tags in order of appearance, taken from the text in one regular-expression pass. Counts,
presence and order are then cheap operations on a handful of elements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.binding import once
from sparkcurate.functions.text import block, rstrip, strip, with_spaces

# Answer phrases, tried in this order; group 1 is the answer.
FINAL_ANSWER_PATTERNS = (
    r"""(?i)(?:final\s+)?(?:answer|result)\s*(?:is|:)\s*["']?([^"'.\n]+)""",
    r"(?i)(?:therefore|thus|hence)[,\s]+([^.\n]+)",
    r"(?md)=\s*([^=\n]+)$",
)
# Boxed results with up to one level of nested braces; words that conclude.
BOXED_PATTERN = r"\\boxed\{([^{}]+(?:\{[^{}]*\}[^{}]*)*)\}"
CONCLUSION_PATTERN = r"(?:therefore|thus|hence|finally|in conclusion)[^.]*\."

# Wording of the tag issues.
MISSING_TEXTS = {
    "<think>": "Missing <think> tag",
    "</think>": "Missing </think> tag",
    "<answer>": "Missing <answer> tag",
    "</answer>": "Missing </answer> tag - CRITICAL: model learned to never conclude",
}
ORDER_TEXT = "Tags not in correct order: <think>...</think><answer>...</answer>"


def skeleton(c: Column) -> Column:
    """Array of the think/answer tags of a text, lower-cased, in order of appearance."""
    found = F.regexp_extract_all(c, F.lit("(?i)</?(?:think|answer)>"), F.lit(0))
    return F.transform(found, F.lower)


def _has(tags: Column, tag: str) -> Column:
    return F.array_contains(tags, tag)


def _count(tags: Column, tag: str) -> Column:
    return F.size(F.filter(tags, lambda t: t == tag))


def tags_valid(tags: Column) -> Column:
    """True when nothing would be reported by :func:`tag_issues`."""
    return once(tags, _tags_valid)


def _tags_valid(tags: Column) -> Column:
    ordered = (
        (F.array_position(tags, "<think>") < F.array_position(tags, "</think>"))
        & (F.array_position(tags, "</think>") < F.array_position(tags, "<answer>"))
        & (F.array_position(tags, "<answer>") < F.array_position(tags, "</answer>"))
    )
    balanced = (_count(tags, "<think>") == _count(tags, "</think>")) & (
        _count(tags, "<answer>") == _count(tags, "</answer>")
    )
    # array_position is 0 for an absent tag, so presence of the first tag completes the test.
    return _has(tags, "<think>") & ordered & balanced


def tag_issues(tags: Column) -> Column:
    """Missing and unbalanced tags; the order is judged only when there are none of those."""
    return once(tags, _tag_issues)


def _tag_issues(tags: Column) -> Column:
    missing = [
        F.when(~_has(tags, tag), F.lit(message)) for tag, message in MISSING_TEXTS.items()
    ]
    unbalanced = []
    for name in ("think", "answer"):
        opens, closes = _count(tags, f"<{name}>"), _count(tags, f"</{name}>")
        unbalanced.append(
            F.when(
                opens != closes,
                F.format_string(f"Unbalanced {name} tags: %d opens, %d closes", opens, closes),
            )
        )
    found = F.array_compact(F.array(*missing, *unbalanced))
    return (
        F.when(_tags_valid(tags), F.array().cast("array<string>"))
        .when(F.size(found) > 0, found)
        .otherwise(F.array(F.lit(ORDER_TEXT)))
    )


def boxed_answer(c: Column) -> Column:
    r"""Content of the last ``\boxed{}``, trimmed; null when there is none."""
    return strip(F.try_element_at(F.regexp_extract_all(c, F.lit(BOXED_PATTERN), F.lit(1)), F.lit(-1)))


def final_answer(c: Column) -> Column:
    """The first answer phrase that leaves more than three characters.

    Per pattern only its first match counts; a short one moves on to the next pattern.
    """
    candidates = []
    for pattern in FINAL_ANSWER_PATTERNS:
        # Group 1 of these patterns is never empty on a match, so '' means "no match".
        raw = strip(F.regexp_extract(c, with_spaces(pattern), 1))
        cut = F.regexp_replace(raw, with_spaces(r"(?d)\s*[.,:;]?\s*$"), "")
        candidates.append(once(cut, lambda c: F.when(F.length(c) > 3, c)))
    return F.coalesce(*candidates)


def _heal_result(text: Column, method: Column | str | None) -> Column:
    label = F.lit(method) if method is None or isinstance(method, str) else method
    return F.struct(text.alias("text"), label.cast("string").alias("method"))


def heal_think(c: Column, tags: Column) -> Column:
    """Struct(text, method) after repairing the think tags; method is null if untouched."""
    opened, closed = _has(tags, "<think>"), _has(tags, "</think>")
    halves = F.split(c, "(?i)<answer>", 2)
    before_answer = F.concat(halves[0], F.lit("</think>\n\n<answer>"), halves[1])
    # Anchored, so that only the first conclusion is touched; the inserted text is constant.
    concluded = F.regexp_replace(c, rf"(?is)^(.*?{CONCLUSION_PATTERN})", "$1\n</think>\n")
    return (
        F.when(closed & ~opened, _heal_result(F.concat(F.lit("<think>\n"), c), "add_open_tag"))
        .when(
            opened & ~closed & _has(tags, "<answer>"),
            _heal_result(before_answer, "add_close_before_answer"),
        )
        .when(
            opened & ~closed & c.rlike(f"(?i){CONCLUSION_PATTERN}"),
            _heal_result(concluded, "add_close_at_conclusion"),
        )
        .otherwise(_heal_result(c, None))
    )


def heal_answer(c: Column, opened: Column, closed: Column, think_closed: Column) -> Column:
    """Struct(text, method) after repairing the answer tags; method is null if untouched.

    ``opened`` / ``closed`` / ``think_closed`` say which tags the text ``c`` holds.
    """
    close_tag = F.concat(rstrip(c), F.lit("\n</answer>"))
    after_tag = strip(F.split(c, "(?i)<answer>", 2)[1])
    boxed = F.nullif(boxed_answer(c), F.lit(""))
    # A boxed result goes before an answer phrase, which is looked for only without one.
    found = F.coalesce(
        once(boxed, lambda b: F.when(b.isNotNull(), _heal_result(b, "boxed_extraction"))),
        once(final_answer(c), lambda p: F.when(p.isNotNull(), _heal_result(p, "pattern_extraction"))),
    )

    def insert(answer: Column) -> Column:
        around = F.split(c, "(?i)</think>", 2)
        return F.concat(
            around[0], F.lit("</think>\n\n<answer>\n"), answer, F.lit("\n</answer>"), around[1]
        )

    inserted = once(
        F.when(~opened & think_closed, found),
        lambda f: F.when(f.isNotNull(), _heal_result(insert(f["text"]), f["method"])),
    )

    # The answer may be open-ended; it then runs to the end of the text.
    open_ended = "(?isd)<answer>.*?(?:</answer>|$)"
    content = F.regexp_extract(c, "(?isd)<answer>(.*?)(?:</answer>|$)", 1)
    replaced = once(
        F.when(opened & (F.length(strip(content)) < 20), boxed),
        lambda b: F.when(
            b.isNotNull(),
            _heal_result(
                # By name, because the separator is a Column here.
                F.call_function(
                    "array_join", F.split(c, open_ended),
                    F.concat(F.lit("<answer>\n"), b, F.lit("\n</answer>")),
                ),
                "answer_replacement",
            ),
        ),
    )
    filled = F.coalesce(F.length(strip(block(c, "answer"))) > 0, F.lit(False))
    fallback = F.when(opened & ~closed, _heal_result(close_tag, "close_tag_fallback"))
    return (
        F.when(opened & closed & filled, _heal_result(c, None))
        .when(opened & ~closed & (F.length(after_tag) > 20), _heal_result(close_tag, "close_tag"))
        .otherwise(F.coalesce(inserted, replaced, fallback, _heal_result(c, None)))
    )


def answer_status(c: Column, tags: Column) -> Column:
    """Method name of :func:`heal_answer`, or why there is none (already_valid, unrecoverable)."""
    opened, closed = _has(tags, "<answer>"), _has(tags, "</answer>")
    healed = heal_answer(c, opened, closed, _has(tags, "</think>"))
    filled = F.coalesce(F.length(strip(block(c, "answer"))) > 0, F.lit(False))
    return F.coalesce(
        healed["method"],
        F.when(opened & closed & filled, "already_valid").otherwise("unrecoverable"),
    )
