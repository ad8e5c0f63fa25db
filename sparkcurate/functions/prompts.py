"""Prompt and document text built from templates. Templates are taken apart while the plan is
built, so braces inside the data are never interpreted."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.text import strip, truncated

# Pair-count hints added to the system prompt, and the sizes that choose them.
SHORT_CONTENT = 2000
LONG_CONTENT = 12000
CHUNK_SIZE = 10000
HINT_SHORT = "\n\nGenerate 3-5 Q&A pairs from this content."
HINT_MEDIUM = "\n\nGenerate 6-8 Q&A pairs from this content."

# Placeholders a judge template must hold; the reply format is what ``judge_scores`` reads.
JUDGE_TEMPLATE = """Check a model's answer against the sources below and grade it.

Question:
{question}

Answer to grade:
{answer}

Expected answer:
{reference}

Sources:
{context}

Give each of the three dimensions a whole number from 0 (worst) to 100 (best) and reply with
exactly these four lines:
FACTUAL_ACCURACY: [score]
COMPLETENESS: [score]
TECHNICAL_PRECISION: [score]
JUSTIFICATION: [one short paragraph]"""

CORRECTION_TEMPLATE = """A model answered the question below badly. Write the answer it should have given.

Question:
{instruction}

Rejected answer:
{output}

Expected answer:
{reference}

Sources:
{context}

Use the sources and the expected answer. Reply with one JSON object and nothing else:
{{"instruction": "<the question, unchanged>", "output": "<the new answer>"}}"""

# How much of each part a judge prompt shows.
JUDGE_LIMITS = {"question": 1500, "answer": 2000, "reference": 1500, "context": 3000}

# How much of an abstract a context shows.
CONTEXT_ABSTRACT = 500


def render(template: str, *positional: Column, **named: Column) -> Column:
    """``str.format`` as a Column: ``{name}`` and ``{}`` stand for Columns, null prints as ''."""
    parts, queue = [], list(positional)
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            value = queue.pop(0) if name == "" else named[name]
            parts.append(F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def placeholders(template: str) -> set[str]:
    return {name for _, name, _, _ in Formatter().parse(template) if name}


def author_line(authors: Column, shown: int = 5) -> Column:
    """The first authors, comma separated."""
    return F.array_join(F.slice(authors, 1, shown), ", ")


def author_line_et_al(authors: Column, shown: int = 3) -> Column:
    return F.when(
        F.size(authors) > shown, F.concat(author_line(authors, shown), F.lit(" et al."))
    ).otherwise(author_line(authors, shown))


def pair_hint(content: Column, section: Column | None = None, sections: Column | None = None):
    """How many pairs to ask for: by section of a long paper, else by content length."""
    whole = F.when(F.length(content) < SHORT_CONTENT, F.lit(HINT_SHORT)).otherwise(
        F.lit(HINT_MEDIUM)
    )
    if section is None:
        return whole
    part = F.concat(
        F.lit("\n\nGenerate 3-4 Q&A pairs from this section (section "),
        section.cast("string"), F.lit("/"), sections.cast("string"), F.lit(" of the paper)."),
    )
    return F.when(section.isNotNull(), part).otherwise(whole)


def context_block(papers: Column) -> Column:
    """Numbered text of an array of retrieved papers (title, year, authors, citations, abstract)."""

    def entry(p: Column, i: Column) -> Column:
        return F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "),
            F.coalesce(p["title"], F.lit("Unknown")), F.lit(" ("),
            F.coalesce(p["year"].cast("string"), F.lit("N/A")), F.lit(")\n    Authors: "),
            F.coalesce(author_line_et_al(p["authors"]), F.lit("")),
            F.lit("\n    Citations: "), F.coalesce(p["citation_count"], F.lit(0)).cast("string"),
            F.lit("\n    Abstract: "),
            F.coalesce(truncated(p["abstract"], CONTEXT_ABSTRACT), F.lit("")),
        )

    return F.coalesce(F.array_join(F.transform(papers, entry), "\n\n"), F.lit(""))


def grounded_context(question_context: Column, reference_context: Column) -> Column:
    """Both contexts under a heading each, or the one that is there."""
    q, r = F.coalesce(question_context, F.lit("")), F.coalesce(reference_context, F.lit(""))
    return F.when(
        (q != "") & (r != ""),
        F.concat(
            F.lit("Academic context from question:\n"), q,
            F.lit("\n\nAdditional context from reference topic:\n"), r,
        ),
    ).otherwise(F.concat(q, r))


def judge_prompt(
    question: Column, answer: Column, reference: Column, context: Column,
    template: str = JUDGE_TEMPLATE,
) -> Column:
    def cut(name: str, c: Column) -> Column:
        return F.substring(c, 1, JUDGE_LIMITS[name])

    expected = F.when(
        F.coalesce(F.length(reference), F.lit(0)) > 0, cut("reference", reference)
    ).otherwise("No reference provided")
    return render(
        template, question=cut("question", question), answer=cut("answer", answer),
        reference=expected, context=cut("context", context),
    )


def correction_prompt(
    instruction: Column, output: Column, reference: Column, context: Column,
    template: str = CORRECTION_TEMPLATE,
) -> Column:
    return render(
        template, instruction=instruction, output=output, reference=reference, context=context
    )


def fenced_json(reply: Column) -> Column:
    """JSON text of a reply: what stands between its first two fences, else the whole reply."""
    text = strip(reply)
    inner = F.split(text, "```")[1]
    inner = F.when(F.startswith(inner, F.lit("json")), F.substring(inner, 5, 2**31 - 1)).otherwise(
        inner
    )
    return F.when(F.contains(text, F.lit("```")), strip(inner)).otherwise(text)


def parsed_correction(reply: Column) -> Column:
    """Struct(instruction, output) of a correction reply; null when it is not valid JSON."""
    text = fenced_json(reply)
    return F.when(
        F.try_parse_json(text).isNotNull(),
        F.from_json(text, "instruction string, output string"),
    )


def topic_label(titles: Column, total: Column) -> Column:
    """Label from the first three titles, 40 characters each, and how many more there are."""
    shown = F.array_join(F.transform(F.slice(titles, 1, 3), lambda t: F.substring(t, 1, 40)), ", ")
    more = F.concat(F.lit(" (+"), (total - 3).cast("string"), F.lit(" more)"))
    return F.concat(shown, F.when(total > 3, more).otherwise(""))
