"""Judge scores, classifications and other numeric Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkcurate.functions.numbers import rounded, scientific
from sparkcurate.functions.text import strip, with_spaces

# Score dimensions of a judge response and their weights in the overall score.
DIMENSIONS = {"factual_accuracy": 0.50, "completeness": 0.30, "technical_precision": 0.20}


def _number(c: Column, pattern: str, kind: str = "bigint") -> Column:
    """Group 1 of the first match as a number without thousands separators; null if none."""
    digits = F.regexp_replace(F.regexp_extract(c, with_spaces(pattern), 1), ",", "")
    return digits.try_cast(kind)


def judge_scores(response: Column) -> Column:
    """Struct of the three dimensions, each 0..100, and 0 when the response does not give it.

    A run of more than 18 digits does not fit a number and is simply above 100.
    """
    parts = []
    for name in DIMENSIONS:
        raw = F.regexp_extract(response, with_spaces(rf"(?i){name}:\s*(\d+)"), 1)
        value = F.when(F.length(raw) > 18, F.lit(100)).otherwise(
            F.least(F.lit(100), F.greatest(F.lit(0), raw.try_cast("bigint")))
        )
        parts.append(F.when(raw == "", F.lit(0)).otherwise(value).cast("int").alias(name))
    return F.struct(*parts)


def overall_score(scores: Column) -> Column:
    return sum((scores[n] * F.lit(w) for n, w in DIMENSIONS.items()), F.lit(0.0))


def justification(response: Column) -> Column:
    return strip(F.regexp_extract(response, with_spaces(r"(?is)JUSTIFICATION:\s*(.+)"), 1))


def eval_class(skipped: Column, overall: Column) -> Column:
    """scored / skipped / failed."""
    return (
        F.when(F.coalesce(skipped, F.lit(False)), "skipped")
        .when(F.coalesce(overall, F.lit(0.0)) > 0, "scored")
        .otherwise("failed")
    )


def should_retry(skipped: Column, reason: Column, scores: Column, overall: Column) -> Column:
    """True for an evaluation attempt worth repeating.

    No response, a failed judge, no retrieved articles, or a zero in every score.
    """
    why = F.coalesce(reason, F.lit(""))
    zero = overall == 0
    for name in DIMENSIONS:
        zero = zero & (F.coalesce(scores[name], F.lit(0)) == 0)
    skip = F.coalesce(skipped, F.lit(False))
    return (
        (why == "No response")
        | (skip & (why == "Judge model failed"))
        | (skip & F.contains(F.lower(why), F.lit("articles")))
        | (~skip & F.coalesce(zero, F.lit(False)))
    )


def run_log_metrics(text: Column) -> Column:
    """Struct of token counts and energy named in the text of a run log; null if unnamed."""
    return F.struct(
        _number(text, r"Prompt tokens:\s+([\d,]+)").alias("prompt_tokens"),
        _number(text, r"Completion tokens:\s+([\d,]+)").alias("completion_tokens"),
        _number(text, r"Total tokens:\s+([\d,]+)").alias("total_tokens"),
        _number(text, r"Total energy:\s+([\d.]+)\s*kWh", "double").alias("gpu_kwh"),
    )


def metric_bucket(value: Column) -> Column:
    """Traffic-light bucket of a 0..1 metric."""
    return (
        F.when(value.isNull(), "none")
        .when(value >= 0.8, "high")
        .when(value >= 0.6, "middle")
        .otherwise("low")
    )


def metric_text(value: Column) -> Column:
    """Percent text of a 0..1 metric with one decimal."""
    percent = F.format_string("%.1f", rounded(value * 100, ties_up=True))
    # format_string prints something for null, so null is taken care of first.
    return F.when(value.isNull(), F.lit("\u2014")).otherwise(F.concat(percent, F.lit("%")))


def dataset_node_size(qa_count: Column) -> Column:
    return rounded(F.least(F.lit(20.0), 12 + F.log2(qa_count + 1) * 1.5))


def paper_node_size(qa_count: Column, citations: Column) -> Column:
    return rounded(4 + F.log2(qa_count + 1) * 2 + F.log2(citations + 1) * 2)


def progress_percent(step: Column, max_steps: Column) -> Column:
    return F.when(max_steps > 0, rounded(step / max_steps * 100)).otherwise(F.lit(0.0))


def progress_message(step: Column, max_steps: Column, loss: Column, rate: Column) -> Column:
    """``step 5/10 (50.0%) | loss=0.1235 | lr=1.00e-05``; parts without a value are left out."""
    head = F.concat(
        F.lit("step "), step.cast("string"), F.lit("/"), max_steps.cast("string"), F.lit(" ("),
        F.when(max_steps > 0, F.format_string("%.1f", progress_percent(step, max_steps)))
        .otherwise("0"),
        F.lit("%)"),
    )
    return F.concat_ws(
        " | ",
        head,
        F.when(loss.isNotNull(), F.concat(F.lit("loss="), F.format_string("%.4f", rounded(loss, 4)))),
        F.when(rate.isNotNull(), F.concat(F.lit("lr="), scientific(rate))),
    )


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch, for time stamps with and without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end`` with fractions; 0 when the start is unknown."""
    micros = epoch_micros(end) - epoch_micros(start)
    return F.when(start.isNull(), F.lit(0.0)).otherwise(micros / F.lit(1e6))


def paper_targets(target: Column) -> Column:
    """Struct(max_papers, top_n) for a wanted number of pairs."""
    papers = F.greatest(F.lit(10), F.ceil(target / 3)).cast("bigint")
    return F.struct(
        papers.alias("max_papers"),
        F.greatest(F.lit(5), F.floor(papers / 4)).cast("bigint").alias("top_n"),
    )
