"""Healing and judging samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.config import Rules
from sparkcurate.functions import tags as T
from sparkcurate.functions.numbers import rounded
from sparkcurate.functions.validation import latex_issues, quality_issues
from sparkcurate.operators.rows import settled

def heal_samples(df: DataFrame, output_col: str = "output") -> DataFrame:
    """Repair outputs whose tags are not valid.

    Replaces ``output_col`` and adds ``heal_tried``, ``healed`` and ``heal_methods``. The
    repairs run in two steps, think tags before answer tags, and only for rows that need them.
    """
    tags, output = F.col("_tags"), F.col(output_col)
    scanned = settled(
        df.withColumn(output_col, F.coalesce(output, F.lit(""))), {"_tags": T.skeleton(output)}
    ).withColumn("heal_tried", ~T.tags_valid(tags))
    think = settled(
        scanned, {"_think": F.when(F.col("heal_tried"), T.heal_think(output, tags))}
    )
    text, method = F.col("_think.text"), F.col("_think.method")
    # Which tags the text holds after the first repair follows from its method.
    think_closed = F.array_contains(tags, "</think>") | F.coalesce(
        method.startswith("add_close"), F.lit(False)
    )
    answer = settled(
        think,
        {
            "_answer": F.when(
                F.col("heal_tried"),
                T.heal_answer(
                    text, F.array_contains(tags, "<answer>"),
                    F.array_contains(tags, "</answer>"), think_closed,
                ),
            )
        },
    )
    methods = F.array_compact(
        F.array(
            F.concat(F.lit("think:"), F.col("_think.method")),
            F.concat(F.lit("answer:"), F.col("_answer.method")),
        )
    )
    healed = F.coalesce(
        F.col("_think.method").isNotNull() | F.col("_answer.method").isNotNull(), F.lit(False)
    )
    plain = [c for c in df.columns if c != output_col]
    return answer.select(
        *[F.col(f"`{c}`") for c in plain],
        F.coalesce(F.col("_answer.text"), output).alias(output_col),
        "heal_tried",
        healed.alias("healed"),
        F.when(healed, methods).otherwise(F.array().cast("array<string>")).alias("heal_methods"),
    )


def judge_samples(
    df: DataFrame, rules: Rules = Rules(), heal: bool = True, output_col: str = "output"
) -> DataFrame:
    """Heal (optionally) and attach the issues of every sample. No row is dropped."""
    none = F.array().cast("array<string>")
    if heal:
        rows = heal_samples(df, output_col)
    else:
        rows = df.withColumn(output_col, F.coalesce(F.col(output_col), F.lit(""))).select(
            "*", F.lit(False).alias("heal_tried"), F.lit(False).alias("healed"),
            none.alias("heal_methods"),
        )
    output = F.col(output_col)
    latex = none
    if rules.check_latex_consistency:
        latex = latex_issues(output, rules.plain_text_patterns, rules.texts)
    return settled(
        settled(rows, {"_tags": T.skeleton(output)}),
        {
            "tag_issues": T.tag_issues(F.col("_tags")),
            "latex_issues": latex,
            "quality_issues": quality_issues(output, rules),
        },
    ).drop("_tags")


def with_decision(judged: DataFrame, strict: bool = True, malformed: str | None = None) -> DataFrame:
    """Add ``issues`` and ``keep``.

    Strict keeps only samples without an issue. Lenient keeps those whose tag issues do not
    name the closing answer tag. Rows flagged ``malformed`` are never kept.
    """
    all_issues = F.concat("tag_issues", "latex_issues", "quality_issues")
    if strict:
        keep = F.size("issues") == 0
    else:
        keep = ~F.exists("tag_issues", lambda i: F.contains(i, F.lit("</answer>")))
    if malformed:
        all_issues = F.when(F.col(malformed), F.array(F.lit("Invalid JSON"))).otherwise(all_issues)
        keep = keep & ~F.col(malformed)
    return judged.withColumn("issues", all_issues).withColumn("keep", keep)


def funnel(decided: DataFrame, malformed: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row of filter counts, or one per ``by``. A sample may fail several checks and count in each."""
    read = ~F.col(malformed) if malformed else F.lit(True)
    n, kept = F.count(F.lit(1)), F.count_if("keep")
    tried = F.count_if(read & F.col("heal_tried"))
    success = F.count_if(read & F.col("healed"))

    def percent(part, whole):
        return rounded(100 * part / F.greatest(F.lit(1), whole))

    return decided.groupBy(*by).agg(
        n.alias("total"),
        F.count_if(F.col("keep") & ~F.col("healed")).alias("passed_original"),
        F.count_if(F.col("keep") & F.col("healed")).alias("passed_healed"),
        F.count_if(read & (F.size("tag_issues") > 0)).alias("failed_tags"),
        F.count_if(read & (F.size("latex_issues") > 0)).alias("failed_latex"),
        F.count_if(read & (F.size("quality_issues") > 0)).alias("failed_quality"),
        tried.alias("heal_attempts"),
        success.alias("heal_success"),
        (n - kept).alias("rejected"),
        percent(kept, n).alias("pass_pct"),
        percent(success, tried).alias("heal_pct"),
    )


def rejections(decided: DataFrame, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` rejected samples with their first two issues."""
    return (
        decided.filter(~F.col("keep"))
        .select(order, "healed", "heal_methods", F.slice("issues", 1, 2).alias("issues"))
        .orderBy(order)
        .limit(n)
    )
