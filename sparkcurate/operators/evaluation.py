"""Evaluation results: summaries, article logs, selection for correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.scoring import DIMENSIONS, eval_class, judge_scores, justification, overall_score
from sparkcurate.operators.ranking import first_per_key


def parse_judge(df: DataFrame, response: str = "judge_response") -> DataFrame:
    """Add scores, overall_score, justification, skipped and reason to judged rows.

    No response means the judge failed; the row is then skipped.
    """
    reply = F.col(response)
    return (
        df.withColumn("skipped", reply.isNull())
        .withColumn("reason", F.when(reply.isNull(), F.lit("Judge model failed")))
        .withColumn("scores", F.when(reply.isNotNull(), judge_scores(reply)))
        .withColumn("overall_score", F.when(reply.isNotNull(), overall_score(F.col("scores"))))
        .withColumn("justification", justification(reply))
    )


def summarise_eval(results: DataFrame) -> DataFrame:
    """One row: averages over the scored results (0.0 if none) and counts per class."""
    classed = results.withColumn("_class", eval_class(F.col("skipped"), F.col("overall_score")))
    scored = F.col("_class") == "scored"

    def average(c: Column) -> Column:
        return F.coalesce(F.avg(F.when(scored, c)), F.lit(0.0))

    return classed.agg(
        *[average(F.col(f"scores.{n}")).alias(n) for n in DIMENSIONS],
        average(F.col("overall_score")).alias("overall_accuracy"),
        F.count_if(scored).alias("samples_scored"),
        F.count_if(F.col("_class") == "skipped").alias("samples_skipped"),
        F.count_if(F.col("_class") == "failed").alias("samples_failed"),
    )


def attach_sources(results: DataFrame, log: DataFrame, index: str = "question_index") -> DataFrame:
    """Add ``rag_sources`` from the last log entry of each question; an empty array if none.

    ``log`` holds (question_index, log_seq, papers_retrieved).
    """
    last = first_per_key(log, index, ["log_seq"], last=True)
    sources = F.transform(
        "papers_retrieved",
        lambda p: F.struct(
            F.coalesce(p["title"], F.lit("")).alias("title"), p["year"].alias("year"),
            p["authors"].alias("authors"), p["url"].alias("url"), p["pdf_url"].alias("pdf_url"),
            F.coalesce(p["is_open_access"], F.lit(False)).alias("is_open_access"),
        ),
    )
    joined = results.join(last.select(index, sources.alias("_s")), index, "left")
    return joined.withColumn("rag_sources", F.coalesce("_s", F.array())).drop("_s")


def failing_score(score_col: str, fallback: str | None = None) -> Column:
    """The score a correction looks at: the first that is given and not zero, else 0."""
    other = F.col(fallback) if fallback else F.lit(None).cast("double")
    return F.coalesce(F.nullif(F.col(score_col), F.lit(0)), other, F.lit(0)).cast("double")


def select_corrections(
    results: DataFrame,
    threshold: float = 50.0,
    score_col: str = "overall_score",
    fallback: str | None = None,
) -> DataFrame:
    """Results below the threshold. A result without a score counts as 0."""
    return results.filter(failing_score(score_col, fallback) < threshold)


def usable_corrections(corrected: DataFrame) -> DataFrame:
    """Corrections with both fields filled: the only ones that are appended."""
    return corrected.filter(
        (F.coalesce(F.length("instruction"), F.lit(0)) > 0)
        & (F.coalesce(F.length("output"), F.lit(0)) > 0)
    )


def correction_summary(replies: DataFrame, parsed: str = "correction") -> DataFrame:
    """One row: failing, corrected, errors, appended. ``parsed`` is the struct or null."""
    c = F.col(parsed)
    usable = (F.coalesce(F.length(c["instruction"]), F.lit(0)) > 0) & (
        F.coalesce(F.length(c["output"]), F.lit(0)) > 0
    )
    return replies.agg(
        F.count(F.lit(1)).alias("total_failing"),
        F.count(c).alias("corrected"),
        F.count_if(c.isNull()).alias("errors"),
        F.count_if(usable).alias("appended"),
    )


def context_papers(log: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` logged articles with a title: (title, abstract), in log order."""
    return (
        log.select("question_index", F.posexplode("papers_retrieved").alias("pos", "p"))
        .select("question_index", "pos", "p.title", "p.abstract")
        .orderBy("question_index", "pos")
        .limit(n)
        .filter(F.coalesce(F.length("title"), F.lit(0)) > 0)
    )


def trial_summary(results: DataFrame, gate: float = 0.8) -> DataFrame:
    """One row over trial results (quality, seconds, flags): label counts, averages, the gate."""
    n = F.count(F.lit(1))
    label = {q: F.count_if(F.col("quality") == q) for q in ("PASS", "MARGINAL", "FAIL", "ERROR")}
    usable = label["PASS"] + label["MARGINAL"]
    return results.agg(
        n.alias("total"),
        *[c.alias(q.lower()) for q, c in label.items()],
        F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"),
        F.coalesce(F.avg("flags.domain_score"), F.lit(0.0)).alias("avg_domain_score"),
        F.coalesce(F.max("flags.domain_total"), F.lit(0)).alias("max_domain_total"),
        F.coalesce(usable / F.nullif(n, F.lit(0)) >= gate, F.lit(False)).alias("ready"),
    )
