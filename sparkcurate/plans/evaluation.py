"""Evaluation of answers against retrieved papers, and correction of the bad ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.prompts import (
    CONTEXT_ABSTRACT,
    context_block,
    correction_prompt,
    grounded_context,
    judge_prompt,
    parsed_correction,
)
from sparkcurate.operators.completion import CompleteFn, complete
from sparkcurate.operators.evaluation import (
    correction_summary,
    parse_judge,
    select_corrections,
    summarise_eval,
    usable_corrections,
)
from sparkcurate.operators.retrieval import query_text, retrieve
from sparkcurate.session import materialise

SHOWN_PAPERS = 5
REFERENCE_CHARS = 300
REFERENCE_MINIMUM = 50


def map_questions(
    df: DataFrame, instruction: str = "instruction", response: str = "output", domain: str = "General"
) -> DataFrame:
    """question, reference and topic (topic, else sub_topic, else the domain) of test rows."""
    topic = [F.col(c) for c in ("topic", "sub_topic") if c in df.columns]
    kept = [c for c in df.columns if c not in (instruction, response, "topic", "sub_topic")]
    return df.select(
        *kept, F.coalesce(F.col(instruction), F.lit("")).alias("question"),
        F.coalesce(F.col(response), F.lit("")).alias("reference"),
        F.coalesce(*topic, F.lit(domain)).alias("topic"),
    )


def articles(hits: DataFrame, papers: DataFrame) -> DataFrame:
    """(query, papers_retrieved) from (query, rank, paper_id), best first."""
    return hits.join(papers, "paper_id").groupBy("query").agg(
        # At most k papers a query.
        F.sort_array(
            F.collect_list(
                F.struct(
                    "rank", "paper_id", "title", "year", "authors", "citation_count", "abstract",
                    "url", "pdf_url",
                )
            )
        ).alias("papers_retrieved")
    )


def retrieved_articles(questions: DataFrame, papers: DataFrame, k: int = SHOWN_PAPERS) -> DataFrame:
    """(query, papers_retrieved) of every distinct query that finds something, best first."""
    return articles(retrieve(questions, papers, "question", "paper_id", k).drop("citation_count"), papers)


def article_log(questions: DataFrame, papers: DataFrame, key: str, k: int = SHOWN_PAPERS) -> DataFrame:
    """(key, query, papers_retrieved): the retrieved papers of every question, best first.

    Retrieval runs once per distinct query. Questions without a hit have an empty array.
    """
    return (
        questions.select(key, query_text("question").alias("query"))
        .join(retrieved_articles(questions, papers, k), "query", "left")
        .withColumn("papers_retrieved", F.coalesce("papers_retrieved", F.array()))
    )


def _searched_reference(minimum: int, chars: int) -> Column:
    return F.when(F.length("reference") > minimum, F.substring("reference", 1, chars))


def _hits(questions: DataFrame, papers: DataFrame, k: int, minimum: int, chars: int) -> DataFrame:
    """(query, rank, paper_id) of questions and references, which are one table of queries, so that the papers are
    gone over once."""
    asked = questions.select("question").unionAll(
        questions.select(_searched_reference(minimum, chars).alias("question")).filter("question IS NOT NULL")
    )
    return materialise(retrieve(asked, papers, "question", "paper_id", k).drop("citation_count"), "hits")


def _with_context(questions: DataFrame, hits: DataFrame, papers: DataFrame, minimum: int, chars: int) -> DataFrame:
    """Questions with ``query`` and ``context``. Of a paper only what a context shows of it is moved."""
    shown = papers.withColumn("abstract", F.substring("abstract", 1, CONTEXT_ABSTRACT + 1))
    blocks = articles(hits, shown).select("query", context_block(F.col("papers_retrieved")).alias("_block"))
    own = blocks.withColumnRenamed("_block", "_own")
    again = blocks.select(F.col("query").alias("_query"), F.col("_block").alias("_ref"))
    return (
        questions.withColumn("query", query_text("question"))
        .withColumn("_start", _searched_reference(minimum, chars)).withColumn("_query", query_text("_start"))
        .drop("_start")
        .join(own, "query", "left").join(again, "_query", "left")
        .withColumn("context", grounded_context(F.col("_own"), F.col("_ref")))
        .drop("_own", "_ref", "_query")
    )


def _with_articles(rows: DataFrame, hits: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows with the whole ``papers_retrieved`` of their ``query``."""
    return rows.join(articles(hits, papers), "query", "left").withColumn(
        "papers_retrieved", F.coalesce("papers_retrieved", F.array())
    )


def grounded_questions(
    questions: DataFrame, papers: DataFrame, key: str, k: int = SHOWN_PAPERS,
    reference_minimum: int = REFERENCE_MINIMUM, reference_chars: int = REFERENCE_CHARS,
) -> DataFrame:
    """Questions with ``papers_retrieved`` and the text ``context`` shown to the judge.

    A reference of more than ``reference_minimum`` characters is searched for too, by its first
    ``reference_chars``. What was found, ``k`` papers a query, is stored by paper id alone and joined to both; the
    whole papers are joined by a plan of their own, so that who reads only the context moves no whole paper.
    """
    hits = _hits(questions, papers, k, reference_minimum, reference_chars)
    rows = _with_context(questions, hits, papers, reference_minimum, reference_chars)
    return _with_articles(rows, hits, papers)


def judge_prompts(grounded: DataFrame) -> DataFrame:
    """Rows to be judged: those with an answer and a context."""
    return grounded.filter(
        (F.coalesce(F.length("answer"), F.lit(0)) > 0) & (F.length("context") > 0)
    ).withColumn("system_prompt", F.lit("")).withColumn(
        "user_prompt",
        judge_prompt(F.col("question"), F.col("answer"), F.col("reference"), F.col("context")),
    )


@dataclass(frozen=True)
class Evaluation:
    """Per-question results, the one-row summary, and the article log."""

    results: DataFrame
    summary: DataFrame
    log: DataFrame


def evaluate(
    questions: DataFrame, papers: DataFrame, judge_fn: CompleteFn, key: str, retries: int = 2
) -> Evaluation:
    """Judge the ``answer`` of every question against retrieved papers.

    Questions without an answer or a context are skipped with the reason. A judged row is
    asked again while the judge fails or gives only zeros, at most ``retries`` times, and the
    last result stands.
    """
    hits = _hits(questions, papers, SHOWN_PAPERS, REFERENCE_MINIMUM, REFERENCE_CHARS)
    grounded = materialise(
        _with_context(questions, hits, papers, REFERENCE_MINIMUM, REFERENCE_CHARS), "grounded"
    )
    answered = F.coalesce(F.length("answer"), F.lit(0)) > 0
    pending = judge_prompts(grounded).select(key, "system_prompt", "user_prompt")
    final = None
    for attempt in range(retries + 1):
        replies = parse_judge(complete(pending, judge_fn).withColumnRenamed("output", "judge_response"))
        again = F.col("skipped") | F.coalesce(F.col("overall_score") == 0, F.lit(False))
        # A prompt is stored only where it is asked again.
        judged = materialise(
            replies.withColumn("again", again).withColumn("user_prompt", F.when(F.col("again"), F.col("user_prompt"))),
            "judged",
        )
        last = attempt == retries
        done = judged if last else judged.filter("not again")
        part = done.select(key, "scores", "overall_score", "justification", "reason", "skipped")
        final = part if final is None else final.unionByName(part)
        pending = judged.filter("again").select(key, "system_prompt", "user_prompt")
        if last or pending.isEmpty():
            break
    reason = (
        F.when(~answered, "No response")
        .when(F.length("context") == 0, "No Semantic Scholar articles found")
        .otherwise(F.col("reason"))
    )
    results = (
        grounded.join(final, key, "left")
        .withColumn("reason", reason)
        .withColumn("skipped", F.coalesce("skipped", F.lit(True)))
        .drop("context")
    )
    log = _with_articles(grounded, hits, papers).select(
        F.col(key).alias("question_index"), "question",
        F.col("query").alias("search_keywords"), "papers_retrieved",
    )
    return Evaluation(_with_articles(results, hits, papers).drop("query"), summarise_eval(results), log)


@dataclass(frozen=True)
class Corrections:
    """Replies, the usable corrected samples, and the one-row summary."""

    replies: DataFrame
    corrected: DataFrame
    summary: DataFrame


def own_context(papers: Column) -> Column:
    """The retrieved papers of a question as text, those with a title, best first."""
    titled = F.filter(papers, lambda p: F.coalesce(F.length(p["title"]), F.lit(0)) > 0)
    return F.array_join(
        F.transform(titled, lambda p: F.concat(F.lit("### "), p["title"], F.lit("\n"), F.coalesce(p["abstract"], F.lit("")))),
        "\n\n",
    )


def apply_corrections(
    results: DataFrame, log: DataFrame | None, complete_fn: CompleteFn, threshold: float = 50.0,
    score_col: str = "overall_score", key: str = "question_index",
) -> Corrections:
    """Ask for a better answer for every result below the threshold.

    With a log, every prompt shows the papers that were retrieved for its own question, ``key``
    being the results' column with the log's question_index.
    """
    failing, context = select_corrections(results, threshold, score_col), F.lit("")
    if log is not None:
        own = log.select(F.col("question_index").alias(key), own_context(F.col("papers_retrieved")).alias("_own"))
        failing, context = failing.join(own, key, "left"), F.coalesce("_own", F.lit(""))
    name = lambda *names: F.coalesce(
        *[F.col(n) for n in names if n in results.columns], F.lit("")
    )
    prompts = failing.withColumn("system_prompt", F.lit("")).withColumn(
        "user_prompt",
        correction_prompt(
            name("instruction", "question"), name("model_output", "output", "answer"),
            name("reference", "expected"), context,
        ),
    )
    replies = materialise(
        complete(prompts.select("system_prompt", "user_prompt"), complete_fn).withColumn(
            "correction", parsed_correction(F.col("output"))
        ),
        "corrections",
    )
    usable = usable_corrections(replies.filter("correction is not null").select("correction.*"))
    return Corrections(replies, usable, correction_summary(replies))


def append_corrections(training: DataFrame, corrected: DataFrame) -> DataFrame:
    """The training set with the corrected samples added."""
    return training.unionByName(usable_corrections(corrected), allowMissingColumns=True)
