"""Queries and upkeep of the dataset / paper / qa tables.

Tables: datasets(id, user_id, topic, status, created_at, completed_at, ...),
papers(id, paper_id, title, ..., user_id, dataset_id), qa_pairs(id, instruction, output,
is_valid, was_healed, paper_id, dataset_id, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.prompts import author_line_et_al
from sparkcurate.operators.ranking import first_per_key


def search(df: DataFrame, term: str, cols: Sequence[str]) -> DataFrame:
    """Rows where a column holds the term, ignoring case; ``%`` and ``_`` are wildcards."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return df.filter(hit)


def search_text(df: DataFrame, term: str, cols: Sequence[str]) -> DataFrame:
    """Rows where the columns joined by a blank hold the term, ignoring case; no wildcards."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])
    return df.filter(F.contains(F.lower(text), F.lower(F.lit(term))))


def topics(datasets: DataFrame, papers: DataFrame) -> DataFrame:
    """Distinct non-empty topics of datasets that have papers."""
    named = datasets.filter(F.coalesce(F.col("topic"), F.lit("")) != "")
    # Distinct first: a dataset with a third of all papers then sends one row per task.
    with_papers = papers.select(F.col("dataset_id").alias("id")).distinct()
    return (
        named.join(with_papers, "id", "left_semi")
        .select("topic").distinct().orderBy("topic")
    )


def papers_by_topic(papers: DataFrame, datasets: DataFrame, topic: str) -> DataFrame:
    """Papers whose dataset has a topic matching the term (ignoring case)."""
    chosen = search(datasets, topic, ["topic"]).select(F.col("id").alias("dataset_id"))
    return papers.join(chosen, "dataset_id", "left_semi")


def link_papers(qa: DataFrame, papers: DataFrame, by: Sequence[str] = ("source_paper_id",)) -> DataFrame:
    """Add ``paper_id``, the id of the paper named by ``source_paper_id``; null if unknown.

    A source id given to several papers means the one with the largest id. Join columns other
    than the source id (such as the dataset) must exist on both sides.
    """
    others = [c for c in by if c != "source_paper_id"]
    last = (
        papers.withColumnRenamed("paper_id", "source_paper_id")
        .groupBy("source_paper_id", *others)
        .agg(F.max("id").alias("paper_id"))
    )
    return qa.join(last, list(by), "left")


def paper_detail(papers: DataFrame, qa: DataFrame, paper: int) -> DataFrame:
    """The pairs of one paper, each with the paper's data; one row with nulls if it has none.

    Kept flat, ordered by id when shown, because a paper may have any number of pairs.
    """
    pairs = qa.filter(F.col("paper_id") == paper).select(
        F.col("paper_id").alias("id"), F.col("id").alias("qa_id"), "instruction", "output",
        "is_valid", "was_healed", "think_text", "answer_text",
    )
    head = papers.filter(F.col("id") == paper).select(
        "id", F.coalesce(F.col("paper_id"), F.col("id").cast("string")).alias("paper_id"), "title",
        "abstract", "year", F.coalesce("citation_count", F.lit(0)).alias("citation_count"),
    )
    return head.join(pairs, "id", "left")


def qa_counts(parents: DataFrame, qa: DataFrame, foreign: str, name: str = "qa_pair_count") -> DataFrame:
    """``parents`` with the number of their pairs, zero included."""
    counts = qa.filter(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias("id")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        parents.drop(name).join(counts, "id", "left")
        .withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n")
    )


def contents(datasets: DataFrame, papers: DataFrame, qa: DataFrame) -> DataFrame:
    """Per dataset: papers, pairs linked to a paper, pairs linked to the dataset only, pairs."""
    per_paper = papers.filter("dataset_id is not null").groupBy(F.col("dataset_id").alias("id")).agg(
        F.count(F.lit(1)).alias("papers")
    )
    per_qa = qa.filter("dataset_id is not null").groupBy(F.col("dataset_id").alias("id")).agg(
        F.count("paper_id").alias("qa_with_paper"),
        F.count_if(F.col("paper_id").isNull()).alias("qa_dataset_only"),
        F.count(F.lit(1)).alias("qa_total"),
    )
    return datasets.select("id", "topic").join(per_paper, "id", "left").join(per_qa, "id", "left").na.fill(0)


def select_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the wanted ids; :func:`missing_ids` tells whether all of them were found."""
    return df.join(ids.select(key), key, "left_semi")


def missing_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Wanted ids that have no row; empty when the selection is complete."""
    return ids.select(key).distinct().join(df.select(key), key, "left_anti")


def delete_dataset(
    datasets: DataFrame, papers: DataFrame, qa: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New versions of the tables without the datasets in ``gone`` (id) and what hangs on them."""
    gone = gone.select("id")
    by_dataset = gone.withColumnRenamed("id", "dataset_id")
    gone_papers = papers.join(by_dataset, "dataset_id", "left_semi").select(
        F.col("id").alias("paper_id")
    )
    return (
        datasets.join(gone, "id", "left_anti"),
        papers.join(by_dataset, "dataset_id", "left_anti"),
        qa.join(by_dataset, "dataset_id", "left_anti").join(gone_papers, "paper_id", "left_anti"),
    )


def delete_users(
    datasets: DataFrame, papers: DataFrame, qa: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New versions of the tables without the datasets of the users in ``gone`` (id)."""
    owned = datasets.join(gone.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return delete_dataset(datasets, papers, qa, owned)


def delete_papers(papers: DataFrame, qa: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New versions of the tables without the papers in ``gone`` (id) and their pairs."""
    gone = gone.select("id")
    return (
        papers.join(gone, "id", "left_anti"),
        qa.join(gone.withColumnRenamed("id", "paper_id"), "paper_id", "left_anti"),
    )


def delete_runs(runs: DataFrame, evaluations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New versions of the tables without the training runs in ``gone`` (id) and their evaluations."""
    gone = gone.select("id")
    return (
        runs.join(gone, "id", "left_anti"),
        evaluations.join(
            gone.withColumnRenamed("id", "training_run_id"), "training_run_id", "left_anti"
        ),
    )


def counters_after_delete(datasets: DataFrame, deleted: DataFrame) -> DataFrame:
    """Dataset counters lowered by the deleted pairs, never below zero."""
    lost = deleted.groupBy(F.col("dataset_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("is_valid").alias("_v")
    )
    n, v = F.coalesce("_n", F.lit(0)), F.coalesce("_v", F.lit(0))
    zero = F.lit(0)
    return (
        datasets.join(lost, "id", "left")
        .withColumn("actual_size", F.greatest(zero, F.col("actual_size") - n))
        .withColumn("valid_count", F.greatest(zero, F.col("valid_count") - v))
        .withColumn("invalid_count", F.greatest(zero, F.col("invalid_count") - (n - v)))
        .drop("_n", "_v")
    )


def latest_completed(datasets: DataFrame) -> DataFrame:
    """The dataset of every user that completed last; ties go to the larger id."""
    return first_per_key(
        datasets.filter(F.col("status") == "completed"), "user_id", ["completed_at", "id"], last=True
    )


def training_rows(qa: DataFrame, dataset_id: int | None = None) -> DataFrame:
    """Valid pairs as training rows."""
    if dataset_id is not None:
        qa = qa.filter(F.col("dataset_id") == dataset_id)
    return qa.filter(F.col("is_valid")).select("instruction", "output")


def resolve_eval_paths(evaluations: DataFrame, runs: DataFrame) -> DataFrame:
    """Model and dataset paths of evaluations, taken from the training run where not given.

    The model of a run counts only once the run is completed.
    """
    run = runs.select(
        F.col("id").alias("training_run_id"),
        F.when(F.col("status") == "completed", F.col("adapter_path")).alias("_model"),
        F.col("dataset_path").alias("_data"),
    )
    joined = evaluations.join(run, "training_run_id", "left")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return (
        joined.withColumn("model_path", F.coalesce(given("model_path"), "_model"))
        .withColumn("correction_path", F.coalesce("_data", given("test_dataset_path")))
        .withColumn("test_dataset_path", F.coalesce(given("test_dataset_path"), "_data"))
        .drop("_model", "_data")
    )


def export_rows(qa: DataFrame) -> DataFrame:
    """The five published fields."""
    return qa.select("instruction", "output", "is_valid", "was_healed", "source_title")


def source_rows(papers: DataFrame) -> DataFrame:
    """Cells of the source table of a dataset card, one row per paper, with its ``dataset_id``."""
    title = F.coalesce("title", F.lit("Unknown"))
    url = F.coalesce("url", F.lit(""))
    return papers.select(
        "id", "dataset_id",
        F.when(url != "", F.concat(F.lit("["), title, F.lit("]("), url, F.lit(")")))
        .otherwise(title).alias("title"),
        author_line_et_al(F.coalesce("authors", F.array().cast("array<string>"))).alias("authors"),
        F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit("N/A")).alias("year"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("qa_pair_count", F.lit(0)).alias("qa_pair_count"),
    )


def size_category(pairs: Column) -> Column:
    return F.when(pairs >= 1000, "1K<n<10K").otherwise("n<1K")
