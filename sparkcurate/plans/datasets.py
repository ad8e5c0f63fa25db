"""Whole datasets: build one from papers, load it into the catalogue, publish it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.config import Rules, Task
from sparkcurate.functions.prompts import topic_label
from sparkcurate.functions.scoring import run_log_metrics
from sparkcurate.functions.text import block, strip
from sparkcurate.operators import catalogue
from sparkcurate.operators.completion import CompleteFn
from sparkcurate.operators.ranking import with_position
from sparkcurate.operators.stats import result_counts
from sparkcurate.plans.papers import (
    citation_totals,
    citations,
    cited_papers,
    paper_pairs,
    resolve_full_text,
    source_key,
    topic_ranks,
    with_paper,
    with_ranks,
)
from sparkcurate.plans.samples import FilterResult, filter_samples
from sparkcurate.session import exists, materialise
from sparkcurate.sources.readers import read_jsonl_tolerant
from sparkcurate.sources.writers import save_part, save_table, write_jsonl


@dataclass(frozen=True)
class BuiltDataset:
    """Tables of a built dataset; all of them carry what is needed to load the catalogue.

    Replies and places are stored. Samples are joined from them when they are read, so that the metadata of their
    papers are moved for those who read them; only the citations, which read the samples several times, store them.
    """

    samples: DataFrame
    attempts: DataFrame
    rules: Rules

    @cached_property
    def filtered(self) -> FilterResult:
        return filter_samples(self.samples, self.rules)

    @cached_property
    def citations(self) -> DataFrame:
        stored = materialise(self.samples, "samples")
        return citations(stored, filter_samples(stored, self.rules).kept, by=["topic"])

    @property
    def stats(self) -> DataFrame:
        """Filter counts of every topic."""
        return self.filtered.stats_by("topic")

    @property
    def citation_totals(self) -> DataFrame:
        return citation_totals(self.citations)


def build_dataset(
    topics: DataFrame, papers: DataFrame, fetched: DataFrame, complete_fn: CompleteFn, task: Task,
    separator: str = "\n\n",
) -> BuiltDataset:
    """Search results and fetched texts to filtered datasets, one per topic, for any number of topics at once.

    A paper found for several topics is asked about once, and what it gave belongs to each of them: samples,
    citations and statistics carry ``topic``, and ``line_no`` counts within it.
    """
    ranks = materialise(topic_ranks(topics, papers).filter("fetch"), "ranks")
    # Ids and places are enough to find where a paper is asked about; its texts are moved once.
    chosen = materialise(with_ranks(papers, ranks).select("topic", "paper_id", "rank"), "chosen")
    first = chosen.groupBy("paper_id").agg(F.min("topic").alias("topic"))
    asked = chosen.join(first, ["paper_id", "topic"], "left_semi").select("topic", "rank")
    asked = materialise(ranks.join(asked, ["topic", "rank"], "left_semi"), "asked")
    # Papers with a full text are asked about, so abstracts are for the samples alone; topic and rank tell rows apart.
    at = [F.col("topic").alias("_topic"), F.col("rank").alias("_rank")]
    own = with_ranks(papers.drop("abstract"), asked).withColumnsRenamed({"topic": "_topic", "rank": "_rank"})
    once = materialise(resolve_full_text(own, fetched), "papers")
    pairs, attempts = paper_pairs(once, complete_fn, task, separator)
    pairs = materialise(pairs, "pairs")
    ready = once.filter(F.coalesce(F.length("full_text"), F.lit(0)) > 0)
    found = chosen.select("topic", "paper_id")
    # Only the places are numbered; the texts follow by one join.
    place = ["paper_id", "section", "pair"]
    several = ready.select("paper_id")  # a paper that comes in several rows gives its pairs for each of them
    slim = pairs.select(*place).join(several, "paper_id").join(found, "paper_id")
    slim = with_position(slim, ["topic", *place], "_at")
    start = slim.groupBy("topic").agg(F.min("_at").alias("_first"))
    slim = slim.join(start, "topic").select("topic", *place, (F.col("_at") - F.col("_first") + 1).alias("line_no"))
    abstracts = with_ranks(papers, asked).select(*at, "abstract")
    placed = with_paper(slim, ready.join(abstracts, ["_topic", "_rank"]))
    texts = pairs.withColumnRenamed("paper_id", "source_paper")
    numbered = texts.join(placed.hint("shuffle_hash"), ["source_paper", *place[1:]])
    return BuiltDataset(numbered, attempts, task.rules)


def custom_selection(papers: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, missing ids, one-row label) for a dataset made from chosen papers."""
    chosen = catalogue.select_ids(papers, ids)
    # Three titles and a count, whatever the size of the selection.
    first = chosen.orderBy("id").limit(3).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", "title"))), lambda s: s["title"]).alias("t")
    )
    total = chosen.count()
    label = first.select(
        F.concat(F.lit("Custom: "), topic_label(F.col("t"), F.lit(total))).alias("topic"),
        F.lit(total * 5).alias("target_size"),
    )
    return chosen, catalogue.missing_ids(papers, ids), label


def think_and_answer(output: Column) -> tuple[Column, Column]:
    """Reasoning and answer as the catalogue stores them: tags are case-sensitive here, a
    missing reasoning is '' and a missing answer is the whole output."""
    return (
        F.coalesce(strip(block(output, "think", ignore_case=False)), F.lit("")),
        F.coalesce(strip(block(output, "answer", ignore_case=False)), output),
    )


def load_catalogue(
    samples: DataFrame, dataset_id: int, user_id: int, order: str = "line_no", parity: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, qa_pairs, dataset row) for the samples of one dataset, with ids from 1 on.

    Paper ids follow the first appearance of a paper, pair ids follow ``order``.
    """
    owned = samples.withColumn("dataset_id", F.lit(dataset_id)).withColumn("user_id", F.lit(user_id))
    return catalogue_rows(owned, order, parity)


def catalogue_rows(
    samples: DataFrame, order: str = "line_no", parity: bool = False, papers_from: int = 1, pairs_from: int = 1
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, qa_pairs, dataset rows) for the samples of any number of datasets.

    ``samples`` has dataset_id and user_id; ``order`` tells the samples of a dataset apart. Ids start at the given
    numbers and follow the datasets, then ``order``. Places and source names alone are sorted and numbered; texts
    are joined to the numbers by hashing, once for the papers and once for the pairs.
    """
    place = ["dataset_id", order]
    slim = samples.select(*place, source_key(samples).alias("_source"))
    slim = materialise(with_position(slim, place, "_id"), "pair-ids")
    # A paper is numbered by its first pair; how many pairs it has comes with that.
    first = slim.filter(F.col("_source").isNotNull()).groupBy("dataset_id", "_source").agg(
        F.min(order).alias(order), F.count(F.lit(1)).alias("qa_pair_count")
    )
    numbered = materialise(with_position(first, place, "id"), "paper-ids").withColumn(
        "id", F.col("id") + F.lit(papers_from - 1)
    )
    cited = cited_papers(samples, [order], ["dataset_id", "user_id"])
    papers = cited.join(numbered.drop("_source").hint("shuffle_hash"), place).drop(order)
    linked = slim.join(
        numbered.select("dataset_id", "_source", F.col("id").alias("paper_id")), ["dataset_id", "_source"], "left"
    ).select(
        *place, (F.col("_id") + F.lit(pairs_from - 1)).alias("id"), "paper_id",
        F.coalesce("_source", F.lit("")).alias("source_paper_id"),
    )
    think, answer = think_and_answer(F.col("output"))
    flag = lambda names, default: F.coalesce(
        *[F.col(n) for n in names if n in samples.columns], F.lit(default)
    )
    healed = ["was_healed"] if parity else ["was_healed", "healed"]
    texts = samples.select(
        *place, "user_id", "instruction", "output", flag(["is_valid", "valid"], True).alias("is_valid"),
        flag(healed, False).alias("was_healed"), F.coalesce("source_title", F.lit("")).alias("source_title"),
    )
    qa = texts.join(linked.hint("shuffle_hash"), place).select(
        "id", "instruction", "output", "is_valid", "was_healed", "source_paper_id", "source_title",
        think.alias("think_text"), answer.alias("answer_text"), "dataset_id", "user_id", "paper_id",
    )
    datasets = result_counts(samples, parity, ["dataset_id", "user_id"]).select(
        F.col("dataset_id").alias("id"), "user_id", F.lit("completed").alias("status"),
        "actual_size", "valid_count", "invalid_count", "healed_count",
    )
    return papers, qa, datasets


@dataclass(frozen=True)
class CatalogueTables:
    """Names of the tables that loads go to; they are made by the first load."""

    papers: str = "papers"
    qa_pairs: str = "qa_pairs"
    datasets: str = "datasets"


def load_tables(
    samples: DataFrame, load: str, tables: CatalogueTables = CatalogueTables(), order: str = "line_no",
    parity: bool = False,
) -> None:
    """Add the datasets of ``samples`` to existing tables, with ids above those that are there.

    ``load`` names this load: its rows are one partition of each table, and a load that is repeated after a
    failure replaces them. The dataset rows are written last and are what counts: a dataset that the table has, from
    this load or another one, is not loaded again, so repeating a finished load adds nothing. One load at a time.
    """
    spark = samples.sparkSession

    def known(name: str) -> DataFrame | None:
        return spark.table(name) if spark.catalog.tableExists(name) else None

    done = known(tables.datasets)
    if done is not None:
        samples = samples.join(done.select(F.col("id").alias("dataset_id")), "dataset_id", "left_anti")
    samples = materialise(samples, "load")
    if samples.isEmpty():
        return

    def next_id(name: str) -> int:
        table = known(name)
        if table is None:
            return 1
        return (table.filter(F.col("load") != load).agg(F.max("id")).first()[0] or 0) + 1

    papers, qa, datasets = catalogue_rows(
        samples, order, parity, next_id(tables.papers), next_id(tables.qa_pairs)
    )
    for name, rows in ((tables.papers, papers), (tables.qa_pairs, qa)):
        save_part(rows.withColumn("load", F.lit(load)), name, "load")
    # By appending, because a load may have brought some of its datasets before.
    save_table(datasets.withColumn("load", F.lit(load)), tables.datasets)


def parse_run_log(log: DataFrame, text: str = "text") -> DataFrame:
    """Token counts and energy named in run logs, as columns beside the other ones."""
    return log.withColumn("_m", run_log_metrics(F.col(text))).select(
        *[c for c in log.columns if c != text], "_m.*"
    )


def card_numbers(datasets: DataFrame, qa: DataFrame) -> DataFrame:
    """One row per dataset (by ``id``) with the figures of its card; stored counts win over counted ones.

    Pairs are counted by ``dataset_id``; a dataset without pairs has none.
    """
    counted = qa.groupBy(F.col("dataset_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("is_valid").alias("_v")
    )
    zero = F.lit(0)
    pairs = F.coalesce(F.nullif("actual_size", zero), "_n", zero)
    return datasets.join(counted, "id", "left").select(
        "id",
        "topic",
        F.lower(F.replace("topic", F.lit(" "), F.lit("-"))).alias("topic_tag"),
        pairs.alias("pair_count"),
        F.coalesce(F.nullif("valid_count", zero), "_v", zero).alias("valid_count"),
        catalogue.size_category(pairs).alias("size_category"),
        F.concat(
            F.coalesce("provider", F.lit("unknown")), F.lit("/"), F.coalesce("model", F.lit("default"))
        ).alias("model"),
        F.coalesce("prompt_tokens", zero).alias("prompt_tokens"),
        F.coalesce("completion_tokens", zero).alias("completion_tokens"),
        F.coalesce("total_tokens", zero).alias("total_tokens"),
        F.coalesce("gpu_kwh", F.lit(0.0)).alias("gpu_kwh"),
    )


def export_dataset(qa: DataFrame, path: str) -> None:
    """Publish the pairs as JSON lines; an empty dataset is an error."""
    if qa.isEmpty():
        raise ValueError("the dataset has no pairs")
    write_jsonl(catalogue.export_rows(qa), path)


def dataset_card(numbers: DataFrame, sources: DataFrame, shown_sources: int | None = None) -> DataFrame:
    """Markdown lines of the cards of all datasets as (id, part, line_no, line), in order of the first three.

    The table of source papers has a line per paper of the dataset and is built as rows; papers of no dataset are
    in no card. Write the lines of one id sorted to get its document.
    """
    n = numbers.select(
        "id",
        F.posexplode(
            F.array(
                F.concat(F.lit("# "), F.col("topic")),
                F.concat(F.lit("size_categories: "), F.col("size_category")),
                F.concat(F.lit("| Total Q&A Pairs | "), F.col("pair_count").cast("string"), F.lit(" |")),
                F.concat(F.lit("| Valid Pairs | "), F.col("valid_count").cast("string"), F.lit(" |")),
                F.concat(F.lit("| Provider/Model | "), F.col("model"), F.lit(" |")),
                F.concat(F.lit("| Prompt Tokens | "), F.format_number("prompt_tokens", 0), F.lit(" |")),
                F.concat(F.lit("| Completion Tokens | "), F.format_number("completion_tokens", 0), F.lit(" |")),
                F.concat(F.lit("| Total Tokens | "), F.format_number("total_tokens", 0), F.lit(" |")),
                F.concat(F.lit("| GPU Energy | "), F.format_string("%.4f", "gpu_kwh"), F.lit(" kWh |")),
            )
        ).alias("line_no", "line"),
    ).select("id", F.lit(0).alias("part"), F.col("line_no").cast("bigint").alias("line_no"), "line")
    own = sources.filter("dataset_id is not null").join(
        numbers.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi"
    )
    # Numbered over all datasets at once, so that the papers of a large one are not sorted by one task.
    placed = with_position(own, ["dataset_id", "id"])
    first = placed.groupBy("dataset_id").agg(F.min("position").alias("_first"))
    placed = placed.join(first, "dataset_id").withColumn("line_no", F.col("position") - F.col("_first") + 1)
    if shown_sources is not None:
        placed = placed.filter(F.col("line_no") <= shown_sources)
    table = placed.select(
        F.col("dataset_id").alias("id"), F.lit(1).alias("part"), "line_no",
        F.concat(
            F.lit("| "), F.col("line_no").cast("string"), F.lit(" | "), F.col("title"),
            F.lit(" | "), F.col("authors"), F.lit(" | "), F.col("year"), F.lit(" | "),
            F.col("source"), F.lit(" | "), F.col("qa_pair_count").cast("string"), F.lit(" |"),
        ).alias("line"),
    )
    return n.unionByName(table)


def training_source(
    datasets: DataFrame, user_id: int, path: str | None = None, dataset_id: int | None = None
) -> str | None:
    """Where training data comes from: the given path, the given dataset, the latest completed."""
    if path:
        return path
    own = datasets.filter(F.col("user_id") == user_id)
    if dataset_id is not None:
        row = own.filter(F.col("id") == dataset_id).select("output_path").first()
        if row is None:
            raise ValueError(f"dataset {dataset_id} not found")
        if row[0]:
            return row[0]
    row = catalogue.latest_completed(own).select("output_path").first()
    return row[0] if row else None


def training_data(
    spark: SparkSession, datasets: DataFrame, qa: DataFrame, user_id: int, path: str | None = None,
    dataset_id: int | None = None,
) -> DataFrame:
    """instruction and output of the training rows that :func:`training_source` names.

    Where its file is missing, the valid pairs of the catalogue are taken for the dataset that was asked for.
    ValueError where nothing is named, nothing is there, or the dataset has no valid pair.
    """
    source = training_source(datasets, user_id, path, dataset_id)
    if source is None:
        raise ValueError("no dataset path could be resolved")
    if exists(spark, source):
        return read_jsonl_tolerant(spark, source, "instruction string, output string")
    if dataset_id is None:
        raise ValueError(f"dataset file not found: {source}")
    rows = catalogue.training_rows(qa, dataset_id)
    if rows.isEmpty():
        raise ValueError(f"dataset {dataset_id} has no valid pairs")
    return rows


def export_training(qa: DataFrame, dataset_id: int, path: str) -> None:
    """Write the valid pairs of a dataset as JSON lines; ValueError if there are none."""
    rows = catalogue.training_rows(qa, dataset_id)
    if rows.isEmpty():
        raise ValueError(f"dataset {dataset_id} has no valid pairs")
    write_jsonl(rows, path)
