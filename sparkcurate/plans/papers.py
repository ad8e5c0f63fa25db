"""Jobs on papers: collect, fetch results, prompts, pairs, citations, whole datasets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.config import Task
from sparkcurate.functions.binding import once
from sparkcurate.functions.papers import candidate_urls, has_full_text, title_key
from sparkcurate.functions.prompts import CHUNK_SIZE, LONG_CONTENT, author_line, pair_hint, render
from sparkcurate.functions.scoring import paper_targets
from sparkcurate.functions.text import block, is_english, strip
from sparkcurate.operators.chunking import chunk_texts
from sparkcurate.operators.completion import CompleteFn, complete_with_retry
from sparkcurate.operators.dedup import greedy_order
from sparkcurate.operators.ranking import with_position
from sparkcurate.operators.rows import settled

UNLIMITED = 2**31 - 1
TOPIC_PLACE = ["topic", "source_rank", "pos"]  # tells the papers of a search apart
MAX_URLS = 4  # addresses that can be tried for one paper
PAPER_FIELDS = (
    "source_paper", "source_title", "authors", "year", "abstract", "url", "doi", "source",
    "citation_count", "pdf_path",
)


def merge_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of search results with ``source_rank``; every frame brings its own ``pos``."""
    ranked = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def english_only(papers: DataFrame) -> DataFrame:
    """Papers whose title and abstract read as English."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return papers.filter(is_english(text))


def distinct_papers(papers: DataFrame) -> DataFrame:
    """English papers, each paper id and each title once, earlier sources first.

    Titles are compared by their md5, which keeps long ones out of the shuffles.
    """
    order = ["source_rank", "pos"]
    keys = [F.col("paper_id"), F.md5(title_key(F.col("title")))]
    # Joined to all papers: those kept are English already, so the test is not made again.
    return papers.join(greedy_order(english_only(papers), order, keys), order, "left_semi")


def ranked_for_fetch(papers: DataFrame, n: int, place: Sequence[str] = ("source_rank", "pos")) -> DataFrame:
    """The ``n`` most cited papers, whose full texts are fetched; ties go by ``place``, which tells papers apart.

    They are chosen among places and citations alone; no text is moved to find them.
    """
    best = papers.select(*place, "citation_count").orderBy(F.col("citation_count").desc(), *place).limit(n)
    return papers.join(F.broadcast(best.select(*place)), list(place), "left_semi")


def collect_papers(frames: Sequence[DataFrame], max_results: int = 20) -> DataFrame:
    """The most cited distinct English papers of several sources."""
    merged, place = merge_sources(frames), ["source_rank", "pos"]
    keys = [F.col("paper_id"), F.md5(title_key(F.col("title")))]
    # The kept places and their citations decide; the chosen papers, a fixed number, are joined at the end.
    kept = greedy_order(english_only(merged), place, keys)
    slim = merged.select(*place, "citation_count").join(kept, place, "left_semi")
    return merged.join(
        F.broadcast(ranked_for_fetch(slim, max_results).select(*place)), place, "left_semi"
    ).orderBy(F.col("citation_count").desc(), *place)


def resolve_full_text(papers: DataFrame, fetched: DataFrame) -> DataFrame:
    """Set ``full_text`` and ``pdf_path`` from a table of fetched addresses.

    ``papers`` has pdf_url, doi and the optional pmc_url / unpaywall_url; ``fetched`` has one
    row (url, text, pdf_path) per address. The first address in order whose text is long
    enough wins; a path is also kept from an address tried before without a usable text.
    """

    def optional(name: str) -> Column:
        return F.col(name) if name in papers.columns else F.lit(None).cast("string")

    urls = candidate_urls(
        F.col("pdf_url"), F.col("paper_id"), F.col("doi"), optional("pmc_url"),
        optional("unpaywall_url"),
    )
    # The winner is decided without the texts; each winning text is then fetched by one join.
    marks = fetched.select("url", has_full_text(F.col("text")).alias("good"), F.col("pdf_path").alias("path"))
    tried = papers.select("paper_id", F.posexplode(urls).alias("at", "url")).join(marks, "url")
    found = (
        tried.groupBy("paper_id")
        .agg(
            F.min(F.when(F.col("good"), F.col("at"))).alias("won"),
            F.min_by("url", F.when(F.col("good"), F.col("at"))).alias("_won_url"),
            *[F.max(F.when(F.col("at") == i, F.col("path"))).alias(f"_p{i}") for i in range(MAX_URLS)],
        )
        .select(
            "paper_id", F.when(F.col("won").isNotNull(), F.col("_won_url")).alias("_won_url"),
            F.coalesce(
                *[
                    F.when(F.col("won").isNull() | (F.col("won") >= i), F.col(f"_p{i}"))
                    for i in reversed(range(MAX_URLS))
                ]
            ).alias("pdf_path"),
        )
    )
    # Papers without a winner get an address of their own, so that they do not meet in one task.
    address = F.coalesce("_won_url", F.concat(F.lit("none:"), F.col("paper_id")))
    placed = papers.drop("full_text", "pdf_path").join(found, "paper_id", "left").withColumn("_won_url", address)
    texts = fetched.select(F.col("url").alias("_won_url"), strip(F.col("text")).alias("full_text"))
    own = [c for c in papers.columns if c not in ("full_text", "pdf_path")]
    return placed.join(texts, "_won_url", "left").select(*own, "full_text", "pdf_path")


def content_census(papers: DataFrame) -> DataFrame:
    """One row: papers with a full text, and with only an abstract."""
    full = F.coalesce(F.length("full_text"), F.lit(0)) > 0
    abstract = F.coalesce(F.length("abstract"), F.lit(0)) > 0
    return papers.agg(
        F.count_if(full).alias("full_text_count"),
        F.count_if(abstract & ~full).alias("abstract_only_count"),
    )


def paper_sections(papers: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Content of papers cut into sections when it is long; ``section`` is null when it is not."""
    content = F.coalesce(
        F.nullif("full_text", F.lit("")), F.nullif("abstract", F.lit(""))
    )
    # Settled, because the packing looks at the size once per paragraph.
    rows = settled(papers, {"content": content}).filter(F.col("content").isNotNull())
    long = F.length("content") > LONG_CONTENT
    # Short contents go through the same operator as one chunk, so the papers are read once.
    rows = settled(rows, {"_size": F.when(long, F.lit(CHUNK_SIZE)).otherwise(F.lit(UNLIMITED))})
    return (
        chunk_texts(rows, "content", F.col("_size"), separator)
        .withColumn("section", F.when(F.col("_size") != UNLIMITED, F.col("chunk_index")))
        .withColumn("sections", F.when(F.col("_size") != UNLIMITED, F.col("chunk_count")))
        .withColumn("content", F.col("chunk"))
        .drop("chunk", "chunk_index", "chunk_count", "_size")
    )


def paper_prompts(papers: DataFrame, task: Task, separator: str = "\n\n") -> DataFrame:
    """(paper_id, section, system_prompt, user_prompt) of every section to ask about."""
    hint = pair_hint(F.col("content"), F.col("section"), F.col("sections"))
    return paper_sections(papers, separator).select(
        "paper_id", F.coalesce("section", F.lit(1)).alias("section"),
        F.concat(F.lit(task.system_prompt), hint).alias("system_prompt"),
        render(
            task.user_template, title=F.col("title"), authors=author_line(F.col("authors")),
            content=F.col("content"),
        ).alias("user_prompt"),
    )


def _qa_blocks(completion: Column) -> Column:
    """Array of the ``<qa>`` blocks that hold a question and an answer."""
    blocks = F.regexp_extract_all(completion, F.lit("(?is)<qa>(.*?)</qa>"), F.lit(1))
    return F.filter(
        blocks,
        lambda b: b.rlike("(?is)<question>.*?</question>") & b.rlike("(?is)<answer>.*?</answer>"),
    )


def has_pairs(completion: Column) -> Column:
    return F.size(_qa_blocks(completion)) > 0


def parse_pairs(df: DataFrame, completion: str = "output") -> DataFrame:
    """One row per pair of a completion: ``pair``, ``instruction`` and the canonical ``output``."""
    carried = [c for c in df.columns if c != completion]
    b = F.col("_b")
    lead = once(
        strip(block(b, "think")),
        lambda t: F.when(t != "", F.concat(F.lit("<think>"), t, F.lit("</think>\n"))).otherwise(""),
    )
    output = F.concat(lead, F.lit("<answer>"), strip(block(b, "answer")), F.lit("</answer>"))
    return (
        df.select(*carried, F.posexplode(_qa_blocks(F.col(completion))).alias("pair", "_b"))
        .withColumn("instruction", strip(block(b, "question")))
        .withColumn("output", output)
        .withColumn("valid", F.lit(True))
        .drop("_b")
    )


def with_paper(pairs: DataFrame, papers: DataFrame) -> DataFrame:
    """Pairs with the metadata of their paper under the names a sample uses."""
    path = F.col("pdf_path") if "pdf_path" in papers.columns else F.lit(None).cast("string")
    meta = papers.select(
        "paper_id", F.col("title").alias("source_title"), "authors", "year", "abstract", "url",
        "doi", "source", "citation_count", path.alias("pdf_path"),
    )
    return pairs.join(meta, "paper_id").withColumnRenamed("paper_id", "source_paper")


def paper_pairs(
    papers: DataFrame, complete_fn: CompleteFn, task: Task, separator: str = "\n\n", **calls
) -> tuple[DataFrame, DataFrame]:
    """(pairs, attempts) of :func:`papers_to_qa`; the pairs know their paper by its id alone."""
    ready = papers.filter(F.coalesce(F.length("full_text"), F.lit(0)) > 0)
    # What has a full text needs no abstract to ask about.
    ready = ready.withColumn("abstract", F.lit(None).cast("string"))
    attempts = complete_with_retry(
        paper_prompts(ready, task, separator), complete_fn, has_pairs, task.max_retries, **calls
    )
    return parse_pairs(attempts.filter("valid").select("paper_id", "section", "output")), attempts


def papers_to_qa(
    papers: DataFrame, complete_fn: CompleteFn, task: Task, separator: str = "\n\n", **calls
) -> tuple[DataFrame, DataFrame]:
    """(samples, attempts) of asking about every section of papers that have a full text.

    A section is asked again, up to the task's limit, until its reply holds a pair.
    """
    pairs, attempts = paper_pairs(papers, complete_fn, task, separator, **calls)
    return with_paper(pairs, papers.filter(F.coalesce(F.length("full_text"), F.lit(0)) > 0)), attempts


def citation_log(papers: DataFrame, samples: DataFrame) -> DataFrame:
    """Papers that were asked about, with the number of pairs each one gave (zero included)."""
    counts = samples.groupBy(F.col("source_paper").alias("paper_id")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        papers.select("paper_id", "title", "authors", "year", "doi", "url", "source")
        .join(counts, "paper_id", "left")
        .withColumn("qa_pairs_generated", F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def source_key(df: DataFrame) -> Column:
    """``source_paper_id`` when given, else ``source_paper``."""
    names = [c for c in ("source_paper_id", "source_paper") if c in df.columns]
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names])


def cited_papers(samples: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per source paper (of every ``by``), taken from its first sample in ``order``.

    The first sample is found among keys and places alone; the paper's texts are fetched by one join. ``by``
    and ``order`` together must tell samples apart.
    """
    keyed = samples.withColumn("_source", source_key(samples))
    keep = [c for c in PAPER_FIELDS if c in samples.columns and c != "source_paper"]
    place = F.struct(*[F.col(c) for c in order])
    first = keyed.filter(F.col("_source").isNotNull()).groupBy(*by, "_source").agg(F.min(place).alias("_at"))
    first = first.select(*by, "_source", *[F.col(f"_at.{c}").alias(c) for c in order])
    defaults = {
        "source_title": F.coalesce("source_title", F.lit("Unknown")).alias("title"),
        "authors": F.coalesce("authors", F.array().cast("array<string>")).alias("authors"),
        "abstract": F.coalesce("abstract", F.lit("")).alias("abstract"),
        "url": F.coalesce("url", F.lit("")).alias("url"),
        "source": F.coalesce("source", F.lit("")).alias("source"),
        "citation_count": F.coalesce("citation_count", F.lit(0)).alias("citation_count"),
    }
    texts = samples.select(*by, *keep, *order).join(first.hint("shuffle_hash"), [*by, *order])
    return texts.select(
        *by, F.col("_source").alias("paper_id"), *[defaults.get(c, F.col(c)) for c in keep], *order
    )


def citations(raw: DataFrame, filtered: DataFrame, order: str = "line_no", by: Sequence[str] = ()) -> DataFrame:
    """Papers cited by a dataset (or by every ``by``): first seen over the raw samples, then the filtered ones."""
    both = raw.withColumn("file_rank", F.lit(0)).unionByName(
        filtered.withColumn("file_rank", F.lit(1)), allowMissingColumns=True
    )
    return cited_papers(both, ["file_rank", order], by)


def citation_totals(cited: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """(topic, total_papers): the head of a citation list, one row per topic."""
    return cited.groupBy(*by).agg(F.count(F.lit(1)).alias("total_papers"))


def topic_ranks(topics: DataFrame, papers: DataFrame) -> DataFrame:
    """(topic, source_rank, pos, rank, fetch) of the most cited distinct English papers of every topic.

    Ranks come from positions over all topics, so that no topic is sorted by one task; only places and citations
    are moved. A place that occurs in several rows has as many ranks.
    """
    sizes = topics.select("topic", paper_targets(F.col("target")).alias("_s")).select("topic", "_s.*")
    key = lambda c: F.struct(F.col("topic"), c)
    keys = [key(F.col("paper_id")), key(F.md5(title_key(F.col("title"))))]
    kept = greedy_order(english_only(papers), TOPIC_PLACE, keys)
    slim = papers.select(*TOPIC_PLACE, "citation_count").join(kept, TOPIC_PLACE, "left_semi")
    order = [F.col("topic"), F.col("citation_count").desc(), F.col("source_rank"), F.col("pos")]
    placed = with_position(slim, order, "_at")
    first = placed.groupBy("topic").agg(F.min("_at").alias("_first"))
    ranked = placed.join(first, "topic").withColumn("rank", (F.col("_at") - F.col("_first") + 1).cast("int"))
    return (
        ranked.join(sizes, "topic").filter("rank <= max_papers")
        .select(*TOPIC_PLACE, "rank", (F.col("rank") <= F.col("top_n")).alias("fetch"))
    )


def with_ranks(papers: DataFrame, ranks: DataFrame) -> DataFrame:
    """The ranked papers with their ``rank`` and ``fetch``; rows of one place take its ranks in turn.

    Which row takes which rank is told by what the rows hold beside their texts, so it is the same without those.
    """
    own = ranks.groupBy(*TOPIC_PLACE).agg(F.sort_array(F.collect_list(F.struct("rank", "fetch"))).alias("_r"))
    short = [c for c in papers.columns if c not in ("abstract", "full_text")]
    copies = Window.partitionBy(*TOPIC_PLACE).orderBy(F.col("citation_count").desc(), F.xxhash64(*short))
    found = papers.join(own, TOPIC_PLACE).withColumn("_copy", F.row_number().over(copies))
    found = found.withColumn("_r", F.try_element_at("_r", "_copy")).filter("_r IS NOT NULL")
    return found.select(*papers.columns, "_r.rank", "_r.fetch")


def topic_papers(topics: DataFrame, papers: DataFrame) -> DataFrame:
    """Per topic the most cited distinct English papers, as many as its target asks for.

    ``topics`` is (topic, target); ``papers`` carries ``topic``, ``source_rank`` and ``pos``.
    Adds ``rank`` and ``fetch``, true for the papers whose full text is wanted.
    """
    return with_ranks(papers, topic_ranks(topics, papers))
