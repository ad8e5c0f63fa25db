"""Keyword graph over datasets, papers and pairs."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions.binding import once
from sparkcurate.functions.scoring import dataset_node_size, paper_node_size
from sparkcurate.functions.text import keyword_tokens
from sparkcurate.operators.catalogue import qa_counts
from sparkcurate.operators.ranking import top_per_key, with_position
from sparkcurate.operators.rows import settled
from sparkcurate.session import materialise

# Colours of clusters in turn, the colour of papers without a dataset.
CLUSTER_COLORS = (
    "#7eb8ff", "#6ee7d8", "#ffd666", "#c084fc", "#ff7eb3",
    "#a3e635", "#fb923c", "#60a5fa", "#f472b6", "#34d399",
)
ORPHAN_COLOR = "#888888"

#: Rows of groups that are counted at once; a larger group is counted as a whole.
GROUP_ROWS = 20_000


@dataclass(frozen=True)
class GraphLimits:
    """What a drawn graph leaves out; None is all.

    Pairs shown in all, per paper and per dataset, and the papers compared with each other, by
    id. Without ``edge_papers`` papers are linked to their keywords instead of to each other: a
    fixed number of rows per paper, from which the overlap of any two follows.
    """

    qa_nodes: int | None = None
    qa_per_paper: int | None = None
    qa_per_dataset: int | None = None
    edge_papers: int | None = None


#: The numbers of the graph as it is drawn on a screen (fixed values).
DRAWN = GraphLimits(qa_nodes=150, qa_per_paper=2, qa_per_dataset=4, edge_papers=200)

NODE_COLUMNS = (
    "id string, type string, label string, size double, color string, cluster bigint, year int, "
    "citation_count bigint, abstract string, authors array<string>, url string, "
    "qa_pair_count bigint, instruction string, answer_text string, is_valid boolean"
)
LINK_COLUMNS = "source string, target string, weight double, type string"


def _shaped(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the listed columns; those it lacks are null."""
    out = []
    for part in ddl.split(", "):
        name, kind = part.split(" ")
        value = F.col(name) if name in df.columns else F.lit(None)
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def top_keywords(df: DataFrame, text: Column, k: int = 10, name: str = "keywords") -> DataFrame:
    """Add the ``k`` most frequent keywords of a text, earlier ones first on ties.

    Everything happens inside the row, without a shuffle, whatever the text lengths are: the
    sorted tokens form runs of equal words, one regular expression cuts the runs apart, and a
    run's length gives the count. Positions are looked up only for words at least as frequent
    as the ``k``-th, which are few in a long text.
    """
    words = settled(df, {"_w": keyword_tokens(text)})
    runs = settled(
        words,
        {
            "_runs": F.regexp_extract_all(
                F.array_join(F.sort_array("_w"), " "), F.lit(r"\b([a-z]+)(?: \1\b)*"), F.lit(0)
            ),
            "_line": F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")),
        },
    )
    counted = settled(
        runs,
        {
            "_c": F.transform(
                "_runs",
                lambda r: once(
                    F.substring_index(r, " ", 1),
                    lambda w: F.struct(
                        ((F.length(r) + 1) / (F.length(w) + 1)).cast("int").alias("n"), w.alias("w")
                    ),
                ),
            )
        },
    )
    # The count of the k-th most frequent word; every word counts when there are fewer.
    least = F.coalesce(
        F.try_element_at(F.sort_array(F.transform("_c", lambda c: c["n"]), asc=False), F.lit(k)),
        F.lit(1),
    )
    frequent = settled(settled(counted, {"_least": least}), {
        "_f": F.filter("_c", lambda c: c["n"] >= F.col("_least"))
    })
    ranked = F.sort_array(
        F.transform(
            "_f",
            lambda c: F.struct(
                (-c["n"]).alias("less"),
                F.call_function(
                    "instr", F.col("_line"), F.concat(F.lit(" "), c["w"], F.lit(" "))
                ).alias("at"),
                c["w"].alias("w"),
            ),
        )
    )
    best = F.transform(F.slice(ranked, 1, k), lambda r: r["w"])
    return settled(frequent, {name: best}).select(*df.columns, name)


def paper_text() -> Column:
    return F.concat(
        F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))
    )


def paper_keywords(papers: DataFrame, key: str = "id", k: int = 10) -> DataFrame:
    """(key, keyword, rank) for the ``k`` top keywords of every paper; row-local."""
    return top_keywords(papers, paper_text(), k).select(
        key, F.posexplode("keywords").alias("rank", "keyword")
    ).select(key, "keyword", (F.col("rank") + 1).alias("rank"))


def keyword_edges(papers: DataFrame, min_shared: int = 2, key: str = "id", k: int = 10) -> DataFrame:
    """Pairs a < b of the given papers that share ``min_shared`` top keywords: a, b, shared, weight.

    The pairs of a keyword grow with the square of its papers, so this is for a set that is
    chosen to be looked at; :func:`paper_keywords` says the same of any number of papers in
    ``k`` rows each. The weight is the share of the ``k`` keywords.
    """
    words = paper_keywords(papers, key, k)
    a = words.select(F.col(key).alias("a"), "keyword")
    b = words.select(F.col(key).alias("b"), "keyword")
    return (
        a.join(b, "keyword").filter(F.col("a") < F.col("b"))
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") >= min_shared)
        .withColumn("weight", F.col("shared") / F.lit(k))
    )


def _group_counts(least: int, ends: list[str]):
    """For ``mapInArrow`` over rows sorted by ``ends``: the papers that share exactly these last words with each row.

    Sets of the words before are numbered by a trie, a level at a time: the set without its last word, then that word.
    A set that a single row holds is left with all that contain it, since other rows add nothing to it.
    """
    sign = lambda t: (-1) ** t * math.comb(t + least - 1, least - 1)
    own = lambda e: sum(math.comb(e, t) * sign(t) for t in range(e + 1))

    def counted(rows: pa.Table) -> pa.Table:
        before, n = rows["before"].combine_chunks(), rows["n"].to_numpy()
        words, starts = before.flatten().to_numpy(), before.offsets.to_numpy() - before.offsets[0].as_py()
        sizes = np.diff(starts)
        keys = np.stack([rows[e].to_numpy() for e in ends])
        node = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
        total = n * np.array([own(e) for e in range(sizes.max() + 1)])[sizes]
        row, at, level = np.arange(len(n)), np.zeros(len(n), np.int64), 0
        while len(row):
            others = np.bincount(node, n[row])[node] - n[row]
            total = total + sign(level) * np.bincount(row, others, len(n)).astype(np.int64)
            live = np.bincount(node)[node] > 1
            row, at, node = row[live], at[live], node[live]
            grown = sizes[row] - at
            which = np.repeat(np.arange(len(row)), grown)
            at = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(grown) - grown, grown)
            row = row[which]
            held = node[which].astype(np.int64) << 32 | words[starts[row] + at]
            node, at, level = np.unique(held, return_inverse=True)[1], at + 1, level + 1
        return rows.drop_columns("n").append_column("papers", pa.array(total, pa.int64()))

    def run(batches):
        waiting, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            count += batch.num_rows
            if count < GROUP_ROWS:
                continue
            # The last group may go on in the next batch.
            rows = pa.Table.from_batches(waiting)
            same = np.logical_and.reduce([rows[e].to_numpy() == rows[e][-1].as_py() for e in ends])
            whole = rows.num_rows - int(same.sum())
            if whole:
                yield from counted(rows.slice(0, whole)).to_batches()
            waiting = rows.slice(whole).combine_chunks().to_batches()
            count = 0
        if waiting:
            yield from counted(pa.Table.from_batches(waiting)).to_batches()

    return run


def link_counts(papers: DataFrame, min_shared: int = 2, key: str = "id", k: int = 10) -> DataFrame:
    """(key, links): of every paper, how many others share ``min_shared`` of their ``k`` top keywords with it.

    That is the number of its links in the graph of all papers, without a link ever being a row. Papers with the
    same keywords are one class. A set of keywords counts the papers of all classes that hold it, and the sets of a
    paper are added up with the signs of inclusion and exclusion, so that a paper that shares three keywords is not
    counted once for each two of them.

    Sets are not rows either. Words are numbered, frequent ones first, and a set belongs to the group of its last
    ``min_shared`` words: a class goes to each of its groups, ``comb(k, min_shared)`` of them, with the words before,
    and the sets are made there. Classes with the same words before are one row of a group, and only more frequent
    words are before, so the groups of the most frequent words have few rows, however many papers they have.
    """
    words = top_keywords(papers, paper_text(), k).select(key, F.sort_array("keywords").alias("words"))
    words = materialise(words, "paper-keywords")
    classes = words.filter(F.size("words") >= min_shared).groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    held = classes.select("class", "n", F.explode("words").alias("word"))
    order = [F.col("papers").desc(), F.col("word")]
    numbers = with_position(held.groupBy("word").agg(F.sum("n").alias("papers")), order, "number")
    numbered = held.join(numbers.select("word", F.col("number").cast("int").alias("number")), "word")
    numbered = numbered.groupBy("class", "n").agg(F.sort_array(F.collect_list("number")).alias("w"))
    numbered = materialise(numbered, "numbered-classes")
    ends = [f"end{i}" for i in range(min_shared)]
    places = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(k), min_shared)])
    groups = numbered.select(
        "class", "n", "w", F.explode(F.filter(places, lambda p: p[min_shared - 1] < F.size("w"))).alias("p")
    ).select(
        "class", "n", *[F.get("w", F.col("p")[i]).alias(e) for i, e in enumerate(ends)],
        F.slice("w", F.lit(1), F.col("p")[0]).alias("before"),
    )
    rows = groups.groupBy(*ends, "before").agg(F.sum("n").alias("n"))
    schema = ", ".join([f"{e} int" for e in ends]) + ", before array<int>, papers bigint"
    shared = rows.repartition(*ends).sortWithinPartitions(*ends).mapInArrow(_group_counts(min_shared, ends), schema)
    # A class shares all its words with itself. The groups are far more than the classes that Catalyst knows the size
    # of, hence the hint: they would be broadcast.
    total = groups.join(shared.hint("merge"), [*ends, "before"]).groupBy("class").agg((F.sum("papers") - 1).alias("links"))
    found = words.join(classes.join(total, "class").select("words", "links"), "words", "left")
    return found.select(key, F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def clusters(
    datasets: DataFrame, papers: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clusters, papers with ``cluster`` and ``color``, datasets with the same): a cluster per
    dataset in id order.

    Papers of no listed dataset form one more cluster, when there are any.
    """
    palette = F.array(*[F.lit(c) for c in CLUSTER_COLORS])
    numbered = with_position(datasets.select("id", "topic"), ["id"]).select(
        F.col("id").alias("dataset_id"), "topic", (F.col("position") - 1).alias("cluster")
    )
    numbered = numbered.withColumn(
        "color",
        F.element_at(palette, (F.col("cluster") % len(CLUSTER_COLORS) + 1).cast("int")),
    )
    count = datasets.count()
    placed = papers.join(numbered.drop("topic"), "dataset_id", "left").withColumns(
        {
            "color": F.coalesce("color", F.lit(ORPHAN_COLOR)),
            "cluster": F.coalesce("cluster", F.lit(count)),
        }
    )
    sizes = papers.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("paper_count"))
    named = numbered.join(sizes, "dataset_id", "left").select(
        F.col("cluster").alias("id"),
        F.when(F.coalesce(F.length("topic"), F.lit(0)) > 0, F.substring("topic", 1, 30))
        .otherwise(F.concat(F.lit("Dataset "), F.col("dataset_id").cast("string"))).alias("label"),
        "color",
        F.coalesce("paper_count", F.lit(0)).alias("paper_count"),
    )
    orphans = (
        placed.filter(F.col("cluster") == count)
        .agg(F.count(F.lit(1)).alias("paper_count"))
        .filter("paper_count > 0")
        .select(
            F.lit(count).cast("bigint").alias("id"), F.lit("uncategorized").alias("label"),
            F.lit(ORPHAN_COLOR).alias("color"), "paper_count",
        )
    )
    hubs = numbered.select(F.col("dataset_id").alias("id"), "cluster", "color")
    return named.unionByName(orphans), placed, hubs


def sampled_qa(
    papers: DataFrame, datasets: DataFrame, qa: DataFrame, limits: GraphLimits = GraphLimits()
) -> DataFrame:
    """Pairs shown in the graph, with ``parent_kind`` and ``parent``: a paper, or a dataset for pairs without one.

    Each parent shows its first ``limits.qa_per_paper`` or ``qa_per_dataset`` pairs by id. Parents
    are served in id order, papers first, while fewer than ``qa_nodes`` pairs are shown; that is
    looked at between parents only. Every parent shows at least one pair, so the first ``qa_nodes``
    parents of each kind are all that can matter.
    """
    by_paper = qa.join(
        papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi"
    ).withColumn("parent", F.col("paper_id"))
    by_dataset = (
        qa.filter("paper_id is null")
        .join(datasets.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi")
        .withColumn("parent", F.col("dataset_id"))
    )
    picked = []
    for kind, rows, limit in (
        ("paper", by_paper, limits.qa_per_paper), ("dataset", by_dataset, limits.qa_per_dataset)
    ):
        if limit is not None:
            rows = top_per_key(rows, "parent", [F.col("id")], limit, "_r").drop("_r")
        picked.append(rows.withColumn("parent_kind", F.lit(kind)))
    shown = picked[0].unionByName(picked[1])
    if limits.qa_nodes is None:
        return shown
    parents = [
        p.groupBy("parent_kind", "parent").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("parent").limit(limits.qa_nodes)
        for p in picked
    ]
    # At most twice ``qa_nodes`` rows: papers before datasets, each by id.
    before = Window.orderBy(F.col("parent_kind").desc(), "parent").rowsBetween(
        Window.unboundedPreceding, -1
    )
    served = (
        parents[0].unionByName(parents[1])
        .withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .filter(F.col("_before") < limits.qa_nodes)
        .select("parent_kind", "parent")
    )
    return shown.join(served, ["parent_kind", "parent"], "left_semi")


def _qa_nodes(rows: DataFrame, answer: Column) -> DataFrame:
    return _shaped(
        rows.select(
            F.col("node").alias("id"), F.lit("qa").alias("type"),
            F.substring(F.coalesce("instruction", F.lit("")), 1, 50).alias("label"),
            F.lit(2.5).alias("size"), "color", "cluster", "instruction",
            answer.alias("answer_text"), "is_valid",
        ),
        NODE_COLUMNS,
    )


def knowledge_graph(
    datasets: DataFrame, papers: DataFrame, qa: DataFrame, limits: GraphLimits = GraphLimits()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, clusters) of one owner's completed datasets, papers and pairs.

    Everything by default; ``limits=DRAWN`` gives the graph as it is drawn.
    """
    completed = datasets.filter(F.col("status") == "completed")
    cluster_rows, placed, hubs = clusters(completed, papers)
    sized_sets = qa_counts(completed, qa, "dataset_id")
    per_set = papers.groupBy(F.col("dataset_id").alias("id")).agg(
        F.count(F.lit(1)).alias("paper_count")
    )
    text = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    dataset_nodes = (
        sized_sets.join(per_set, "id", "left").join(hubs, "id")
        .select(
            F.concat(F.lit("dataset-"), F.col("id").cast("string")).alias("id"),
            F.lit("dataset").alias("type"),
            F.coalesce(F.nullif("topic", F.lit("")), "name").alias("label"),
            dataset_node_size(F.col("qa_pair_count")).alias("size"), "color", "cluster",
            F.concat(
                F.coalesce("paper_count", F.lit(0)).cast("string"), F.lit(" papers, "),
                F.col("qa_pair_count").cast("string"), F.lit(" Q&A pairs | "),
                text("provider", "unknown"), F.lit("/"), text("model", "default"),
            ).alias("abstract"),
            "qa_pair_count",
        )
    )
    citations = F.coalesce("citation_count", F.lit(0))
    paper_nodes = qa_counts(placed, qa, "paper_id").select(
        F.concat(F.lit("paper-"), F.col("id").cast("string")).alias("id"),
        F.lit("paper").alias("type"), text("title", "Untitled").alias("label"),
        paper_node_size(F.col("qa_pair_count"), citations).alias("size"), "color", "cluster",
        "year", citations.alias("citation_count"),
        F.substring(text("abstract", ""), 1, 300).alias("abstract"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "url",
        "qa_pair_count",
    )
    shown = sampled_qa(papers, completed, qa, limits).withColumn(
        "node", F.concat(F.lit("qa-"), F.col("id").cast("string"))
    )
    parents = placed.select(
        F.lit("paper").alias("parent_kind"), F.col("id").alias("parent"), "color", "cluster"
    ).unionByName(
        hubs.select(
            F.lit("dataset").alias("parent_kind"), F.col("id").alias("parent"), "color", "cluster"
        )
    )
    preview = F.coalesce(
        F.nullif("answer_text", F.lit("")), F.substring(text("output", ""), 1, 200)
    )
    qa_nodes = _qa_nodes(shown.join(parents, ["parent_kind", "parent"]), preview)
    nodes = (
        _shaped(dataset_nodes, NODE_COLUMNS)
        .unionByName(_shaped(paper_nodes, NODE_COLUMNS))
        .unionByName(qa_nodes)
    )

    def named(kind: Column | str, number: str) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.concat(kind, F.lit("-"), F.col(number).cast("string"))

    qa_links = shown.select(
        named(F.col("parent_kind"), "parent").alias("source"), F.col("node").alias("target"),
        F.when(F.col("parent_kind") == "paper", 0.3).otherwise(0.2).alias("weight"),
        F.concat("parent_kind", F.lit("_qa")).alias("type"),
    )
    set_links = papers.filter("dataset_id is not null").select(
        named("dataset", "dataset_id").alias("source"), named("paper", "id").alias("target"),
        F.lit(0.5).alias("weight"), F.lit("dataset_paper").alias("type"),
    )
    if limits.edge_papers is None:
        word_links = paper_keywords(papers).select(
            named("paper", "id").alias("source"), F.concat(F.lit("keyword-"), "keyword").alias("target"),
            F.lit(0.1).alias("weight"), F.lit("paper_keyword").alias("type"),
        )
    else:
        word_links = keyword_edges(papers.orderBy("id").limit(limits.edge_papers)).select(
            named("paper", "a").alias("source"), named("paper", "b").alias("target"), "weight",
            F.lit("keyword").alias("type"),
        )
    links = _shaped(qa_links.unionByName(set_links).unionByName(word_links), LINK_COLUMNS)
    return nodes, links, cluster_rows


def subgraph(nodes: DataFrame, links: DataFrame, cluster: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one cluster and the links that stay inside it."""
    inside = nodes.filter(F.col("cluster") == cluster)
    ids = inside.select("id")
    kept = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    return inside, kept.select(*links.columns)


def cluster_papers(nodes: DataFrame, cluster: int) -> DataFrame:
    """Paper nodes of the cluster a dataset node stands for."""
    return nodes.filter((F.col("type") == "paper") & (F.col("cluster") == cluster))


def with_match(nodes: DataFrame, term: str) -> DataFrame:
    """Flag nodes whose label, or instruction for pairs, holds the term, ignoring case."""
    low = F.lower(F.lit(term))
    in_question = (F.col("type") == "qa") & F.contains(F.lower("instruction"), low)
    return nodes.withColumn(
        "match",
        F.coalesce(F.contains(F.lower("label"), low), F.lit(False))
        | F.coalesce(in_question, F.lit(False)),
    )


def expand_paper(
    nodes: DataFrame, links: DataFrame, qa: DataFrame, paper: int, shown: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Replace a paper's sampled pairs by its first ``shown`` real ones, all by default."""
    node_id = f"paper-{paper}"
    sampled = links.filter((F.col("source") == node_id) & (F.col("type") == "paper_qa")).select(
        F.col("target").alias("id")
    )
    first = qa.filter(F.col("paper_id") == paper)
    first = first if shown is None else first.orderBy("id").limit(shown)
    # The pairs of one paper, so one window over them is small.
    numbered = first.withColumn(
        "node",
        F.concat(
            F.lit("qa-exp-"), (F.row_number().over(Window.orderBy("id")) - 1).cast("string")
        ),
    )
    hub = nodes.filter(F.col("id") == node_id).select("color", "cluster").first()
    if hub is None:
        return nodes, links
    rows = numbered.withColumns({"color": F.lit(hub["color"]), "cluster": F.lit(hub["cluster"])})
    answer = F.coalesce(F.nullif("answer_text", F.lit("")), F.col("output"), F.lit(""))
    new_links = _shaped(
        rows.select(
            F.lit(node_id).alias("source"), F.col("node").alias("target"),
            F.lit(0.3).alias("weight"), F.lit("paper_qa").alias("type"),
        ),
        LINK_COLUMNS,
    )
    kept_nodes = nodes.join(sampled, "id", "left_anti").select(*nodes.columns)
    kept_links = links.join(
        sampled.withColumnRenamed("id", "target"), "target", "left_anti"
    ).select(*links.columns)
    return kept_nodes.unionByName(_qa_nodes(rows, answer)), kept_links.unionByName(new_links)
