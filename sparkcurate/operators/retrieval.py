"""Keyword retrieval of papers for questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate.functions.text import query_keywords
from sparkcurate.operators.ranking import top_per_key
from sparkcurate.session import materialise


#: Papers whose words are looked at together.
BLOCK_PAPERS = 2_000


def _first_of_blocks(k: int):
    """For ``mapInArrow`` over (words, paper, citation_count): (term, paper, citation_count), of every block of papers
    the first ``k`` of each word, most cited first."""

    def first(block: pa.RecordBatch) -> pa.RecordBatch:
        words, paper, cited = block.columns
        keys = {"unknown": pc.cast(pc.is_null(cited), "int8"), "cited": cited, "named": pc.cast(pc.is_valid(paper), "int8"), "paper": paper}
        order = pc.sort_indices(
            pa.table(keys),
            sort_keys=[("unknown", "ascending"), ("cited", "descending"), ("named", "ascending"), ("paper", "ascending")],
        ).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = np.repeat(np.arange(len(order)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        terms = pc.list_flatten(words).dictionary_encode()
        codes = terms.indices.to_numpy()
        sorted_ = np.lexsort((place[at], codes))
        codes = codes[sorted_]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        kept = np.arange(len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes))) < k
        rows = pa.array(at[sorted_][kept])
        found = [terms.dictionary.take(pa.array(codes[kept])), paper.take(rows), cited.take(rows)]
        return pa.RecordBatch.from_arrays(found, names=["term", *block.schema.names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_PAPERS):
                yield first(batch.slice(start, BLOCK_PAPERS))

    return run


def retrieve(
    questions: DataFrame,
    papers: DataFrame,
    question: str = "question",
    paper_id: str = "paper_id",
    k: int = 5,
) -> DataFrame:
    """The ``k`` most cited papers per search query that contain at least one of its keywords.

    Returns (query, rank, paper_id, citation_count) per *distinct* query (the keywords joined
    by a blank); join on :func:`query_text` to get back to questions. Papers without an
    abstract never match. Ties in citations go to the smaller paper id.

    The order of papers does not depend on the query, so the ``k`` best papers of every single
    keyword hold the ``k`` best of any set of keywords. Posting lists are therefore cut to
    ``k`` before the join, exactly, and a keyword shared by a third of all papers costs no
    more than a rare one. The cut happens inside each task, a block of papers at a time, before any shuffle. Postings of words
    that no question has are dropped first; the stored words let Catalyst choose how.
    """
    queries = questions.select(query_text(question).alias("query")).filter("query <> ''").distinct()
    terms = materialise(
        queries.select("query", F.explode(F.split("query", " ")).alias("term")), "terms"
    )
    wanted = terms.select("term").distinct()
    words = F.array_distinct(
        F.regexp_extract_all(
            F.lower(F.concat_ws(" ", "title", "abstract")), F.lit("[a-z]{3,}"), F.lit(0)
        )
    )
    searched = papers.filter(F.col("abstract") != "").select(words.alias("words"), paper_id, "citation_count")
    schema = T.StructType([T.StructField("term", T.StringType()), *searched.schema.fields[1:]])
    # A block at a time, so that no task sorts all words of its papers.
    postings = searched.mapInArrow(_first_of_blocks(k), schema)
    postings = postings.join(wanted, "term", "left_semi")
    order = [F.col("citation_count").desc(), F.col(paper_id)]
    best = top_per_key(postings, "term", order, k, "_r")
    # One row per term, of k papers at most, and one per query from there on: a query's papers are few, and are
    # ranked inside its row. A paper that comes with several numbers of citations counts with the largest.
    cited = F.col("citation_count")
    place = F.struct(cited.isNull().alias("unknown"), (-cited).alias("less"), F.col(paper_id).alias("id"))
    best = best.groupBy("term").agg(F.collect_list(place).alias("best"))
    found = terms.join(best, "term").groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("_all"))
    first = F.filter(
        "_all", lambda x, i: ~F.exists(F.slice("_all", F.lit(1), i), lambda y: y["id"].eqNullSafe(x["id"]))
    )
    return found.select("query", F.posexplode(F.slice(first, 1, k)).alias("_at", "_hit")).select(
        "query", F.col("_hit.id").alias(paper_id), (-F.col("_hit.less")).alias("citation_count"),
        (F.col("_at") + 1).alias("rank"),
    )


def query_text(question: str):
    """The search query of a question: its five longest distinct keywords."""
    return F.array_join(query_keywords(F.col(question)), " ")
