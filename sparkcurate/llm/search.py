"""Ranked lexical search: the documents' texts go through an automaton of all terms of all items.

A term is a run of digits, ASCII letters and characters beyond ASCII, A-Z in lower case. A text becomes its
terms with one guard character between them, before the first and behind the last one, and the automaton
holds every term of the items between two guards. So it finds whole terms only, next to each other too,
and counts them straight from the text: there is no index of the documents. One pass stores per document
its length in terms and the terms found with their counts; how many documents hold a term comes
from that, and so do the scores. A found term leads to its items by a list, and every task keeps the best
documents of each item among its own.

The automaton grows with the items, not with the documents. Items whose terms have more than ``block_chars``
characters together are searched in blocks below that size, one after another, so what is sent to all
tasks and held by the driver is bounded; each block goes over the documents once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.llm.common import arrow_type, map_texts
from sparkcurate.session import materialise

GUARD = " "

# Terms' characters (fixed values): digits, letters, everything beyond ASCII; the rest separates.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTE = np.array([b > 0x7F or chr(b).isalnum() for b in range(256)])
_PLAIN = bytes(b if b > 0x7F else ord(chr(b).lower()) if _TERM_BYTE[b] else ord(GUARD) for b in range(256))

_SALTS = 64


@dataclass(frozen=True)
class Settings:
    """``top`` documents per item; see the module about ``block_chars``."""

    top: int = 10
    block_chars: int = 16_000_000


def with_guards(text: str) -> bytes:
    """The text in lower case with guards for all separators, and one at both ends."""
    guard = GUARD.encode()
    return guard + text.encode("utf-8", "surrogatepass").translate(_PLAIN) + guard


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): every term of an item once."""
    plain = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(plain, F.lit(f"({TERM})"), F.lit(1))
    return items.select(F.col(item).alias("item"), F.explode(found).alias("term")).distinct()


def automaton_of(terms: list[str]):
    """An automaton that finds every term between two guards and gives its place in the list."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        automaton.add_word(f"{GUARD}{term}{GUARD}", i)
    automaton.make_automaton()
    return automaton


def count_terms(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (terms of the whole text) and hits (number and count of every one of ``terms`` in it)."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        automaton = automaton_of(sent.value)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            plain = [with_guards(t or "") for t in batch.column("text").to_pylist()]
            n = [_count_starts(t) for t in plain]
            texts = [t.decode("utf-8", "surrogatepass") for t in plain]
            found = [sorted(Counter(map(itemgetter(1), automaton.iter(t))).items()) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
            flat = np.array([x for h in found for x in h], np.int64).reshape(-1, 2)
            both = pa.StructArray.from_arrays([flat[:, 0].astype(np.int32), flat[:, 1].copy()], ["term", "tf"])
            return pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, both)],
                ["key", "n", "hits"],
            )

        return work

    schema = f"key {arrow_type(docs, key)}, n long, hits array<struct<term:int,tf:long>>"
    return map_texts(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), make, schema)


def _count_starts(plain: bytes) -> int:
    inside = _TERM_BYTE[np.frombuffer(plain, np.uint8)]
    return int((inside[1:] & ~inside[:-1]).sum())


def _weights(hits: DataFrame, n_terms: int, n_docs: int) -> np.ndarray:
    """The weight of every term, from the documents that hold it; one row per term and task is shuffled."""

    def count(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            held = batch.column("hits").flatten().field("term")
            total += np.bincount(held.to_numpy(zero_copy_only=False), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([some.astype(np.int32), total[some]], ["term", "df"])

    found = hits.select("hits").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = np.zeros(n_terms, np.int64)
    rows = found.toArrow()  # at most one row per term of the items
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def search(
    docs: DataFrame, items: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item, rank (from 1), key and score of the best documents of every item, scores above 0 only.

    Equal scores go by ascending key, a null key first. Rows that repeat a key are documents of their own, and
    may both be ranked; rows of ``items`` that repeat an item are one item with the terms of all. Null
    and empty texts have no terms: as documents they are not counted, as items they give no row, as do
    empty tables. Texts are taken whole; other columns are not read.

    The terms of a block of items, their weights and lists go through the driver; see the module.
    """
    spark = docs.sparkSession
    schema = f"`{item}` {arrow_type(items, item)}, rank int, `{key}` {arrow_type(docs, key)}, score long"
    pairs = materialise(item_terms(items, item, item_text), "item-terms")
    chars = pairs.agg(F.sum(F.length("term") + 8)).first()[0]
    if not chars:
        return spark.createDataFrame([], schema)
    n_blocks = -(-chars // settings.block_chars)
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = [_search_block(slim, pairs.filter(block == b), settings.top) for b in range(n_blocks)]
    return reduce(DataFrame.unionAll, [f for f in found if f is not None]).toDF(item, "rank", key, "score")


def _search_block(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame | None:
    spark = docs.sparkSession
    kind, item_kind = arrow_type(docs, "key"), arrow_type(pairs, "item")
    rows = pairs.collect()  # bounded by block_chars
    if not rows:
        return None
    terms = sorted({r.term for r in rows})
    ids = list({r.item for r in rows})
    n_items, term_no, item_no = len(ids), {t: n for n, t in enumerate(terms)}, {i: n for n, i in enumerate(ids)}
    lists = np.array(sorted((term_no[r.term], item_no[r.item]) for r in rows), np.int64)
    items_of, first = lists[:, 1], np.searchsorted(lists[:, 0], np.arange(len(terms) + 1))
    hits = materialise(count_terms(docs, terms, "key", "text"), "hits")
    n_docs, n_all = hits.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    known = spark.sparkContext.broadcast((_weights(hits, len(terms), n_docs), items_of, first))
    m = F.lit(100 - 90) + F.expr(f"(90 * n * {n_docs}L) div {max(n_all or 0, 1)}L")
    scored = hits.filter(F.size("hits") > 0).select("key", m.alias("m"), "hits")

    def best(batches):
        weights, items_of, first = known.value
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.int64()))
        keys = None
        for batch in batches:
            column = batch.column("hits")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            term = flat.field("term").to_numpy(zero_copy_only=False).astype(np.int64)
            tf = flat.field("tf").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            m = batch.column("m").to_numpy(zero_copy_only=False)[doc]
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            # In blocks, so that what is spread over the items stays small.
            wide = np.cumsum(first[term + 1] - first[term])
            at = 0
            while at < len(term):
                done = wide[at - 1] if at else 0
                end = int(np.searchsorted(wide, done + 4_000_000, side="right"))
                # Whole documents only.
                end = at + 1 if end <= at else end
                last = doc[end - 1] if end == len(term) or doc[end] != doc[end - 1] else doc[end - 1] - 1
                last = max(last, doc[at])
                end = int(np.searchsorted(doc, last, side="right"))
                block = _scores(doc[at:end], term[at:end], value[at:end], items_of, first, n_items)
                kept, keys = _keep(kept, keys, block, batch.column("key"), top)
                at = end
        if keys is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), keys, kept[1]], ["item", "key", "score"])

    found = scored.mapInArrow(best, f"item long, key {kind}, score long")
    by = [F.desc("score"), F.asc("key")]
    # First in parts of each item, so that no task gets the best documents of all tasks.
    within = Window.partitionBy("item", "salt").orderBy(*by)
    found = found.withColumn("salt", F.spark_partition_id() % _SALTS)
    found = found.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by)))
    names = spark.createDataFrame(list(enumerate(ids)), f"item long, name {item_kind}")
    return ranked.filter(F.col("rank") <= top).join(names, "item").select("name", "rank", "key", "score")


def _scores(doc, term, value, items_of, first, n_items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, row and score of every document and item that share a term, in whole numbers."""
    size = first[term + 1] - first[term]
    ends = np.cumsum(size)
    items = items_of[np.arange(ends[-1]) + np.repeat(first[term] - ends + size, size)]
    start = int(doc[0])
    cell = (np.repeat(doc, size) - start) * n_items + items
    n_docs = int(doc[-1]) - start + 1
    if n_docs * n_items <= 16 * len(cell) + 1_000_000:
        total = np.zeros(n_docs * n_items, np.int64)
        np.add.at(total, cell, np.repeat(value, size))
        cell = np.flatnonzero(total)
        total = total[cell]
    else:
        cell, which = np.unique(cell, return_inverse=True)
        total = np.zeros(len(cell), np.int64)
        np.add.at(total, which, np.repeat(value, size))
        cell, total = cell[total > 0], total[total > 0]
    return cell % n_items, start + cell // n_items, total


def _keep(kept, keys, block, column, top):
    """The best of what was kept and of a block, by item."""
    items, rows, scores = block
    # Of the block first what can be among the best of its own.
    order = np.lexsort((-scores, items))
    items, rows, scores = items[order], rows[order], scores[order]
    start = np.searchsorted(items, items)
    # Everything that scores as much as the last one kept may still go before it by its key.
    least = scores[np.minimum(start + top - 1, np.searchsorted(items, items, side="right") - 1)]
    some = scores >= least
    items, rows, scores = items[some], rows[some], scores[some]
    new = column.take(pa.array(rows))
    all_items, all_scores = np.concatenate([kept[0], items]), np.concatenate([kept[1], scores])
    all_keys = new if keys is None else pa.concat_arrays([keys, new])
    table = pa.table({"i": all_items, "s": all_scores, "k": all_keys})
    at = pc.sort_indices(
        table, sort_keys=[("i", "ascending"), ("s", "descending"), ("k", "ascending")], null_placement="at_start"
    ).to_numpy()
    ordered = all_items[at]
    at = at[np.arange(len(at)) - np.searchsorted(ordered, ordered) < top]
    return (all_items[at], all_scores[at]), all_keys.take(pa.array(at))


def op12_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), "score"
    )


SEARCH_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), t AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term
), c AS (
    SELECT count(*) FILTER (len(terms) > 0) AS nd, sum(len(terms))::BIGINT AS al FROM d
), w AS (
    SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM t CROSS JOIN c GROUP BY term
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), m AS (
    SELECT r, doc_id, 100 - 90 + ((90 * len(terms)::BIGINT * nd) // al) AS m FROM d CROSS JOIN c WHERE al > 0
), s AS (
    SELECT q.item_id, m.r, m.doc_id, sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m)))::BIGINT AS score
    FROM q JOIN t USING (term) JOIN w USING (term) JOIN m ON m.r = t.r
    GROUP BY q.item_id, m.r, m.doc_id
), o AS (
    SELECT item_id, doc_id, score,
        row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank
    FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""
