"""Benchmark items in documents, found by spaced seeds.

A seed is a mask over consecutive words; words at its zeros may be anything. Wherever a mask's
words are the same in a document and in an item, the two are laid on each other at that offset, and
the words that agree are counted: substituted words cost only themselves.

The four masks together miss nothing: in any overlap of at least five words of which 80 % agree, one of
them finds all its words (if four words in a row agree, the first; else the runs of agreeing words
between substitutions are so full that one of the others fits). Items of fewer than five words are found by
the words in a row that they are.

An item leaks where a stretch of it is found, not only where it is whole: a part of an item, and an item
with a word put in or left out, have a stretch on one side of the gap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.common import lower_words, map_texts
from sparkcurate.session import materialise

MASKS = ("1111", "11101", "11011", "10111")


@dataclass(frozen=True)
class Settings:
    """An item is found where ``percent`` of the words of a stretch of it agree.

    The stretch is any ``stretch`` words of the item, or the whole item if it has no more. Items of fewer than
    ``loose_words`` words must agree in all of them. ``index_bytes`` bounds what is sent to all
    tasks at once; more items are searched in as many blocks.
    """

    percent: int = 80
    stretch: int = 13
    loose_words: int = 5
    index_bytes: int = 16_000_000


class Index:
    """Items as word numbers, and their seeds in order."""

    def __init__(self, items: list[tuple], settings: Settings):
        self.settings = settings
        self.numbers: dict[bytes, int] = {}
        self.ids, self.items = [], []
        for item, text in items:
            words = lower_words(text)
            if words:
                self.ids.append(item)
                self.items.append(np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]))
        # Short items have a mask of their own length; the others the four masks.
        self.seeds = []
        for n in (1, 2, 3, None):
            which = [i for i, x in enumerate(self.items) if (len(x) == n if n else len(x) > 3)]
            for mask in ("1" * n,) if n else MASKS:
                self.seeds.append((mask, *self._seeds(which, mask)))

    def _seeds(self, which: list[int], mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of a mask over some items in order, with their items and places."""
        none = np.zeros(0, np.int64)
        tokens = np.concatenate([none, *[np.append(self.items[i], 0) for i in which]])
        owner = np.repeat(np.array(which, np.int64), [len(self.items[i]) + 1 for i in which])
        place = np.concatenate([none, *[np.arange(len(self.items[i]) + 1) for i in which]])
        at, keys = seeds(tokens, mask)
        order = np.argsort(keys, kind="stable")
        return keys[order], owner[at][order], place[at][order]

    def find(self, words: list[bytes]) -> list:
        """Ids of the items that a document holds, in order."""
        get = self.numbers.get
        tokens = np.array([get(w, 0) for w in words], np.int64)
        hits = []
        for mask, keys, owner, place in self.seeds:
            if not len(keys):
                continue
            at, mine = seeds(tokens, mask)
            low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
            n = high - low
            if n.any():
                where = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                hits.append(np.stack([owner[where], np.repeat(at, n) - place[where]]))
        if not hits:
            return []
        found = set()
        for i, offset in np.unique(np.concatenate(hits, axis=1), axis=1).T.tolist():
            if i not in found and self.overlaps(tokens, self.items[i], offset):
                found.add(i)
        return sorted(self.ids[i] for i in found)

    def overlaps(self, tokens: np.ndarray, item: np.ndarray, offset: int) -> bool:
        """Whether enough words of some stretch of the item agree with the document at an offset."""
        same = np.zeros(len(item) + 1, np.int64)
        a, b = max(0, -offset), min(len(item), len(tokens) - offset)
        same[a + 1 : b + 1] = tokens[a + offset : b + offset] == item[a:b]
        total = np.cumsum(same)
        size = min(len(item), self.settings.stretch)
        percent = self.settings.percent if len(item) >= self.settings.loose_words else 100
        return 100 * int((total[size:] - total[: len(total) - size]).max()) >= percent * size


def seeds(tokens: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a mask fits on known words (not 0) only, and the keys of those words."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    care = [i for i, c in enumerate(mask) if c == "1"]
    good = np.ones(n, bool)
    for i in care:
        good &= tokens[i : i + n] > 0
    at = np.flatnonzero(good)
    keys = np.zeros(len(at), np.uint64)
    for i in care:
        # Equal words give equal keys; unequal ones that meet are sorted out by the overlap.
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + tokens[at + i].astype(np.uint64)
    return at, keys


def _blocks(benchmark: DataFrame, settings: Settings, key: str, text: str) -> list[Index]:
    """Indexes over parts of the benchmark, each of about ``index_bytes`` of text; usually one."""
    slim = benchmark.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(
        F.col("key").isNotNull() & F.col("text").isNotNull()
    )
    size = slim.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = size // settings.index_bytes + 1
    part = F.pmod(F.xxhash64("key", "text"), F.lit(n))
    for i in range(n):
        rows = slim.filter(part == i).collect() if n > 1 else slim.collect()
        yield Index(sorted({(r["key"], r["text"]) for r in rows}), settings)


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    settings: Settings = Settings(), keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all) of every row and ``leaked_items``: the items found in its whole text.

    Nothing is found in a null or empty text, nor of items without key or text. One row per input
    row, repeated rows included; an empty table gives an empty result, an empty benchmark finds nothing.
    A column ``leaked_items`` of the input is replaced. The benchmark is sent to the tasks only in blocks
    of a checked size, one after the other.
    """
    kind = benchmark.schema[item_key].dataType.simpleString()
    rest = [c for c in (docs.columns if keep is None else keep) if c != "leaked_items"]
    columns = list(dict.fromkeys([*rest, text]))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.array().cast(f"array<{kind}>").alias("leaked_items"))
    blocks = _blocks(benchmark, settings, item_key, item_text)
    index = next(blocks)
    while index is not None:
        following = next(blocks, None)
        out = rest if following is None else columns
        rows = _search(rows, index, text, out)
        rows = rows if following is None else materialise(rows, "leaks")
        index = following
    return rows


def _search(rows: DataFrame, index: Index, text: str, out: list[str]) -> DataFrame:
    schema = rows.select(*[F.col(f"`{c}`") for c in out], "leaked_items").schema

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            before = batch.column("leaked_items")
            found = [index.find(lower_words(t)) for t in batch.column(text).to_pylist()]
            if len(before.values):
                found = [sorted({*old, *new}) for old, new in zip(before.to_pylist(), found)]
            return pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in out], pa.array(found, before.type)], [*out, "leaked_items"]
            )

        return work

    return map_texts(rows, make, schema, text)


def op6_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id", (F.size("leaked_items") > 0).alias("contaminated"), F.size("leaked_items").cast("long").alias("n_items"),
        F.array_join("leaked_items", ",").alias("items"),
    )


LEAKS_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
 words AS (SELECT 'd' AS side, r, text FROM d UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL),
 split AS (SELECT side, r, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM words),
 tokens AS (SELECT side, r, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM split),
 same AS (SELECT a.r, b.r AS item, a.i - b.i AS shift, b.i AS q, least(b.n, {Settings.stretch}) AS size, CASE WHEN b.n < {Settings.loose_words} THEN 100 ELSE {Settings.percent} END AS pct
   FROM tokens a JOIN tokens b ON a.side = 'd' AND b.side = 'b' AND a.t = b.t),
 hits AS (SELECT DISTINCT r, item FROM (SELECT *, max(size) OVER w AS s,
    count(*) OVER (PARTITION BY r, item, shift ORDER BY q RANGE BETWEEN CURRENT ROW AND {Settings.stretch - 1} FOLLOWING) AS c FROM same
    WINDOW w AS (PARTITION BY r, item, shift)) WHERE 100 * c >= pct * size)
SELECT doc_id, count(item) > 0 AS contaminated, count(item) AS n_items,
 coalesce(string_agg(item::VARCHAR, ',' ORDER BY item), '') AS items
FROM d LEFT JOIN hits USING (r) GROUP BY r, doc_id
"""
