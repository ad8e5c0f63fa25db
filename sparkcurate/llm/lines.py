"""Removal of repeated runs of words, found by winnowing.

A run of at least ``min_words`` words that an earlier place has goes, wherever in a line or sentence it begins
and ends. That is the union of all windows of ``min_words`` words that an earlier place has.

Every window selects one of its shingles, the one with the least hash (the last one of equals): the
same window in two places selects the same shingle in both. The neighbouring windows that select one place
make up its context. A shingle that is selected once belongs to no repeated run, which settles most
places at once. Where a shingle is shared, contexts are compared as wholes by their hash, whose first
place is found by an aggregate: a context that an earlier place has goes. Only where the contexts of a
shingle differ, the first one of each kind is taken apart, and its windows are compared one by one by a
128-bit hash, again by the first place. So matches end at the exact word, without a pair of places ever
being formed, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.common import arrow_type, map_texts, mix
from sparkcurate.session import materialise

#: Words of a shingle, or half a window if that is less.
SHINGLE = 8


@dataclass(frozen=True)
class Settings:
    """A repeated run is removed if it has at least this many words."""

    min_words: int = 50


# Words are runs of anything but these six characters.
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\v\f\r")] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and the number of words of each; final full stops don't count."""
    words, sizes = [], []
    for text in texts:
        before = len(words)
        words += text.split()
        sizes.append(len(words) - before)
    hashes = map(xxhash.xxh3_64_intdigest, [w.rstrip(b".") for w in words])
    return np.fromiter(hashes, np.uint64, len(words)), np.array(sizes, np.int64)


def contexts(hashes: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Text, shingle, first and last word (in the text), and hash of the context of every selected shingle."""
    size = max(1, min(SHINGLE, (least + 1) // 2))
    n = len(hashes) - least + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    text = np.repeat(np.arange(len(sizes)), sizes)
    shingles = hashes[: len(hashes) - size + 1]
    for j in range(1, size):
        shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - size + 1 + j]
    shingles = mix(shingles)
    # The upper half of the hash, then the place from the end: the least one is the last of equals.
    low = np.uint64(0xFFFFFFFF)
    best = (shingles & ~low) | (low - np.arange(len(shingles), dtype=np.uint64))
    wide, width = 1, least - size + 1
    while 2 * wide <= width:
        best = np.minimum(best[:-wide], best[wide:])
        wide *= 2
    if wide < width:
        best = np.minimum(best[: wide - width], best[width - wide :])
    starts = np.flatnonzero(text[:n] == text[least - 1 :])
    chosen = (low - (best[starts] & low)).astype(np.int64)
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    first = starts[new]
    stop = starts[np.append(new[1:] - 1, len(starts) - 1)[: len(new)]] + least
    data = memoryview(hashes.astype("<u8").tobytes())
    whole = (xxhash.xxh3_64_intdigest(data[8 * a : 8 * b]) for a, b in zip(first.tolist(), stop.tolist()))
    owner = text[first]
    begin = (np.cumsum(sizes) - sizes)[owner]
    return owner, shingles[chosen[new]], first - begin, stop - 1 - begin, np.fromiter(whole, np.uint64, len(first))


def _contexts(docs: DataFrame, settings: Settings) -> DataFrame:
    """One row per selected shingle of every text: key, mark, shingle, context, first and last word."""
    kind = arrow_type(docs, "key")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, sizes = word_hashes(batch.column("text").cast(pa.binary()).to_pylist())
            owner, shingle, first, last, context = contexts(hashes, sizes, settings.min_words)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(owner)), batch.column("mark").take(pa.array(owner)),
                    pa.array(shingle.view(np.int64)), pa.array(context.view(np.int64)),
                    pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                ],
                ["key", "mark", "shingle", "context", "first", "last"],
            )

        return work

    return map_texts(docs, make, f"key {kind}, mark long, shingle long, context long, first int, last int")


def _windows_of(texts: DataFrame, settings: Settings) -> DataFrame:
    """All windows in the parts (first, last word) of every text: key, mark, two hashes, first word."""
    kind, least = arrow_type(texts, "key"), settings.min_words

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner, places, found = [], [], []
            texts, parts = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("parts").to_pylist()
            for i, text in enumerate(texts):
                data = memoryview(word_hashes([text])[0].astype("<u8").tobytes())
                for part in parts[i]:
                    at = range(part["first"], part["last"] - least + 2)
                    places.extend(at)
                    owner.extend([i] * len(at))
                    found.extend([xxhash.xxh3_128_digest(data[8 * s : 8 * (s + least)]) for s in at])
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            rows = pa.array(owner, pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(rows), batch.column("mark").take(rows),
                    pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(places, pa.int32()),
                ],
                ["key", "mark", "w1", "w2", "first"],
            )

        return work

    return map_texts(texts, make, f"key {kind}, mark long, w1 long, w2 long, first int")


def without_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without the runs (first, last word) and the blanks behind them.

    A line that loses its end keeps its line break; one that is lost as a whole loses it too.
    """
    blank = _BLANK[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, stops = edges[::2].tolist(), edges[1::2].tolist()
    merged: list[list[int]] = []
    for first, last in sorted(runs):
        before = merged[-1][1] if merged else -2
        if first <= before or first == before + 1 and text.find(b"\n", stops[before], starts[first]) < 0:
            merged[-1][1] = max(before, last)
        else:
            merged.append([first, last])
    left, done = [], 0
    for first, last in merged:
        start, stop = starts[first], stops[last]
        line = text.rfind(b"\n", 0, start) + 1
        # Whether nothing of the first line, then of the last one, is left before what goes.
        whole = not first or line > stops[first - 1]
        left.append(text[done : line if whole else start])
        if text.find(b"\n", start, stop) >= 0:
            if not whole:
                left.append(b"\n")
            whole = True
        after = starts[last + 1] if last + 1 < len(starts) else len(text)
        end = text.find(b"\n", stop, after)
        done = after if end < 0 else end + whole
    return b"".join([*left, text[done:]])


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """All columns of all rows, the text without runs that an earlier place has, and ``removed_chars``.

    Earlier is by key, then by place in the text, so a run that a text repeats itself goes
    too. Null texts and rows without a key are returned as they are. Rows that repeat key and text are the
    same place: none is earlier. An empty table gives an empty result. A column ``removed_chars`` of the
    input is replaced. Rows of one key with different texts are ordered by a hash of the text.
    """
    mark = F.xxhash64(text)
    slim = docs.select(F.col(key).alias("key"), mark.alias("mark"), F.col(text).alias("text")).filter(
        F.col("key").isNotNull() & F.col("text").isNotNull()
    )
    rows = materialise(_contexts(slim, settings), "contexts")
    # Repeated rows are one document here; where they alone share a shingle, nothing comes of it.
    counts = rows.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b")
    )
    several = counts.filter("n > 1").select("shingle", (F.col("a") != F.col("b")).alias("differ"))
    # Stored, so that the join has no aggregate in it and a frequent shingle can be split.
    shared = materialise(rows.join(materialise(several, "several").hint("merge"), "shingle"), "shared")
    at = F.struct("key", "mark", "first", "last")
    kinds = shared.groupBy("shingle", "context", "differ").agg(F.min(at).alias("at"), F.max(at).alias("to"))
    first = kinds.filter("at <> to").select("shingle", "context", "at")
    runs = shared.join(first, ["shingle", "context"]).filter(at > F.col("at")).select("key", "mark", "first", "last")
    parts = kinds.filter("differ").select("at.*").groupBy("key", "mark").agg(
        F.collect_list(F.struct("first", "last")).alias("parts")
    )
    # As many texts may have a shared part as there are, so this side is never sent to all tasks.
    found = materialise(_windows_of(slim.join(parts.hint("merge"), ["key", "mark"]), settings), "windows")
    at = F.struct("key", "mark", "first")
    first = found.groupBy("w1", "w2").agg(F.min(at).alias("at"), F.max(at).alias("to")).filter("at <> to")
    later = found.join(first.select("w1", "w2", "at"), ["w1", "w2"]).filter(at > F.col("at"))
    runs = runs.union(
        later.select("key", "mark", "first", (F.col("first") + settings.min_words - 1).alias("last"))
    )
    runs = runs.groupBy("key", "mark").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    return _without(docs, materialise(runs, "runs"), key, text)


def _without(docs: DataFrame, runs: DataFrame, key: str, text: str) -> DataFrame:
    others = [c for c in docs.columns if c != "removed_chars"]
    left = docs.select(*[F.col(f"`{c}`") for c in others]).alias("d")
    # As many texts may change as there are, so this side is never sent to all tasks.
    joined = left.join(
        runs.hint("merge").alias("k"),
        (F.col(f"d.`{key}`") == F.col("k.key")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("k.mark")), "left",
    )

    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        rows = zip(texts.cast(pa.binary()).to_pylist(), runs.to_pylist())
        new = [without_runs(t, [(r["first"], r["last"]) for r in k]) if k else None for t, k in rows]
        return pa.array(new, pa.binary()).cast(pa.string())

    old, changed = F.col(f"d.`{text}`"), F.col("k.runs").isNotNull()
    # Only texts that change go through Python.
    new = F.arrow_udf(cut, "string")(F.when(changed, old), F.col("k.runs"))
    new = F.when(changed, new).otherwise(old)
    removed = F.when(changed, F.length(old) - F.length(new)).otherwise(0).cast("long")
    return joined.select(
        *[new.alias(c) if c == text else F.col(f"d.`{c}`") for c in others], removed.alias("removed_chars")
    )


def op5_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "removed_chars", "text")
