"""De-duplication by first seen row over several keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.session import materialise

#: Rounds on the whole table before what is left is cut into its components.
ROUNDS = 3

#: Rows of a component that one task settles; larger ones go through further rounds.
TASK_ROWS = 100_000


def greedy_dedup(df: DataFrame, order: Sequence[str], keys: Sequence[Column]) -> DataFrame:
    """The rows of ``df`` that :func:`greedy_order` keeps."""
    return df.join(greedy_order(df, order, keys), list(order), "left_semi")


def greedy_order(
    df: DataFrame, order: Sequence[str], keys: Sequence[Column], rounds: int = ROUNDS, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Walk the rows in ``order``; keep a row unless a *kept* earlier row shares one of its keys.

    Returns the ``order`` columns of the kept rows.

    Rows without a key share the null key, as rows with an equal one share theirs.

    Only kept rows use up keys, so this is not the same as dropping duplicates key by key.
    The order must be total. The walk is done in rounds on the whole table: a row that is the
    first undecided one of all its keys is kept, every row sharing a key with it is dropped,
    and the rest goes to the next round. Nearly all rows are settled by ``rounds`` of them.

    What is left are chains of rows that each depend on the one before. Rows of different
    connected parts do not depend on each other, so parts of at most ``task_rows`` rows are walked
    as a whole, each inside one task, however long their chains are; finding the parts takes a number of
    steps that grows with the logarithm of their size. Only larger parts go through rounds again.

    Rows with the same keys are first reduced to their earliest one by a map-side combined
    aggregate, so groups of copies cost nothing afterwards. The first row of a key comes from
    an aggregate too; only the anti-joins see a frequent key, and there each key occurs once
    on the other side, which lets the adaptive skew join split it.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rank = F.struct(*order).alias("_rank")
    # Null is a key like any other here, so every key becomes a text that is never null.
    plain = [F.when(k.isNull(), "").otherwise(F.concat(F.lit("="), k.cast("string"))) for k in keys]
    slim = df.select(rank, *[k.alias(n) for n, k in zip(names, plain)])
    undecided = materialise(slim.groupBy(*names).agg(F.min("_rank").alias("_rank")), "dedup")
    kept: list[DataFrame] = []
    while True:
        for _ in range(rounds):
            if undecided.isEmpty():
                break
            won, undecided = _round(undecided, names)
            kept.append(won)
        if undecided.isEmpty():
            break
        parts = materialise(_with_parts(undecided, names), "dedup-parts")
        sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        small = materialise(sizes.filter(F.col("_n") <= task_rows).select("_part"), "dedup-small")
        kept.append(materialise(_walk(parts.join(small, "_part", "left_semi"), names), "dedup-walked"))
        undecided = materialise(parts.join(small, "_part", "left_anti").drop("_part"), "dedup-large")
    if not kept:
        return df.select(*order).limit(0)
    every = kept[0].select("_rank")
    for more in kept[1:]:
        every = every.unionByName(more.select("_rank"))
    return every.select("_rank.*")


def _round(undecided: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that are kept, rows that are still undecided) after one round."""
    winners = None
    for name in names:
        first = undecided.groupBy(name).agg(F.min("_rank").alias("_rank"))
        winners = first if winners is None else winners.join(first, "_rank")
    won = materialise(winners, "dedup-won")
    if won.isEmpty():
        raise RuntimeError("a round without a first row: the order has null parts")
    rest = undecided
    for name in names:
        rest = rest.join(won.select(name), name, "left_anti")
    return won, materialise(rest, "dedup-rest")


def _with_parts(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the number of their connected part, rows being connected by common keys.

    Numbers of rows take turns: every node tells all its larger neighbours, then all smaller ones, of the least
    number it knows, until nothing changes. A key's rows are joined with the first of them alone, so
    a frequent key gives as many links as it has rows.
    """
    numbered = materialise(rows.withColumn("_id", F.monotonically_increasing_id()), "dedup-numbered")
    links = None
    for name in names:
        first = numbered.groupBy(name).agg(F.min("_id").alias("b"))
        part = numbered.join(first, name).filter("_id <> b").select(F.col("_id").alias("a"), "b")
        links = part if links is None else links.unionByName(part)
    # (a, b): a is larger than b; in the end b is the least of a's part.
    links = materialise(links.distinct(), "dedup-links")
    before = None
    while True:
        both = links.unionAll(links.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        # Larger neighbours point to the least one.
        up = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = materialise(up.distinct(), "dedup-up")
        # Smaller neighbours and the node itself point to the least of them.
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").select(F.col("b").alias("x"), "m", "a")
        new = down.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        new = materialise(new.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "dedup-links")
        mark = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        links = new
        if mark == before:
            break
        before = mark
    part = F.coalesce("b", "_id").alias("_part")
    return numbered.join(links, numbered["_id"] == links["a"], "left").select("_rank", *names, part)


def _walk(rows: DataFrame, names: list[str]) -> DataFrame:
    """The kept rows of whole parts: every task has its parts together, each in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used = None, [set() for _ in names]
        for batch in batches:
            keys = [batch.column(n).to_pylist() for n in names]
            chosen = []
            for i, p in enumerate(batch.column("_part").to_pylist()):
                if p != part:
                    part, used = p, [set() for _ in names]
                own = [k[i] for k in keys]
                if not any(k in u for k, u in zip(own, used)):
                    chosen.append(i)
                    for k, u in zip(own, used):
                        u.add(k)
            yield batch.take(pa.array(chosen, pa.int64())).select(["_rank"])

    whole = rows.repartition("_part").sortWithinPartitions("_part", "_rank")
    return whole.select("_part", "_rank", *names).mapInArrow(run, rows.select("_rank").schema)
