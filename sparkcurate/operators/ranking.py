"""Order-dependent operators that never gather all rows in one task.

Global positions and running totals come from a range partitioning plus one small table of
per-partition totals. Exact random samples and splits come from cut values found by counting
hash prefixes, so the final selection is a comparison on each row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.config import SplitRatios
from sparkcurate.session import materialise

_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id
_SALTS = 64
_PREFIX = 4  # hex digits counted per step: at most 65,536 groups
_FEW = 100  # so many first rows are brought to one task by a sort, not more


def first_per_key(
    df: DataFrame, key: str | Column, order: Sequence[str], last: bool = False
) -> DataFrame:
    """The first (or last) row of every key by ``order``; null and empty keys are left out.

    An aggregate, not a window: a key holding a third of all rows shrinks to one row per task
    before anything is shuffled.
    """
    key = F.col(key) if isinstance(key, str) else key
    pick = F.max_by if last else F.min_by
    return (
        df.withColumn("_key", key)
        .filter(F.col("_key").isNotNull() & (F.col("_key").cast("string") != ""))
        .groupBy("_key")
        .agg(
            pick(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("_row")
        )
        .select("_row.*")
    )


def top_per_key(df: DataFrame, key: str, order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of every key; ``order`` should be total.

    A key is first cut to its first ``k`` rows in each of several parts, so that a frequent
    key is not sorted by one task; whatever the parts are, they hold the first ``k`` of all.
    """
    parts = df.withColumn("_salt", F.spark_partition_id() % _SALTS)
    within = Window.partitionBy(key, "_salt").orderBy(*order)
    cut = parts.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= k).drop("_salt", rank)
    w = Window.partitionBy(key).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _sorted_parts(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` range-partitioned and sorted, stored, with ``_part`` and ``_seq``.

    Stored because range bounds come from a sample and may differ between two runs.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(parts.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    return stored.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_seq", F.col("_id").bitwiseAND(F.lit(_IN_PARTITION))
    )


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """Add the 1-based position in ``order``, which must be a total order."""
    parts = _sorted_parts(df, order)
    # One row per partition, so the unpartitioned window below stays small.
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        parts.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_seq") + 1)
        .select(*df.columns, name)
    )


def running_totals(
    df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column]
) -> DataFrame:
    """Add running sums in ``order`` (a total order), each including its own row."""
    staged = df.select("*", *[c.cast("bigint").alias(f"_v_{n}") for n, c in sums.items()])
    parts = _sorted_parts(staged, order)
    totals = parts.groupBy("_part").agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums]
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    within = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(f"_v_{n}").over(within).alias(f"_l_{n}") for n in sums])
    return local.join(offsets, "_part").select(
        *df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums]
    )


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by one column, nulls first; of rows that are equal at the end, any. They are in no order.

    Above a few rows only the values of the column are sorted, equal ones as one. The rows are then compared with the
    last value where they are: none is moved, and only those equal to it are stored, where not all of them are wanted.
    """
    if n <= _FEW:
        return df.orderBy(order).limit(n)
    counts = df.groupBy(F.col(order).alias("_last")).agg(F.count(F.lit(1)).alias("_n"))
    totals = running_totals(counts, ["_last"], {"_total": F.col("_n")})
    last = materialise(totals.filter(F.col("_total") >= n).orderBy("_last").limit(1), "last")
    found = last.select("_n", "_total").first()
    if found is None:  # there are fewer rows
        return df
    value, bound, last = F.col(order), F.col("_last"), F.broadcast(last.select("_last"))
    below = (value < bound) | (value.isNull() & bound.isNotNull())
    equal = value.eqNullSafe(bound)
    if found["_total"] == n:
        return df.join(last, below | equal, "left_semi")
    stored = materialise(
        df.join(last, equal, "left_semi").withColumn("_id", F.monotonically_increasing_id()), "equal"
    )
    wanted = found["_n"] - (found["_total"] - n)
    for part, size in sorted(stored.groupBy(F.shiftright("_id", 33)).count().collect()):
        if wanted <= size:
            break
        wanted -= size
    some = stored.filter(F.col("_id") < (part << 33) + wanted).drop("_id")
    return df.join(last, below, "left_semi").union(some)


def random_order(key: Column | str, seed: int) -> Column:
    """A reproducible random order of unique keys, a null one included: md5 of seed and key, as hex text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))


def _prefix_counts(hashes: DataFrame, prefixes: dict[str, int]) -> dict[str, list[tuple[str, int]]]:
    """Rows per next hash digits among those that start with a prefix, in hash order, in one pass.

    The prefixes have one length and come with their numbers of rows. Few rows are counted by all digits.
    """
    length = len(next(iter(prefixes)))
    if length == 32:
        raise ValueError("the key of a random order must be unique")
    few = length and sum(prefixes.values()) <= len(prefixes) * 16**_PREFIX
    size = 32 if few else length + _PREFIX
    within = hashes.filter(F.substring("h", 1, length).isin(*prefixes)) if length else hashes
    found: dict[str, list[tuple[str, int]]] = {p: [] for p in prefixes}
    for g, n in sorted(within.groupBy(F.substring("h", 1, size).alias("g")).count().collect()):
        found[g[:length]].append((g, n))
    return found


def cut_values(
    df: DataFrame, order: Column, ns: Sequence[int], counts: list[tuple[str, int]] | None = None
) -> list[str]:
    """For each of ``ns`` the hex text ``t`` such that exactly so many rows have ``order < t`` (for distinct values).

    All cuts descend through hash prefixes together. A step counts at most 65,536 groups per cut in one pass, and only
    the groups that hold a cut are looked at further; where those are small, by whole hashes. So there are two
    passes up to some four billion rows, three above. ``counts`` are those of the first step, when they are known.
    """
    hashes, cuts = df.select(order.alias("h")), {}
    known = {"": counts if counts is not None else _prefix_counts(hashes, {"": 0})[""]}
    waiting = {n: ("", n) for n in ns}
    while waiting:
        inside, sizes = {}, {}
        for n, (prefix, rest) in waiting.items():
            for g, count in known[prefix]:
                if rest < count:
                    break
                rest -= count
            else:
                cuts[n] = "g"  # above every hex digit: all rows are below the cut
                continue
            if rest == 0:
                cuts[n] = g
            else:
                inside[n], sizes[g] = (g, rest), count
        waiting = inside
        known = _prefix_counts(hashes, sizes) if waiting else {}
    return [cuts[n] for n in ns]


def cut_value(df: DataFrame, order: Column, n: int) -> str:
    """One of :func:`cut_values`."""
    return cut_values(df, order, [n])[0]


def sample_rows(
    df: DataFrame, n: int, key: str, seed: int | None = None, offset: int = 0
) -> DataFrame:
    """``n`` rows: at random without replacement when seeded, else in key order after ``offset``."""
    if seed is None:
        return df.orderBy(key).offset(offset).limit(n)
    order = random_order(key, seed)
    return df.filter(order < cut_value(df, order, n))


def split_sizes(total: int, ratios: SplitRatios) -> tuple[int, int, int]:
    """Sizes of train, validation and test; each carve-out is rounded up."""
    held_share = ratios.val + ratios.test
    held = math.ceil(total * held_share) if held_share else 0
    test = math.ceil(held * (ratios.test / held_share)) if ratios.test > 0 else 0
    return total - held, held - test, test


def split(df: DataFrame, key: str, ratios: SplitRatios | None, name: str = "split") -> DataFrame:
    """Label every row train, validation or test, with exact sizes and no shuffle of the rows.

    Without ratios everything is training data. ``key`` must be unique.
    """
    if ratios is None:
        return df.withColumn(name, F.lit("train"))
    order = random_order(key, ratios.seed)
    counts = _prefix_counts(df.select(order.alias("h")), {"": 0})[""]
    _, val, test = split_sizes(sum(n for _, n in counts), ratios)
    label = F.lit("train")
    if val + test:
        held_cut, test_cut = cut_values(df, order, [val + test, test], counts)
        label = F.when(order < test_cut, "test").when(order < held_cut, "validation").otherwise(label)
    return df.withColumn(name, label)


def page(df: DataFrame, order: Sequence[Column], number: int, per_page: int) -> DataFrame:
    """One page (1-based) of ``df`` in ``order``, which should end with a unique column."""
    return df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def page_with_total(df: DataFrame, order: Sequence[Column], number: int, per_page: int) -> DataFrame:
    """One page with ``total``, the number of all rows, beside every row of it."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    # One row, so this is no product of two tables.
    return page(df, order, number, per_page).crossJoin(F.broadcast(total))


def page_after(
    df: DataFrame, column: str, last: object | None, per_page: int, descending: bool = False
) -> DataFrame:
    """The next page by the unique ``column`` after the last value seen.

    Unlike an offset this stays cheap however deep the page lies: the bound is pushed down.
    """
    if last is not None:
        df = df.filter(F.col(column) < last if descending else F.col(column) > last)
    return df.orderBy(F.col(column).desc() if descending else F.col(column)).limit(per_page)
