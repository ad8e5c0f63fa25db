"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document is the set of its distinct word shingles. Its sketch has t coordinates: in round
i < t every shingle is thrown into a random coordinate with a value between i and i + 1, in round
t + j into coordinate j, and a coordinate keeps its least value. Rounds stop when every
coordinate is filled, which is certain after 2 t and usual after ln t / n of them, so a sketch takes
time in proportion to the set and not to its t-fold; coordinates agree with the concentration
of t independent ones. Bands of coordinates are the buckets in which documents meet.

Documents with equal sets are one node from the start. Links are confirmed on whole sets. Only links
between nodes that are not yet connected can change the result:

1. Every bucket tests its leader against its other members. Leaders are the nodes of which the
   least part is theirs alone: in a family of copies those nearest to the original, with which every
   copy is most similar. This connects most of what is connected, by fewer tests than members.
2. Buckets that still hold several components compare the members outside their main component
   with all others, blocks of members with blocks of members, each pair in its first common bucket
   only. Blocks are bounded and spread over all tasks; no pair is a row.

A node with u of its n shingles in no other candidate shares at most m = min(n - u, n' - u') with
another one, so pairs with m / (n + n' - m) below the threshold are not tested, without loss.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.common import arrow_type, chain, lower_words, map_texts, mix
from sparkcurate.session import materialise

#: Members of a bucket that a task compares with as many others.
BLOCK = 128

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    """A pair of similarity s shares no band with probability (1 - s^rows)^bands: 3e-6 for 0.8."""

    shingle: int = 4
    percent: int = 80
    bands: int = 32
    rows: int = 5


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, an empty one none."""
    return shingles_of(lower_words(text), size, {})


def shingles_of(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    get = known.get
    h = np.array([get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
    if len(h) < size:
        size = len(h)
    out = mix(h[: len(h) - size + 1] + np.uint64(size))
    for i in range(1, size):
        out = chain(out, h[i : len(h) - size + 1 + i])
    return np.unique(out)


def sketch(sets: Sequence[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t values per set; sets must not be empty."""
    result = np.full((len(sets), t), EMPTY)
    todo = np.arange(len(sets))
    h = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(todo, [len(s) for s in sets])
    for i in range(2 * t):
        if not len(todo):
            break
        v = mix(h ^ mix(np.array([i + 1], np.uint64)))
        place = ((v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        value = np.uint64(i << 48) | v & np.uint64((1 << 48) - 1)
        flat = result.reshape(-1)
        np.minimum.at(flat, owner * t + place, value)
        left = (result[todo] == EMPTY).any(axis=1)
        if not left.all():
            open_ = np.zeros(len(sets), bool)
            open_[todo[left]] = True
            todo = todo[left]
            keep = open_[owner]
            h, owner = h[keep], owner[keep]
    return result


def bands_of(sketches: np.ndarray, settings: Settings) -> np.ndarray:
    """A 64-bit hash for each band of each sketch."""
    parts = sketches.reshape(len(sketches), settings.bands, settings.rows)
    out = mix(np.arange(1, settings.bands + 1, dtype=np.uint64))[None, :]
    for i in range(settings.rows):
        out = chain(out, parts[:, :, i])
    return out


def sketch_texts(docs: DataFrame, settings: Settings) -> DataFrame:
    """key, n_shingles, node (64-bit hash of the set) and bands of every row; no node for empty sets."""
    schema = f"key {arrow_type(docs, 'key')}, n_shingles long, node long, bands array<long>"
    t = settings.bands * settings.rows

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict[bytes, int] = {}
            sets = [shingles_of(lower_words(x), settings.shingle, known) for x in batch.column("text").to_pylist()]
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else None for s in sets]
            full = [s for s in sets if len(s)]
            found = iter(bands_of(sketch(full, t), settings).view(np.int64))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([None if n is None else n - (n >> 63 << 64) for n in nodes], pa.int64()),
                    pa.array([next(found) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["key", "n_shingles", "node", "bands"],
            )

        return work

    return map_texts(docs.select("key", "text"), make, schema)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it is connected with) of every node of the edges (a, b).

    Large-star and small-star steps in turn until nothing changes; a step replaces neighbours by
    their least one, so its work is linear in the edges whatever the degree of a node.
    """
    stars = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "edges")
    mark = _mark(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Here every edge goes from a node to a smaller one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        nxt = materialise(small.distinct(), "edges")
        before, mark = mark, _mark(nxt)
        if before == mark:
            break
        stars = nxt
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough; sets of too different sizes cannot be."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], ["a", "b"]
            )

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """node, n, members (sorted 64-bit hashes) and bands of the wanted (key, node), one row per node."""
    kind = arrow_type(docs, "key")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            known: dict[bytes, int] = {}
            sets = [shingles_of(lower_words(x), settings.shingle, known) for x in batch.column("text").to_pylist()]
            nodes = [xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            full = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
            bands = bands_of(sketch(full, settings.bands * settings.rows), settings)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([n - (n >> 63 << 64) for n in nodes], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                    pa.array([x.astype("<u8").tobytes() for x in bands], pa.binary()), batch.column("key"),
                ],
                ["node", "n", "members", "bands", "key"],
            )

        return work

    # All nodes may be wanted, so this side is never sent to all tasks.
    texts = docs.join(wanted.select("key").distinct().hint("merge"), "key", "left_semi")
    made = map_texts(texts.select("key", "text"), make, f"node long, n long, members binary, bands binary, key {kind}")
    # A key that stands for several texts may bring a text that was not asked for, or one twice.
    made = made.join(wanted, ["key", "node"], "left_semi")
    return made.drop("key")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """key, n_shingles, component_id and kept of every row.

    ``component_id`` is the least key among the rows connected with this one by links, itself included.
    Rows without words are linked with nothing. Rows without a key take no part: component null,
    kept. Repeated rows have the same set, so the same component; each is returned. An empty table
    gives an empty result; other columns are not read.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = materialise(sketch_texts(slim, settings), "sketches")
    alive = rows.filter(F.col("key").isNotNull() & F.col("node").isNotNull())
    nodes = materialise(alive.groupBy("node").agg(F.min("key").alias("key")), "nodes")
    buckets = alive.join(nodes, ["node", "key"], "left_semi").select("node", F.explode("bands").alias("bucket"))
    buckets = materialise(buckets.distinct(), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(
        buckets.join(shared.select("bucket"), "bucket", "left_semi").withColumn("label", F.col("node")), "members"
    )
    links = _links(slim, nodes, members, settings) if not members.isEmpty() else None
    if links is None:
        labels = nodes.select("node", F.col("key").alias("component_id"))
    else:
        roots = materialise(components(links), "roots")
        whole = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = whole.groupBy("root").agg(F.min("key").alias("component_id"))
        labels = whole.join(least, "root").select("node", "component_id")
    found = rows.join(labels, "node", "left").select(
        "key", "n_shingles",
        F.when(F.col("node").isNull(), F.col("key")).when(F.col("key").isNotNull(), F.col("component_id"))
        .alias("component_id"),
    )
    return found.select(
        F.col("key").alias(key), "n_shingles", "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _alone(sets: DataFrame) -> DataFrame:
    """node, n and u, the number of its shingles that no other of the sets has."""

    def run(batches):
        for batch in batches:
            for node, members in zip(batch.column("node").to_pylist(), batch.column("members")):
                found = np.frombuffer(members.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), node, np.int64))], ["shingle", "node"]
                )

    rows = sets.select("node", "members").mapInArrow(run, "shingle long, node long")
    once = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1")
    u = once.groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    return sets.select("node", "n").join(u, "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))


def _links(docs: DataFrame, nodes: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """Links that connect whatever is connected; see the head of the module."""
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = materialise(_sets(docs, wanted, settings).dropDuplicates(["node"]), "sets")
    alone = materialise(_alone(sets), "alone")
    members = materialise(_open(members.join(alone, "node"), settings), "members")
    leaders = materialise(
        members.groupBy("bucket").agg(F.min(F.struct(F.col("u") / F.col("n"), F.xxhash64("node"), "node", "n", "u")).alias("l"))
        .select("bucket", F.col("l.node").alias("a"), F.col("l.n").alias("na"), (F.col("l.n") - F.col("l.u")).alias("ma")),
        "leaders",
    )
    pairs = members.join(leaders, "bucket").filter(f"node <> a AND {_possible('least(n - u, ma)', settings)}")
    pairs = pairs.select("a", F.col("node").alias("b")).distinct()
    links = materialise(verified(pairs, sets, settings.percent), "links")
    roots = components(links)
    rest = members.join(leaders.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti").drop("label")
    rest = rest.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    rest = materialise(_open(rest, settings), "rest")
    return links.unionByName(materialise(_by_blocks(rest, sets, settings), "links"))


def _possible(most: str, settings: Settings) -> str:
    """Whether a pair with at most ``most`` common shingles can be similar enough; sizes n and na."""
    return f"100 * {most} >= {settings.percent} * (n + na - {most})"


def _open(members: DataFrame, settings: Settings) -> DataFrame:
    """Members that may still have a link to another component, in buckets of several components.

    A bucket has no other node with fewer than ``least`` shingles.
    """
    lows = members.groupBy("bucket").agg(F.min("n").alias("least"))
    hopeful = members.join(lows, "bucket").filter(
        f"100 * (n - u) >= {settings.percent} * (u + greatest(least, n - u))"
    ).drop("least")
    mixed = hopeful.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    return hopeful.join(mixed.select("bucket"), "bucket", "left_semi")


def _by_blocks(members: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between components, from comparing blocks of about BLOCK members of a bucket."""
    per = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    shape = per.groupBy("bucket").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("main")).select(
        "bucket", F.col("main.label").alias("main"), F.expr(f"(size + {BLOCK - 1}) DIV {BLOCK}").alias("n_all"),
        F.expr(f"(size - main.c + {BLOCK - 1}) DIV {BLOCK}").alias("n_minor"),
    )
    rows = members.join(shape, "bucket").withColumn("minor", F.col("label") != F.col("main"))
    slim = "bucket", "node", "label", "minor", "n", "u"
    every = rows.select(
        *slim, F.lit(False).alias("asks"), F.pmod(F.xxhash64("node"), "n_all").alias("y"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_minor") - 1)).alias("x"),
    )
    asks = rows.filter("minor").select(
        *slim, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1)).alias("y"),
        F.pmod(F.xxhash64("node", F.lit("x")), "n_minor").alias("x"),
    )
    blocks = every.unionByName(asks).join(sets.select("node", "members", "bands"), "node")

    def run(table: pa.Table) -> pa.Table:
        asking = np.array(table.column("asks"))
        left, right = table.filter(pa.array(asking)), table.filter(pa.array(~asking))
        bucket = np.int64(table.column("bucket")[0].as_py())
        found = []
        if left.num_rows and right.num_rows:
            nodes, labels = np.array(right.column("node")), np.array(right.column("label"))
            n, minor = np.array(right.column("n")), np.array(right.column("minor"))
            most = n - np.array(right.column("u"))
            bands = np.stack([np.frombuffer(x.as_buffer(), "<i8") for x in right.column("bands")])
            members = [np.frombuffer(x.as_buffer(), "<u8") for x in right.column("members")]
            for row in left.to_pylist():
                mine, bound = np.frombuffer(row["bands"], "<i8"), np.minimum(most, row["n"] - row["u"])
                same = bands == mine
                good = (labels != row["label"]) & (mine[same.argmax(axis=1)] == bucket) & ~(minor & (nodes < row["node"]))
                good &= 100 * bound >= settings.percent * (n + row["n"] - bound)
                where = np.flatnonzero(good)
                if not len(where):
                    continue
                own = np.frombuffer(row["members"], "<u8")
                others = np.concatenate([members[i] for i in where])
                hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
                starts = np.concatenate([[0], np.cumsum(n[where])[:-1]])
                shared = np.add.reduceat(hit.astype(np.int64), starts)
                linked = 100 * shared >= settings.percent * (n[where] + len(own) - shared)
                found += [(row["node"], int(nodes[i])) for i in where[linked]]
        return pa.table(
            {"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())}
        )

    return blocks.groupBy("bucket", "x", "y").applyInArrow(run, "a long, b long")


def op4_near(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
