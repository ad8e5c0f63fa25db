"""Scores of an n-gram language model, walked as a weighted automaton with failure arcs.

The model. States are the histories seen in training, from the empty one up. From the state of a
history h there is an arc for every token w seen after it, with the weight log10 p(w | h), and a
failure arc to the state of the shorter history with the weight log10(m / (c(h) + m)):

    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m),  p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

with counts c of training tokens, h' being h without its first token. A token that is not found
takes failure arcs until it is; so the weights on the way add up to m / (c(h) + m) p(w | h'), which
the first formula gives for c(h w) = 0. Histories of no state are passed over at no cost.

The work. The counts of all n-grams of all training texts are needed by every text, and neither fits
a machine. Texts are tokenised once into blocks of whole documents, each with its own small vocabulary.
A block sends its distinct n-grams, as sorted 64-bit hashes with its own counts, to buckets by
hash; a bucket adds up what all blocks send and answers every block with the totals, in the order
asked. Then each block has the part of the automaton that its documents can visit, and walks them.
An n-gram goes to a bucket once per block, however frequent it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.common import arrow_type, chain, crc_mod, lower_words, mix, slices
from sparkcurate.session import materialise

END_HASH = np.uint64(0x9AE16A3B2F90404F)
START_HASH = np.uint64(0xC949D7C7509E6557)


@dataclass(frozen=True)
class Settings:
    """``strength`` is m above. Blocks and buckets bound the memory of a task, not the data."""

    order: int = 3
    strength: float = 2.0
    block_tokens: int = 2_000_000
    bucket_entries: int = 1_500_000


def pack(values: np.ndarray, ascending: bool) -> bytes:
    """64-bit integers, as differences if ascending, byte plane by byte plane, compressed."""
    values = values.astype("<u8")
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, ascending: bool) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).view("<u8").reshape(n)
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def _blocks(docs: DataFrame, settings: Settings) -> DataFrame:
    """Blocks of whole documents: tokens as numbers of the block's own vocabulary, 0 being the end."""
    kind = arrow_type(docs, "key")
    schema = f"""block long, n_docs long, n_train long, n_tokens long, keys array<{kind}>, train binary,
        lengths binary, tokens binary, vocabulary binary"""

    def run(batches) -> Iterator[pa.RecordBatch]:
        place, number = TaskContext.get().partitionId(), 0
        table: dict = {None: 0}
        keys, train, parts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            words = iter(table)
            next(words)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(table) - 1)
            tokens = np.concatenate(parts)
            row = {
                "block": place << 32 | number, "n_docs": len(keys), "n_train": sum(train), "n_tokens": size,
                "keys": keys, "train": bytes(train), "lengths": np.array([len(p) for p in parts], "<u4").tobytes(),
                "tokens": pack(tokens, False), "vocabulary": np.append(END_HASH, hashes).astype("<u8").tobytes(),
            }
            columns = [pa.array([row["keys"]], pa.list_(key_type)) if n == "keys" else pa.array([v]) for n, v in row.items()]
            return pa.RecordBatch.from_arrays(columns, list(row))

        for batch in batches:
            key_type = batch.schema.field("key").type
            for part in slices(batch):
                for key, text, learn in zip(*[part.column(c).to_pylist() for c in ("key", "text", "train")]):
                    ids = [table.setdefault(w, len(table)) for w in lower_words(text)]
                    ids.append(0)
                    keys.append(key)
                    train.append(learn)
                    parts.append(np.array(ids, np.uint32))
                    size += len(ids)
                    if size >= settings.block_tokens:
                        yield block()
                        number += 1
                        table = {None: 0}
                        keys, train, parts, size = [], [], [], 0
        if keys:
            yield block()

    return docs.select("key", "text", "train").mapInArrow(run, schema)


class Block:
    """A block's tokens, and the hashes of the n-grams that end at each of them."""

    def __init__(self, row: dict, order: int):
        self.keys = row["keys"]
        self.train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        tokens = vocabulary[unpack(row["tokens"], False).astype(np.int64)]
        self.place = np.arange(len(tokens)) - np.repeat(self.starts, self.lengths)
        self.grams = [tokens]
        for k in range(2, order + 1):
            # The oldest token first: the hash of the n-gram one shorter ends at the same token.
            old = np.full(len(tokens), START_HASH)
            old[k - 1 :] = tokens[: -(k - 1)] if k > 1 else tokens
            old[self.place < k - 1] = START_HASH
            self.grams.append(chain(self.grams[-1], mix(old + np.uint64(k))))


def _ask(blocks: DataFrame, settings: Settings, bits: int) -> DataFrame:
    """The distinct n-grams of every block and how often its training documents have them, by bucket."""
    schema = "k int, bucket int, block long, hashes binary, counts binary"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, settings.order)
                learn = np.repeat(block.train, block.lengths)
                for k, grams in enumerate(block.grams, 1):
                    found, where = np.unique(grams, return_inverse=True)
                    counts = np.bincount(where, weights=learn, minlength=len(found)).astype(np.uint64)
                    cuts = np.searchsorted(found, _bounds(bits)).tolist() + [len(found)]
                    rows = [
                        (k, b, row["block"], pack(found[i:j], True), pack(counts[i:j], False))
                        for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(list(c), t)
                            for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))
                        ],
                        ["k", "bucket", "block", "hashes", "counts"],
                    )

    return blocks.mapInArrow(run, schema)


def _bounds(bits: int) -> np.ndarray:
    """The smallest hash of each of 2^bits buckets; buckets in order hold hashes in order."""
    return np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)


def _answer(asked: DataFrame) -> DataFrame:
    """Totals for every block's n-grams in the order asked; the first row of a bucket has its sums."""
    schema = "block long, k int, bucket int, totals binary, n_distinct long, n_all long"

    def run(table: pa.Table) -> pa.Table:
        hashes = [unpack(h.as_py(), True) for h in table.column("hashes")]
        counts = np.concatenate([unpack(c.as_py(), False) for c in table.column("counts")])
        _, where = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(where, weights=counts).astype(np.uint64)
        ends = np.cumsum([len(h) for h in hashes])
        packed = [pack(totals[w], False) for w in np.split(where, ends[:-1])]
        n = len(packed)
        first = lambda x: pa.array([int(x)] + [0] * (n - 1), pa.int64())
        return pa.table(
            {
                "block": table.column("block"), "k": table.column("k"), "bucket": table.column("bucket"),
                "totals": pa.array(packed, pa.binary()), "n_distinct": first((totals > 0).sum()),
                "n_all": first(totals.sum()),
            }
        )

    return asked.groupBy("k", "bucket").applyInArrow(run, schema)


def walk(block: Block, counts: list[np.ndarray], n: int, v: int, n_docs: int, strength: float) -> dict:
    """Log-probabilities of a block's documents: all their tokens take their arcs side by side.

    The state before a token is given by the tokens before it, so no token has to wait for
    another: in each step those that have not found an arc take the failure arc.
    """
    first = block.place == 0
    unigram = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
    probability, history = [unigram], [None]
    for k in range(2, len(counts) + 1):
        seen = np.empty(len(first), np.float64)
        seen[1:] = counts[k - 2][:-1]
        seen[first] = n_docs
        backed = (counts[k - 1] + strength * probability[-1]) / (seen + strength)
        probability.append(np.where(seen > 0, backed, probability[-1]))
        history.append(seen)
    score, open_ = np.zeros(len(first)), np.ones(len(first), bool)
    for k in range(len(counts), 0, -1):
        arc = open_ & (counts[k - 1] > 0) if k > 1 else open_
        score[arc] += np.log10(probability[k - 1][arc])
        open_ = open_ & ~arc
        if k > 1:
            fail = open_ & (history[k - 1] > 0)
            score[fail] += np.log10(strength / (history[k - 1][fail] + strength))
    add = lambda x: np.add.reduceat(x, block.starts)
    return {
        "n_tokens": block.lengths, "n_known": add((counts[0] > 0).astype(np.int64)),
        "base_score": add(np.log10(unigram)), "score": add(score),
    }


def score_texts(
    docs: DataFrame, train, key: str = "doc_id", text: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``train`` is a Column: the rows to learn from (null: not). A null or empty text is its end token
    alone. One row per input row; repeated rows are learned from and scored as often as they
    occur; a null key stays null; an empty table gives an empty result; other columns are not read.
    n-grams are told apart by 64-bit hashes.
    """
    slim = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    kind = arrow_type(docs, key)
    blocks = materialise(_blocks(slim, settings), "lm-blocks")
    size = blocks.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    n_tokens, n_docs = size[0] or 0, size[1] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, n_tokens / settings.bucket_entries)))))
    totals = materialise(_answer(_ask(blocks, settings, bits)), "lm-totals")
    sums = totals.filter("k = 1").agg(F.sum("n_all"), F.sum("n_distinct")).first()
    n, v = sums[0] or 0, sums[1] or 0

    def score(asked: pa.Table, answered: pa.Table) -> pa.Table:
        parts = []
        for row in asked.to_pylist():
            block, counts = Block(row, settings.order), []
            for k, grams in enumerate(block.grams, 1):
                mine = answered.filter(pc.equal(answered.column("k"), k)).sort_by("bucket")
                found = np.concatenate([unpack(t.as_py(), False) for t in mine.column("totals")])
                counts.append(found[np.unique(grams, return_inverse=True)[1]].astype(np.float64))
            columns = walk(block, counts, n, v, n_docs, settings.strength)
            key_type = asked.schema.field("keys").type.value_type
            parts.append(
                pa.table(
                    {
                        "key": pa.array(block.keys, key_type), "train": pa.array(block.train),
                        "n_tokens": pa.array(columns["n_tokens"], pa.int64()),
                        "n_known": pa.array(columns["n_known"], pa.int64()),
                        "base_score": pa.array(columns["base_score"], pa.float64()),
                        "score": pa.array(columns["score"], pa.float64()),
                    }
                )
            )
        return pa.concat_tables(parts)

    schema = f"key {kind}, train boolean, n_tokens long, n_known long, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, schema)
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).withColumnRenamed("key", key)


def op3_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_texts(docs, crc_mod("doc_id", 5) != 1)
    return scored.select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"),
    )


_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1),
   lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))),
   4294967295)"""

LM_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, ({_CRC}) % 5 = 1 AS held_out, coalesce(text, '') AS text FROM documents),
 split AS (SELECT r, held_out, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM docs),
 tokens AS (SELECT r, held_out, i, CASE WHEN i > 2 THEN w[i - 2] ELSE '<s> ' END AS g, CASE WHEN i > 1 THEN w[i - 1] ELSE '<s> ' END AS h,
   coalesce(w[i], '</s> ') AS t
   FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM split)),
 c1 AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t),
 c2 AS (SELECT h, t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY h, t),
 ch AS (SELECT h, sum(c) AS c FROM c2 GROUP BY h),
 c3 AS (SELECT g, h, t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY g, h, t),
 cg AS (SELECT g, h, sum(c) AS c FROM c3 GROUP BY g, h),
 n AS (SELECT coalesce(sum(c), 0)::DOUBLE AS n, count(*) AS v FROM c1),
 p AS (SELECT r, coalesce(c1.c, 0) AS c1, (coalesce(c1.c, 0) + 0.5) / (n.n + 0.5 * (v + 1)) AS p1, coalesce(c2.c, 0) AS c2,
    coalesce(ch.c, 0) AS ch, coalesce(c3.c, 0) AS c3, coalesce(cg.c, 0) AS cg
   FROM tokens LEFT JOIN c1 USING (t) LEFT JOIN c2 USING (h, t) LEFT JOIN ch USING (h) LEFT JOIN c3 USING (g, h, t) LEFT JOIN cg USING (g, h), n),
 q AS (SELECT *, CASE WHEN ch > 0 THEN (c2 + {Settings.strength} * p1) / (ch + {Settings.strength}) ELSE p1 END AS p2 FROM p)
SELECT doc_id, held_out, n_tokens, n_known, n::BIGINT AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score
FROM docs JOIN (SELECT r, count(*) AS n_tokens, count(*) FILTER (c1 > 0) AS n_known, sum(log10(p1)) AS base_score,
   sum(log10(CASE WHEN cg > 0 THEN (c3 + {Settings.strength} * p2) / (cg + {Settings.strength}) ELSE p2 END)) AS score
   FROM q GROUP BY r) USING (r), n
"""
