"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all labelled documents; the regression is fitted with
follow-the-regularised-leader (elastic net, per-coordinate steps) on a bounded sample of them,
and a temperature on the part of the sample that was held back makes its scores probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.common import arrow_type, crc_mod, map_texts
from sparkcurate.operators.ranking import top_per_key

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the rows that the regression sees, shared evenly among languages."""

    sample_rows: int = 6000
    bits: int = 16
    orders: tuple[int, ...] = (1, 2, 3)
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    calibration_share: float = 0.2


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: Settings


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or a blank where it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: str | None, settings: Settings) -> np.ndarray | None:
    """Hashed n-grams of the whole text with white space and the like as one blank; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.concatenate([[32], _letters()[points], [32]]).astype(np.uint32)
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 32) | (found[:-1] != 32)
    found = found[keep]
    if len(found) < 3:
        return None
    parts, h = [], found
    for n in range(1, max(settings.orders) + 1):
        if n > 1:
            if len(h) < 2:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ found[n - 1 :]
        if n in settings.orders:
            mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            parts.append((mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - settings.bits))
    return np.concatenate(parts)


def counts(text: str | None, settings: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets that occur and how often."""
    found = grams(text, settings)
    if found is None:
        return None
    if len(found) < 4000:
        return np.unique(found, return_counts=True)
    tally = np.bincount(found, minlength=1 << settings.bits)
    where = tally.nonzero()[0]
    return where, tally[where]


def _vector(where: np.ndarray, tally: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(tally)) * idf[where]
    return x / np.sqrt((x * x).sum())


def _frequencies(labelled: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the documents; every task sums before it sends."""
    size = 1 << settings.bits

    def run(batches):
        df, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                found = counts(text.as_py(), settings)
                if found is not None:
                    df[found[0]] += 1
                    n += 1
        where = df.nonzero()[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *where.tolist()], pa.int32()), pa.array([n, *df[where].tolist()], pa.int64())],
            ["bucket", "n"],
        )

    rows = labelled.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(size + 1, np.int64)  # the last place takes bucket -1, the number of documents
    for bucket, n in rows.collect():  # at most 2^bits + 1 rows
        df[bucket] = n
    return df[:-1], int(df[-1])


def _sample(labelled: DataFrame, settings: Settings) -> tuple[list[str], list[tuple]]:
    """The learned languages and (language number, buckets, counts) of a fixed sample, the same in every run."""
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return [], []
    each = max(1, settings.sample_rows // len(languages))
    mark = F.xxhash64(F.col("key").cast("string"), F.lit("sample"))
    # In two steps, so that a frequent language is not ordered by one task.
    marked = labelled.select("key", "lang", mark.alias("mark"))
    chosen = top_per_key(marked, "lang", [F.asc("mark"), F.asc("key")], each, "place").select("key").distinct()
    texts = labelled.join(chosen, "key", "left_semi").select("key", "lang", "text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [counts(t, settings) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("lang"),
                    pa.array([None if f is None else f[0].astype("<u4").tobytes() for f in found], pa.binary()),
                    pa.array([None if f is None else f[1].astype("<u4").tobytes() for f in found], pa.binary()),
                ],
                ["key", "lang", "where", "tally"],
            )

        return work

    schema = f"key {arrow_type(labelled, 'key')}, lang string, where binary, tally binary"
    rows = map_texts(texts, make, schema).filter(F.col("where").isNotNull()).collect()
    rows.sort(key=lambda r: (_spread(r["key"]), r["lang"]))
    number = {x: i for i, x in enumerate(languages)}
    return languages, [
        (number[r["lang"]], np.frombuffer(r["where"], "<u4"), np.frombuffer(r["tally"], "<u4")) for r in rows
    ]


def _spread(key) -> tuple:
    """An order of the sample that has nothing to do with that of the keys."""
    import zlib

    return zlib.crc32(f"order {key}".encode()), str(key)


def fit_ftrl(rows: list[tuple], n_languages: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, language) and bias by FTRL-proximal steps on (language, buckets, values)."""
    size = 1 << settings.bits
    z, n = np.zeros((size + 1, n_languages)), np.zeros((size + 1, n_languages))

    def weights(at) -> np.ndarray:
        small = np.abs(z[at]) <= settings.l1
        w = -(z[at] - np.sign(z[at]) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        return np.where(small, 0.0, w)

    for _ in range(settings.epochs):
        for language, where, x in rows:
            at = np.append(where, size)  # the last row is the bias
            x = np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[language] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(size + 1))
    return every[:-1], every[-1]


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss; golden-section search on its logarithm."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-300)).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    held_out: Column | None = None, settings: Settings = Settings(),
) -> Model | None:
    """A model from the rows with a text and a language that are not held out; None if there are none.

    Rows without a key are not learned from.
    """
    slim = docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"),
        (F.lit(False) if held_out is None else held_out).alias("out"),
    )
    labelled = slim.filter(
        F.col("key").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.col("out")
    )
    df, n = _frequencies(labelled, settings)
    languages, sample = _sample(labelled, settings)
    if not sample:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = [(language, where, _vector(where, tally, idf)) for language, where, tally in sample]
    cut = int(len(rows) * settings.calibration_share)
    weights, bias = fit_ftrl(rows[cut:], len(languages), settings)
    scores = np.array([x @ weights[where] + bias for _, where, x in rows[:cut]])
    temperature = fit_temperature(scores, np.array([r[0] for r in rows[:cut]], int))
    return Model(languages, idf, weights.astype(np.float32), bias, temperature, settings)


def predict(
    docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all) of every row with lang_pred and score, from the text alone.

    ``und`` with score 0 where the text is null, has no letter, or there is no model. One row per
    input row; repeated rows count each; columns lang_pred and score of the input are replaced.
    Ties go to the first language by name.
    """
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    read = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*rest, text])])
    schema = read.select(*[F.col(f"`{c}`") for c in rest]).schema.add("lang_pred", "string").add("score", "double")

    def make():
        def one(value: str | None) -> tuple[str, float]:
            found = counts(value, model.settings) if model else None
            if found is None:
                return UNKNOWN, 0.0
            x = _vector(*found, model.idf)
            p = _softmax((x @ model.weights[found[0]] + model.bias) / model.temperature)
            best = int(p.argmax())
            return model.languages[best], float(p[best])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [one(t) for t in batch.column(text).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in rest], pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                [*rest, "lang_pred", "score"],
            )

        return work

    return map_texts(read, make, schema, text)


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from learning; one without a key is not."""
    return F.coalesce(crc_mod(key, 4) == 2, F.lit(False))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all documents, learning from those not held out."""
    found = predict(docs, train(docs, held_out=held_out(), settings=settings), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_language(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
