"""The corpus pipeline: five operators of ``sparkcurate.llm`` from raw documents to token ids.

Every stage takes all that its predecessor kept, and all but the last return the columns of
documents. None needs a text, a key or a language: rows without one pass through what needs it, but
for texts without a letter, which have no language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm import bpe, language, leaks, lines, near
from sparkcurate.session import materialise

#: A document stays if the probability of its language is at least this.
LEAST_SCORE = 0.5


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents under names of their own, which no operator's columns can clash with, and their real names.

    The columns that stages read keep their names.
    """
    names = docs.columns
    return docs.toDF(*[n if n in _READ else f"_own_{i}" for i, n in enumerate(names)]), names


#: Columns that the stages read or set.
_READ = ("doc_id", "text", "lang", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; texts without letters and undecided ones go."""
    own, names = _apart(docs)
    found = language.predict(own, language.train(own))
    found = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*own.columns).toDF(*names)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; those of which nothing is left go."""
    own, names = _apart(docs)
    left = lines.dedup_lines(own)
    changed = F.col("removed_chars") > 0
    nothing = changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(changed, F.length("text").cast(own.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    left = left.filter(~F.coalesce(nothing, F.lit(False))).withColumn("n_chars", n_chars)
    return left.select(*own.columns).toDF(*names)


def _row_key() -> Column:
    """A text that tells rows apart by id and text and sorts by id, rows without an id last."""
    place = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(place, F.lit("none")), F.lit(":"), F.hex(F.xxhash64("text")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    A document goes by its id and its text, so another text under the same id stays. Rows without an
    id take part, after those that have one. Of rows that repeat id and text one stays, if the text has words.
    """
    own, names = _apart(docs)
    keyed = own.withColumn("_row", _row_key())
    found = near.near_duplicates(keyed, key="_row", settings=near.Settings(shingle=5))
    found = materialise(found.select("_row", "kept", "n_shingles"), "near-found")
    gone = found.filter(~F.col("kept")).select("_row").distinct()
    # As many may go as there are, so this side is never sent to all tasks.
    left = keyed.join(gone.hint("merge"), "_row", "left_anti")
    again = found.filter("kept AND n_shingles > 0").groupBy("_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = materialise(again.select("_row"), "near-repeated").hint("merge")
    if not again.isEmpty():
        one = left.join(again, "_row", "left_semi").dropDuplicates(["_row"])
        left = left.join(again, "_row", "left_anti").unionByName(one)
    return left.select(*own.columns).toDF(*names)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    own, names = _apart(docs)
    found = leaks.with_leaks(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("leaked_items") == 0).select(*own.columns).toDF(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document, and the bytes that they decode to as a checksum."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.encode_texts(docs, path, pattern, decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: SQL cannot express the stages; ``tests/llm`` holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
