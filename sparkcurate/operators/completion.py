"""Calling a user-supplied completion function over a table of prompts.

The function runs in Python workers on Arrow batches; everything around it (deciding whether a
reply is good, choosing what is asked again, parsing) stays in Spark expressions. Every round
is stored in a ledger before the next begins, so neither a lost executor nor, where the ledger has a folder of its
own, a lost driver repeats calls of rounds that were answered.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcurate.session import application_folder, exists, materialise

# complete_fn(system_prompts, user_prompts) -> one reply per prompt: text, None, or a mapping
# with "text" and the optional token counts.
CompleteFn = Callable[[Sequence[str], Sequence[str]], Sequence[Any]]

REPLY = (
    "output string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, "
    "seconds double, error string"
)


def complete(
    prompts: DataFrame, complete_fn: CompleteFn, batch_size: int = 16, partitions: int | None = None
) -> DataFrame:
    """Add the reply columns to a table with ``system_prompt`` and ``user_prompt``.

    A call that raises, or gives another number of replies than it got prompts, gives no output and its
    message in ``error``. ``partitions`` spreads
    slow calls over more tasks than the data alone would need.
    """
    if partitions:
        prompts = prompts.repartition(partitions)
    fields = T.StructType(prompts.schema.fields + T._parse_datatype_string(REPLY).fields)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size].copy()
                systems, users = part["system_prompt"].tolist(), part["user_prompt"].tolist()
                began, error = time.monotonic(), None
                try:
                    replies = list(complete_fn(systems, users))
                    if len(replies) != len(part):  # nobody knows which reply is whose
                        raise ValueError(f"{len(replies)} replies to {len(part)} prompts")
                except Exception as exc:  # a failed call is data, not a failed job
                    replies, error = [None] * len(part), str(exc)
                took = (time.monotonic() - began) / max(1, len(part))
                rows = [r if isinstance(r, dict) else {"text": r} for r in replies]
                part["output"] = pd.Series([r.get("text") for r in rows], part.index, dtype=object)
                for name in ("prompt_tokens", "completion_tokens", "total_tokens"):
                    part[name] = pd.array([r.get(name) for r in rows], dtype="Int64")
                part["seconds"] = took
                part["error"] = pd.Series([error] * len(part), part.index, dtype=object)
                yield part

    return prompts.mapInPandas(call, fields)


def prompt_hash() -> Column:
    """What a call is known by: a hash of both prompts."""
    return F.sha2(F.to_json(F.struct("system_prompt", "user_prompt"), {"ignoreNullFields": "false"}), 256)


def complete_with_retry(
    prompts: DataFrame,
    complete_fn: CompleteFn,
    accept: Callable[[Column], Column],
    max_attempts: int = 3,
    batch_size: int = 16,
    partitions: int | None = None,
    ledger: str | None = None,
    parts: int = 1,
) -> DataFrame:
    """Attempts table: the prompt columns, ``attempt``, the reply columns and ``valid``.

    ``accept`` says as a Column whether an output is good. Rows without a good output are
    asked again, up to ``max_attempts`` times in all. Rows with the same prompts are asked once and share the reply.

    Replies go to a ledger by the hash of their prompt; it holds no prompt. The prompts are made once and stored
    beside the application's other intermediate tables. With a ``ledger`` folder of your own a
    run whose driver was lost goes on where it stopped: every attempt is stored in ``parts`` parts, and a part that
    is there is not asked for again. A ledger belongs to one table of prompts.
    """
    spark = prompts.sparkSession
    ledger = ledger or f"{application_folder(spark)}/ledger-{uuid.uuid4().hex}"
    # Made once: every round and the attempts read them again. Rows are known by their places, of which a few that are
    # to be left out or asked again go to the tasks where the prompts are; the prompts are not moved for that.
    keyed = prompts.withColumn("_hash", prompt_hash()).withColumn("_row", F.monotonically_increasing_id())
    keyed = materialise(keyed, "prompts")
    firsts = keyed.groupBy("_hash").agg(F.min("_row").alias("_row"), F.count(F.lit(1)).alias("_n"))
    twice = firsts.filter("_n > 1").select("_hash", F.col("_row").alias("_first"))
    again = keyed.select("_hash", "_row").join(twice, "_hash").filter("_row > _first").select("_row")
    asked_for = keyed.select("_hash", "_row", "system_prompt", "user_prompt").join(
        materialise(again, "repeated"), "_row", "left_anti"
    )
    tables: list[DataFrame] = []
    for attempt in range(1, max_attempts + 1):
        pending = asked_for
        if tables:
            failed = tables[-1].filter(~F.col("valid")).select("_hash")
            failed = materialise(firsts.join(failed, "_hash", "left_semi").select("_row"), "failed")
            if failed.isEmpty():
                break
            pending = asked_for.join(failed, "_row", "left_semi")
        for part in range(parts):
            folder = f"{ledger}/attempt={attempt}/part={part}"
            if exists(spark, f"{folder}/_SUCCESS"):
                continue
            own = pending.filter(F.pmod(F.xxhash64("_hash"), F.lit(parts)) == part).drop("_row")
            replies = complete(own, complete_fn, batch_size, partitions)
            good = F.coalesce(accept(F.col("output")), F.lit(False)) & (
                F.coalesce(F.length("output"), F.lit(0)) > 0
            )
            replies.withColumn("valid", good).drop("system_prompt", "user_prompt").write.mode("overwrite").option(
                "compression", "zstd"
            ).parquet(folder)
        schema = T.StructType([T.StructField("_hash", T.StringType())])
        schema = T.StructType(schema.fields + T._parse_datatype_string(REPLY + ", valid boolean").fields)
        done = spark.read.schema(schema).parquet(*[f"{ledger}/attempt={attempt}/part={i}" for i in range(parts)])
        tables.append(done.withColumn("attempt", F.lit(attempt)))
    attempts = tables[0]
    for table in tables[1:]:
        attempts = attempts.unionByName(table)
    names = [f.name for f in T._parse_datatype_string(REPLY).fields]
    return keyed.join(attempts, "_hash").select(*prompts.columns, *names, "attempt", "valid")
