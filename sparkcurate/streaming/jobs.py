"""Streaming jobs. The operators are the batch ones; only source, sink and trigger differ.

Nothing here depends on event time: a sample is judged on its own, and the state of a job is
one row per job that later events update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from sparkcurate.config import Rules
from sparkcurate.operators import events as E
from sparkcurate.operators.filtering import judge_samples, with_decision
from sparkcurate.sources.readers import SAMPLE_SCHEMA, parse_lines
from sparkcurate.streaming.store import Fold, RunStore


def read_sample_stream(
    spark: SparkSession, folder: str, schema: str = SAMPLE_SCHEMA, files_per_batch: int | None = None
) -> DataFrame:
    """Samples from JSON-lines files as they arrive in a folder, with ``malformed``."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_lines(reader.text(folder), schema)


def stream_filter(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    rules: Rules = Rules(),
    strict: bool = True,
    heal: bool = True,
    available_now: bool = True,
    schema: str = SAMPLE_SCHEMA,
) -> StreamingQuery:
    """Heal and check new files and append the kept samples to ``out`` as JSON lines.

    ``schema`` names the fields of a sample, all of which are written: PAPER_SAMPLE_SCHEMA for
    samples that name their paper.
    The checkpoint remembers which files were done, so a restart goes on where it stopped.
    """
    samples = read_sample_stream(spark, folder, schema).drop("healed", "heal_methods")
    decided = with_decision(judge_samples(samples, rules, heal), strict, "malformed")
    fields = [c for c in samples.columns if c != "malformed"]
    kept = decided.filter("keep").select(*fields, "healed", "heal_methods")
    writer = (
        kept.writeStream.format("json").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


#: What the streams below keep per key.
JOB_STATUS = Fold(E.status_parts, E.merged_status, E.status_of, lambda: F.col("final").isNotNull())
LATEST_METRIC = Fold(E.metric_parts, E.merged_metrics, E.metric_of)
CORRECTIONS = Fold(E.correction_progress, E.merged_corrections, lambda rows: rows, lambda: F.col("done"))


def stream_fold(
    events: DataFrame, fold: Fold, out: str, checkpoint: str, available_now: bool = True, fan: int = 8
) -> StreamingQuery:
    """Keep the state of every key in the runs under ``out``; :func:`current` reads it.

    Events may come late and in any order. The checkpoint remembers what was read; a batch that is repeated
    after a failure is not counted twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        RunStore(batch.sparkSession, out, fold, fan).add(batch, batch_id)

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, out: str, fold: Fold) -> DataFrame | None:
    """State of all keys, one row each; None before the first batch."""
    return RunStore(spark, out, fold).current()


def stream_job_status(events: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the current state of every job; see :func:`stream_fold`."""
    return stream_fold(events, JOB_STATUS, out, checkpoint, available_now)


def current_status(spark: SparkSession, out: str) -> DataFrame:
    """The latest stored state per job."""
    return current(spark, out, JOB_STATUS)


def stream_latest_metric(metrics: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the metric row with the highest step of every run; see :func:`stream_fold`."""
    return stream_fold(metrics, LATEST_METRIC, out, checkpoint, available_now)


def stream_correction_progress(
    events: DataFrame, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Keep the progress of every correction run; see :func:`stream_fold`."""
    return stream_fold(events, CORRECTIONS, out, checkpoint, available_now)


def _bucket(job, buckets: int):
    return F.pmod(F.xxhash64(job), F.lit(buckets)).cast("int")


def stream_event_log(
    events: DataFrame, log: str, checkpoint: str, available_now: bool = True, buckets: int = 64
) -> StreamingQuery:
    """Append all events to ``log``, by buckets of their job, so that the replay of a job reads one of them."""
    writer = (
        events.withColumn("bucket", _bucket("job_id", buckets)).writeStream.format("parquet")
        .partitionBy("bucket").option("checkpointLocation", checkpoint).option("path", log)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replay_stream(
    spark: SparkSession, log: str, schema: StructType | str, job: int, last_id: int, buckets: int = 64
) -> DataFrame:
    """What a reader that has seen everything before ``last_id`` gets: stored events of the job, then new ones.

    A stream; its checkpoint is the reader's place, so a reader that comes back with it goes on where it stopped,
    late files included. ``schema`` is that of the events.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    # The column has the job's own type, so that its hash is that of the log's.
    kind = schema["job_id"].dataType
    bucket = spark.range(1).select(_bucket(F.lit(job).cast(kind), buckets)).first()[0]
    # The whole log, because only there is it known which files were committed; the bucket's are read.
    stored = spark.readStream.schema(StructType([*schema.fields]).add("bucket", IntegerType())).parquet(log)
    return E.replay(stored.filter(F.col("bucket") == bucket).drop("bucket"), job, last_id)
