"""Log, status, metric and correction events. All of these also work on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.scoring import progress_message, progress_percent, seconds_between

# States a job does not leave any more.
TERMINAL = ("completed", "failed", "cancelled")


def replay(events: DataFrame, job: int, last_id: int, seq: str = "event_id") -> DataFrame:
    """Events of one job from ``last_id`` on: what a reconnecting reader has not seen."""
    return events.filter((F.col("job_id") == job) & (F.col(seq) >= last_id))


def job_status(events: DataFrame, seq: str = "event_id") -> DataFrame:
    """Current state per job: the first terminal one if any, else the latest."""
    final = F.col("status").isin(*TERMINAL)
    return (
        events.groupBy("job_id")
        .agg(
            F.min_by("status", F.when(final, F.col(seq))).alias("_final"),
            F.max_by("status", seq).alias("_latest"),
            F.max(seq).alias("last_event"),
            F.count(F.lit(1)).alias("events"),
        )
        .select(
            "job_id", F.coalesce("_final", "_latest").alias("status"), "last_event", "events"
        )
    )


def job_durations(events: DataFrame, ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """Seconds from a job's first running event to its first terminal one; null while open."""
    status = F.col("status")
    return (
        events.groupBy("job_id")
        .agg(
            F.min_by(ts, F.when(status == "running", F.col(seq))).alias("started"),
            F.min_by(ts, F.when(status.isin(*TERMINAL), F.col(seq))).alias("ended"),
        )
        .select("job_id", seconds_between(F.col("started"), F.col("ended")).alias("seconds"))
    )


def metric_progress(metrics: DataFrame) -> DataFrame:
    """Metric rows with ``percent`` and the one-line ``message``."""
    step, most = F.col("step"), F.col("max_steps")
    return metrics.withColumn("percent", progress_percent(step, most)).withColumn(
        "message", progress_message(step, most, F.col("loss"), F.col("learning_rate"))
    )


def latest_metric(metrics: DataFrame, run: str = "run_id") -> DataFrame:
    """The metric row with the highest step per run."""
    names = [c for c in metrics.columns if c not in (run, "step")]
    return (
        metrics.groupBy(run)
        .agg(F.max("step").alias("step"), F.max_by(F.struct(*names), "step").alias("_m"))
        .select(run, "step", "_m.*")
    )


def correction_progress(events: DataFrame) -> DataFrame:
    """Per correction run: progress messages so far, how many are expected, whether it is done."""
    kind = F.col("type")
    return events.groupBy("run_id").agg(
        F.count_if(kind == "progress").alias("progressed"),
        F.max("total").alias("total"),
        (F.count_if(kind == "complete") > 0).alias("done"),
    )


def status_parts(events: DataFrame, seq: str = "event_id") -> DataFrame:
    """Rows of :func:`job_status` that can be merged: first terminal and latest state with their places."""
    state = F.struct(F.col(seq).alias("seq"), "status")
    final = F.col("status").isin(*TERMINAL)
    return events.groupBy("job_id").agg(
        F.min(F.when(final, state)).alias("final"), F.max(state).alias("latest"), F.count(F.lit(1)).alias("events")
    )


def merged_status(parts: DataFrame) -> DataFrame:
    return parts.groupBy("job_id").agg(
        F.min("final").alias("final"), F.max("latest").alias("latest"), F.sum("events").alias("events")
    )


def status_of(parts: DataFrame) -> DataFrame:
    return parts.select(
        "job_id", F.coalesce("final.status", "latest.status").alias("status"),
        F.col("latest.seq").alias("last_event"), "events",
    )


def metric_parts(metrics: DataFrame, run: str = "run_id") -> DataFrame:
    """The row with the highest step per run as one struct, steps first, which a maximum merges."""
    names = [c for c in metrics.columns if c not in (run, "step")]
    return metrics.groupBy(run).agg(F.max(F.struct("step", *names)).alias("m"))


def merged_metrics(parts: DataFrame, run: str = "run_id") -> DataFrame:
    return parts.groupBy(run).agg(F.max("m").alias("m"))


def metric_of(parts: DataFrame, run: str = "run_id") -> DataFrame:
    return parts.select(run, "m.*")


def merged_corrections(parts: DataFrame) -> DataFrame:
    """Merged rows of :func:`correction_progress`."""
    return parts.groupBy("run_id").agg(
        F.sum("progressed").alias("progressed"), F.max("total").alias("total"), F.max("done").alias("done")
    )
