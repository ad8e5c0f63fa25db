"""The attempts table of a generation or evaluation: choosing results and summing usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.numbers import rounded
from sparkcurate.functions.scoring import should_retry
from sparkcurate.operators.ranking import running_totals


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """Per item the first valid attempt, else the last one with an output; neither: no row.

    Columns: key, attempt, output, valid, attempts_used. One aggregate; every task sends at
    most one candidate of each kind per item.
    """
    given = F.coalesce(F.length("output"), F.lit(0)) > 0
    valid = F.coalesce(F.col("valid"), F.lit(False)) & given
    row = F.struct("attempt", "output")
    return (
        attempts.groupBy(key)
        .agg(
            F.min(F.when(valid, row)).alias("_valid"),
            F.max(F.when(given, row)).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
        .filter(F.col("_last").isNotNull())
        .select(
            key,
            F.coalesce("_valid.attempt", "_last.attempt").alias("attempt"),
            F.coalesce("_valid.output", "_last.output").alias("output"),
            F.col("_valid").isNotNull().alias("valid"),
            F.coalesce("_valid.attempt", "_n").cast("bigint").alias("attempts_used"),
        )
    )


def generation_summary(attempts: DataFrame, key: str) -> DataFrame:
    """One row: processed, valid, invalid_kept, skipped, total_retries, valid_pct.

    Attempts count up to the first valid one; every attempt but an item's first is a retry.
    """
    given = F.coalesce(F.length("output"), F.lit(0)) > 0
    valid = F.coalesce(F.col("valid"), F.lit(False)) & given
    items = attempts.groupBy(key).agg(
        F.min(F.when(valid, F.col("attempt"))).alias("first_valid"),
        F.count_if(given).alias("given"),
        F.count(F.lit(1)).alias("n"),
    )
    used = F.coalesce("first_valid", "n")
    done, good = F.count_if(F.col("given") > 0), F.count_if(F.col("first_valid").isNotNull())
    return items.agg(
        done.alias("processed"),
        good.alias("valid"),
        (done - good).alias("invalid_kept"),
        F.count_if(F.col("given") == 0).alias("skipped"),
        F.sum(used - 1).cast("bigint").alias("total_retries"),
        F.when(done > 0, rounded(100 * good / done)).otherwise(F.lit(0.0)).alias("valid_pct"),
    )


def usage(attempts: DataFrame) -> DataFrame:
    """One row: token sums, requests, whole-number average per request."""
    prompt, completion = F.col("prompt_tokens"), F.col("completion_tokens")
    total = F.coalesce(F.sum("total_tokens"), F.lit(0))
    answered = F.count_if(F.coalesce(prompt, completion, F.col("total_tokens")).isNotNull())
    return attempts.agg(
        answered.alias("request_count"),
        F.coalesce(F.sum(prompt), F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce(F.sum(completion), F.lit(0)).cast("bigint").alias("completion_tokens"),
        total.cast("bigint").alias("total_tokens"),
        F.when(answered > 0, F.floor(total / answered))
        .otherwise(F.lit(0)).cast("bigint").alias("avg_tokens"),
    )


def progress(best: DataFrame, key: str, every: int = 25) -> DataFrame:
    """Running share of valid results after every ``every`` processed items, in key order."""
    totals = running_totals(
        best.select(key, "valid"), [key], {"processed": F.lit(1), "valid_so_far": F.col("valid")}
    )
    return totals.filter(F.col("processed") % every == 0).select(
        "processed", "valid_so_far",
        rounded(100 * F.col("valid_so_far") / F.col("processed")).alias("valid_pct"),
    )


def missing_items(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a result yet: what a resumed run has to do."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def missing_items_by_position(items: DataFrame, done_rows: int, position: str) -> DataFrame:
    """The positional form of resuming: skip as many items as there are written rows.

    Skipped items write no row, so this repeats some work after failures; kept for parity.
    """
    return items.filter(F.col(position) > done_rows)


def final_evaluation(
    attempts: DataFrame, key: str, retries: int = 2, scores: Column | None = None
) -> DataFrame:
    """Per question the first attempt that needs no retry, else the last allowed one."""
    scores = F.col("scores") if scores is None else scores
    allowed = attempts.filter(F.col("attempt") <= retries + 1)
    again = should_retry(F.col("skipped"), F.col("reason"), scores, F.col("overall_score"))
    row = F.struct("attempt", *[c for c in attempts.columns if c not in (key, "attempt")])
    return (
        allowed.groupBy(key)
        .agg(
            F.min_by(row, F.when(~again, F.col("attempt"))).alias("_good"),
            F.max_by(row, "attempt").alias("_last"),
        )
        .select(key, F.coalesce("_good", "_last").alias("_row"))
        .select(key, "_row.*")
    )
