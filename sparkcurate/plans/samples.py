"""Jobs on samples: filter, profile, extract, import, generate, try out, prepare for training."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcurate.config import SIMPLE_SPLIT, FieldMapping, Rules, SftConfig, SplitRatios, Task
from sparkcurate.functions.prompts import render
from sparkcurate.functions.sft import chat_text, training_text
from sparkcurate.functions.text import strip
from sparkcurate.functions.validation import detailed_flags, quality_label, rule_issues
from sparkcurate.operators import ranking, stats
from sparkcurate.operators.attempts import best_attempt, missing_items
from sparkcurate.operators.completion import CompleteFn, complete, complete_with_retry
from sparkcurate.operators.filtering import funnel, judge_samples, rejections, with_decision

# Column names looked for, in this order, when a dataset is imported.
INSTRUCTION_NAMES = ("instruction", "input", "question", "prompt")
OUTPUT_NAMES = ("output", "response", "answer", "completion")


@dataclass(frozen=True)
class FilterResult:
    """Decided samples. ``kept`` and ``rejected`` are two filters over the same rows."""

    decided: DataFrame
    columns: tuple[str, ...]
    malformed: str | None = None

    @property
    def kept(self) -> DataFrame:
        return self.decided.filter("keep").select(*self.columns, "healed", "heal_methods")

    @property
    def rejected(self) -> DataFrame:
        return self.decided.filter("not keep").select(
            *self.columns, "healed", "heal_methods", "issues"
        )

    @property
    def stats(self) -> DataFrame:
        return funnel(self.decided, self.malformed)

    def stats_by(self, *by: str) -> DataFrame:
        return funnel(self.decided, self.malformed, by)

    def first_rejections(self, order: str, n: int = 5) -> DataFrame:
        return rejections(self.decided, order, n)


def filter_samples(
    df: DataFrame,
    rules: Rules = Rules(),
    strict: bool = True,
    heal: bool = True,
    output_col: str = "output",
    malformed: str | None = None,
) -> FilterResult:
    """Heal samples with broken tags, check every sample, and keep the good ones.

    One pass over the rows. To use more than one of ``kept``, ``rejected`` and ``stats`` on
    large data, store ``decided`` first (``session.materialise``) and wrap it again.
    """
    judged = judge_samples(df, rules, heal, output_col)
    decided = with_decision(judged, strict, malformed)
    own = tuple(c for c in df.columns if c not in ("healed", "heal_methods", malformed))
    return FilterResult(decided, own, malformed)


def profile(df: DataFrame, topics: Sequence[str] = (), k: int = 10) -> tuple[DataFrame, DataFrame | None]:
    """Statistics row, and the ``k`` most frequent topics when topics are given."""
    return stats.profile(df), stats.topic_counts(df, topics, k) if topics else None


def extract(df: DataFrame, mapping: FieldMapping, n: int | None = None, order: str | None = None) -> DataFrame:
    """Questions and answers under their common names, with the metadata columns as text.

    Metadata the source does not have becomes ``''``. ``n`` keeps the first rows by ``order``.
    """
    if n is not None:
        df = df.orderBy(order).limit(n) if order else df.limit(n)
    return df.select(
        F.col(mapping.question).alias("question"),
        F.col(mapping.answer).alias("answer"),
        *[
            F.coalesce(F.col(m).cast("string"), F.lit("")).alias(m) if m in df.columns
            else F.lit("").alias(m)
            for m in mapping.metadata
        ],
    )


def auto_map(df: DataFrame, source: str) -> DataFrame:
    """Samples from a dataset with unknown column names; rows with a blank question are dropped."""
    question = next((c for c in INSTRUCTION_NAMES if c in df.columns), None)
    question = question or ("text" if "text" in df.columns else None)
    if question is None:
        raise ValueError(f"no question column among {sorted(df.columns)}")
    answer = next((c for c in OUTPUT_NAMES if c in df.columns), None)
    text = F.coalesce(F.col(question).cast("string"), F.lit(""))
    return df.filter(F.length(strip(text)) > 0).select(
        text.alias("instruction"),
        (F.coalesce(F.col(answer).cast("string"), F.lit("")) if answer else F.lit("")).alias("output"),
        F.lit(source).alias("source"),
        F.lit(True).alias("is_valid"),
    )


def task_prompts(items: DataFrame, task: Task) -> DataFrame:
    """``system_prompt`` and ``user_prompt`` for items with ``question`` and ``answer``."""
    return items.withColumn("system_prompt", F.lit(task.system_prompt)).withColumn(
        "user_prompt",
        render(task.user_template, question=F.col("question"), answer=F.col("answer")),
    )


def generate(
    items: DataFrame,
    complete_fn: CompleteFn,
    task: Task,
    key: str,
    done: DataFrame | None = None,
    **calls,
) -> DataFrame:
    """Attempts for every item, repeated until the task's rules are met.

    ``done`` holds results of an earlier run; their items are not asked again.
    """
    todo = items if done is None else missing_items(items, done, key)
    return complete_with_retry(
        task_prompts(todo, task).select(key, "question", "system_prompt", "user_prompt"),
        complete_fn,
        lambda output: F.size(rule_issues(output, task.rules)) == 0,
        task.max_retries,
        **calls,
    )


def generated_samples(attempts: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """The samples a generation run writes: question, best output, whether it was valid."""
    best = best_attempt(attempts, key)
    return items.select(key, F.col("question").alias("instruction")).join(best, key).select(
        key, "instruction", "output", "valid"
    )


def trial_run(items: DataFrame, complete_fn: CompleteFn, task: Task, key: str, n: int = 5) -> DataFrame:
    """One completion for the first ``n`` items, with detailed flags and a quality label.

    Above a few items the prompts are asked where the items are, and the rows are in no order.
    """
    first = task_prompts(ranking.first_rows(items, key, n), task)
    asked = complete(first.select(key, "question", "system_prompt", "user_prompt"), complete_fn)
    given = F.coalesce(F.length("output"), F.lit(0)) > 0
    return asked.withColumn(
        "flags", F.when(given, detailed_flags(F.col("output"), task.rules))
    ).withColumn("quality", quality_label(F.col("flags"), task.rules))


def format_sft(df: DataFrame, config: SftConfig) -> DataFrame:
    """Add the training ``text`` a dataset configuration describes."""
    return df.withColumn("text", training_text(config, df.columns))


def chat_format(df: DataFrame) -> DataFrame:
    """Add the training ``text`` as chat turns."""
    return df.withColumn("text", chat_text(F.col("instruction"), F.col("output")))


def prepare_sft(df: DataFrame, key: str, config: SftConfig | None = None) -> DataFrame:
    """Training texts with their ``split``; without a configuration chat turns and 80/10/10."""
    if config is None:
        return ranking.split(chat_format(df), key, SIMPLE_SPLIT)
    return ranking.split(format_sft(df, config), key, config.split)


def held_out(df: DataFrame, key: str, ratios: SplitRatios) -> DataFrame:
    """Just the held-out part of a split: the test rows, or the validation rows without any."""
    part = "test" if ratios.test > 0 else "validation"
    return ranking.split(df, key, ratios).filter(F.col("split") == part).drop("split")
