"""Dataset statistics: each is one aggregate over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcurate.functions.numbers import rounded
from sparkcurate.functions.records import first_object, is_object, json_objects
from sparkcurate.functions.scoring import epoch_micros
from sparkcurate.functions.text import WHITESPACE, block, strip, truncated
from sparkcurate.operators.rows import settled


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _flag(df: DataFrame, names: Sequence[str], default: bool) -> Column:
    """The first of the columns that exists and is not null."""
    known = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*known, F.lit(default))


def _share(part: Column, whole: Column) -> Column:
    """Percent with one decimal, 0 for an empty table."""
    return F.when(whole > 0, rounded(100 * part / whole)).otherwise(F.lit(0.0))


def _whole_average(total: Column, n: Column) -> Column:
    return F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("bigint")


def profile(df: DataFrame) -> DataFrame:
    """One row: counts, whole-number average lengths, share of rows with LaTeX, healed rows.

    Reasoning and answer lengths are averaged over the rows that have the block.
    """
    output = _text(df, "output")
    rows = df.select(
        F.length(_text(df, "instruction")).alias("i"),
        F.length(output).alias("o"),
        F.length(block(output, "think")).alias("t"),
        F.length(block(output, "answer")).alias("a"),
        output.rlike(r"(?s)\$[^$]+\$|\\\[.*?\\\]").alias("x"),
        _flag(df, ["healed"], False).alias("h"),
    )
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("total_samples"),
        _whole_average(F.sum("i"), n).alias("avg_instruction_len"),
        _whole_average(F.sum("o"), n).alias("avg_output_len"),
        _whole_average(F.sum("t"), F.count("t")).alias("avg_think_len"),
        _whole_average(F.sum("a"), F.count("a")).alias("avg_answer_len"),
        _share(F.count_if("x"), n).alias("has_latex_pct"),
        F.count_if("h").alias("healed_count"),
    )


def topic_counts(df: DataFrame, topics: Sequence[str], k: int | None = None) -> DataFrame:
    """Rows whose instruction contains each topic keyword; topics without a row are left out.

    All topics are counted in one pass over the data. ``k`` keeps the most frequent ones,
    earlier listed topics first on ties.
    """
    low = df.select(F.lower(_text(df, "instruction")).alias("low"))
    counted = low.agg(
        *[F.count_if(F.contains("low", F.lit(t))).alias(f"_{i}") for i, t in enumerate(topics)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(t).alias("topic"), F.col(f"_{i}").alias("n"), F.lit(i).alias("i"))
            for i, t in enumerate(topics)
        ]
    )
    rows = counted.select(F.inline(entries)).filter("n > 0")
    if k is not None:
        rows = rows.orderBy(F.col("n").desc(), "i").limit(k)
    return rows.select("topic", "n")


def service_stats(df: DataFrame) -> DataFrame:
    """One row: total, valid, invalid, healed, average lengths to one decimal; zeros if empty."""
    n = F.count(F.lit(1))
    valid = F.count_if(_flag(df, ["valid"], True))

    def average(name: str) -> Column:
        return F.when(n > 0, rounded(F.sum(F.length(_text(df, name))) / n)).otherwise(F.lit(0.0))

    return df.agg(
        n.alias("total"),
        valid.alias("valid"),
        (n - valid).alias("invalid"),
        F.count_if(_flag(df, ["healed"], False)).alias("healed"),
        average("instruction").alias("avg_instruction_len"),
        average("output").alias("avg_output_len"),
    )


def result_counts(df: DataFrame, parity: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one per ``by``: size, valid, invalid, healed.

    The filter marks repaired rows ``healed``; with ``parity`` only ``was_healed`` is read.
    """
    n = F.count(F.lit(1))
    valid = F.count_if(_flag(df, ["is_valid", "valid"], True))
    healed = _flag(df, ["was_healed"] if parity else ["was_healed", "healed"], False)
    return df.groupBy(*by).agg(
        n.alias("actual_size"),
        valid.alias("valid_count"),
        (n - valid).alias("invalid_count"),
        F.count_if(healed).alias("healed_count"),
    )


def purity(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: percent of the non-blank lines that are well-formed samples.

    Well-formed: a JSON object whose trimmed instruction and output have ten characters or
    more each and differ. Lines that do not parse count in the denominator.
    """
    fields = "instruction string, output string"
    rows = lines.select(strip(F.col(value)).alias("_line")).filter(F.length("_line") > 0)
    rows = settled(rows, {"_o": json_objects(F.col("_line"), fields)})
    parsed = F.when(is_object(F.col("_o"), F.col("_line")), first_object(F.col("_o")))
    rows = rows.select(
        strip(F.coalesce(parsed["instruction"], F.lit(""))).alias("i"),
        strip(F.coalesce(parsed["output"], F.lit(""))).alias("o"),
    )
    good = (F.length("i") >= 10) & (F.length("o") >= 10) & (F.col("i") != F.col("o"))
    return rows.agg(
        F.coalesce(F.count_if(good) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100.0, F.lit(0.0))
        .alias("purity")
    )


def token_counts(df: DataFrame) -> DataFrame:
    """White-space separated, lower-cased words of instruction and output with their counts."""
    text = F.lower(F.concat(_text(df, "instruction"), F.lit(" "), _text(df, "output")))
    # One plain blank for every kind of white space, so that one split fits all of them.
    spaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return (
        df.select(F.explode(F.split(spaced, " +")).alias("token"))
        .filter("token <> ''")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def entropy(df: DataFrame) -> DataFrame:
    """One row: Shannon entropy of the words over its maximum; 0 for fewer than two words.

    With total T and counts c the entropy is log2(T) - sum(c * log2(c)) / T, so one pass over
    the word counts gives it without a second look at T.
    """
    sums = token_counts(df).agg(
        F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("w"),
        F.count(F.lit(1)).alias("v"),
    )
    value = (F.log2("t") - F.col("w") / F.col("t")) / F.log2("v")
    return sums.select(F.when(F.col("v") > 1, value).otherwise(F.lit(0.0)).alias("entropy"))


def preview(df: DataFrame, size: int = 500, answer_size: int = 300) -> DataFrame:
    """Display form of samples: cut texts with their full lengths."""
    think, answer = strip(block(F.col("output"), "think")), strip(block(F.col("output"), "answer"))
    return df.select(
        *[c for c in df.columns if c not in ("instruction", "output")],
        F.length("instruction").alias("instruction_chars"),
        truncated(F.col("instruction"), size).alias("instruction_preview"),
        F.length(think).alias("think_chars"),
        truncated(think, size).alias("think_preview"),
        F.length(answer).alias("answer_chars"),
        F.substring(answer, 1, answer_size).alias("answer_preview"),
    )


def energy(
    df: DataFrame, by: str, ts: str = "ts", watts: str = "watts", bucket_seconds: int = 3600
) -> DataFrame:
    """Energy (kWh, trapezoid rule), mean watts, seconds covered and samples per ``by``.

    Sums are taken inside fixed stretches of time and then over the joints between
    neighbouring stretches, so that a device with a third of all samples is spread over as
    many tasks as it has stretches. Samples at the same instant are ordered by their watts.
    """
    micros = epoch_micros(F.col(ts))
    rows = df.select(
        F.col(by), micros.alias("m"), F.col(watts).alias("w"),
        F.floor(micros / F.lit(bucket_seconds * 1_000_000)).alias("b"),
    )
    inside = Window.partitionBy(by, "b").orderBy("m", "w")
    area = (F.col("w") + F.lag("w").over(inside)) / 2 * (F.col("m") - F.lag("m").over(inside)) / 1e6
    stretches = (
        rows.withColumn("joules", area)
        .groupBy(by, "b")
        .agg(
            F.sum("joules").alias("joules"), F.sum("w").alias("w_sum"),
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("m", "w")).alias("first"), F.max(F.struct("m", "w")).alias("last"),
        )
    )
    along = Window.partitionBy(by).orderBy("b")
    before = F.lag("last").over(along)
    joint = (F.col("first.w") + before["w"]) / 2 * (F.col("first.m") - before["m"]) / 1e6
    return (
        stretches.withColumn("joint", joint)
        .groupBy(by)
        .agg(
            F.sum(F.coalesce("joules", F.lit(0.0)) + F.coalesce("joint", F.lit(0.0))).alias("j"),
            (F.sum("w_sum") / F.sum("n")).alias("avg_watts"),
            ((F.max("last.m") - F.min("first.m")) / 1e6).alias("duration_seconds"),
            F.sum("n").alias("samples"),
        )
        .select(
            by, (F.col("j") / 3.6e6).alias("kwh"), "avg_watts", "duration_seconds", "samples"
        )
    )
