"""Quality rules judged by host.

Every document is counted once, by built-in functions only. How often each rule fails is summed
by host; the rates are shrunk towards the rate of all documents by a beta prior that is itself
estimated from the hosts; a host whose shrunk rate is too high takes its documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.functions.binding import once
from sparkcurate.llm.common import NOT_SPACE, SPACE
from sparkcurate.operators.rows import settled
from sparkcurate.session import materialise

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rules by name: whether a document fails, from its counts.
RULES = {
    "base": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "lines": "n_dup_lines > 0 AND 100 * n_dup_lines > 30 * n_lines",
    "length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}


def _neighbours(a: Column, distance: int) -> Column:
    """Hashes of every element with the one ``distance`` places on."""
    rest = F.greatest(F.size(a) - distance, F.lit(0))
    return F.zip_with(
        F.slice(a, F.lit(1), rest), F.slice(a, F.lit(1 + distance), rest), lambda x, y: F.xxhash64(x, y)
    )


def _marks(words: Column) -> Column:
    """For every window a hash of its first two and last two words: equal for equal windows."""
    return once(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: once(_neighbours(h, 1), lambda pairs: _neighbours(pairs, WINDOW - 2)),
    )


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows that are found twice or more in the text.

    The windows are sorted with their places, and each is compared with its neighbour.
    """
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(1))),
            lambda i: F.struct(F.array_join(F.slice(words, i, WINDOW), " ").alias("w"), i.alias("i")),
        )
    )
    none = F.array().cast("array<int>")

    def positions(s: Column) -> Column:
        pairs = F.zip_with(
            F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1),
            lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(none),
        )
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    def covered(p: Column) -> Column:
        steps = F.zip_with(
            F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1),
            lambda a, b: F.least(F.lit(WINDOW), b - a),
        )
        total = F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)
        return F.when(F.size(p) > 0, total + WINDOW).otherwise(0)

    return once(windows, lambda s: once(positions(s), lambda p: covered(p)))


def document_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """key, host and the counts of every row; a null text has no words. Other columns are left.

    Texts in which no two windows have the same mark have no repeated window; only the others
    have their windows sorted.
    """
    text_ = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(text_, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text_, "\n"), lambda x: x.rlike(NOT_SPACE))
    parts = settled(
        docs.select(F.col(key).alias("key"), F.col(host).alias("host"), text_.alias("text")),
        {
            "p": once(words, lambda w: F.struct(w.alias("words"), _marks(w).alias("marks"))),
            "lines": lines,
            "n_symbols": F.length(F.regexp_replace(text_, "[^#*$%&|<>]+", "")).cast("long"),
        },
    )
    word, mark = F.col("p.words"), F.col("p.marks")
    repeats = F.when(F.size(F.array_distinct(mark)) < F.size(mark), _repeat_words(word)).otherwise(0)
    return parts.select(
        "key", "host", "n_symbols",
        F.size(word).cast("long").alias("n_words"),
        F.length(F.array_join(word, "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
    )


def beta_prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """alpha and beta of a rule from the failures (column ``rule``) and rows (``n``) of all hosts.

    The mean is the rate over all rows; the spread comes from the weighted variance between
    hosts less what chance alone gives. Returns (rate, alpha + beta); with no spread beyond
    chance the second is infinite: every host then has the common rate.
    """
    n, f = F.col("n").cast("double"), F.col(rule).cast("double")
    s = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"),
        F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff"),
    ).first()
    if not s["n"]:
        return 0.0, float("inf")
    rate, rows, k = s["f"] / s["n"], s["n"], s["k"]
    noise = rate * (1 - rate)
    if k < 2 or noise <= 0:
        return rate, float("inf")
    between = s["ff"] - rate * s["f"]
    room = rows - s["nn"] / rows - (k - 1)
    within = (between - noise * (k - 1)) / (noise * room) if room > 0 else 0.0
    if within <= 0:
        return rate, float("inf")
    return rate, max(0.0, 1 / min(within, 1.0) - 1)


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5
) -> DataFrame:
    """Counts, own failure and verdict of every row: key, COUNTS, n_lines, base_failed, host_ok, kept.

    A host is rejected when, for any rule, (failures + alpha) / (rows + alpha + beta) exceeds
    ``max_rate``. Rows without a host form no host and are judged alone. One row per input row:
    repeated rows count as often as they occur; a null key stays null; an empty table gives an
    empty result; other columns are not read, so their names cannot clash.

    A host's rows are summed before they are shuffled, so a host with a third of all rows costs
    no more than any other. The counts, not the texts, are stored once and used twice.
    """
    rules = {name: F.expr(rule) for name, rule in RULES.items()}
    counted = materialise(
        document_counts(docs, key, text, host).withColumns({f"f_{n}": r for n, r in rules.items()}), "quality"
    )
    hosts = counted.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"f_{n}").cast("long")).alias(n) for n in rules]
    )
    hosts = materialise(hosts, "hosts")
    bad = F.lit(False)
    for name in rules:
        rate, strength = beta_prior(hosts, name)
        if strength == float("inf"):
            shrunk = F.lit(rate)
        else:
            shrunk = (F.col(name) + F.lit(rate * strength)) / (F.col("n") + F.lit(strength))
        bad = bad | (shrunk > max_rate)
    # Only the rejected hosts travel; every other host is fine.
    rejected = hosts.filter(bad).select("host", F.lit(False).alias("host_ok"))
    return counted.join(rejected, "host", "left").select(
        F.col("key").alias(key), *COUNTS, "n_lines", F.col("f_base").alias("base_failed"),
        F.coalesce("host_ok", F.lit(True)).alias("host_ok"),
        (~F.col("f_base") & F.coalesce("host_ok", F.lit(True))).alias("kept"),
    )


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", *COUNTS, "base_failed", "kept", "host_ok"
    )


def _host_sql(rule: str) -> str:
    return f"""
 prior_{rule} AS (SELECT rate, CASE WHEN k < 2 OR noise <= 0 OR room <= 0 OR between_ - noise * (k - 1) <= 0 THEN NULL
    ELSE greatest(0, 1 / least((between_ - noise * (k - 1)) / (noise * room), 1) - 1) END AS strength
  FROM (SELECT f / n AS rate, (f / n) * (1 - f / n) AS noise, k, ff - (f / n) * f AS between_, n - nn / n - (k - 1) AS room
    FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum({rule})::DOUBLE AS f, sum(n::DOUBLE * n) AS nn,
      sum({rule}::DOUBLE * {rule} / n) AS ff FROM hosts))),"""


QUALITY_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
 words AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, text FROM docs),
 windows AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
   FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)),
 twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1),
 covered AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
   FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
 counts AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
   FROM docs JOIN (SELECT r, w, l FROM words) USING (r) LEFT JOIN covered USING (r)),
 failed AS (SELECT *, {", ".join(f"({rule}) AS f_{name}" for name, rule in RULES.items())} FROM counts),
 hosts AS (SELECT source, count(*) AS n, {", ".join(f"sum(f_{name}::INT) AS {name}" for name in RULES)}
   FROM failed WHERE source IS NOT NULL GROUP BY source),
 {"".join(_host_sql(name) for name in RULES)}
 rejected AS (SELECT source FROM hosts WHERE {" OR ".join(f'''(SELECT CASE WHEN strength IS NULL THEN rate
    ELSE (hosts.{name} + rate * strength) / (hosts.n + strength) END FROM prior_{name}) > 0.5''' for name in RULES)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed,
 NOT f_base AND host_ok AS kept, host_ok
FROM (SELECT *, source IS NULL OR source NOT IN (SELECT source FROM rejected) AS host_ok FROM failed)
"""
