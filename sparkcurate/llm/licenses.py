"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

A notice with s shingles (of five words) is looked for in windows of 2 s shingles that begin every
s shingles, so every run of s shingles lies in a window. If a window holds 80 % of the notice,
their similarity is at least 0.8 s / (2 s + 0.2 s) = 0.36, and with 40 bands of one row each they
meet with probability 1 - 0.64^40 = 1 - 2e-8. Windows that meet a notice are compared with it shingle
by shingle.

Only windows with a word that a notice cannot be found without are hashed, and only texts that hold such
a word are cut into words: those words are chosen so that without them more than 20 % of each
notice's shingles are missing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.operators.rows import settled

SHINGLE = 5
PERCENT = 80
BANDS = 40

#: Notices by license, as they are usually written (fixed values).
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-3.0": (
        "licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
}


def notice_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def notice_shingles(text: str) -> list[str]:
    """Distinct shingles in order; a notice needs at least one."""
    words = notice_words(text)
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def needed_words(notices: list[str], percent: int = PERCENT) -> list[str]:
    """Words without any of which no text can hold ``percent`` of the shingles of any notice.

    Long words first, and words already taken for another notice before those.
    """
    taken: list[str] = []
    for notice in notices:
        shingles = [s.split(" ") for s in notice_shingles(notice)]
        by_length = sorted(set(notice_words(notice)), key=lambda w: (-len(w), w))
        for word in [None, *by_length]:
            if word is not None:
                taken.append(word)
            missing = sum(any(w in taken for w in s) for s in shingles)
            if 100 * (len(shingles) - missing) < percent * len(shingles):
                break
    return list(dict.fromkeys(taken))


def _shingles(words: Column) -> Column:
    """Distinct hashes of the shingles of an array of words; empty if there are too few."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(hashes)).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    """The least of the shingles' hashes under each of BANDS functions."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda j: F.struct(
            j.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j))).alias("value")
        ),
    )


def text_mark(text: str) -> list[Column]:
    """Two hashes that stand for a text, ``mark1`` and ``mark2``; null texts share one mark."""
    return [F.xxhash64(text).alias("mark1"), F.xxhash64(F.lit(1), F.col(text)).alias("mark2")]


def scan_licenses(
    docs: DataFrame, notices: dict[str, tuple[str, ...]] = NOTICES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row, window and notice found: key, license, notice, start, shared, n_shingles.

    ``start`` is the number of words (runs of a-z and 0-9 after lower-casing) before the window. Null and
    empty texts and those of fewer than five words hold nothing; a null key is a key like any other, rows that repeat
    a key are looked at each by its own text, and repeated rows give their findings as often as they occur;
    an empty table gives an empty result; other columns are not read.
    """
    found = find_notices(docs, notices, text)
    rows = docs.select(F.col(key).alias("key"), *text_mark(text))
    return rows.join(found, ["mark1", "mark2"]).select(
        F.col("key").alias(key), "license", "notice", "start", "shared", "n_shingles"
    )


def find_notices(docs: DataFrame, notices: dict[str, tuple[str, ...]] = NOTICES, text: str = "text") -> DataFrame:
    """(mark1, mark2, license, notice, start, shared, n_shingles) of every distinct text that holds something.

    What is found depends on the text alone, so it is told by the text's mark, see :func:`text_mark`. The
    notices are a parameter of the job, a table of a few rows; no copy of a notice is compared with another, each is
    retrieved on its own. Findings of a text that many rows share are made one by every task before they
    are shuffled.
    """
    spark = docs.sparkSession
    listed = [(name, i, t, len(notice_shingles(t))) for name, texts in notices.items() for i, t in enumerate(texts)]
    listed = [row for row in listed if row[3]]
    if not listed:
        raise ValueError("a notice needs at least five words")
    anchors = needed_words([row[2] for row in listed])
    sizes = sorted({row[3] for row in listed})

    rows = [
        F.struct(
            F.lit(name).alias("license"), F.lit(i).alias("notice"), F.lit(n).alias("size"),
            F.array(*[F.lit(w) for w in notice_words(t)]).alias("words"),
        )
        for name, i, t, n in listed
    ]
    templates = settled(
        spark.range(1).select(F.inline(F.array(*rows))), {"template": _shingles(F.col("words"))}
    ).select("license", "notice", "size", "template", F.inline(_bands(F.col("template"))))

    low = F.lower(F.col(text))
    hopeful = F.lit(False)
    for word in anchors:
        # A word that holds another one is found with it.
        if not any(other != word and other in word for other in anchors):
            hopeful = hopeful | F.contains(low, F.lit(word))
    anchor_words = F.array(*[F.lit(w) for w in anchors])
    cut = settled(
        docs.filter(hopeful).select(*text_mark(text), low.alias("low")),
        {"words": F.filter(F.split("low", "[^a-z0-9]+"), lambda w: w != "")},
    ).select("mark1", "mark2", "words")

    def places(size: Column) -> Column:
        """Windows of one size that hold a needed word; they begin every ``size`` shingles."""
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)), size)
        return F.filter(
            F.transform(
                starts,
                lambda s: F.struct(
                    size.alias("size"), s.alias("start"),
                    F.slice("words", s + 1, 2 * size + F.lit(SHINGLE - 1)).alias("window"),
                ),
            ),
            lambda w: F.arrays_overlap(w["window"], anchor_words),
        )

    sized = cut.select("mark1", "mark2", "words", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    windows = sized.select("mark1", "mark2", F.inline(places(F.col("size"))))
    hashed = settled(windows, {"shingles": _shingles(F.col("window"))}).drop("window")
    banded = hashed.filter(F.size("shingles") > 0).select(
        "mark1", "mark2", "size", "start", "shingles", F.inline(_bands(F.col("shingles")))
    )
    met = banded.join(templates, ["size", "band", "value"]).select(
        "mark1", "mark2", "start", "license", "notice", "size",
        F.size(F.array_intersect("shingles", "template")).alias("shared"),
    )
    return met.filter(F.col("shared") * 100 >= F.col("size") * PERCENT).distinct().select(
        "mark1", "mark2", "license", "notice", "start", "shared", F.col("size").alias("n_shingles")
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_notices(docs).groupBy("mark1", "mark2").agg(
        F.sort_array(F.collect_set("license")).alias("licenses"),
        F.max((100 * F.col("shared") / F.col("n_shingles")).cast("long")).alias("best"),
    )
    return docs.select("doc_id", *text_mark("text")).join(found, ["mark1", "mark2"], "left").select(
        "doc_id", F.coalesce(F.size("licenses"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("licenses", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0)).alias("best"),
    )


def _values() -> str:
    return ", ".join(
        f"('{name}', {i}, '{t}')" for name, texts in NOTICES.items() for i, t in enumerate(texts)
    )


LICENSES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS text FROM documents),
 n AS (SELECT * FROM (VALUES {_values()}) AS v(license, notice, text)),
 dw AS (SELECT r, list_filter(regexp_split_to_array(text, '[^a-z0-9]+'), lambda w: w <> '') AS w FROM d),
 nw AS (SELECT license, notice, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM n),
 ns AS (SELECT DISTINCT license, notice, array_to_string(w[i:i + 4], ' ') AS s
   FROM (SELECT license, notice, w, unnest(range(1, len(w) - 3)) AS i FROM nw)),
 nn AS (SELECT license, notice, count(*) AS size FROM ns GROUP BY ALL),
 ds AS (SELECT r, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT r, w, unnest(range(0, len(w) - 4)) AS i FROM dw)),
 hit AS (SELECT r, i, license, notice, size, s FROM ds JOIN ns USING (s) JOIN nn USING (license, notice)),
 win AS (SELECT r, license, notice, size, i // size * size AS start, s FROM hit
   UNION ALL SELECT r, license, notice, size, i // size * size - size, s FROM hit WHERE i >= size),
 found AS (SELECT r, license, size, count(DISTINCT s) AS shared FROM win GROUP BY r, license, notice, size, start
   HAVING count(DISTINCT s) * 100 >= size * {PERCENT})
SELECT doc_id, count(DISTINCT license) AS n_licenses, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses,
 coalesce(max(100 * shared // size), 0)::BIGINT AS best
FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id
"""
