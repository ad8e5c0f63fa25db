"""Repeated runs against brute force over words, with passages that begin and end inside sentences."""

import numpy as np
import pytest

from sparkcurate.llm import lines


def words(text):
    return [w.rstrip(b".") for w in text.encode().split()]


def kept_words(rows, least):
    """Words that lie in no window of ``least`` words that an earlier place has."""
    first, out = {}, {}
    for i, text in sorted(rows):
        w, gone = words(text), set()
        for a in range(len(w) - least + 1):
            if first.setdefault(tuple(w[a : a + least]), (i, a)) != (i, a):
                gone.update(range(a, a + least))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


@pytest.mark.parametrize("least", [50, 7, 1])
def test_planted_runs(spark, least):
    rng = np.random.default_rng(least)
    marks = np.array([" "] * 12 + [". ", "! ", "? ", ": ", ".\n", "\n", "\n\n  ", ".", " \r\n"])

    def prose(n):
        w = [f"{'abcdefgh'[k % 8]}{k}" for k in rng.integers(0, 5000, n)]
        return "".join(a + b for a, b in zip(w, rng.choice(marks, n)))

    passages = [prose(int(n)) for n in rng.integers(least, 3 * least + 2, 6)]
    rows = []
    for i in range(120):
        parts = [prose(int(rng.integers(0, 40)))]
        for p in rng.choice(6, rng.integers(0, 3)):
            w = passages[p].split(" ")
            a, b = sorted(rng.integers(0, len(w) + 1, 2))
            parts += [" ".join(w[a:b] if i % 2 else w), prose(int(rng.integers(0, 40)))]
        rows.append((i, " ".join(parts)))
    rows += [(200, "same " * 130), (201, "x y " * 70), (202, rows[0][1]), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.dedup_lines(docs, settings=lines.Settings(min_words=least)).collect()
    assert {r.doc_id: words(r.text) for r in got} == kept_words(rows, least)
    texts = dict(rows)
    assert all(len(texts[r.doc_id]) - len(r.text) == r.removed_chars for r in got)


def test_a_run_inside_sentences_goes_whole(spark):
    run = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"Some say {run} and stop. End"), (2, f"Others! wrote {run} then\n left"), (3, f"{run}?\nmore")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "Others! wrote then\n left", 3: "w59?\nmore"}


def test_small_table_by_words(spark, small_rows):
    from sparkcurate.llm.lines import op5_lines

    got = {r.doc_id: words(r.text) for r in op5_lines(spark, "/root/testdata/sf0.001").collect()}
    assert got == kept_words(small_rows, 50)
