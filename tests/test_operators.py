"""Operators against brute force on small data, hot keys included."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkcurate.config import Rules, SplitRatios
from sparkcurate.operators import attempts as A
from sparkcurate.operators import ranking as K
from sparkcurate.operators import stats
from sparkcurate.operators.chunking import chunk_texts
from sparkcurate.operators.completion import complete, complete_with_retry
from sparkcurate.operators.dedup import greedy_dedup, greedy_order
from sparkcurate.operators.graph import link_counts, paper_text, top_keywords
from sparkcurate.operators.events import job_status
from sparkcurate.operators.retrieval import retrieve
from sparkcurate.plans import evaluation as E
from sparkcurate.plans import papers as P
from sparkcurate.plans.datasets import build_dataset, export_training, training_data, training_source
from sparkcurate.plans.samples import filter_samples, trial_run
from sparkcurate.config import Task


def walk(rows):
    """Keep a row unless a kept one has its id or its title."""
    ids, titles, kept = set(), set(), []
    for pos, pid, title in sorted(rows):
        if pid not in ids and title not in titles:
            ids.add(pid), titles.add(title), kept.append(pos)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_greedy_dedup_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    rows = [
        # A third of all rows share a title, another part an id.
        (i, "hot" if rng.random() < 0.2 else f"p{rng.randint(0, 60)}", "" if rng.random() < 0.33 else f"t{rng.randint(0, 60)}")
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "pos int, pid string, title string")
    got = greedy_dedup(df, ["pos"], [F.col("pid"), F.col("title")])
    assert sorted(r.pos for r in got.collect()) == walk(rows)


def test_greedy_dedup_chain(spark):
    # Every row depends on the one before: A(1,1) B(2,1) C(2,3) D(4,3) ...
    rows = [(i, f"p{(i + 1) // 2}", f"t{i // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "pos int, pid string, title string")
    got = greedy_dedup(df, ["pos"], [F.col("pid"), F.col("title")])
    assert sorted(r.pos for r in got.collect()) == walk(rows)


def test_greedy_dedup_of_long_chains_takes_few_jobs(spark):
    # Ten chains of 500 rows, their rows mixed, each of which depends on the one before.
    rows = [(10 * i + c, f"p{c}-{(i + 1) // 2}", f"t{c}-{i // 2}") for i in range(500) for c in range(10)]
    df = spark.createDataFrame(rows, "pos int, pid string, title string").repartition(4)
    spark.sparkContext.setJobGroup("chains", "")
    got = sorted(r.pos for r in greedy_dedup(df, ["pos"], [F.col("pid"), F.col("title")]).collect())
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chains")
    spark.sparkContext.setJobGroup("", "")
    assert got == walk(rows)
    assert len(jobs) < 400  # rounds alone would take more than 250 of several jobs each


@pytest.mark.parametrize("task_rows", [0, 3, 1000])
def test_greedy_dedup_by_parts_equals_the_walk(spark, task_rows):
    rng = random.Random(9)
    rows = [(i, f"p{rng.randint(0, 90)}", f"t{rng.randint(0, 90)}") for i in range(200)]
    df = spark.createDataFrame(rows, "pos int, pid string, title string")
    got = greedy_order(df, ["pos"], [F.col("pid"), F.col("title")], rounds=1, task_rows=task_rows)
    assert sorted(r.pos for r in got.collect()) == walk(rows)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_link_counts_equal_the_pairs(spark, least):
    rng = random.Random(least)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    rows = [(i, " ".join(rng.sample(words, rng.randint(0, 6))), None) for i in range(60)] + [(60 + i, "alpha beta gamma", "") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, title string, abstract string")
    sets = {r.id: set(r.keywords) for r in top_keywords(df, paper_text(), 4).collect()}
    want = {a: sum(len(sets[a] & sets[b]) >= least for b in sets if b != a) for a in sets}
    assert {r.id: r.links for r in link_counts(df, least, k=4).collect()} == want


def test_positions_and_running_totals(spark):
    rng = random.Random(3)
    values = [(i * 7 % 1009, rng.randint(0, 5)) for i in range(1009)]
    df = spark.createDataFrame(values, "k int, v int").repartition(7)
    got = K.with_position(df, ["k"]).orderBy("k").collect()
    assert [r.position for r in got] == list(range(1, 1010))
    totals = K.running_totals(df, ["k"], {"s": F.col("v")}).orderBy("k").collect()
    run = 0
    for r in totals:
        run += r.v
        assert r.s == run


@pytest.mark.parametrize("n", [0, 1, 3, 10, 97, 1000])
@pytest.mark.parametrize("ratios", [SplitRatios(), SplitRatios(0.9, 0.05, 0.05), SplitRatios(0.7, 0.3, 0.0)])
def test_split_sizes_are_exact(spark, n, ratios):
    df = spark.range(n)
    counts = {r["split"]: r["n"] for r in K.split(df, "id", ratios).groupBy("split").agg(F.count("*").alias("n")).collect()}
    sizes = K.split_sizes(n, ratios)
    assert tuple(counts.get(s, 0) for s in ("train", "validation", "test")) == sizes
    assert sum(sizes) == n


def test_cut_value_takes_exactly_n(spark):
    df = spark.range(500)
    order = K.random_order("id", 7)
    for n in (0, 1, 250, 499, 500):
        assert df.filter(order < K.cut_value(df, order, n)).count() == n


def test_sample_is_reproducible(spark):
    a = {r.id for r in K.sample_rows(spark.range(1000), 30, "id", seed=1).collect()}
    b = {r.id for r in K.sample_rows(spark.range(1000).repartition(5), 30, "id", seed=1).collect()}
    assert a == b and len(a) == 30


def pack(text, size, sep):
    """Chunks before the lead-in, by packing paragraph by paragraph."""
    groups, length = [[]], 0
    for i, p in enumerate(text.split(sep)):
        if i and length + len(p) > size:
            groups.append([])
            length = -len(sep)
        groups[-1].append(p)
        length += len(p) + len(sep)
    return [sep.join(g) for g in groups]


def test_chunks(spark):
    rng = random.Random(9)
    texts = ["", "one", "a" * 50] + [
        "\n\n".join("".join(rng.choice("ab. C") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 25)))
        for _ in range(40)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = chunk_texts(df, "t", 40, overlap_sentences=2).orderBy("i", "chunk_index").collect()
    for i, text in enumerate(texts):
        expected = pack(text, 40, "\n\n")
        got = [r for r in rows if r.i == i]
        assert [r.chunk_index for r in got] == list(range(1, len(expected) + 1))
        assert all(r.chunk_count == len(expected) for r in got)
        # The text itself is whole: lead-ins aside, the chunks give it back.
        assert all(r.chunk.endswith(e) for r, e in zip(got, expected))
        assert "\n\n".join(expected) == text
        assert got[0].chunk == expected[0]


def test_kept_and_rejected_make_up_the_input(spark):
    rows = [(i, "q", t) for i, t in enumerate(["<think>1. " + "x" * 120 + " $a$</think><answer>" + "y" * 12 + "</answer>", "bad", None, "<think>a</think><answer>b"])]
    df = spark.createDataFrame(rows, "i int, instruction string, output string")
    for strict in (True, False):
        for heal in (True, False):
            result = filter_samples(df, Rules(), strict, heal)
            kept, rejected = result.kept.count(), result.rejected.count()
            s = result.stats.first()
            assert kept + rejected == s.total == 4
            assert s.passed_original + s.passed_healed == kept and s.rejected == rejected
    assert [r.i for r in filter_samples(df).kept.collect()] == [0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "instruction string, output string, valid boolean, healed boolean")
    assert stats.profile(empty).first()[:5] == (0, 0, 0, 0, 0)
    assert stats.service_stats(empty).first()[:4] == (0, 0, 0, 0)
    assert stats.entropy(empty).first()[0] == 0.0
    assert filter_samples(empty.drop("healed")).stats.first().pass_pct == 0.0
    assert stats.purity(spark.createDataFrame([], "value string")).first()[0] == 0.0


def test_entropy(spark):
    df = spark.createDataFrame([("A b", "a\u2003B"), (None, None)], "instruction string, output string")
    assert stats.entropy(df).first()[0] == pytest.approx(1.0)
    one = spark.createDataFrame([("a", "a")], "instruction string, output string")
    assert stats.entropy(one).first()[0] == 0.0


def test_greedy_dedup_with_null_keys(spark):
    rows = [(0, None, "a"), (1, None, "b"), (2, None, "c"), (3, "x", None), (4, None, None), (5, "y", None), (6, "z", "q")]
    df = spark.createDataFrame(rows, "pos int, pid string, title string")
    got = greedy_dedup(df, ["pos"], [F.col("pid"), F.col("title")])
    # The first null id uses up the null id, the first null title the null title.
    assert sorted(r.pos for r in got.collect()) == [0, 3, 6]


def test_random_order_takes_one_null_key(spark):
    df = spark.range(50).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    assert K.sample_rows(df, 20, "k", seed=3).count() == 20
    assert [r["count"] for r in K.split(df, "k", SplitRatios(0.6, 0.2, 0.2, 1)).groupBy("split").count().orderBy("split").collect()] == [10, 30, 10]


def test_energy_is_the_same_for_any_stretch(spark):
    rng = random.Random(2)
    rows, t = [], 0
    for i in range(400):
        t += rng.randint(1, 4000)
        rows.append(("hot" if i % 3 else f"d{i % 5}", t, float(rng.randint(0, 300))))
    df = spark.createDataFrame(rows, "d string, s long, w double").withColumn("ts", F.timestamp_seconds("s"))
    for bucket in (1, 60, 3600, 10**7):
        got = {r.d: r.kwh for r in stats.energy(df, "d", "ts", "w", bucket).collect()}
        for d in {r[0] for r in rows}:
            own = [(s, w) for x, s, w in rows if x == d]
            joules = sum((a[1] + b[1]) / 2 * (b[0] - a[0]) for a, b in zip(own, own[1:]))
            assert got[d] == pytest.approx(joules / 3.6e6)


def test_retrieval_against_all_pairs(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    papers = [(f"p{i:03d}", "common " + rng.choice(words), rng.choice(words) if i % 4 else "", rng.randint(0, 20)) for i in range(120)]
    questions = [(i, " ".join(rng.sample(words + ["common"], 2))) for i in range(25)]
    p = spark.createDataFrame(papers, "paper_id string, title string, abstract string, citation_count long")
    q = spark.createDataFrame(questions, "i int, question string")
    got = {}
    for r in retrieve(q, p, k=4).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r.paper_id
    for query, ranks in got.items():
        terms = set(query.split())
        hits = [x for x in papers if x[2] and terms & set((x[1] + " " + x[2]).split())]
        best = [x[0] for x in sorted(hits, key=lambda x: (-x[3], x[0]))[:4]]
        assert [ranks[i + 1] for i in range(len(best))] == best


@pytest.mark.parametrize("k", [3, 1500])
def test_top_per_key(spark, k):
    # One key holds half of the rows.
    df = spark.range(8000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5).alias("k"), ((F.col("id") * 7919) % 8009).alias("v")
    ).repartition(9)
    got = {}
    for r in K.top_per_key(df, "k", [F.col("v")], k, "r").collect():
        got.setdefault(r["k"], []).append((r["r"], r["v"]))
    for key, rows in got.items():
        values = sorted(r.v for r in df.filter(F.col("k") == key).collect())[:k]
        assert sorted(rows) == list(enumerate(values, 1))


def test_best_attempt(spark):
    rows = [(1, 1, "a", False), (1, 2, "b", True), (1, 3, "c", True), (2, 1, "x", False), (2, 2, None, False), (3, 1, None, False), (4, 1, "", True)]
    df = spark.createDataFrame(rows, "k int, attempt int, output string, valid boolean")
    got = sorted((r.k, r.output, r.valid, r.attempts_used) for r in A.best_attempt(df, "k").collect())
    assert got == [(1, "b", True, 2), (2, "x", False, 2)]
    s = A.generation_summary(df, "k").first()
    assert (s.processed, s.valid, s.invalid_kept, s.skipped, s.total_retries) == (2, 1, 1, 2, 2)


def test_status_keeps_first_terminal_state(spark):
    rows = [(1, 1, "pending"), (2, 1, "cancelled"), (3, 1, "completed"), (1, 2, "running"), (2, 2, "pending")]
    df = spark.createDataFrame(rows, "event_id int, job_id int, status string")
    assert {r.job_id: r.status for r in job_status(df).collect()} == {1: "cancelled", 2: "pending"}


def test_parse_pairs(spark):
    reply = "<qa><question> Q </question><answer>A</answer></qa><QA>none</QA><qa><question>R</question><think> t </think><answer>B</answer>"
    df = spark.createDataFrame([(1, reply), (2, "")], "k int, output string")
    rows = P.parse_pairs(df).collect()
    assert [(r.k, r.instruction, r.output) for r in rows] == [(1, "Q", "<answer>A</answer>")]


def test_trial_run(spark):
    items = spark.createDataFrame([(i, f"q{i}", "a") for i in range(9)], "k int, question string, answer string")
    reply = lambda systems, users: [None if "q1" in u else "<think>step 1</think><answer>x</answer>" for u in users]
    got = trial_run(items, reply, Task("s", "{question} {answer}"), "k", 3).orderBy("k").collect()
    assert [r.quality for r in got] == ["PASS", "ERROR", "PASS"]


def test_failed_call_is_data(spark):
    def broken(systems, users):
        raise ValueError("service down")

    items = spark.createDataFrame([(1, "q", "a")], "k int, question string, answer string")
    got = trial_run(items, broken, Task("s", "{question}"), "k").first()
    assert got.error == "service down" and got.quality == "ERROR"


def test_build_dataset(spark):
    text = "The first result of this long paper is about the state of a qubit. " * 4
    rows = [("physics", 0, i, f"arxiv:{i}", f"Title of paper {i}", text, 10 * i) for i in range(12)]
    papers = spark.createDataFrame(rows, "topic string, source_rank int, pos int, paper_id string, title string, abstract string, citation_count long")
    none = F.lit(None).cast("string")
    papers = papers.withColumns(
        {"authors": F.array(F.lit("A")), "year": F.lit(2024), "doi": none, "url": none, "pdf_url": none, "source": F.lit("arxiv"), "full_text": none}
    )
    fetched = spark.createDataFrame([(f"https://arxiv.org/pdf/{i}", text, f"/pdf/{i}") for i in range(0, 12, 2)], "url string, text string, pdf_path string")
    topics = spark.createDataFrame([("physics", 60)], "topic string, target long")
    think = "<think>Step 1. " + "because " * 40 + "</think>"
    reply = lambda s, u: [f"<qa><question>Why so?</question>{think}<answer>{'so it is ' * 30}</answer></qa>" for _ in u]
    rules = Rules(check_latex_consistency=False)
    built = build_dataset(topics, papers, fetched, reply, Task("s", "{title} {authors} {content}", rules))
    # The five most cited papers (7 to 11) are fetched, two of them have a text.
    assert built.samples.count() == 2 and built.filtered.kept.count() == 2
    assert {r.paper_id for r in built.citations.collect()} == {"arxiv:10", "arxiv:8"}
    assert {r.pdf_path for r in built.samples.collect()} == {"/pdf/10", "/pdf/8"}


def test_a_wrong_number_of_replies_is_an_error_row(spark):
    prompts = spark.createDataFrame([(i, "s", f"u{i}") for i in range(5)], "id int, system_prompt string, user_prompt string").coalesce(1)
    rows = complete(prompts, lambda s, u: list(u)[1:] if "u3" in u else list(u), batch_size=2).collect()
    assert {r.id: r.output for r in rows} == {0: "u0", 1: "u1", 2: None, 3: None, 4: "u4"}
    assert {r.id for r in rows if r.error} == {2, 3}


def test_a_run_that_was_lost_goes_on_where_it_stopped(spark, tmp_path):
    """The first driver dies in its second part; the next one asks only for what is not in the ledger."""
    asked = spark.sparkContext.accumulator(0)
    prompts = spark.createDataFrame([(i, "s", f"u{i % 30}") for i in range(40)], "id int, system_prompt string, user_prompt string")
    accept = lambda o: o.endswith("2") | ~o.startswith("odd")

    def model(broken):
        def call(systems, users):
            asked.add(len(users))
            if broken:
                raise SystemExit("killed")
            return [f"odd {u}" if int(u[1:]) % 2 else u for u in users]

        return call

    ledger = str(tmp_path / "ledger")
    run = lambda fn, n: complete_with_retry(prompts, fn, accept, n, ledger=ledger, parts=3)
    done = {(r.id, r.attempt): (r.output, r.valid) for r in run(model(False), 1).collect()}
    assert asked.value == 30 and len(done) == 40  # equal prompts are asked once
    import shutil

    shutil.rmtree(tmp_path / "ledger" / "attempt=1" / "part=2")
    with pytest.raises(Exception):
        run(model(True), 1).collect()
    before = asked.value
    rows = run(model(False), 2).collect()
    assert asked.value - before < 30  # part 2 of the first attempt, then those without a good reply
    want = {(i, 1) for i in range(40)} | {(i, 2) for i in range(40) if (i % 30) % 2 and (i % 30) % 10 != 2}
    assert {(r.id, r.attempt) for r in rows} == want
    stored = spark.read.parquet(f"{ledger}/attempt=1/part=0").columns
    assert "user_prompt" not in stored and "system_prompt" not in stored


def test_a_reply_that_is_good_on_the_second_try(spark, tmp_path):
    """A stand-in that keeps count of its calls in a folder."""
    folder = str(tmp_path)

    def second_time(systems, users):
        import os

        out = []
        for u in users:
            again = os.path.exists(f"{folder}/{u}")
            open(f"{folder}/{u}", "w").close()
            out.append("good" if again else "bad")
        return out

    prompts = spark.createDataFrame([(i, "s", f"u{i}") for i in range(6)], "id int, system_prompt string, user_prompt string")
    rows = complete_with_retry(prompts, second_time, lambda o: o == "good", 3).collect()
    assert sorted((r.id, r.attempt, r.output, r.valid) for r in rows) == sorted(
        [(i, 1, "bad", False) for i in range(6)] + [(i, 2, "good", True) for i in range(6)]
    )


def test_white_space_is_that_of_unicode(evaluate):
    from sparkcurate.functions.tags import final_answer
    from sparkcurate.functions.text import last_sentences

    assert evaluate(last_sentences, ["One.\u00a0Two.\u2003Three."]) == ["Two. Three."]
    assert evaluate(final_answer, ["the final\u00a0answer\u2009is\u3000forty two"]) == ["forty two"]


def test_training_data(spark, tmp_path):
    sets = spark.createDataFrame([(1, 7, "completed", 5, "gone/x"), (2, 7, "completed", 9, str(tmp_path / "there"))], "id int, user_id int, status string, completed_at int, output_path string")
    qa = spark.createDataFrame([(1, "i", "o", True), (1, "j", "p", False), (3, "k", "q", False)], "dataset_id int, instruction string, output string, is_valid boolean")
    export_training(qa, 1, str(tmp_path / "there"))
    read = lambda *a, **k: [tuple(r) for r in training_data(spark, sets, qa, *a, **k).collect()]
    assert read(7) == [("i", "o")] == read(7, dataset_id=1) == read(7, path=str(tmp_path / "there"))
    for bad in (dict(user_id=8), dict(user_id=7, path="nowhere"), dict(user_id=7, path="nowhere", dataset_id=3)):
        with pytest.raises(ValueError):
            training_data(spark, sets, qa, **bad)
    with pytest.raises(ValueError):
        export_training(qa, 3, str(tmp_path / "none"))


def test_training_source(spark):
    rows = [(1, 7, "completed", 5, "a"), (2, 7, "completed", 9, "b"), (3, 7, "failed", 11, "c"), (4, 8, "completed", 99, "d")]
    sets = spark.createDataFrame(rows, "id int, user_id int, status string, completed_at int, output_path string")
    assert training_source(sets, 7) == "b"
    assert training_source(sets, 7, dataset_id=1) == "a"
    assert training_source(sets, 7, path="x") == "x"
    assert training_source(sets, 9) is None


def test_purity_counts_bad_lines(spark):
    good = json.dumps({"instruction": "i" * 10, "output": "o" * 10})
    same = json.dumps({"instruction": "i" * 10, "output": "i" * 10})
    lines = spark.createDataFrame([(good,), (same,), ("{bad",), ("  ",), ("",), (good,)], "value string")
    assert stats.purity(lines).first()[0] == pytest.approx(50.0)


def test_corrections_show_the_papers_of_their_own_question(spark):
    results = spark.createDataFrame([(1, "q1", "a", 10.0), (2, "q2", "a", 20.0), (3, "q3", "a", 90.0), (4, "q4", "a", 5.0)], "question_index long, question string, answer string, overall_score double")
    log = spark.createDataFrame([(1, [("T1", "x")]), (2, [("", "no"), ("T2", None)]), (3, [("T3", "z")])], "question_index long, papers_retrieved array<struct<title: string, abstract: string>>")
    seen = lambda s, users: [json.dumps({"instruction": "i", "output": "+".join(t for t in ("T1", "T2", "T3") if f"### {t}" in u) or "none"}) for u in users]
    done = E.apply_corrections(results, log, seen)
    assert sorted(r.output for r in done.corrected.collect()) == ["T1", "T2", "none"]
    assert done.summary.first().total_failing == 3
