"""What is stored and moved on the way to a result."""

import random
import re

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from sparkcurate.config import Task
from sparkcurate.operators import completion, graph, ranking
from sparkcurate.operators.completion import complete_with_retry
from sparkcurate.operators.retrieval import retrieve
from sparkcurate.plans import datasets
from sparkcurate.plans import evaluation as P
from sparkcurate.plans.papers import paper_sections, topic_papers
from sparkcurate.plans.samples import trial_run


def test_an_evaluation_stores_no_whole_paper(spark, monkeypatch):
    stored = []
    keep = P.materialise

    def noted(df, label="step"):
        stored.append(df.schema.simpleString())
        return keep(df, label)

    monkeypatch.setattr(P, "materialise", noted)
    long = "qubit " + "x" * 3000
    papers = spark.createDataFrame(
        [(f"p{i}", f"Paper {i}", 2000 + i, ["A", "B"], i, long, "u", None) for i in range(7)],
        "paper_id string, title string, year int, authors array<string>, citation_count long, abstract string, url string, pdf_url string",
    )
    questions = spark.createDataFrame(
        [(1, "what about qubit", "the reference " * 5, "an answer"), (2, "nothing here", "short", "an answer"), (3, "again qubit", "short", "")],
        "id long, question string, reference string, answer string",
    )
    asked = spark.sparkContext.accumulator(0)

    def judge(systems, users):
        asked.add(len(users))
        return ["FACTUAL_ACCURACY: 0\nCOMPLETENESS: 0\nTECHNICAL_PRECISION: 0" for _ in users]

    done = P.evaluate(questions, papers, judge, "id", retries=1)
    rows = {r.id: r for r in done.results.collect()}
    assert asked.value == 2  # the one judged question, twice
    assert not [s for s in stored if "abstract" in s or "papers_retrieved" in s]
    assert [p.paper_id for p in rows[1].papers_retrieved] == ["p6", "p5", "p4", "p3", "p2"]
    assert {p.abstract for p in rows[1].papers_retrieved} == {long} and rows[2].papers_retrieved == []
    assert rows[2].reason == "No Semantic Scholar articles found" and rows[3].reason == "No response"
    context = P.grounded_questions(questions, papers, "id").filter("id = 1").first().context
    assert context.startswith("[1] Paper 6 (2006)") and long[:500] + "..." in context and long[:501] not in context
    log = {r.question_index: len(r.papers_retrieved) for r in done.log.select("question_index", "papers_retrieved").collect()}
    assert log == {1: 5, 2: 0, 3: 5}


def test_prompts_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def prompt(i):
        made.add(1)
        return f"u{i}"

    prompts = spark.range(6).select("id", F.lit("s").alias("system_prompt"), prompt("id").alias("user_prompt"))
    rows = complete_with_retry(prompts, lambda s, u: list(u), lambda o: o == "u1", 3).collect()
    assert made.value == 6 and len(rows) == 6 + 5 + 5


def test_a_topic_is_ranked_by_many_tasks(spark):
    rows = [("t" if i % 3 else "u", 0, i, f"p{i}", f"Title {i}", "the text of it", (i * 7) % 10) for i in range(60)]
    rows += rows[:9]  # rows that come twice have ranks of their own
    names = "topic string, source_rank int, pos int, paper_id string, title string, abstract string, citation_count long"
    papers = spark.createDataFrame(rows, names)
    topics = spark.createDataFrame([("t", 90), ("u", 30)], "topic string, target long")
    got = topic_papers(topics, papers)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(topic#\d+L?, citation_count", plan)  # by place, not by topic alone
    ranks = {}
    for r in got.collect():
        ranks.setdefault(r.topic, []).append((r["rank"], -r.citation_count, r.pos))
    for topic, most in (("t", 30), ("u", 10)):
        want = sorted((-r[6], r[2]) for r in rows if r[0] == topic)[:most]
        assert [x[1:] for x in sorted(ranks[topic])] == want
        assert [x[0] for x in sorted(ranks[topic])] == list(range(1, len(want) + 1))


def test_contents_are_settled_before_they_are_cut(spark):
    papers = spark.createDataFrame([("p", "a\nb " * 9000, ""), ("q", None, "c"), ("r", "", None)], "paper_id string, full_text string, abstract string")
    cut = paper_sections(papers, "\n")
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") >= 3
    rows = cut.collect()
    assert {(r.paper_id, r.section, r.sections) for r in rows if r.paper_id != "p"} == {("q", None, None)}
    assert [r.section for r in rows if r.paper_id == "p"] == [1, 2, 3, 4][: len(rows) - 1] and len(rows) > 2


def test_lines_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    from checks import events

    lines = spark.range(80, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("x").alias("value"))
    samples = spark.range(80, numPartitions=8).select(F.lit("i").alias("instruction"), F.lit("o").alias("output"))
    monkeypatch.setattr(events, "view", lambda spark, sf, name: {"lines": lines, "samples": samples}[name])
    parts = lambda folder: len(spark.read.text(folder).inputFiles())
    assert parts(events.written_lines(spark, "")) == 8
    assert parts(events.written_lines(spark, "", 3)) == 3
    seen = []

    def filtered(spark, folder, out, mark):
        seen.append(parts(folder))
        raise InterruptedError

    monkeypatch.setattr(events.J, "stream_filter", filtered)
    try:
        events.QUERIES["stream_filter"](spark, "")
    except InterruptedError:
        pass
    assert seen == [8]


def test_links_are_counted_in_groups(spark, monkeypatch):
    stored = []
    keep = graph.materialise

    def noted(df, label="step"):
        stored.append(keep(df, label))
        return stored[-1]

    monkeypatch.setattr(graph, "materialise", noted)
    monkeypatch.setattr(graph, "GROUP_ROWS", 7)
    rng = random.Random(5)
    letters = [f"{a}{a}{b}" for a in "abcd" for b in "efgh"]
    rows = [(i, " ".join(rng.sample(letters[: 9 + i % 8], rng.randint(0, 9))), None) for i in range(150)]
    rows += [(i, rows[i % 4][1], "") for i in range(150, 170)] + [(None, " ".join(letters[:5]), "")] * 3
    df = spark.createDataFrame(rows, "id long, title string, abstract string")
    sets = [set(r[1].split()) for r in rows]
    for least in (1, 2, 4):
        want = sorted((r[0] or -1, sum(len(a & b) >= least for j, b in enumerate(sets) if j != i)) for i, (r, a) in enumerate(zip(rows, sets)))
        assert sorted((r.id or -1, r.links) for r in graph.link_counts(df, least).collect()) == want
    # Nothing that is stored has more rows than there are papers.
    assert max(s.count() for s in stored) <= len(rows)


def test_lines_of_a_given_number_of_files_are_not_shuffled(spark, tmp_path, monkeypatch):
    from checks import events

    lines = spark.range(90, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("x" * 5).alias("value"))
    lines = lines.unionAll(lines.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("null").alias("value")))
    monkeypatch.setattr(events, "view", lambda spark, sf, name: lines)
    written = []
    keep = DataFrameWriter.text

    def noted(writer, path):
        written.append(writer._df)
        return keep(writer, path)

    monkeypatch.setattr(DataFrameWriter, "text", noted)
    folder = events.written_lines(spark, "", 3)
    assert "Exchange" not in written[0]._jdf.queryExecution().executedPlan().toString()
    back = spark.read.text(folder)
    assert back.count() == 91 and back.filter("value = 'null'").count() == 1 and len(back.inputFiles()) == 3


def test_papers_of_a_query_are_ranked_in_its_row(spark):
    papers = spark.createDataFrame(
        [("b", "gamma omega", "x", 5), ("b", "gamma", "x", 9), ("a", "omega", "x", 5), ("c", "gamma omega", "x", None), (None, "omega", "x", None), ("d", "gamma", "", 10)],
        "paper_id string, title string, abstract string, citation_count long",
    )
    questions = spark.createDataFrame([("gamma omega",), ("omega gamma",), ("omega",), ("nothing",), (None,)], "question string")
    hits = retrieve(questions, papers, k=3)
    got = {}
    for r in hits.orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.rank, r.paper_id, r.citation_count))
    both = [(1, "b", 9), (2, "a", 5), (3, None, None)]
    assert got == {"gamma omega": both, "omega gamma": both, "omega": [(1, "a", 5), (2, "b", 5), (3, None, None)]}
    # Words are cut a block of papers at a time: no task has a row for every word of its papers.
    assert "Generate explode(array_distinct" not in hits._jdf.queryExecution().optimizedPlan().toString()
    # The one window is that of words; queries are ranked by what their rows hold.
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"row_number\(\) windowspecdefinition\((\w+)#", plan)
    assert windows and set(windows) == {"term"}


def test_prompts_and_abstracts_stay_where_they_are(spark, monkeypatch):
    asked = []
    keep = completion.complete

    def noted(prompts, *args):
        asked.append(prompts._jdf.queryExecution().executedPlan().toString())
        return keep(prompts, *args)

    monkeypatch.setattr(completion, "complete", noted)
    stored = []
    store = datasets.materialise

    def kept(df, label="step"):
        stored.append(df.columns)
        return store(df, label)

    monkeypatch.setattr(datasets, "materialise", kept)
    text = "the text of the paper " * 20
    rows = [(t, 0, i, f"p{i}", f"Title of number {i}", ["A"], 2000, f"the abstract {i}", f"u{i}", None, "s", i, f"f{i}") for i in range(6) for t in (("t", "u") if i % 2 else ("t",))]
    names = "topic string, source_rank int, pos int, paper_id string, title string, authors array<string>, year int, abstract string, url string, doi string, source string, citation_count long, pdf_url string"
    papers = spark.createDataFrame(rows, names)
    fetched = spark.createDataFrame([(f"f{i}", text + str(i % 3), "x") for i in range(6)], "url string, text string, pdf_path string")
    topics = spark.createDataFrame([("t", 500), ("u", 500)], "topic string, target long")
    # Prompts of equal texts are equal: half of them are asked, and those without a pair once more.
    answer = lambda s, u: [f"<qa><question>Q?</question><answer>{x[-1]}</answer></qa>" if x[-1] != "1" else "none" for x in u]
    built = datasets.build_dataset(topics, papers, fetched, answer, Task("s", "{content}", max_retries=2))
    assert len(asked) == 2 and not any("Exchange hashpartitioning" in plan for plan in asked)
    assert not [c for c in stored if "abstract" in c]
    got = sorted((r.topic, r.line_no, r.source_paper, r.output, r.abstract) for r in built.samples.collect())
    want = [("t", n, f"p{i}", f"<answer>{i % 3}</answer>", f"the abstract {i}") for n, i in enumerate((0, 2, 3, 5), 1)]
    assert got == want + [("u", n, f"p{i}", f"<answer>{i % 3}</answer>", f"the abstract {i}") for n, i in enumerate((3, 5), 1)]
    assert sorted((r.topic, r.paper_id, r.abstract) for r in built.citations.collect()) == [(g[0], g[2], g[4]) for g in got]
    assert built.attempts.count() == 8


def test_a_trial_of_many_items_is_asked_by_many_tasks(spark):
    text = lambda name: F.concat(F.lit(name), F.col("k").cast("string"))
    items = spark.range(1500, numPartitions=8).select(F.col("id").alias("k")).select("k", text("q").alias("question"), text("a").alias("answer"))
    reply = lambda systems, users: [f"<think>{u}</think><answer>x</answer>" for u in users]
    for n in (1500, 1201, 2000):
        got = trial_run(items, reply, Task("s", "{question} {answer}"), "k", n)
        # No limit brings the items to one task, nor does anything else.
        assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
        rows = got.select("k", "question", "output", "quality", F.spark_partition_id().alias("task")).collect()
        assert len({r.task for r in rows}) > 1
        want = [(k, f"q{k}", f"<think>q{k} a{k}</think><answer>x</answer>", "PASS") for k in range(min(n, 1500))]
        assert sorted((r.k, r.question, r.output, r.quality) for r in rows) == want


def test_first_rows_are_as_many_as_asked_for(spark):
    nan = float("nan")
    # Nulls, values that come once, twice and for a third of all rows, negative zero, NaN.
    keys = [None] * 150 + [float(i) for i in range(1, 80)] + [0.0, -0.0] * 20 + [7.5] * 140 + [nan] * 9
    random.Random(3).shuffle(keys)
    df = spark.createDataFrame(spark.sparkContext.parallelize([(k, i) for i, k in enumerate(keys)], 6), "k double, i long")
    rank = lambda k: (0, 0.0) if k is None else (2, 0.0) if k != k else (1, k + 0.0)
    want = sorted(map(rank, keys))
    for n in (0, 5, 100, 101, 149, 150, 151, 190, 191, 200, 270, 345, len(keys) - 1, len(keys), len(keys) + 1, 2**40):
        rows = ranking.first_rows(df, "k", n).collect()
        assert sorted(rank(r.k) for r in rows) == want[:n], n
        assert len({r.i for r in rows}) == len(rows)  # each row once, with its own columns
        assert all(rank(r.k) == rank(keys[r.i]) for r in rows)


def test_a_summary_of_a_trial_gathers_no_rows(spark, monkeypatch):
    from checks import samples

    good = "<think>the 12</think><answer>$x$ is the result</answer>"
    outputs = F.array(F.lit(good), F.lit("in the end"), F.lit(""))
    # Rows of a generator, as Catalyst leaves out a limit that it knows to be above the number of rows.
    items = spark.range(200, numPartitions=8).select(F.col("id").alias("sample_id"), F.lit("i").alias("instruction"), F.explode(outputs).alias("output"))
    monkeypatch.setattr(samples, "view", lambda spark, sf, name: items)
    got = samples.QUERIES["trial_run_summary"](spark, "")
    assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().asDict() == {"total": 600, "pass": 200, "marginal": 0, "fail": 200, "avg_domain_score": 2.5, "ready": False}
