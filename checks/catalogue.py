"""Checks of the catalogue, the knowledge graph, and the attempts of a generation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.sqlparts import et_al, keyword_rows, strip
from checks.views import table, view, with_views
from sparkcurate.config import Rules, Task
from sparkcurate.functions import scoring as S
from sparkcurate.operators import attempts as A
from sparkcurate.operators import catalogue as C
from sparkcurate.operators import graph as G
from sparkcurate.operators.ranking import page_after, page_with_total
from sparkcurate.plans import datasets as D
from sparkcurate.session import application_folder
from sparkcurate.plans import samples as P

QUERIES, ORACLE = {}, {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


# --- loading ---------------------------------------------------------------------------------

CITED = """
k AS (SELECT *, row_number() OVER (PARTITION BY source_paper ORDER BY line_no) AS rn FROM sourced WHERE source_paper <> ''),
cp AS MATERIALIZED (SELECT source_paper, source_title, year, citation_count, row_number() OVER (ORDER BY line_no) AS id FROM k WHERE rn = 1)
"""


@check(
    "catalogue_papers",
    with_views(
        "sourced",
        body="+" + CITED + """SELECT id, source_paper AS paper_id, source_title AS title, year, citation_count, 5::INT AS dataset_id,
 (SELECT count(*) FROM sourced s WHERE s.source_paper = cp.source_paper) AS qa_pair_count FROM cp""",
    ),
)
def _(spark, sf):
    return D.load_catalogue(view(spark, sf, "sourced"), 5, 2)[0].select(
        "id", "paper_id", "title", "year", "citation_count", "dataset_id", "qa_pair_count"
    )


@check(
    "catalogue_qa",
    with_views(
        "sourced",
        body="+" + CITED + f"""SELECT row_number() OVER (ORDER BY line_no) AS id, instruction, output, valid AS is_valid, healed AS was_healed,
 s.source_paper AS source_paper_id, cp.id AS paper_id,
 coalesce(CASE WHEN regexp_matches(output, '(?s)<think>.*?</think>') THEN {strip("regexp_extract(output, '(?s)<think>(.*?)</think>', 1)")} END, '') AS think_text,
 CASE WHEN regexp_matches(output, '(?s)<answer>.*?</answer>') THEN {strip("regexp_extract(output, '(?s)<answer>(.*?)</answer>', 1)")} ELSE output END AS answer_text
FROM sourced s LEFT JOIN cp ON cp.source_paper = s.source_paper""",
    ),
)
def _(spark, sf):
    return D.load_catalogue(view(spark, sf, "sourced"), 5, 2)[1].select(
        "id", "instruction", "output", "is_valid", "was_healed", "source_paper_id", "paper_id",
        "think_text", "answer_text",
    )


@check(
    "catalogue_dataset",
    with_views("sourced", body="SELECT 5::INT AS id, 'completed' AS status, count(*) AS actual_size, count(*) FILTER (valid) AS valid_count, count(*) FILTER (healed) AS healed_count FROM sourced"),
)
def _(spark, sf):
    return D.load_catalogue(view(spark, sf, "sourced"), 5, 2)[2].select(
        "id", "status", "actual_size", "valid_count", "healed_count"
    )


# Five datasets; the first load has three of them, the second all but the first.
LOADS = """
w AS (SELECT *, line_no % 5 + 1 AS ds, CASE WHEN line_no % 5 < 3 THEN 1 ELSE 2 END AS ld FROM sourced),
f AS (SELECT ds, ld, source_paper, min(line_no) AS line_no, count(*) AS n FROM w WHERE source_paper <> '' GROUP BY ALL),
lp AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ld, ds, line_no) AS id FROM f)
"""


def two_loads(spark, sf):
    tables = D.CatalogueTables(*(f"{n}_{uuid.uuid4().hex}" for n in ("papers", "pairs", "sets")))
    rows = view(spark, sf, "sourced").withColumns(
        {"dataset_id": F.col("line_no") % 5 + 1, "user_id": F.lit(2)}
    )
    D.load_tables(rows.filter("dataset_id <= 3"), "first", tables)
    D.load_tables(rows.filter("dataset_id >= 2"), "second", tables)
    D.load_tables(rows, "third", tables)  # nothing is new
    return tables


@check(
    "loaded_pairs",
    with_views(
        "sourced",
        body="+" + LOADS + """SELECT row_number() OVER (ORDER BY w.ld, w.ds, w.line_no) AS id, w.ds AS dataset_id, w.instruction, w.output, lp.id AS paper_id,
 lp.source_paper AS paper, lp.n AS qa_pair_count FROM w LEFT JOIN lp ON lp.ds = w.ds AND lp.source_paper = w.source_paper""",
    ),
)
def _(spark, sf):
    """Two loads into the same tables and one that repeats both; every pair finds its paper."""
    tables = two_loads(spark, sf)
    papers = spark.table(tables.papers).select(
        F.col("id").alias("paper_id"), F.col("paper_id").alias("paper"), "qa_pair_count"
    )
    return spark.table(tables.qa_pairs).join(papers, "paper_id", "left").select(
        "id", "dataset_id", "instruction", "output", "paper_id", "paper", "qa_pair_count"
    )


@check(
    "loaded_datasets",
    with_views("sourced", body="SELECT line_no % 5 + 1 AS id, count(*) AS actual_size, count(*) FILTER (valid) AS valid_count, count(*) FILTER (healed) AS healed_count FROM sourced GROUP BY 1"),
)
def _(spark, sf):
    return spark.table(two_loads(spark, sf).datasets).select("id", "actual_size", "valid_count", "healed_count")


@check(
    "link_papers",
    with_views(
        "sourced", "cat_papers",
        body="SELECT line_no, source_paper AS source_paper_id, (SELECT max(id) FROM cat_papers c WHERE c.paper_id = s.source_paper) AS paper_id FROM sourced s",
    ),
)
def _(spark, sf):
    qa = view(spark, sf, "sourced").select("line_no", F.col("source_paper").alias("source_paper_id"))
    papers = view(spark, sf, "cat_papers")
    # Every paper twice: the larger id counts.
    twice = papers.withColumn("id", F.col("id") - 1).unionByName(papers)
    return C.link_papers(qa, twice)


# --- queries ---------------------------------------------------------------------------------


@check(
    "paper_topics",
    with_views("cat_datasets", "cat_papers", body="SELECT DISTINCT topic FROM cat_datasets d JOIN cat_papers p ON p.dataset_id = d.id WHERE topic <> ''"),
)
def _(spark, sf):
    return C.topics(view(spark, sf, "cat_datasets"), view(spark, sf, "cat_papers"))


@check(
    "papers_by_topic",
    with_views("cat_datasets", "cat_papers", body="SELECT p.id, dataset_id FROM cat_papers p JOIN cat_datasets d ON d.id = p.dataset_id WHERE topic ILIKE '%RC1%'"),
)
def _(spark, sf):
    return C.papers_by_topic(view(spark, sf, "cat_papers"), view(spark, sf, "cat_datasets"), "RC1").select(
        "id", "dataset_id"
    )


@check(
    "search_ilike",
    with_views("qa", body="SELECT id, instruction FROM qa WHERE instruction ILIKE '%ON_TH%' OR output ILIKE '%ON_TH%'"),
)
def _(spark, sf):
    return C.search(view(spark, sf, "qa"), "ON_TH", ["instruction", "output"]).select("id", "instruction")


@check(
    "search_text",
    with_views("qa", body="SELECT id FROM qa WHERE contains(lower(instruction||' '||output), 'der')"),
)
def _(spark, sf):
    return C.search_text(view(spark, sf, "qa"), "DER", ["instruction", "output"]).select("id")


@check(
    "owner_filter",
    with_views("cat_datasets", "cat_papers", body="SELECT id, dataset_id FROM cat_papers WHERE user_id = 2 AND dataset_id IN (SELECT id FROM cat_datasets WHERE status = 'completed')"),
)
def _(spark, sf):
    own = view(spark, sf, "cat_papers").filter("user_id = 2")
    done = view(spark, sf, "cat_datasets").filter("status = 'completed'")
    return C.select_ids(own, done.select(F.col("id").alias("dataset_id")), "dataset_id").select("id", "dataset_id")


@check(
    "paper_detail",
    with_views(
        "qa", "cat_papers",
        body="""+ b AS (SELECT paper_id FROM qa WHERE paper_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, paper_id LIMIT 1)
SELECT p.id, p.paper_id, p.title, p.citation_count, q.id AS qa_id, q.instruction, q.answer_text FROM cat_papers p LEFT JOIN qa q ON q.paper_id = p.id WHERE p.id = (SELECT paper_id FROM b)""",
    ),
)
def _(spark, sf):
    qa = view(spark, sf, "qa")
    busiest = (
        qa.filter("paper_id is not null").groupBy("paper_id").count()
        .orderBy(F.col("count").desc(), "paper_id").first()[0]
    )
    return C.paper_detail(view(spark, sf, "cat_papers"), qa, busiest).select(
        "id", "paper_id", "title", "citation_count", "qa_id", "instruction", "answer_text"
    )


@check(
    "dataset_contents",
    with_views(
        "cat_datasets", "cat_papers", "qa",
        body="""SELECT id, topic, (SELECT count(*) FROM cat_papers p WHERE p.dataset_id = d.id) AS papers,
 (SELECT count(*) FROM qa WHERE qa.dataset_id = d.id AND qa.paper_id IS NOT NULL) AS qa_with_paper,
 (SELECT count(*) FROM qa WHERE qa.dataset_id = d.id AND qa.paper_id IS NULL) AS qa_dataset_only,
 (SELECT count(*) FROM qa WHERE qa.dataset_id = d.id) AS qa_total FROM cat_datasets d""",
    ),
)
def _(spark, sf):
    return C.contents(view(spark, sf, "cat_datasets"), view(spark, sf, "cat_papers"), view(spark, sf, "qa"))


@check(
    "qa_counts",
    with_views("cat_papers", "qa", body="SELECT id, (SELECT count(*) FROM qa WHERE qa.paper_id = p.id) AS qa_pair_count FROM cat_papers p"),
)
def _(spark, sf):
    return C.qa_counts(view(spark, sf, "cat_papers").select("id"), view(spark, sf, "qa"), "paper_id")


@check("missing_ids", with_views("cat_papers", "qa", body="SELECT DISTINCT paper_id * 11 AS id FROM qa WHERE paper_id * 11 NOT IN (SELECT id FROM cat_papers)"))
def _(spark, sf):
    wanted = view(spark, sf, "qa").select((F.col("paper_id") * 11).alias("id")).filter("id is not null")
    return C.missing_ids(view(spark, sf, "cat_papers"), wanted)


@check(
    "delete_datasets",
    with_views(
        "cat_datasets", "cat_papers", "qa",
        body="""+ g AS (SELECT id FROM cat_datasets WHERE status = 'failed' OR id = 1)
SELECT 'datasets' AS t, id FROM cat_datasets WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'papers', id FROM cat_papers WHERE dataset_id IS NULL OR dataset_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'qa', id FROM qa WHERE dataset_id NOT IN (SELECT id FROM g) AND (paper_id IS NULL OR paper_id NOT IN (SELECT id FROM cat_papers WHERE dataset_id IN (SELECT id FROM g)))""",
    ),
)
def _(spark, sf):
    sets, papers, qa = (view(spark, sf, n) for n in ("cat_datasets", "cat_papers", "qa"))
    left = C.delete_dataset(sets, papers, qa, sets.filter("status = 'failed' or id = 1"))
    named = [d.select(F.lit(n).alias("t"), "id") for n, d in zip(("datasets", "papers", "qa"), left)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@check(
    "delete_users",
    with_views(
        "cat_datasets", "cat_papers", "qa",
        body="""+ g AS (SELECT id FROM cat_datasets WHERE user_id = 2)
SELECT 'datasets' AS t, id FROM cat_datasets WHERE user_id <> 2
UNION ALL SELECT 'papers', id FROM cat_papers WHERE dataset_id IS NULL OR dataset_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'qa', id FROM qa WHERE dataset_id NOT IN (SELECT id FROM g) AND (paper_id IS NULL OR paper_id NOT IN (SELECT id FROM cat_papers WHERE dataset_id IN (SELECT id FROM g)))""",
    ),
)
def _(spark, sf):
    sets, papers, qa = (view(spark, sf, n) for n in ("cat_datasets", "cat_papers", "qa"))
    left = C.delete_users(sets, papers, qa, sets.filter("user_id = 2").select(F.col("user_id").alias("id")).distinct())
    named = [d.select(F.lit(n).alias("t"), "id") for n, d in zip(("datasets", "papers", "qa"), left)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@check(
    "training_source",
    with_views("cat_datasets", body="SELECT id, output_path FROM cat_datasets d WHERE status = 'completed' AND output_path = (SELECT arg_max(output_path, (completed_at, id)) FROM cat_datasets c WHERE c.status = 'completed' AND c.user_id = 1)"),
)
def _(spark, sf):
    sets = view(spark, sf, "cat_datasets")
    return sets.filter(F.col("output_path") == D.training_source(sets, 1)).select("id", "output_path")


@check(
    "delete_papers",
    with_views(
        "cat_papers", "qa",
        body="""SELECT 'papers' AS t, id FROM cat_papers WHERE citation_count < 900
UNION ALL SELECT 'qa', id FROM qa WHERE paper_id IS NULL OR paper_id NOT IN (SELECT id FROM cat_papers WHERE citation_count >= 900)""",
    ),
)
def _(spark, sf):
    papers, qa = view(spark, sf, "cat_papers"), view(spark, sf, "qa")
    a, b = C.delete_papers(papers, qa, papers.filter("citation_count >= 900"))
    return a.select(F.lit("papers").alias("t"), "id").unionByName(b.select(F.lit("qa").alias("t"), "id"))


RUNS = "SELECT event_id AS id, event_type AS status, 'data'||CAST(event_id AS VARCHAR(20)) AS dataset_path, 'model'||CAST(user_id AS VARCHAR(20)) AS adapter_path FROM {events}"
EVALS = """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE doc_id * 7 END AS training_run_id,
 CASE WHEN doc_id % 3 = 0 THEN 'own model' ELSE '' END AS model_path, CASE WHEN doc_id % 4 = 0 THEN 'own data' ELSE '' END AS test_dataset_path FROM {documents}"""


def runs_and_evaluations(spark, sf):
    runs = spark.sql(RUNS, events=table(spark, sf, "events")).withColumn(
        "status", F.when(F.col("status") == "purchase", "completed").otherwise("failed")
    )
    return runs, spark.sql(EVALS, documents=table(spark, sf, "documents"))


_RUNS_SQL = f"WITH r AS (SELECT id, CASE WHEN status = 'purchase' THEN 'completed' ELSE 'failed' END AS status, dataset_path, adapter_path FROM ({RUNS.format(events='events')})), e AS ({EVALS.format(documents='documents')})"


@check(
    "delete_runs",
    _RUNS_SQL + """SELECT 'runs' AS t, id FROM r WHERE status <> 'completed'
UNION ALL SELECT 'evaluations', id FROM e WHERE training_run_id IS NULL OR training_run_id NOT IN (SELECT id FROM r WHERE status = 'completed')""",
)
def _(spark, sf):
    runs, evaluations = runs_and_evaluations(spark, sf)
    a, b = C.delete_runs(runs, evaluations, runs.filter("status = 'completed'"))
    return a.select(F.lit("runs").alias("t"), "id").unionByName(
        b.select(F.lit("evaluations").alias("t"), "id")
    )


@check(
    "resolve_eval_paths",
    _RUNS_SQL + """SELECT e.id, coalesce(nullif(model_path, ''), CASE WHEN status = 'completed' THEN adapter_path END) AS model_path,
 coalesce(nullif(test_dataset_path, ''), dataset_path) AS test_dataset_path, coalesce(dataset_path, nullif(test_dataset_path, '')) AS correction_path
FROM e LEFT JOIN r ON r.id = e.training_run_id""",
)
def _(spark, sf):
    runs, evaluations = runs_and_evaluations(spark, sf)
    return C.resolve_eval_paths(evaluations, runs).select(
        "id", "model_path", "test_dataset_path", "correction_path"
    )


@check(
    "counters_after_delete",
    with_views(
        "cat_datasets", "qa",
        body="""SELECT d.id, greatest(0, actual_size - n) AS actual_size, greatest(0, valid_count - v) AS valid_count, greatest(0, invalid_count - (n - v)) AS invalid_count
FROM cat_datasets d, LATERAL (SELECT count(*) AS n, count(*) FILTER (is_valid) AS v FROM qa WHERE qa.dataset_id = d.id) x""",
    ),
)
def _(spark, sf):
    return C.counters_after_delete(view(spark, sf, "cat_datasets"), view(spark, sf, "qa")).select(
        "id", "actual_size", "valid_count", "invalid_count"
    )


@check(
    "latest_completed",
    with_views("cat_datasets", body="SELECT user_id, arg_max(id, (completed_at, id)) AS id FROM cat_datasets WHERE status = 'completed' GROUP BY 1"),
)
def _(spark, sf):
    return C.latest_completed(view(spark, sf, "cat_datasets")).select("user_id", "id")


@check(
    "page_with_total",
    with_views("cat_papers", body="SELECT id, title, (SELECT count(*) FROM cat_papers WHERE user_id = 1) AS total FROM cat_papers WHERE user_id = 1 ORDER BY id DESC LIMIT 50 OFFSET 50"),
)
def _(spark, sf):
    own = view(spark, sf, "cat_papers").filter("user_id = 1")
    return page_with_total(own, [F.col("id").desc()], 2, 50).select("id", "title", "total")


@check("page_after", with_views("qa", body="SELECT id, instruction FROM qa WHERE id > 500 ORDER BY id LIMIT 20"))
def _(spark, sf):
    return page_after(view(spark, sf, "qa"), "id", 500, 20).select("id", "instruction")


@check("training_data", with_views("qa", body="SELECT instruction, output FROM qa WHERE is_valid AND dataset_id = 1"))
def _(spark, sf):
    """The file of the dataset is missing, so its valid pairs are taken."""
    sets = view(spark, sf, "cat_datasets")
    user = sets.filter("id = 1").first()["user_id"]
    return D.training_data(spark, sets, view(spark, sf, "qa"), user, dataset_id=1)


@check("exported_dataset", with_views("qa", body="SELECT instruction, output, is_valid, was_healed, source_title FROM qa"))
def _(spark, sf):
    folder = f"{application_folder(spark)}/export-{uuid.uuid4().hex}"
    D.export_dataset(view(spark, sf, "qa"), folder)
    return spark.read.schema(
        "instruction string, output string, is_valid boolean, was_healed boolean, source_title string"
    ).json(folder)


@check("exported_training", with_views("qa", body="SELECT instruction, output FROM qa WHERE is_valid AND dataset_id = 1"))
def _(spark, sf):
    folder = f"{application_folder(spark)}/training-{uuid.uuid4().hex}"
    D.export_training(view(spark, sf, "qa"), 1, folder)
    return spark.read.schema("instruction string, output string").json(folder)


@check("training_rows", with_views("qa", body="SELECT instruction, output FROM qa WHERE is_valid AND dataset_id = 1"))
def _(spark, sf):
    return C.training_rows(view(spark, sf, "qa"), 1)


@check("export_rows", with_views("qa", body="SELECT instruction, output, is_valid, was_healed, source_title FROM qa"))
def _(spark, sf):
    return C.export_rows(view(spark, sf, "qa"))


@check(
    "source_rows",
    with_views(
        "cat_papers", "qa",
        body=f"""SELECT id, dataset_id, '['||title||']('||url||')' AS title, {et_al("string_split(source||'|b|c|'||id, '|')")} AS authors,
 CAST(year AS VARCHAR) AS year, source, (SELECT count(*) FROM qa WHERE qa.paper_id = p.id) AS qa_pair_count FROM cat_papers p""",
    ),
)
def _(spark, sf):
    papers = C.qa_counts(view(spark, sf, "cat_papers"), view(spark, sf, "qa"), "paper_id")
    authors = F.array(F.col("source"), F.lit("b"), F.lit("c"), F.col("id").cast("string"))
    return C.source_rows(papers.withColumn("authors", authors))


# Every second dataset has no stored counts, so its pairs are counted.
CARDS = """card AS (SELECT d.id, topic, CASE WHEN d.id % 2 = 0 THEN coalesce(n, 0) ELSE actual_size END AS pair_count,
 CASE WHEN d.id % 2 = 0 THEN coalesce(v, 0) ELSE valid_count END AS valid_count, coalesce(provider, 'unknown')||'/default' AS model
 FROM cat_datasets d LEFT JOIN (SELECT dataset_id, count(*) AS n, count(*) FILTER (is_valid) AS v FROM qa GROUP BY 1) q ON q.dataset_id = d.id)"""


def card_numbers(spark, sf):
    sets = view(spark, sf, "cat_datasets")
    stored = F.col("id") % 2 != 0
    sets = sets.withColumns(
        {
            "actual_size": F.when(stored, F.col("actual_size")).otherwise(F.lit(0)),
            "valid_count": F.when(stored, F.col("valid_count")), "prompt_tokens": F.lit(1234567).cast("bigint"),
            "completion_tokens": F.lit(0).cast("bigint"), "total_tokens": F.lit(None).cast("bigint"),
            "gpu_kwh": F.lit(0.5),
        }
    )
    return D.card_numbers(sets, view(spark, sf, "qa"))


@check(
    "card_numbers",
    with_views(
        "cat_datasets", "qa",
        body=f"""+ {CARDS} SELECT id, topic, lower(replace(topic, ' ', '-')) AS topic_tag, pair_count, valid_count,
 CASE WHEN pair_count >= 1000 THEN '1K<n<10K' ELSE 'n<1K' END AS size_category, model FROM card""",
    ),
)
def _(spark, sf):
    return card_numbers(spark, sf).select(
        "id", "topic", "topic_tag", "pair_count", "valid_count", "size_category", "model"
    )


@check(
    "dataset_card_sources",
    with_views(
        "cat_datasets", "cat_papers", "qa",
        body="""+ src AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY id) AS line_no, (SELECT count(*) FROM qa WHERE qa.paper_id = p.id) AS n
 FROM cat_papers p WHERE dataset_id IN (SELECT id FROM cat_datasets))
SELECT dataset_id AS id, line_no, '| '||line_no||' | ['||title||']('||url||') | '||source||' | '||year||' | '||source||' | '||n||' |' AS line FROM src WHERE line_no <= 3""",
    ),
)
def _(spark, sf):
    """The table of sources cut to the first three of every dataset, as a card on a screen shows it."""
    papers = C.qa_counts(view(spark, sf, "cat_papers"), view(spark, sf, "qa"), "paper_id")
    sources = C.source_rows(papers.withColumn("authors", F.array("source")))
    return D.dataset_card(card_numbers(spark, sf), sources, 3).filter("part = 1").select("id", "line_no", "line")


@check(
    "dataset_cards",
    with_views(
        "cat_datasets", "cat_papers", "qa",
        body=f"""+ {CARDS}, head AS (SELECT id, unnest(['# '||topic, 'size_categories: '||CASE WHEN pair_count >= 1000 THEN '1K<n<10K' ELSE 'n<1K' END,
 '| Total Q&A Pairs | '||pair_count||' |', '| Valid Pairs | '||valid_count||' |', '| Provider/Model | '||model||' |', '| Prompt Tokens | 1,234,567 |',
 '| Completion Tokens | 0 |', '| Total Tokens | 0 |', '| GPU Energy | 0.5000 kWh |']) AS line, unnest(range(9)) AS line_no FROM card),
src AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY id) AS rn, (SELECT count(*) FROM qa WHERE qa.paper_id = p.id) AS n FROM cat_papers p)
SELECT id, 0 AS part, line_no, line FROM head UNION ALL
SELECT dataset_id, 1, rn, '| '||rn||' | ['||title||']('||url||') | '||source||' | '||year||' | '||source||' | '||n||' |' FROM src WHERE dataset_id IN (SELECT id FROM cat_datasets)""",
    ),
)
def _(spark, sf):
    """The whole cards of all datasets."""
    papers = C.qa_counts(view(spark, sf, "cat_papers"), view(spark, sf, "qa"), "paper_id")
    sources = C.source_rows(papers.withColumn("authors", F.array("source")))
    return D.dataset_card(card_numbers(spark, sf), sources)


@check(
    "custom_selection",
    with_views(
        "cat_papers",
        body="""+ s AS (SELECT * FROM cat_papers WHERE citation_count >= 500), f AS (SELECT title, id FROM s ORDER BY id LIMIT 3)
SELECT 'Custom: '||string_agg(left(title, 40), ', ' ORDER BY id)||' (+'||((SELECT count(*) FROM s) - 3)||' more)' AS topic, ((SELECT count(*) FROM s) * 5)::INT AS target_size FROM f""",
    ),
)
def _(spark, sf):
    papers = view(spark, sf, "cat_papers")
    label = D.custom_selection(papers, papers.filter("citation_count >= 500").select("id"))[2]
    return label.withColumn("target_size", F.col("target_size").cast("int"))


# --- knowledge graph -------------------------------------------------------------------------


def graph(spark, sf):
    sets, qa = view(spark, sf, "cat_datasets"), view(spark, sf, "qa")
    papers = view(spark, sf, "cat_papers").withColumn("authors", F.array("source"))
    return G.knowledge_graph(sets, papers, qa, G.DRAWN)


GRAPH = f"""+
ds AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) - 1 AS cl FROM cat_datasets WHERE status = 'completed'),
col AS (SELECT ['#7eb8ff', '#6ee7d8', '#ffd666', '#c084fc', '#ff7eb3', '#a3e635', '#fb923c', '#60a5fa', '#f472b6', '#34d399'] AS c),
pp AS MATERIALIZED (SELECT p.*, coalesce(ds.cl, (SELECT count(*) FROM ds)) AS cl FROM cat_papers p LEFT JOIN ds ON ds.id = p.dataset_id),
cs AS MATERIALIZED (SELECT cl AS id, CASE WHEN topic <> '' THEN left(topic, 30) ELSE 'Dataset '||id END AS label, c[cl % 10 + 1] AS color,
  (SELECT count(*) FROM cat_papers p WHERE p.dataset_id = ds.id) AS paper_count FROM ds, col
 UNION ALL SELECT (SELECT count(*) FROM ds), 'uncategorized', '#888888', count(*) FROM pp WHERE cl = (SELECT count(*) FROM ds) HAVING count(*) > 0),
par AS (SELECT 0 AS kind, paper_id AS parent, id, row_number() OVER (PARTITION BY paper_id ORDER BY id) AS rn FROM qa WHERE paper_id IN (SELECT id FROM cat_papers)
 UNION ALL SELECT 1, dataset_id, id, row_number() OVER (PARTITION BY dataset_id ORDER BY id) FROM qa WHERE paper_id IS NULL AND dataset_id IN (SELECT id FROM ds)),
top AS (SELECT kind, parent, id FROM par WHERE rn <= CASE kind WHEN 0 THEN 2 ELSE 4 END),
run AS (SELECT kind, parent, sum(count(*)) OVER (ORDER BY kind, parent) - count(*) AS before FROM top GROUP BY kind, parent),
sq AS MATERIALIZED (SELECT top.* FROM top JOIN run USING (kind, parent) WHERE before < 150),
{keyword_rows("(SELECT * FROM cat_papers ORDER BY id LIMIT 200)", "id", "(title||chr(32)||abstract)")},
ed AS MATERIALIZED (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM kw x JOIN kw y ON x.w = y.w AND x.k < y.k GROUP BY 1, 2 HAVING count(*) >= 2),
nodes AS MATERIALIZED (
 SELECT 'dataset-'||ds.id AS id, 'dataset' AS type, coalesce(nullif(topic, ''), name) AS label, printf('%.1f', (least(20, 12 + log2(n + 1) * 1.5))::DOUBLE)::DOUBLE AS size,
  color, cl AS cluster, np||' papers, '||n||' Q&A pairs | '||coalesce(provider, 'unknown')||'/'||coalesce(model, 'default') AS abstract, n AS qa_pair_count, NULL::VARCHAR AS instruction, NULL::VARCHAR AS answer_text
 FROM ds JOIN cs ON cs.id = cl, LATERAL (SELECT count(*) AS n FROM qa WHERE qa.dataset_id = ds.id) q1, LATERAL (SELECT count(*) AS np FROM cat_papers p WHERE p.dataset_id = ds.id) q2
 UNION ALL SELECT 'paper-'||pp.id, 'paper', title, printf('%.1f', (4 + log2(n + 1) * 2 + log2(citation_count + 1) * 2)::DOUBLE)::DOUBLE, color, cl, left(abstract, 300), n, NULL::VARCHAR, NULL::VARCHAR
 FROM pp JOIN cs ON cs.id = cl, LATERAL (SELECT count(*) AS n FROM qa WHERE qa.paper_id = pp.id) q3
 UNION ALL SELECT 'qa-'||qa.id, 'qa', left(instruction, 50), 2.5, color, coalesce(pp.cl, ds.cl), NULL::VARCHAR, NULL::BIGINT, instruction, coalesce(nullif(answer_text, ''), left(output, 200))
 FROM sq JOIN qa ON qa.id = sq.id LEFT JOIN pp ON sq.kind = 0 AND pp.id = sq.parent LEFT JOIN ds ON sq.kind = 1 AND ds.id = sq.parent JOIN cs ON cs.id = coalesce(pp.cl, ds.cl)),
links AS MATERIALIZED (
 SELECT CASE kind WHEN 0 THEN 'paper-' ELSE 'dataset-' END||parent AS source, 'qa-'||id AS target, CASE kind WHEN 0 THEN 0.3 ELSE 0.2 END::DOUBLE AS weight, CASE kind WHEN 0 THEN 'paper_qa' ELSE 'dataset_qa' END AS type FROM sq
 UNION ALL SELECT 'dataset-'||dataset_id, 'paper-'||id, 0.5, 'dataset_paper' FROM cat_papers WHERE dataset_id IS NOT NULL
 UNION ALL SELECT 'paper-'||a, 'paper-'||b, shared / 10, 'keyword' FROM ed)
"""
_GV = ("cat_datasets", "cat_papers", "qa")
_NODE = ("id", "type", "label", "size", "color", "cluster", "abstract", "qa_pair_count", "instruction", "answer_text")


@check("graph_nodes", with_views(*_GV, body=GRAPH + f"SELECT {', '.join(_NODE)} FROM nodes"))
def _(spark, sf):
    return graph(spark, sf)[0].select(*_NODE)


@check("graph_links", with_views(*_GV, body=GRAPH + "SELECT * FROM links"))
def _(spark, sf):
    return graph(spark, sf)[1]


@check("graph_clusters", with_views(*_GV, body=GRAPH + "SELECT * FROM cs"))
def _(spark, sf):
    return graph(spark, sf)[2]


@check("sampled_qa", with_views(*_GV, body=GRAPH + "SELECT CASE kind WHEN 0 THEN 'paper' ELSE 'dataset' END AS parent_kind, parent, id FROM sq"))
def _(spark, sf):
    sets, papers, qa = (view(spark, sf, n) for n in _GV)
    sets = sets.filter("status = 'completed'")
    return G.sampled_qa(papers, sets, qa, G.DRAWN).select("parent_kind", "parent", "id")


def whole(spark, sf):
    """The graph of everything: all pairs, papers linked to their keywords."""
    sets, papers, qa = (view(spark, sf, n) for n in _GV)
    return G.knowledge_graph(sets, papers.withColumn("authors", F.array("source")), qa)


def _unlimited(sql):
    changes = (
        (" WHERE rn <= CASE kind WHEN 0 THEN 2 ELSE 4 END", ""), (" WHERE before < 150", ""),
        ("(SELECT * FROM cat_papers ORDER BY id LIMIT 200)", "cat_papers"),
        ("ed AS MATERIALIZED (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM kw x JOIN kw y ON x.w = y.w AND x.k < y.k GROUP BY 1, 2 HAVING count(*) >= 2),\n", ""),
        ("SELECT 'paper-'||a, 'paper-'||b, shared / 10, 'keyword' FROM ed", "SELECT 'paper-'||k, 'keyword-'||w, 0.1, 'paper_keyword' FROM kw"),
    )
    for old, new in changes:
        assert sql.count(old) == 1, old
        sql = sql.replace(old, new)
    return sql


WHOLE = _unlimited(GRAPH)


@check("graph_nodes_whole", with_views(*_GV, body=WHOLE + f"SELECT {', '.join(_NODE)} FROM nodes"))
def _(spark, sf):
    return whole(spark, sf)[0].select(*_NODE)


@check("graph_links_whole", with_views(*_GV, body=WHOLE + "SELECT * FROM links"))
def _(spark, sf):
    return whole(spark, sf)[1]


@check("all_qa", with_views(*_GV, body=WHOLE + "SELECT CASE kind WHEN 0 THEN 'paper' ELSE 'dataset' END AS parent_kind, parent, id FROM sq"))
def _(spark, sf):
    sets, papers, qa = (view(spark, sf, n) for n in _GV)
    return G.sampled_qa(papers, sets.filter("status = 'completed'"), qa).select("parent_kind", "parent", "id")


@check(
    "subgraph_whole",
    with_views(
        *_GV,
        body=WHOLE + """SELECT 'node' AS kind, id AS a, type AS b FROM nodes WHERE cluster = 1 UNION ALL
SELECT 'link', source, target FROM links WHERE source IN (SELECT id FROM nodes WHERE cluster = 1) AND target IN (SELECT id FROM nodes WHERE cluster = 1)""",
    ),
)
def _(spark, sf):
    nodes, links, _clusters = whole(spark, sf)
    n, l = G.subgraph(nodes, links, 1)
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b")).unionByName(
        l.select(F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"))
    )


@check(
    "node_matches_whole",
    with_views(*_GV, body=WHOLE + "SELECT id, contains(lower(label), 'der') OR (type = 'qa' AND coalesce(contains(lower(instruction), 'der'), false)) AS match FROM nodes"),
)
def _(spark, sf):
    return G.with_match(whole(spark, sf)[0], "Der").select("id", "match")


@check("keyword_edges", with_views(*_GV, body=GRAPH + "SELECT a, b, shared, shared / 10 AS weight FROM ed"))
def _(spark, sf):
    return G.keyword_edges(view(spark, sf, "cat_papers").orderBy("id").limit(G.DRAWN.edge_papers))


@check(
    "paper_links",
    with_views("cat_papers", body=f"""+ {keyword_rows("cat_papers", "id", "(title||chr(32)||abstract)")},
two AS (SELECT x.k AS a, y.k AS b FROM kw x JOIN kw y ON x.w = y.w AND x.k <> y.k GROUP BY 1, 2 HAVING count(*) >= 2),
n AS (SELECT a, count(*) AS links FROM two GROUP BY 1)
SELECT id, coalesce(links, 0) AS links FROM cat_papers LEFT JOIN n ON a = id"""),
)
def _(spark, sf):
    """Links of every paper to all others."""
    return G.link_counts(view(spark, sf, "cat_papers"))


@check(
    "paper_keywords_links",
    with_views("cat_papers", body=f"""+ {keyword_rows("cat_papers", "id", "(title||chr(32)||abstract)")}
SELECT 'paper-'||k AS source, 'keyword-'||w AS target, 0.1::DOUBLE AS weight, 'paper_keyword' AS type FROM kw"""),
)
def _(spark, sf):
    """Links of the whole graph between papers and keywords, over all papers."""
    sets, papers, qa = (view(spark, sf, n) for n in _GV)
    links = G.knowledge_graph(sets, papers.withColumn("authors", F.array("source")), qa)[1]
    return links.filter("type = 'paper_keyword'")


@check(
    "graph_all_pairs",
    with_views(*_GV, body="""SELECT 'qa-'||id AS target, 'paper-'||paper_id AS source, 'paper_qa' AS type FROM qa WHERE paper_id IN (SELECT id FROM cat_papers)
 UNION ALL SELECT 'qa-'||id, 'dataset-'||dataset_id, 'dataset_qa' FROM qa WHERE paper_id IS NULL AND dataset_id IN (SELECT id FROM cat_datasets WHERE status = 'completed')"""),
)
def _(spark, sf):
    """Links of the whole graph to all pairs."""
    sets, papers, qa = (view(spark, sf, n) for n in _GV)
    links = G.knowledge_graph(sets, papers.withColumn("authors", F.array("source")), qa)[1]
    return links.filter("type LIKE '%_qa'").select("target", "source", "type")


@check(
    "subgraph",
    with_views(
        *_GV,
        body=GRAPH + """SELECT 'node' AS kind, id AS a, type AS b FROM nodes WHERE cluster = 1 UNION ALL
SELECT 'link', source, target FROM links WHERE source IN (SELECT id FROM nodes WHERE cluster = 1) AND target IN (SELECT id FROM nodes WHERE cluster = 1)""",
    ),
)
def _(spark, sf):
    nodes, links, _clusters = graph(spark, sf)
    n, l = G.subgraph(nodes, links, 1)
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("type").alias("b")).unionByName(
        l.select(F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"))
    )


@check("cluster_papers", with_views(*_GV, body=GRAPH + "SELECT id, label FROM nodes WHERE type = 'paper' AND cluster = 2"))
def _(spark, sf):
    return G.cluster_papers(graph(spark, sf)[0], 2).select("id", "label")


@check(
    "node_matches",
    with_views(*_GV, body=GRAPH + "SELECT id, contains(lower(label), 'der') OR (type = 'qa' AND coalesce(contains(lower(instruction), 'der'), false)) AS match FROM nodes"),
)
def _(spark, sf):
    return G.with_match(graph(spark, sf)[0], "Der").select("id", "match")


@check(
    "expand_paper",
    with_views(
        *_GV,
        body=GRAPH + """, gone AS (SELECT target FROM links WHERE source = 'paper-2' AND type = 'paper_qa'),
q AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT * FROM qa WHERE paper_id = 2 ORDER BY id LIMIT 30))
SELECT 'node' AS kind, id AS a, label AS b FROM nodes WHERE id NOT IN (SELECT target FROM gone)
UNION ALL SELECT 'node', 'qa-exp-'||i, left(instruction, 50) FROM q
UNION ALL SELECT 'link', source, target FROM links WHERE target NOT IN (SELECT target FROM gone)
UNION ALL SELECT 'link', 'paper-2', 'qa-exp-'||i FROM q""",
    ),
)
def _(spark, sf):
    nodes, links, _clusters = graph(spark, sf)
    n, l = G.expand_paper(nodes, links, view(spark, sf, "qa"), 2, shown=30)
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b")).unionByName(
        l.select(F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"))
    )


@check(
    "node_sizes",
    with_views(
        "cat_papers",
        body="SELECT id, printf('%.1f', (least(20, 12 + log2(citation_count + 1) * 1.5))::DOUBLE)::DOUBLE AS dataset_size, printf('%.1f', (4 + log2(id + 1) * 2 + log2(citation_count + 1) * 2)::DOUBLE)::DOUBLE AS paper_size FROM cat_papers",
    ),
)
def _(spark, sf):
    return view(spark, sf, "cat_papers").select(
        "id", S.dataset_node_size(F.col("citation_count")).alias("dataset_size"),
        S.paper_node_size(F.col("id"), F.col("citation_count")).alias("paper_size"),
    )


# --- attempts --------------------------------------------------------------------------------

BEST = """+
fv AS (SELECT item_id, min(attempt) FILTER (valid AND output IS NOT NULL) AS fv, max(attempt) FILTER (output IS NOT NULL) AS lv, count(*) AS n FROM attempts GROUP BY 1),
best AS (SELECT f.item_id, a.attempt, a.output, fv IS NOT NULL AS valid, coalesce(fv, n) AS attempts_used
 FROM fv f JOIN attempts a ON a.item_id = f.item_id AND a.attempt = coalesce(fv, lv))
"""


@check("best_attempt", with_views("attempts", body=BEST + "SELECT item_id, attempt, output, valid, attempts_used FROM best"))
def _(spark, sf):
    return A.best_attempt(view(spark, sf, "attempts"), "item_id")


@check(
    "generation_summary",
    with_views(
        "attempts",
        body=BEST + """SELECT count(lv) AS processed, count(fv) AS valid, count(lv) - count(fv) AS invalid_kept, count(*) - count(lv) AS skipped,
 sum(coalesce(fv, n) - 1)::BIGINT AS total_retries, printf('%.1f', (100.0 * count(fv) / count(lv))::DOUBLE)::DOUBLE AS valid_pct FROM fv""",
    ),
)
def _(spark, sf):
    return A.generation_summary(view(spark, sf, "attempts"), "item_id")


@check(
    "token_usage",
    with_views("attempts", body="SELECT count(*) AS request_count, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens, (sum(total_tokens) // count(*))::BIGINT AS avg_tokens FROM attempts"),
)
def _(spark, sf):
    return A.usage(view(spark, sf, "attempts"))


@check(
    "generation_progress",
    """WITH r AS (SELECT row_number() OVER (ORDER BY event_id) AS processed, sum(CAST(event_type = 'purchase' AS INT)) OVER (ORDER BY event_id)::BIGINT AS valid_so_far FROM events)
SELECT processed, valid_so_far, printf('%.1f', (100.0 * valid_so_far / processed)::DOUBLE)::DOUBLE AS valid_pct FROM r WHERE processed % 25 = 0""",
)
def _(spark, sf):
    best = table(spark, sf, "events").select(
        "event_id", (F.col("event_type") == "purchase").alias("valid")
    )
    return A.progress(best, "event_id")


@check(
    "resume_missing",
    with_views("attempts", body="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM attempts WHERE valid)"),
)
def _(spark, sf):
    done = view(spark, sf, "attempts").filter("valid").select(F.col("item_id").alias("doc_id"))
    return A.missing_items(table(spark, sf, "documents").select("doc_id"), done, "doc_id")


@check(
    "resume_by_position",
    "SELECT doc_id FROM documents WHERE doc_id + 1 > (SELECT count(*) FROM labels)",
)
def _(spark, sf):
    done = table(spark, sf, "labels").count()
    items = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") + 1).alias("position"))
    return A.missing_items_by_position(items, done, "position").select("doc_id")


def echo_answer():
    """A stand-in completion: tagged for most prompts, nothing for some."""

    def call(systems, users):
        return [
            None if len(u) % 5 == 0
            else f"<think>{u}</think><answer>{u}</answer>" if len(u) % 3 else f"<answer>{u}"
            for u in users
        ]

    return call


ECHO_TASK = Task(
    "s", "Q: {question} A: {answer}", max_retries=3,
    rules=Rules(require_tags=(("<think>", "</think>"), ("<answer>", "</answer>")), min_reasoning_length=40),
)
_ECHO = """+ p AS (SELECT line_no, instruction, 'Q: '||instruction||' A: '||source_title AS u FROM sourced),
g AS (SELECT *, length(u) % 5 <> 0 AND length(u) % 3 <> 0 AND length(trim(u)) >= 40 AS ok FROM p)
"""


@check(
    "generate_attempts",
    with_views("sourced", body=_ECHO + "SELECT line_no, attempt::INT AS attempt, ok AS valid, length(u) % 5 <> 0 AS given FROM g, (SELECT unnest([1, 2, 3]) AS attempt) WHERE attempt = 1 OR NOT ok"),
)
def _(spark, sf):
    items = view(spark, sf, "sourced").select(
        "line_no", F.col("instruction").alias("question"), F.col("source_title").alias("answer")
    )
    return P.generate(items, echo_answer(), ECHO_TASK, "line_no").select(
        "line_no", "attempt", "valid", F.col("output").isNotNull().alias("given")
    )


@check(
    "generated_samples",
    with_views("sourced", body=_ECHO + "SELECT line_no, instruction, CASE WHEN length(u) % 3 <> 0 THEN '<think>'||u||'</think><answer>'||u||'</answer>' ELSE '<answer>'||u END AS output, ok AS valid FROM g WHERE length(u) % 5 <> 0"),
)
def _(spark, sf):
    items = view(spark, sf, "sourced").select(
        "line_no", F.col("instruction").alias("question"), F.col("source_title").alias("answer")
    )
    attempts = P.generate(items, echo_answer(), ECHO_TASK, "line_no")
    return P.generated_samples(attempts, items, "line_no")
