"""Checks of judge parsing, retrieval, prompts, evaluation and correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.papers import library
from checks.sqlparts import et_al, query_rows, strip
from checks.views import table, view, with_views
from sparkcurate.functions import prompts as R
from sparkcurate.functions import scoring as S
from sparkcurate.functions.text import query_keywords
from sparkcurate.operators import attempts as A
from sparkcurate.operators import evaluation as E
from sparkcurate.operators.retrieval import retrieve
from sparkcurate.plans import evaluation as P

QUERIES, ORACLE = {}, {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def score(name, x="judge_response"):
    g = f"regexp_extract({x}, '(?i){name}:\\s*(\\d+)', 1)"
    return f"CASE WHEN {g} = '' THEN 0 ELSE least(100, CAST({g} AS BIGINT)) END"


PARSED = f"""+
js AS MATERIALIZED (SELECT idx, judge_response, {score('FACTUAL_ACCURACY')} AS fa, {score('COMPLETENESS')} AS co, {score('TECHNICAL_PRECISION')} AS tp,
 {strip("regexp_extract(judge_response, '(?is)JUSTIFICATION:\\s*(.+)', 1)")} AS justification FROM judge),
jo AS MATERIALIZED (SELECT *, fa * 0.5::DOUBLE + co * 0.3::DOUBLE + tp * 0.2::DOUBLE AS overall FROM js)
"""


def parsed(spark, sf):
    return E.parse_judge(view(spark, sf, "judge"))


@check(
    "judge_scores",
    with_views("judge", body=PARSED + "SELECT idx, fa::INT AS fa, co::INT AS co, tp::INT AS tp, round(overall, 6) AS overall, justification, overall > 0 AS scored FROM jo"),
)
def _(spark, sf):
    return parsed(spark, sf).select(
        "idx", F.col("scores.factual_accuracy").alias("fa"), F.col("scores.completeness").alias("co"),
        F.col("scores.technical_precision").alias("tp"), F.round("overall_score", 6).alias("overall"),
        "justification",
        (S.eval_class(F.col("skipped"), F.col("overall_score")) == "scored").alias("scored"),
    )


_SKIP = "idx % 10 = 0"


@check(
    "evaluation_summary",
    with_views(
        "judge",
        body=PARSED + f"""SELECT round(avg(fa) FILTER (NOT ({_SKIP}) AND overall > 0), 6) AS factual_accuracy, round(avg(co) FILTER (NOT ({_SKIP}) AND overall > 0), 6) AS completeness,
 round(avg(tp) FILTER (NOT ({_SKIP}) AND overall > 0), 6) AS technical_precision, round(avg(overall) FILTER (NOT ({_SKIP}) AND overall > 0), 6) AS overall_accuracy,
 count(*) FILTER (NOT ({_SKIP}) AND overall > 0) AS samples_scored, count(*) FILTER ({_SKIP}) AS samples_skipped, count(*) FILTER (NOT ({_SKIP}) AND overall = 0) AS samples_failed FROM jo""",
    ),
)
def _(spark, sf):
    df = E.summarise_eval(parsed(spark, sf).withColumn("skipped", F.expr(_SKIP)))
    rounded = ("factual_accuracy", "completeness", "technical_precision", "overall_accuracy")
    return df.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in df.columns])


@check("select_corrections", with_views("judge", body=PARSED + "SELECT idx, round(overall, 6) AS overall FROM jo WHERE overall < 50"))
def _(spark, sf):
    return E.select_corrections(parsed(spark, sf)).select("idx", F.round("overall_score", 6).alias("overall"))


@check(
    "select_corrections_fallback",
    with_views("judge", body=PARSED + "SELECT idx FROM jo WHERE CASE WHEN fa <> 0 THEN fa ELSE co END < 40"),
)
def _(spark, sf):
    flat = parsed(spark, sf).select(
        "idx", F.col("scores.factual_accuracy").cast("double").alias("overall_accuracy"),
        F.col("scores.completeness").cast("double").alias("score"),
    )
    return E.select_corrections(flat, 40.0, "overall_accuracy", "score").select("idx")


# Evaluation attempts, four per question: some failed, some all zero.
EVAL_ATTEMPTS = """SELECT CAST(floor(event_id / 4) AS BIGINT) AS question_id, event_id % 4 + 1 AS attempt,
 event_type IN ('error', 'view', 'click') AS skipped,
 CASE event_type WHEN 'error' THEN 'Judge model failed' WHEN 'view' THEN 'No response' WHEN 'click' THEN 'No Semantic Scholar Articles found' END AS reason,
 CASE WHEN event_id % 2 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS points, event_id FROM {events}"""


@check(
    "final_evaluation",
    f"""WITH e AS ({EVAL_ATTEMPTS.format(events='events')}),
a AS (SELECT *, NOT skipped AND points > 0 AS good FROM e WHERE attempt <= 3),
w AS (SELECT question_id, coalesce(min(attempt) FILTER (good), max(attempt)) AS attempt FROM a GROUP BY 1)
SELECT question_id, attempt, skipped, reason, points, event_id FROM a JOIN w USING (question_id, attempt)""",
)
def _(spark, sf):
    rows = spark.sql(EVAL_ATTEMPTS, events=table(spark, sf, "events"))
    scored = rows.withColumn(
        "scores", F.struct(*[F.col("points").alias(n) for n in S.DIMENSIONS])
    ).withColumn("overall_score", F.col("points").cast("double"))
    return A.final_evaluation(scored, "question_id").select(
        "question_id", "attempt", "skipped", "reason", "points", "event_id"
    )


# --- retrieval -------------------------------------------------------------------------------

QUESTIONS = """SELECT id AS question_id, instruction AS question, output AS reference,
 CASE WHEN id % 6 = 0 THEN '' ELSE output||' '||instruction END AS answer FROM (SELECT * FROM qa_view)"""
WORD_ROWS = """
pw AS MATERIALIZED (SELECT DISTINCT paper_id, citation_count, unnest(regexp_extract_all(lower(title||' '||abstract), '[a-z]{{3,}}')) AS w FROM library WHERE abstract <> '')"""


def hits(queries, name, k=5):
    """CTEs: (query, paper_id, rank) for the distinct queries of CTE ``queries``."""
    return f"""
{name}_q AS (SELECT DISTINCT query FROM {queries}),
{name}_m AS (SELECT DISTINCT q.query, pw.paper_id, pw.citation_count FROM (SELECT query, unnest(string_split(query, ' ')) AS w FROM {name}_q) q JOIN pw USING (w)),
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY citation_count DESC, paper_id) AS rank FROM {name}_m) WHERE rank <= {k})"""


RETRIEVAL = "+" + WORD_ROWS.replace("{{", "{").replace("}}", "}") + ", " + query_rows("qa", "id", "instruction") + ", " + hits("qw", "hit")


@check("retrieval", with_views("qa", "library", body=RETRIEVAL + " SELECT query, paper_id, citation_count, rank::INT AS rank FROM hit"))
def _(spark, sf):
    questions = view(spark, sf, "qa").withColumnRenamed("instruction", "question")
    return retrieve(questions, view(spark, sf, "library"))


def entry_sql(cte):
    return f"""(SELECT h.query, string_agg('['||rank||'] '||title||' ('||year||')'||chr(10)||'    Authors: '||{et_al("[l.source, 'B', 'C', 'D']")}||chr(10)||'    Citations: '||h.citation_count||chr(10)
 ||'    Abstract: '||CASE WHEN length(abstract) > 500 THEN left(abstract, 500)||'...' ELSE abstract END, chr(10)||chr(10) ORDER BY rank) AS ctx FROM {cte} h JOIN library l USING (paper_id) GROUP BY h.query)"""


GROUNDED = (
    RETRIEVAL + ", rf AS (SELECT id, left(output, 300) AS r FROM qa WHERE length(output) > 50), "
    + query_rows("rf", "id", "r", "rq") + ", " + hits("rq", "rhit") + f"""
, qc AS {entry_sql('hit')}, rc AS {entry_sql('rhit')},
gr AS MATERIALIZED (SELECT id, instruction, output, qw.query, CASE WHEN qc.ctx IS NOT NULL AND rc.ctx IS NOT NULL
  THEN 'Academic context from question:'||chr(10)||qc.ctx||chr(10)||chr(10)||'Additional context from reference topic:'||chr(10)||rc.ctx ELSE coalesce(qc.ctx, rc.ctx, '') END AS context
 FROM qa LEFT JOIN qw ON qw.k = id LEFT JOIN qc ON qc.query = qw.query LEFT JOIN rq ON rq.k = id LEFT JOIN rc ON rc.query = rq.query)
"""
)


def questions(spark, sf):
    return view(spark, sf, "qa").select(
        F.col("id").alias("question_id"), F.col("instruction").alias("question"),
        F.col("output").alias("reference"),
        F.when(F.col("id") % 6 == 0, "").otherwise(F.concat("output", F.lit(" "), "instruction")).alias("answer"),
    )


def full_library(spark, sf):
    return library(spark, sf).withColumns(
        {"authors": F.array(F.col("source"), F.lit("B"), F.lit("C"), F.lit("D")),
         "pdf_url": F.lit(None).cast("string")}
    )


@check("grounded_context", with_views("qa", "library", body=GROUNDED + "SELECT id AS question_id, context FROM gr"))
def _(spark, sf):
    return P.grounded_questions(questions(spark, sf), full_library(spark, sf), "question_id").select(
        "question_id", "context"
    )


_JUDGE_SQL = (
    "'Q: '||left(instruction, 1500)||chr(10)||'A: '||left(output||' '||instruction, 2000)||chr(10)||'R: '||left(output, 1500)||chr(10)||'C: '||left(context, 3000)"
)


@check("judge_prompts", with_views("qa", "library", body=GROUNDED + f"SELECT id AS question_id, {_JUDGE_SQL} AS prompt FROM gr WHERE id % 6 <> 0 AND context <> ''"))
def _(spark, sf):
    grounded = P.grounded_questions(questions(spark, sf), full_library(spark, sf), "question_id")
    rows = P.judge_prompts(grounded)
    template = "Q: {question}\nA: {answer}\nR: {reference}\nC: {context}"
    return rows.select(
        "question_id",
        R.judge_prompt(
            F.col("question"), F.col("answer"), F.col("reference"), F.col("context"), template
        ).alias("prompt"),
    )


@check(
    "article_log",
    with_views(
        "qa", "library",
        body=RETRIEVAL + """ SELECT id AS question_id, coalesce(query, '') AS query, coalesce((SELECT string_agg(paper_id, ' ' ORDER BY rank) FROM hit WHERE hit.query = qw.query), '') AS papers FROM qa LEFT JOIN qw ON k = id""",
    ),
)
def _(spark, sf):
    log = P.article_log(questions(spark, sf), full_library(spark, sf), "question_id")
    return log.select(
        "question_id", "query",
        F.array_join(F.transform("papers_retrieved", lambda p: p["paper_id"]), " ").alias("papers"),
    )


def length_judge():
    """A stand-in judge: scores from the length of the prompt, nothing for some prompts."""

    def call(systems, users):
        return [
            None if len(u) % 7 == 0
            else f"FACTUAL_ACCURACY: {len(u) % 101}\nCOMPLETENESS: {len(u) % 83}\nTECHNICAL_PRECISION: 40\nJUSTIFICATION: ok"
            for u in users
        ]

    return call


_TEMPLATE_CHARS = len(R.JUDGE_TEMPLATE.format(question="", answer="", reference="", context=""))
_LEN = f"({_TEMPLATE_CHARS} + length(left(instruction, 1500)) + length(left(output||' '||instruction, 2000)) + length(left(output, 1500)) + length(left(context, 3000)))"
_EVALUATED = GROUNDED + f""", ev AS MATERIALIZED (SELECT id AS question_id, CASE WHEN id % 6 = 0 THEN 'No response' WHEN context = '' THEN 'No Semantic Scholar articles found'
  WHEN {_LEN} % 7 = 0 THEN 'Judge model failed' END AS reason, {_LEN} % 101 * 0.5::DOUBLE + {_LEN} % 83 * 0.3::DOUBLE + 40 * 0.2::DOUBLE AS overall FROM gr)
"""


@check(
    "evaluate",
    with_views("qa", "library", body=_EVALUATED + "SELECT question_id, reason, reason IS NOT NULL AS skipped, CASE WHEN reason IS NULL THEN round(overall, 6) END AS overall FROM ev"),
)
def _(spark, sf):
    done = P.evaluate(questions(spark, sf), full_library(spark, sf), length_judge(), "question_id")
    return done.results.select(
        "question_id", "reason", "skipped", F.round("overall_score", 6).alias("overall")
    )


@check(
    "evaluate_summary",
    with_views(
        "qa", "library",
        body=_EVALUATED + "SELECT round(avg(overall) FILTER (reason IS NULL), 6) AS overall_accuracy, count(*) FILTER (reason IS NULL) AS samples_scored, count(*) FILTER (reason IS NOT NULL) AS samples_skipped, 0::BIGINT AS samples_failed FROM ev",
    ),
)
def _(spark, sf):
    done = P.evaluate(questions(spark, sf), full_library(spark, sf), length_judge(), "question_id")
    return done.summary.select(
        F.round("overall_accuracy", 6).alias("overall_accuracy"), "samples_scored",
        "samples_skipped", "samples_failed",
    )


@check(
    "attach_sources",
    """WITH l AS (SELECT doc_id % 100 AS question_index, max(doc_id) AS log_seq FROM documents WHERE doc_id % 100 < 90 GROUP BY 1)
SELECT label AS idx, vec_id, coalesce('t'||log_seq, '') AS titles FROM embeddings e LEFT JOIN l ON l.question_index = e.vec_id % 100""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").filter("doc_id % 100 < 90")
    none = F.lit(None).cast("string")
    log = docs.select(
        (F.col("doc_id") % 100).alias("question_index"), F.col("doc_id").alias("log_seq"),
        F.array(
            F.struct(
                F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"),
                F.lit(2020).alias("year"), F.array("source").alias("authors"), none.alias("url"),
                none.alias("pdf_url"), F.lit(None).cast("boolean").alias("is_open_access"),
            )
        ).alias("papers_retrieved"),
    )
    results = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 100).alias("question_index"), "vec_id", F.col("label").alias("idx")
    )
    return E.attach_sources(results, log).select(
        "idx", "vec_id",
        F.array_join(F.transform("rag_sources", lambda s: s["title"]), " ").alias("titles"),
    )


@check(
    "map_questions",
    with_views("sourced", body="SELECT line_no, instruction AS question, output AS reference, CASE WHEN line_no % 2 = 0 THEN source ELSE 'Physics' END AS topic FROM sourced"),
)
def _(spark, sf):
    rows = view(spark, sf, "sourced").select(
        "line_no", "instruction", "output",
        F.when(F.col("line_no") % 2 == 0, F.col("source")).alias("sub_topic"),
    )
    return P.map_questions(rows, domain="Physics")


@check("query_text", "WITH " + query_rows("documents", "doc_id", "text") + " SELECT k AS doc_id, query FROM qw")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(query_keywords(F.col("text")), " ").alias("query")
    ).filter("query <> ''")


# --- correction ------------------------------------------------------------------------------

# Replies: fenced JSON, bare JSON, broken JSON, JSON with an empty answer.
REPLIES = """SELECT doc_id, CASE doc_id % 4
 WHEN 0 THEN 'Sure:'||chr(10)||'```json'||chr(10)||'{{"instruction": "q'||CAST(doc_id AS VARCHAR(20))||'", "output": "'||body||'"}}'||chr(10)||'```'||chr(10)||'bye'
 WHEN 1 THEN ' {{"instruction": "q'||CAST(doc_id AS VARCHAR(20))||'", "output": "'||body||'"}} '
 WHEN 2 THEN '{{"instruction": '||body ELSE '```{{"instruction": "q", "output": ""}}```' END AS reply
FROM (SELECT doc_id, replace(replace(replace(text, chr(92), chr(92)||chr(92)), chr(34), chr(92)||chr(34)), chr(10), chr(92)||'n') AS body FROM {documents})"""


def replies(spark, sf):
    rows = spark.sql(REPLIES, documents=table(spark, sf, "documents"))
    return rows.withColumn("correction", R.parsed_correction(F.col("reply")))


@check(
    "parsed_corrections",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'q'||doc_id WHEN 1 THEN 'q'||doc_id WHEN 3 THEN 'q' END AS instruction,
 CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 3 THEN '' END AS output FROM documents""",
)
def _(spark, sf):
    return replies(spark, sf).select("doc_id", "correction.instruction", "correction.output")


@check(
    "correction_summary",
    """SELECT count(*) AS total_failing, count(*) FILTER (doc_id % 4 <> 2) AS corrected, count(*) FILTER (doc_id % 4 = 2) AS errors,
 count(*) FILTER (doc_id % 4 < 2) AS appended FROM documents""",
)
def _(spark, sf):
    return E.correction_summary(replies(spark, sf))


@check(
    "append_corrections",
    with_views("qa", body="SELECT instruction, output FROM qa WHERE is_valid UNION ALL SELECT 'q'||doc_id, text FROM documents WHERE doc_id % 4 < 2"),
)
def _(spark, sf):
    training = view(spark, sf, "qa").filter("is_valid").select("instruction", "output")
    return P.append_corrections(training, replies(spark, sf).select("correction.*"))


def rewrite():
    """A stand-in editor: a JSON answer holding the length of the prompt, broken for some."""

    def call(systems, users):
        return [
            "no json" if len(u) % 4 == 0 else f'```json\n{{"instruction": "i", "output": "{len(u)}"}}\n```'
            for u in users
        ]

    return call


_CORRECTION_CHARS = len(
    R.CORRECTION_TEMPLATE.format(instruction="", output="", reference="", context="")
)


@check(
    "apply_corrections",
    with_views(
        "judge",
        body=PARSED + f""", f AS (SELECT {_CORRECTION_CHARS} + length('q'||idx) + 2 * length(judge_response) AS n FROM jo WHERE overall < 50)
SELECT 'i' AS instruction, CAST(n AS VARCHAR) AS output, (SELECT count(*) FROM f) AS failing FROM f WHERE n % 4 <> 0""",
    ),
)
def _(spark, sf):
    results = parsed(spark, sf).withColumns(
        {"question": F.concat(F.lit("q"), F.col("idx").cast("string")),
         "answer": F.col("judge_response"), "reference": F.col("judge_response")}
    )
    done = P.apply_corrections(results, None, rewrite())
    failing = done.summary.first()["total_failing"]
    return done.corrected.withColumn("failing", F.lit(failing).cast("bigint"))


@check(
    "corrections_with_log",
    with_views(
        "judge",
        body=PARSED + f""", f AS (SELECT {_CORRECTION_CHARS} + length('q'||idx) + 2 * length(judge_response)
  + coalesce((SELECT 5 + length(source) + length(text) FROM documents WHERE doc_id = idx AND doc_id % 2 = 0), 0) AS n FROM jo WHERE overall < 50)
SELECT 'i' AS instruction, CAST(n AS VARCHAR) AS output, (SELECT count(*) FROM f) AS failing FROM f WHERE n % 4 <> 0""",
    ),
)
def _(spark, sf):
    """Every prompt shows the papers of its own question; questions with odd ids have none in the log."""
    results = parsed(spark, sf).withColumns(
        {"question": F.concat(F.lit("q"), F.col("idx").cast("string")),
         "answer": F.col("judge_response"), "reference": F.col("judge_response")}
    )
    paper = F.struct(F.col("source").alias("title"), F.col("text").alias("abstract"))
    log = table(spark, sf, "documents").filter("doc_id % 2 = 0").select(
        F.col("doc_id").alias("question_index"), F.array(paper).alias("papers_retrieved")
    )
    done = P.apply_corrections(results, log, rewrite(), key="idx")
    failing = done.summary.first()["total_failing"]
    return done.corrected.withColumn("failing", F.lit(failing).cast("bigint"))


@check(
    "context_papers",
    "SELECT * FROM (SELECT text AS title, source AS abstract FROM documents ORDER BY doc_id, title LIMIT 10)",
)
def _(spark, sf):
    log = table(spark, sf, "documents").select(
        F.col("doc_id").alias("question_index"),
        F.array(F.struct(F.col("text").alias("title"), F.col("source").alias("abstract"))).alias("papers_retrieved"),
    )
    return E.context_papers(log).select("title", "abstract")


@check(
    "trial_summary",
    """SELECT count(*) AS total, count(*) FILTER (doc_id % 10 < 6) AS pass, count(*) FILTER (doc_id % 10 IN (6, 7)) AS marginal,
 count(*) FILTER (doc_id % 10 = 8) AS fail, count(*) FILTER (doc_id % 10 = 9) AS error, round(avg(n_chars), 6) AS avg_seconds,
 round(avg(doc_id % 5) FILTER (doc_id % 10 <> 9), 6) AS avg_domain_score, 4 AS max_domain_total, count(*) FILTER (doc_id % 10 < 8) / count(*) >= 0.8 AS ready FROM documents""",
)
def _(spark, sf):
    d = F.col("doc_id") % 10
    rows = table(spark, sf, "documents").select(
        F.when(d < 6, "PASS").when(d < 8, "MARGINAL").when(d == 8, "FAIL").otherwise("ERROR").alias("quality"),
        F.col("n_chars").cast("double").alias("seconds"),
        F.when(
            d != 9, F.struct((F.col("doc_id") % 5).alias("domain_score"), F.lit(4).alias("domain_total"))
        ).alias("flags"),
    )
    s = E.trial_summary(rows)
    return s.withColumns({c: F.round(c, 6) for c in ("avg_seconds", "avg_domain_score")})
