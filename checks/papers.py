"""Checks of paper metadata, de-duplication, chunking, prompts, pairs, citations, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.sqlparts import chunked, english, keyword_rows, last_sentences, query_rows, strip
from checks.views import table, view, with_views
from sparkcurate.config import Task
from sparkcurate.functions import papers as C
from sparkcurate.functions import prompts as R
from sparkcurate.functions import text as X
from sparkcurate.functions.scoring import paper_targets
from sparkcurate.operators.chunking import chunk_texts
from sparkcurate.operators.completion import complete_with_retry
from sparkcurate.operators.graph import paper_text, top_keywords
from sparkcurate.operators.ranking import first_per_key
from sparkcurate.plans import datasets as D
from sparkcurate.plans import papers as P
from sparkcurate.sources.readers import normalise_arxiv_records, normalise_index_records

QUERIES, ORACLE = {}, {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def j(x):
    return f"json_extract_string(record, '{x}')"


@check(
    "index_records",
    with_views(
        "index_records",
        body=f"""SELECT pos, CASE WHEN {j('$.externalIds.ArXiv')} IS NOT NULL THEN 'arxiv:'||{j('$.externalIds.ArXiv')}
 WHEN {j('$.externalIds.DOI')} IS NOT NULL THEN 'doi:'||{j('$.externalIds.DOI')} ELSE 's2:'||{j('$.paperId')} END AS paper_id,
 coalesce({j('$.title')}, '') AS title,
 CASE WHEN json_array_length(record, '$.authors') = 2 THEN 'A|' ELSE '' END AS authors,
 coalesce({j('$.abstract')}, '') AS abstract, CAST({j('$.year')} AS INT) AS year, {j('$.externalIds.DOI')} AS doi, '' AS url,
 {j('$.openAccessPdf.url')} AS pdf_url, 'semantic_scholar' AS source, coalesce(CAST({j('$.citationCount')} AS BIGINT), 0) AS citation_count FROM index_records""",
    ),
)
def _(spark, sf):
    return normalise_index_records(view(spark, sf, "index_records")).withColumn(
        "authors", F.array_join("authors", "|")
    ).drop("full_text")


@check(
    "arxiv_records",
    """SELECT doc_id AS pos, 'arxiv:'||doc_id||'.'||length(text) AS paper_id, text AS title, source AS authors, text AS abstract,
 2024 AS year, 'http://arxiv.org/abs/old/abs/'||doc_id||'.'||length(text) AS url, 0::BIGINT AS citation_count, 'arxiv' AS source FROM documents""",
)
def _(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("http://arxiv.org/abs/old/abs/"), F.col("doc_id").cast("string"), F.lit("."), F.length("text").cast("string")).alias("entry_id"),
        F.col("text").alias("title"), F.array("source").alias("authors"), F.col("text").alias("summary"),
        F.lit("2024-05-06").cast("timestamp").alias("published"), F.lit(None).cast("string").alias("doi"),
        F.lit(None).cast("string").alias("pdf_url"),
    )
    return normalise_arxiv_records(raw).select(
        "pos", "paper_id", "title", F.array_join("authors", "|").alias("authors"), "abstract", "year",
        "url", "citation_count", "source",
    )


@check(
    "paper_scalars",
    with_views(
        "papers",
        body=rf"""SELECT pos, left(regexp_replace(title, '[^a-zA-Z0-9_-]', '_', 'g'), 50) AS slug,
 left(regexp_replace(title, '[^a-zA-Z0-9_ -]', '', 'g'), 80) AS name, {strip('lower(title)')} AS title_key,
 CASE WHEN pos % 3 = 0 THEN 'arxiv:1.'||pos WHEN pos % 3 = 1 THEN 'doi:10/'||pos ELSE 's2:unknown' END AS pid,
 CASE WHEN pos % 2 = 0 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/'||title ELSE 'https://ftp.example.org/ftp://ftp.ncbi.nlm.nih.gov/pub/pmc/' END AS pmc,
 length({strip('full_text')}) > 100 AS has_text FROM papers""",
    ),
)
def _(spark, sf):
    pos, title = F.col("pos"), F.col("title")
    arxiv = F.when(pos % 3 == 0, F.concat(F.lit("1."), pos.cast("string"))).otherwise("")
    doi = F.when(pos % 3 == 1, F.concat(F.lit("10/"), pos.cast("string")))
    link = F.when(pos % 2 == 0, F.concat(F.lit("ftp://ftp.ncbi.nlm.nih.gov/pub/pmc/"), title)).otherwise(
        "https://ftp.example.org/ftp://ftp.ncbi.nlm.nih.gov/pub/pmc/"
    )
    return view(spark, sf, "papers").select(
        "pos", X.slug(title).alias("slug"), X.display_name(title).alias("name"),
        C.title_key(title).alias("title_key"),
        C.paper_id(arxiv, doi, F.lit(None).cast("string")).alias("pid"),
        C.rewrite_pmc_link(link).alias("pmc"), C.has_full_text(F.col("full_text")).alias("has_text"),
    )


@check("english_filter", with_views("papers", body=f"SELECT pos, title FROM papers WHERE {english('(title||chr(32)||abstract)')}"))
def _(spark, sf):
    return P.english_only(view(spark, sf, "papers")).select("pos", "title")


@check("full_text_gate", with_views("papers", body=f"SELECT pos FROM papers WHERE length({strip('full_text')}) > 100"))
def _(spark, sf):
    return view(spark, sf, "papers").filter(C.has_full_text(F.col("full_text"))).select("pos")


# The greedy walk, one row at a time, over hashed titles.
GREEDY = f"""+
o AS MATERIALIZED (SELECT *, md5({strip('lower(title)')}) AS tk, row_number() OVER (ORDER BY source_rank, pos) AS rn
  FROM papers WHERE {english('(title||chr(32)||abstract)')}),
walk AS (
 SELECT 0::BIGINT AS rn, []::VARCHAR[] AS ids, []::VARCHAR[] AS tks, false AS keep
 UNION ALL
 SELECT o.rn, CASE WHEN seen THEN w.ids ELSE list_append(w.ids, o.paper_id) END,
  CASE WHEN seen THEN w.tks ELSE list_append(w.tks, o.tk) END, NOT seen
 FROM walk w JOIN (SELECT rn, paper_id, tk FROM o) o ON o.rn = w.rn + 1,
  LATERAL (SELECT list_contains(w.ids, o.paper_id) OR list_contains(w.tks, o.tk) AS seen)),
kept AS (SELECT o.* FROM o JOIN walk USING (rn) WHERE walk.keep)
"""


@check("greedy_dedup", with_views("papers", body=GREEDY + "SELECT source_rank, pos, paper_id, title FROM kept"))
def _(spark, sf):
    return P.distinct_papers(view(spark, sf, "papers")).select("source_rank", "pos", "paper_id", "title")


@check(
    "collect_papers",
    with_views("papers", body=GREEDY + "SELECT source, pos, paper_id, citation_count FROM kept ORDER BY citation_count DESC, source_rank, pos LIMIT 20"),
)
def _(spark, sf):
    papers = view(spark, sf, "papers")
    sources = [papers.filter(F.col("source_rank") == r).drop("source_rank") for r in (0, 1)]
    return P.collect_papers(sources, 20).select("source", "pos", "paper_id", "citation_count")


@check(
    "topic_papers",
    with_views(
        "papers",
        body=f"""+
q AS (SELECT *, lang AS topic, md5({strip('lower(title)')}) AS tk FROM papers WHERE {english('(title||chr(32)||abstract)')}),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY source_rank, pos) AS rn FROM q),
walk AS (
 SELECT DISTINCT topic, 0::BIGINT AS rn, []::VARCHAR[] AS ids, []::VARCHAR[] AS tks, false AS keep FROM o
 UNION ALL
 SELECT o.topic, o.rn, CASE WHEN seen THEN w.ids ELSE list_append(w.ids, o.paper_id) END,
  CASE WHEN seen THEN w.tks ELSE list_append(w.tks, o.tk) END, NOT seen
 FROM walk w JOIN (SELECT topic, rn, paper_id, tk FROM o) o ON o.rn = w.rn + 1 AND o.topic = w.topic,
  LATERAL (SELECT list_contains(w.ids, o.paper_id) OR list_contains(w.tks, o.tk) AS seen)),
t AS (SELECT lang AS topic, greatest(10, ceil(count(*) / 3))::BIGINT AS max_papers FROM documents GROUP BY lang),
r AS (SELECT o.topic, o.pos, row_number() OVER (PARTITION BY o.topic ORDER BY citation_count DESC, source_rank, pos) AS rank
  FROM o JOIN walk USING (topic, rn) WHERE walk.keep)
SELECT topic, pos, rank, rank <= greatest(5, max_papers // 4) AS fetch FROM r JOIN t USING (topic) WHERE rank <= max_papers""",
    ),
)
def _(spark, sf):
    topics = table(spark, sf, "documents").groupBy(F.col("lang").alias("topic")).agg(
        F.count(F.lit(1)).alias("target")
    )
    papers = view(spark, sf, "papers").withColumn("topic", F.col("lang"))
    return P.topic_papers(topics, papers).select(
        "topic", "pos", F.col("rank").cast("bigint").alias("rank"), "fetch"
    )


@check(
    "paper_targets",
    """SELECT doc_id, greatest(10, ceil(n_chars / 3.0))::BIGINT AS max_papers,
 greatest(5, greatest(10, ceil(n_chars / 3.0))::BIGINT // 4)::BIGINT AS top_n FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", paper_targets(F.col("n_chars")).alias("s")
    ).select("doc_id", "s.*")


# Fetched addresses: direct, canonical and fall-back ones, some too short, some failed.
FETCHED = """SELECT 'https://arxiv.org/pdf/'||CAST(doc_id AS VARCHAR(20)) AS url,
 CASE WHEN doc_id % 6 = 0 THEN 'too short' ELSE text END AS text, 'a'||CAST(doc_id AS VARCHAR(20)) AS pdf_path FROM {documents}
UNION ALL SELECT 'pdf:'||CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 4 = 0 THEN text END,
 CASE WHEN doc_id % 8 <> 1 THEN 'd'||CAST(doc_id AS VARCHAR(20)) END FROM {documents}
UNION ALL SELECT 'un:'||CAST(doc_id AS VARCHAR(20)), text, CAST(NULL AS VARCHAR(20)) FROM {documents}"""
RESOLVABLE = """SELECT CASE WHEN doc_id % 2 = 0 THEN 'arxiv:'||CAST(doc_id AS VARCHAR(20)) ELSE 's2:'||CAST(doc_id AS VARCHAR(20)) END AS paper_id,
 CASE WHEN doc_id % 3 <> 0 THEN 'pdf:'||CAST(doc_id AS VARCHAR(20)) END AS pdf_url,
 CASE WHEN doc_id % 5 <> 0 THEN '10/x' ELSE '' END AS doi,
 CASE WHEN doc_id % 7 = 0 THEN 'pdf:'||CAST(doc_id AS VARCHAR(20)) END AS pmc_url,
 'un:'||CAST(doc_id AS VARCHAR(20)) AS unpaywall_url FROM {documents}"""


@check(
    "resolve_full_text",
    f"""WITH f AS ({FETCHED.format(documents='documents')}), p AS ({RESOLVABLE.format(documents='documents')}),
u AS (SELECT paper_id, 1 AS nr, pdf_url AS url FROM p UNION ALL SELECT paper_id, 2, 'https://arxiv.org/pdf/'||paper_id[7:] FROM p WHERE paper_id LIKE 'arxiv:%'
 UNION ALL SELECT paper_id, 3, pmc_url FROM p WHERE doi <> '' UNION ALL SELECT paper_id, 4, unpaywall_url FROM p WHERE doi <> ''),
d AS (SELECT paper_id, url, min(nr) AS nr FROM u WHERE url IS NOT NULL GROUP BY ALL),
t AS (SELECT paper_id, nr, text, pdf_path, length({strip('text')}) > 100 AS good FROM d JOIN f USING (url)),
w AS (SELECT paper_id, min(nr) FILTER (good) AS won FROM t GROUP BY paper_id)
SELECT p.paper_id, {strip('(SELECT text FROM t WHERE t.paper_id = p.paper_id AND t.nr = won)')} AS full_text,
 (SELECT max_by(pdf_path, nr) FROM t WHERE t.paper_id = p.paper_id AND pdf_path IS NOT NULL AND (won IS NULL OR nr <= won)) AS pdf_path
FROM p LEFT JOIN w USING (paper_id)""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    papers = spark.sql(RESOLVABLE, documents=docs)
    return P.resolve_full_text(papers, spark.sql(FETCHED, documents=docs)).select(
        "paper_id", "full_text", "pdf_path"
    )


@check("last_sentences", f"SELECT doc_id, {last_sentences('text')} AS tail FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.last_sentences(F.col("text")).alias("tail"))


CHUNK_OUT = f"""SELECT a.k AS doc_id, a.idx::INT AS chunk_index, a.total::INT AS chunk_count,
 CASE WHEN b.plain IS NULL THEN '' ELSE {last_sentences('b.plain')}||chr(10)||chr(10) END||a.plain AS chunk
FROM ch a LEFT JOIN ch b ON b.k = a.k AND b.idx = a.idx - 1"""


@check("chunk_texts", "WITH " + chunked("documents", "doc_id", "text", 1000, "chr(10)") + CHUNK_OUT)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunk_texts(docs, "text", 1000, "\n").drop("text")


TASK = Task("System.", "Title: {title} {{by}} {authors}\n{content}\nEnd.", max_retries=2)
PROMPT_SQL = f"""
SELECT 'p'||a.k AS paper_id, a.idx::INT AS section,
 'System.'||chr(10)||chr(10)||CASE WHEN length(abstract_or_text) > 12000 THEN 'Generate 3-4 Q&A pairs from this section (section '||a.idx||'/'||a.total||' of the paper).'
  WHEN length(abstract_or_text) < 2000 THEN 'Generate 3-5 Q&A pairs from this content.' ELSE 'Generate 6-8 Q&A pairs from this content.' END AS system_prompt,
 'Title: '||title||' {{by}} '||source||', B'||chr(10)||CASE WHEN b.plain IS NULL THEN '' ELSE {last_sentences('b.plain')}||chr(10)||chr(10) END||a.plain||chr(10)||'End.' AS user_prompt
FROM ch a LEFT JOIN ch b ON b.k = a.k AND b.idx = a.idx - 1 JOIN (SELECT pos, title, source, full_text AS abstract_or_text FROM library) l ON l.pos = a.k"""


def library(spark, sf):
    return view(spark, sf, "library").withColumn("authors", F.array(F.col("source"), F.lit("B")))


@check(
    "paper_prompts",
    with_views("library", body="+" + chunked("library", "pos", "full_text", 10000, "chr(10)", 12000) + PROMPT_SQL.replace("{{by}}", "{by}")),
)
def _(spark, sf):
    return P.paper_prompts(library(spark, sf), TASK, "\n")


def pair_block(x, tag):
    return strip(f"regexp_extract({x}, '(?is)<{tag}>(.*?)</{tag}>', 1)")


PAIRS = f"""+
b AS (SELECT paper_id, sample_id, unnest(list_filter(regexp_extract_all(output, '(?is)<qa>(.*?)</qa>', 1),
  lambda z: regexp_matches(z, '(?is)<question>.*?</question>') AND regexp_matches(z, '(?is)<answer>.*?</answer>'))) AS z,
  generate_subscripts(list_filter(regexp_extract_all(output, '(?is)<qa>(.*?)</qa>', 1),
  lambda z: regexp_matches(z, '(?is)<question>.*?</question>') AND regexp_matches(z, '(?is)<answer>.*?</answer>')), 1) - 1 AS pair FROM completions),
pairs AS (SELECT paper_id, pair, {pair_block('z', 'question')} AS instruction,
 CASE WHEN {pair_block('z', 'think')} <> '' THEN '<think>'||{pair_block('z', 'think')}||'</think>'||chr(10) ELSE '' END||'<answer>'||{pair_block('z', 'answer')}||'</answer>' AS output FROM b)
"""


@check("parse_pairs", with_views("completions", body=PAIRS + "SELECT paper_id, pair::INT AS pair, instruction, output, true AS valid FROM pairs"))
def _(spark, sf):
    return P.parse_pairs(view(spark, sf, "completions")).drop("sample_id")


@check(
    "pairs_with_paper",
    with_views("completions", "library", body=PAIRS + "SELECT p.paper_id AS source_paper, pair::INT AS pair, instruction, title AS source_title, year, url, citation_count FROM pairs p JOIN library USING (paper_id)"),
)
def _(spark, sf):
    pairs = P.parse_pairs(view(spark, sf, "completions"))
    papers = library(spark, sf).withColumn("doi", F.lit(None).cast("string"))
    return P.with_paper(pairs, papers).select(
        "source_paper", "pair", "instruction", "source_title", "year", "url", "citation_count"
    )


def echo_pairs():
    """A stand-in completion: a pair for long prompts, nothing usable for short ones."""

    def call(systems, users):
        return [
            {"text": f"<qa><question>Q {len(u)}?</question><answer>{u}</answer></qa>", "total_tokens": len(u)}
            if len(u) >= 600 else "no pairs here"
            for u in users
        ]

    return call


_ECHO = chunked("library", "pos", "full_text", 10000, "chr(10)", 12000) + ", prompts AS (" + PROMPT_SQL.replace("{{by}}", "{by}") + ")"


@check(
    "papers_to_qa",
    with_views("library", body="+" + _ECHO + f"SELECT paper_id AS source_paper, section, 'Q '||length(user_prompt)||'?' AS instruction, '<answer>'||{strip('user_prompt')}||'</answer>' AS output FROM prompts WHERE length(user_prompt) >= 600"),
)
def _(spark, sf):
    papers = library(spark, sf).withColumn("doi", F.lit(None).cast("string"))
    samples, _attempts = P.papers_to_qa(papers, echo_pairs(), TASK, "\n")
    return samples.select("source_paper", "section", "instruction", "output")


# Every paper is found for one of two topics, a third of them for one more.
TOPICS = f"""+
lib2 AS (SELECT * REPLACE ('The paper of number '||pos AS title) FROM library),
{_ECHO.replace("library", "lib2")},
found AS (SELECT CASE pos % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS topic, paper_id FROM lib2
 UNION ALL SELECT 'third', paper_id FROM lib2 WHERE pos % 3 = 0),
asked AS (SELECT p.* FROM prompts p JOIN lib2 l USING (paper_id) WHERE length({strip('full_text')}) > 100 AND length(user_prompt) >= 600),
smp AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY paper_id, section) AS line_no, paper_id AS source_paper, section,
 'Q '||length(user_prompt)||'?' AS instruction, '<answer>'||{strip('user_prompt')}||'</answer>' AS output FROM asked JOIN found USING (paper_id))
"""


def built(spark, sf):
    papers = library(spark, sf).withColumns(
        {
            "title": F.concat(F.lit("The paper of number "), F.col("pos").cast("string")),
            "doi": F.lit(None).cast("string"), "pdf_url": F.concat("url", F.lit(".pdf")), "source_rank": F.lit(0),
        }
    )
    fetched = papers.select(F.col("pdf_url").alias("url"), F.col("full_text").alias("text"), F.lit("x").alias("pdf_path"))
    papers = papers.drop("full_text").withColumn(
        "topic",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("pos") % 2 == 0, "even").otherwise("odd"), F.when(F.col("pos") % 3 == 0, "third")
                )
            )
        ),
    )
    # As many pairs are wanted as fetch every paper.
    topics = papers.groupBy("topic").agg((F.count(F.lit(1)) * 12 + 60).alias("target"))
    return D.build_dataset(topics, papers, fetched, echo_pairs(), TASK, "\n")


@check("topic_samples", with_views("library", body=TOPICS + "SELECT * FROM smp"))
def _(spark, sf):
    return built(spark, sf).samples.select("topic", "line_no", "source_paper", "section", "instruction", "output")


@check(
    "topic_citations",
    with_views("library", body=TOPICS + """SELECT topic, source_paper AS paper_id, min(line_no) AS line_no, any_value(title) AS title,
 (SELECT count(DISTINCT source_paper) FROM smp t WHERE t.topic = smp.topic) AS total_papers FROM smp JOIN lib2 ON lib2.paper_id = smp.source_paper GROUP BY topic, source_paper"""),
)
def _(spark, sf):
    done = built(spark, sf)
    return done.citations.join(done.citation_totals, "topic").select(
        "topic", "paper_id", "line_no", "title", "total_papers"
    )


@check("topic_stats", with_views("library", body=TOPICS + "SELECT topic, count(*) AS total FROM smp GROUP BY topic"))
def _(spark, sf):
    return built(spark, sf).stats.select("topic", "total")


@check(
    "completion_attempts",
    with_views("library", body="+" + _ECHO + """SELECT paper_id, section, attempt::INT AS attempt, length(user_prompt) >= 600 AS valid FROM prompts, (SELECT unnest([1, 2]) AS attempt)
 WHERE attempt = 1 OR length(user_prompt) < 600"""),
)
def _(spark, sf):
    prompts = P.paper_prompts(library(spark, sf), TASK, "\n")
    return complete_with_retry(prompts, echo_pairs(), P.has_pairs, 2).select(
        "paper_id", "section", "attempt", "valid"
    )


@check(
    "citation_log",
    with_views(
        "sourced",
        body="""SELECT 's2:'||doc_id AS paper_id, split_part(text, chr(10), 1) AS title,
 (SELECT count(*) FROM sourced WHERE source_paper = 's2:'||d.doc_id) AS qa_pairs_generated FROM documents d""",
    ),
)
def _(spark, sf):
    papers = view(spark, sf, "cat_papers").withColumns(
        {"authors": F.array("source"), "doi": F.lit(None).cast("string")}
    )
    return P.citation_log(papers, view(spark, sf, "sourced")).select(
        "paper_id", "title", "qa_pairs_generated"
    )


@check(
    "citations",
    with_views(
        "sourced",
        body="""+ r AS (SELECT 0 AS f, * FROM sourced UNION ALL SELECT 1, * FROM sourced WHERE valid),
k AS (SELECT *, row_number() OVER (PARTITION BY source_paper ORDER BY f, line_no) AS rn FROM r WHERE source_paper <> '')
SELECT source_paper AS paper_id, source_title AS title, year, abstract, citation_count, line_no,
 (SELECT count(DISTINCT source_paper) FROM sourced WHERE source_paper <> '') AS total_papers FROM k WHERE rn = 1""",
    ),
)
def _(spark, sf):
    raw = view(spark, sf, "sourced")
    cited = P.citations(raw, raw.filter("valid"))
    return cited.crossJoin(F.broadcast(P.citation_totals(cited, ()))).select(
        "paper_id", "title", "year", "abstract", "citation_count", "line_no", "total_papers"
    )


@check(
    "first_per_paper",
    with_views("sourced", body="SELECT source_paper, min(line_no) AS line_no FROM sourced WHERE source_paper <> '' GROUP BY 1"),
)
def _(spark, sf):
    return first_per_key(view(spark, sf, "sourced"), "source_paper", ["line_no"]).select(
        "source_paper", "line_no"
    )


@check(
    "content_census",
    with_views("library", body="SELECT count(*) FILTER (pos % 3 = 0) AS full_text_count, count(*) FILTER (abstract <> '' AND pos % 3 <> 0) AS abstract_only_count FROM library"),
)
def _(spark, sf):
    papers = view(spark, sf, "library").withColumn(
        "full_text", F.when(F.col("pos") % 3 == 0, F.col("full_text")).otherwise("")
    )
    return P.content_census(papers)


@check(
    "ranked_for_fetch",
    with_views("papers", body="SELECT pos, citation_count FROM papers ORDER BY citation_count DESC, pos LIMIT 25"),
)
def _(spark, sf):
    return P.ranked_for_fetch(view(spark, sf, "papers"), 25, ["pos"]).select("pos", "citation_count")


@check(
    "keywords",
    with_views("library", body="+" + keyword_rows("library", "paper_id", "(title||chr(32)||abstract)") + "SELECT k AS paper_id, string_agg(w, ' ' ORDER BY rn) AS keywords FROM kw GROUP BY k"),
)
def _(spark, sf):
    return (
        top_keywords(view(spark, sf, "library"), paper_text())
        .select("paper_id", F.array_join("keywords", " ").alias("keywords")).filter("keywords <> ''")
    )


@check(
    "query_keywords",
    "WITH " + query_rows("documents", "doc_id", "(chr(36)||lang||chr(36)||text)")
    + " SELECT doc_id, coalesce(query, '') AS query FROM documents LEFT JOIN qw ON k = doc_id",
)
def _(spark, sf):
    question = F.concat(F.lit("$"), F.col("lang"), F.lit("$"), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(X.query_keywords(question), " ").alias("query")
    )


@check(
    "author_lines",
    """SELECT doc_id, array_to_string(string_split(source||'|'||lang||'|c|d|e|f', '|')[1:5], ', ') AS five,
 source||', '||lang||', c et al.' AS three, source||', '||lang AS two FROM documents""",
)
def _(spark, sf):
    a = F.split(F.concat("source", F.lit("|"), "lang", F.lit("|c|d|e|f")), r"\|")
    return table(spark, sf, "documents").select(
        "doc_id", R.author_line(a).alias("five"), R.author_line_et_al(a).alias("three"),
        R.author_line_et_al(F.slice(a, 1, 2)).alias("two"),
    )


# --- whole datasets --------------------------------------------------------------------------


def tagged_pairs():
    """A stand-in completion with a valid pair, except that some answers are too short."""

    def call(systems, users):
        return [
            f"<qa><question>Q {len(u)}?</question><think>Step 1. {u}</think><answer>"
            + ("short" if len(u) % 4 == 0 else u) + "</answer></qa>"
            for u in users
        ]

    return call


TOPIC_FETCH = """SELECT 'arxiv:'||CAST(doc_id AS VARCHAR(20)) AS paper_id, doc_id AS pos, 0 AS source_rank, lang AS topic,
 split_part(text, chr(10), 1)||' '||CAST(doc_id AS VARCHAR(20)) AS title, text AS abstract, (doc_id * 7919) % 1000 AS citation_count, source FROM {documents}"""


@check(
    "build_dataset",
    f"""WITH p AS ({TOPIC_FETCH.format(documents='documents')}),
t AS (SELECT lang AS topic, greatest(10, ceil(count(*) / 3))::BIGINT AS m FROM documents GROUP BY lang),
r AS (SELECT p.*, row_number() OVER (PARTITION BY topic ORDER BY citation_count DESC, pos) AS rank FROM p WHERE {english("(title||' '||abstract)")}),
f AS (SELECT r.*, {strip('abstract')} AS full_text FROM r JOIN t USING (topic) WHERE rank <= m AND rank <= greatest(5, m // 4) AND length({strip('abstract')}) > 100),
"""
    + chunked("f", "pos", "full_text", 10000, "chr(10)", 12000)
    + f""",
u AS (SELECT f.paper_id, a.idx, 'T: '||f.title||chr(10)||CASE WHEN b.plain IS NULL THEN '' ELSE {last_sentences('b.plain')}||chr(10)||chr(10) END||a.plain AS u
 FROM ch a LEFT JOIN ch b ON b.k = a.k AND b.idx = a.idx - 1 JOIN f ON f.pos = a.k),
o AS (SELECT paper_id, idx, u, '<think>Step 1. '||u||'</think>'||chr(10)||'<answer>'||CASE WHEN length(u) % 4 = 0 THEN 'short' ELSE {strip('u')} END||'</answer>' AS output FROM u)
SELECT paper_id AS source_paper, count(*) AS samples, count(*) FILTER (length(u) % 4 <> 0 AND length({strip('u')}) >= 10
  AND length({strip("'Step 1. '||u")}) >= 100
  AND NOT (len(string_split(output, '.')) > 5 AND len(list_distinct(list_transform(list_filter(list_transform(string_split(output, '.'), lambda s: {strip('s')}), lambda s: length(s) > 30), lambda s: lower(left(s, 30))))) < len(string_split(output, '.')) * 0.5)) AS kept
FROM o GROUP BY 1""",
)
def _(spark, sf):
    from sparkcurate.config import Rules
    from sparkcurate.plans.datasets import build_dataset

    docs = table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    papers = spark.sql(TOPIC_FETCH, documents=docs).withColumns(
        {"authors": F.array("source"), "year": F.lit(2024), "doi": none, "url": none, "pdf_url": none, "full_text": none}
    )
    fetched = docs.select(
        F.concat(F.lit("https://arxiv.org/pdf/"), F.col("doc_id").cast("string")).alias("url"), "text",
        none.alias("pdf_path"),
    )
    topics = docs.groupBy(F.col("lang").alias("topic")).agg(F.count(F.lit(1)).alias("target"))
    task = Task("s", "T: {title}\n{content}", Rules(check_latex_consistency=False))
    built = build_dataset(topics, papers, fetched, tagged_pairs(), task, "\n")
    return built.filtered.decided.groupBy("source_paper").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("keep").alias("kept")
    )
