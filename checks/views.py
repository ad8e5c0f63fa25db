"""Inputs of the checks, derived from the given tables by SQL that means the same in both engines.

Whole tables and whole texts: a view only rearranges what a row holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "conversations", "labels", "events", "benchmark", "embeddings", "pages")

# One kind of tag damage per sample_id % 13.
SAMPLES = """
SELECT doc_id AS sample_id, instruction,
 CASE doc_id % 13
  WHEN 0 THEN '<think>'||nl||'Step 1. '||body||' $x = 1$'||nl||'</think>'||nl||'<answer>'||nl||'The value is $x = 1$ here. '||instruction||nl||'</answer>'
  WHEN 1 THEN '<think>First, '||body||'</think><answer>The result stays positive '||instruction
  WHEN 2 THEN '<think>'||body||'</think><answer>yes'
  WHEN 3 THEN '<think>1. '||body||' gives '||bs||'boxed{{x_{{1}} = 42}}</think>'||nl||'done'
  WHEN 4 THEN '<think>'||body||'</think>'||nl||'Therefore, the sum equals forty two.'
  WHEN 5 THEN '<think>'||body||' '||bs||'boxed{{7}}</think><answer> </answer>'
  WHEN 6 THEN 'Let us begin. '||body||'</think><answer>The limit is $0$ exactly.</answer>'
  WHEN 7 THEN '<THINK>'||body||'<answer>The limit is $0$ exactly.</answer>'
  WHEN 8 THEN '<answer>Because of order.</answer><think>'||body||'</think>'
  WHEN 9 THEN body||' costs $5 and '||bs||'$6'
  WHEN 10 THEN '<think>'||repeat(body||' ', 3)||'</think><answer>It loops $a$ times.</answer>'
  WHEN 11 THEN '<think>'||body||'. Hence it holds. '||instruction
  ELSE body||' '||bs||'boxed{{7}}</think><answer> </answer>' END AS output
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS instruction, text AS body,
             chr(10) AS nl, chr(92) AS bs FROM {documents})
"""

# Two sources with colliding ids and titles; the order is (source_rank, pos).
PAPERS = """
SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS source_rank,
 CASE WHEN doc_id % 3 = 0 THEN 'arxiv' ELSE 'semantic_scholar' END AS source,
 CASE WHEN doc_id % 5 = 0 THEN 'arxiv:'||CAST(doc_id - doc_id % 15 AS VARCHAR(20))
      WHEN doc_id % 5 = 1 THEN 'doi:10.1/'||CAST(doc_id - doc_id % 20 AS VARCHAR(20))
      ELSE 's2:'||CAST(doc_id AS VARCHAR(20)) END AS paper_id,
 CASE WHEN doc_id % 7 = 0 AND lang = 'en' THEN upper(split_part(text, chr(10), 1))
      ELSE split_part(text, chr(10), 1) END AS title,
 text AS abstract, CAST(2000 + doc_id % 25 AS INT) AS year, (doc_id * 7919) % 1000 AS citation_count,
 text AS full_text, lang
FROM {documents}
"""

# Papers with unique ids: one per document.
LIBRARY = """
SELECT 'p'||CAST(doc_id AS VARCHAR(20)) AS paper_id, split_part(text, chr(10), 1) AS title,
 CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS abstract, CAST(2000 + doc_id % 25 AS INT) AS year,
 (doc_id * 7919) % 1000 AS citation_count, text AS full_text, source,
 'https://example.org/'||CAST(doc_id AS VARCHAR(20)) AS url, doc_id AS pos
FROM {documents}
"""

# A user turn and the assistant turn after it.
QA = """
SELECT u.conv_id * 100 + u.turn + 1 AS id,
 CASE WHEN (u.conv_id + u.turn) % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE u.conv_id + 1 END AS paper_id,
 CAST(floor(u.conv_id / 100) AS BIGINT) + 1 AS dataset_id,
 u.text AS instruction, a.text AS output, (u.conv_id + u.turn) % 7 <> 0 AS is_valid,
 u.turn % 4 = 0 AS was_healed, '' AS think_text, a.text AS answer_text,
 'title '||CAST(u.conv_id AS VARCHAR(20)) AS source_title
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""

CATALOGUE_PAPERS = """
SELECT doc_id + 1 AS id, 's2:'||CAST(doc_id AS VARCHAR(20)) AS paper_id,
 split_part(text, chr(10), 1) AS title, text AS abstract, CAST(2000 + doc_id % 25 AS INT) AS year,
 (doc_id * 7919) % 1000 AS citation_count, 'https://example.org/'||CAST(doc_id AS VARCHAR(20)) AS url,
 source, doc_id % 3 + 1 AS user_id,
 CASE WHEN doc_id % 10 = 3 THEN CAST(NULL AS BIGINT)
      ELSE CAST(floor(doc_id / 100) AS BIGINT) + 1 END AS dataset_id
FROM {documents}
"""

CATALOGUE_DATASETS = """
SELECT CAST(floor(doc_id / 100) AS BIGINT) + 1 AS id, min(doc_id) % 3 + 1 AS user_id,
 'set '||CAST(CAST(floor(min(doc_id) / 100) AS BIGINT) AS VARCHAR(20)) AS name,
 CASE WHEN floor(min(doc_id) / 100) % 4 = 3 THEN '' ELSE min_by(source, (doc_id * 7919) % 1009) END AS topic,
 CASE WHEN floor(min(doc_id) / 100) % 5 = 4 THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN min(doc_id) % 200 = 0 THEN 'openai' ELSE CAST(NULL AS VARCHAR(20)) END AS provider,
 CAST(NULL AS VARCHAR(20)) AS model, CAST(sum(n_chars) AS BIGINT) AS completed_at, count(*) AS actual_size,
 count(*) - 7 AS valid_count, CAST(7 AS BIGINT) AS invalid_count,
 'out/'||CAST(min(doc_id) AS VARCHAR(20)) AS output_path
FROM {documents} GROUP BY CAST(floor(doc_id / 100) AS BIGINT) + 1
"""

# Judge replies: empty, without scores, all zero, mixed case, above 100.
JUDGE = """
SELECT doc_id AS idx, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'no scores given'
 WHEN 2 THEN 'FACTUAL_ACCURACY: 0'||chr(10)||'COMPLETENESS: 0'||chr(10)||'TECHNICAL_PRECISION: 0'
 ELSE 'Factual_Accuracy: '||CAST((doc_id * 37) % 140 AS VARCHAR(20))||chr(10)||'COMPLETENESS:  '||CAST((doc_id * 53) % 101 AS VARCHAR(20))||chr(10)||'TECHNICAL_PRECISION: '||CAST(quality * 60 + toxic * 20 AS VARCHAR(20))||chr(10)||'JUSTIFICATION: Cited.'||chr(10)||'More.' END AS judge_response
FROM {labels}
"""

POWER = "SELECT user_id AS device, ts, value AS watts FROM {events}"

JOB_EVENTS = """
SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'view' THEN 'pending'
 WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
 ELSE 'cancelled' END AS status
FROM {events}
"""

# Generation attempts, five per item; a null output is a failed call.
ATTEMPTS = """
SELECT CAST(floor(event_id / 5) AS BIGINT) AS item_id, event_id % 5 + 1 AS attempt,
 CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type||CAST(event_id AS VARCHAR(20)) END AS output,
 event_type = 'purchase' AS valid,
 CAST(floor(value) AS BIGINT) AS prompt_tokens, CAST(floor(value / 2) AS BIGINT) AS completion_tokens,
 CAST(floor(value) AS BIGINT) + CAST(floor(value / 2) AS BIGINT) AS total_tokens
FROM {events}
"""

# JSON lines made of documents: whole samples, bare text, blank lines, samples too short to count.
LINES = """
SELECT doc_id, CASE doc_id % 5
 WHEN 0 THEN '{{"instruction": "'||head||'", "output": "'||body||'", "valid": true}}'
 WHEN 1 THEN body
 WHEN 2 THEN ''
 WHEN 3 THEN '{{"instruction": "'||body||'", "output": "'||body||'"}}'
 ELSE '  {{"instruction": "'||body||'", "output": " ok "}} ' END AS value
FROM (SELECT doc_id,
        replace(replace(replace(split_part(text, chr(10), 1), chr(92), chr(92)||chr(92)), chr(34), chr(92)||chr(34)), chr(10), chr(92)||'n') AS head,
        replace(replace(replace(text, chr(92), chr(92)||chr(92)), chr(34), chr(92)||chr(34)), chr(10), chr(92)||'n') AS body
      FROM {documents})
"""

# Raw records of the citation index as JSON text.
INDEX_RECORDS = """
SELECT doc_id AS pos, '{{"paperId": "x'||CAST(doc_id AS VARCHAR(20))||'", "title": '||
 CASE WHEN doc_id % 6 = 5 THEN 'null' ELSE '"'||head||'"' END||
 ', "authors": '||CASE WHEN doc_id % 4 = 3 THEN 'null' ELSE '[{{"name": "A"}}, {{"name": null}}]' END||
 ', "abstract": '||CASE WHEN doc_id % 5 = 4 THEN 'null' ELSE '"'||body||'"' END||
 ', "year": '||CAST(2000 + doc_id % 25 AS VARCHAR(20))||
 ', "externalIds": '||CASE doc_id % 4 WHEN 0 THEN '{{"ArXiv": "24.'||CAST(doc_id AS VARCHAR(20))||'"}}'
   WHEN 1 THEN '{{"DOI": "10.1/'||CAST(doc_id AS VARCHAR(20))||'"}}' WHEN 2 THEN '{{}}' ELSE 'null' END||
 ', "citationCount": '||CASE WHEN doc_id % 8 = 7 THEN 'null' ELSE CAST((doc_id * 7919) % 1000 AS VARCHAR(20)) END||
 ', "openAccessPdf": '||CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '{{"url": "https://example.org/'||CAST(doc_id AS VARCHAR(20))||'.pdf"}}' END||
 '}}' AS record
FROM (SELECT doc_id,
        replace(replace(replace(split_part(text, chr(10), 1), chr(92), chr(92)||chr(92)), chr(34), chr(92)||chr(34)), chr(10), chr(92)||'n') AS head,
        replace(replace(replace(text, chr(92), chr(92)||chr(92)), chr(34), chr(92)||chr(34)), chr(10), chr(92)||'n') AS body
      FROM {documents})
"""

# A completion per document with three blocks, one of them without an answer.
COMPLETIONS = """
SELECT doc_id AS sample_id, 'p'||CAST(doc_id AS VARCHAR(20)) AS paper_id,
 'Here you are. <qa><question> '||split_part(text, chr(10), 1)||' </question><think> '||text||' </think><answer> '||text||chr(10)||'</answer></qa>'||chr(10)||
 '<QA><question>'||text||'</question></QA> <qa><question>Second?</question>'||
 CASE WHEN doc_id % 2 = 0 THEN '<think>  </think>' ELSE '' END||'<Answer>'||text||'</Answer></qa> end' AS output
FROM {documents}
"""

# Pairs that name their source paper, in line order; several pairs per paper.
SOURCED = """
SELECT doc_id + 1 AS line_no, split_part(text, chr(10), 1) AS instruction,
 CASE doc_id % 4 WHEN 0 THEN '<think>'||text||'</think><answer> '||source||' </answer>'
  WHEN 1 THEN text WHEN 2 THEN '<THINK>'||text||'</THINK><ANSWER>x</ANSWER>'
  ELSE '<think>'||text END AS output,
 doc_id % 6 <> 0 AS valid, doc_id % 9 = 0 AS healed,
 CASE WHEN doc_id % 13 = 0 THEN '' ELSE 's2:'||CAST(doc_id % 301 AS VARCHAR(20)) END AS source_paper,
 'title '||CAST(doc_id AS VARCHAR(20)) AS source_title, CAST(2000 + doc_id % 25 AS INT) AS year,
 text AS abstract, (doc_id * 7919) % 1000 AS citation_count, source
FROM {documents}
"""

VIEWS = {
    "samples": SAMPLES, "papers": PAPERS, "library": LIBRARY, "qa": QA,
    "cat_papers": CATALOGUE_PAPERS, "cat_datasets": CATALOGUE_DATASETS, "judge": JUDGE,
    "power": POWER, "job_events": JOB_EVENTS, "attempts": ATTEMPTS, "lines": LINES,
    "index_records": INDEX_RECORDS, "completions": COMPLETIONS, "sourced": SOURCED,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def with_views(*names: str, body: str) -> str:
    """Oracle SQL: the named views as common table expressions, then ``body``."""
    tables = {t: t for t in TABLES}
    parts = [f"{n} AS ({VIEWS[n].format(**tables)})" for n in names]
    glue = ",\n" if body.lstrip().startswith("+") else "\n"
    return "WITH RECURSIVE " + ",\n".join(parts) + glue + body.lstrip().lstrip("+")
