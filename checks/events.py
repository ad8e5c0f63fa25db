"""Checks of events, energy, streaming jobs, readers and writers.

The file and streaming checks write what Spark derives from the tables to the shared scratch
folder and read it back.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.samples import FUNNEL, decided
from checks.sqlparts import strip
from checks.views import LINES, table, view, with_views
from sparkcurate.functions import scoring as S
from sparkcurate.operators import events as V
from sparkcurate.operators import stats
from sparkcurate.plans import datasets as D
from sparkcurate.plans import samples as P
from sparkcurate.session import application_folder
from sparkcurate.sources import readers as I
from sparkcurate.sources import writers as O
from sparkcurate.streaming import jobs as J

QUERIES, ORACLE = {}, {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def new_folder(spark, label):
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


# --- energy and events -----------------------------------------------------------------------


@check(
    "energy",
    with_views(
        "power",
        body="""+ l AS (SELECT *, lag(ts) OVER w AS pt, lag(watts) OVER w AS pw FROM power WINDOW w AS (PARTITION BY device ORDER BY ts, watts))
SELECT device, round(coalesce(sum((watts + pw) / 2 * (epoch_us(ts) - epoch_us(pt)) / 1e6), 0) / 3.6e6, 6) AS kwh, round(avg(watts), 6) AS avg_watts,
 round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) AS duration_seconds, count(*) AS samples FROM l GROUP BY device""",
    ),
)
def _(spark, sf):
    df = stats.energy(view(spark, sf, "power"), "device")
    return df.withColumns({c: F.round(c, 6) for c in ("kwh", "avg_watts", "duration_seconds")})


@check(
    "replay",
    with_views("job_events", body="SELECT event_id, status FROM job_events WHERE job_id = (SELECT min(job_id) FROM job_events) AND event_id >= 500"),
)
def _(spark, sf):
    events = view(spark, sf, "job_events")
    job = events.agg(F.min("job_id")).first()[0]
    return V.replay(events, job, 500).select("event_id", "status")


STATUS = """SELECT job_id, coalesce(arg_min(status, event_id) FILTER (status IN ('completed', 'failed', 'cancelled')), arg_max(status, event_id)) AS status,
 max(event_id) AS last_event, count(*) AS events FROM job_events GROUP BY job_id"""


@check("job_status", with_views("job_events", body=STATUS))
def _(spark, sf):
    return V.job_status(view(spark, sf, "job_events"))


@check("stream_job_status", with_views("job_events", body=STATUS))
def _(spark, sf):
    folder, out, mark = (new_folder(spark, n) for n in ("events", "status", "mark"))
    batch = view(spark, sf, "job_events")
    batch.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    J.stream_job_status(stream, out, mark).awaitTermination()
    return J.current_status(spark, out)


METRICS = """SELECT user_id AS run_id, event_id AS step, CASE WHEN event_type = 'error' THEN 0 ELSE 20000 END AS max_steps,
 CASE WHEN event_type = 'view' THEN CAST(NULL AS DOUBLE) ELSE value / 8 END AS loss, value / 64000 AS learning_rate FROM {events}"""


def metrics(spark, sf):
    return spark.sql(METRICS, events=table(spark, sf, "events"))


CORRECTION_PROGRESS = """SELECT user_id AS run_id, count(*) FILTER (event_type = 'view') AS progressed, max(event_id) AS total, count(*) FILTER (event_type = 'purchase') > 0 AS done FROM events GROUP BY 1"""


def correction_events(spark, sf):
    kind = F.when(F.col("event_type") == "view", "progress").when(
        F.col("event_type") == "purchase", "complete"
    ).otherwise("started")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), kind.alias("type"), F.col("event_id").alias("total")
    )


def in_three_drops(spark, rows, order, run):
    """Files that arrive in three drops, later ones holding earlier events too; ``run`` starts anew after each."""
    folder = new_folder(spark, "drops")
    for drop in range(3):
        part = rows.filter(F.pmod(F.xxhash64(order), F.lit(3)) == drop)
        part.repartition(3, F.xxhash64(order)).write.mode("append").parquet(folder)
        run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))


@check(
    "stream_replay",
    with_views("job_events", body="SELECT event_id, status FROM job_events WHERE job_id = (SELECT min(job_id) FROM job_events) AND event_id >= 500"),
)
def _(spark, sf):
    """A reader that comes back twice, each time with its checkpoint alone."""
    rows = view(spark, sf, "job_events")
    job = rows.agg(F.min("job_id")).first()[0]
    log, mark, out, place = (new_folder(spark, n) for n in ("log", "log-mark", "reader", "place"))

    def run(stream):
        J.stream_event_log(stream, log, mark).awaitTermination()
        reader = J.replay_stream(spark, log, rows.schema, job, 500).writeStream.format("parquet")
        reader = reader.option("checkpointLocation", place).option("path", out)
        reader.trigger(availableNow=True).start().awaitTermination()

    in_three_drops(spark, rows, "event_id", run)
    return spark.read.schema(rows.schema).parquet(out).select("event_id", "status")


@check(
    "stream_latest_metric",
    f"WITH m AS ({METRICS.format(events='events')}) SELECT run_id, max(step) AS step, round(arg_max(learning_rate, step), 9) AS learning_rate FROM m GROUP BY 1",
)
def _(spark, sf):
    out, mark = new_folder(spark, "metric"), new_folder(spark, "mark")
    in_three_drops(
        spark, metrics(spark, sf), "step", lambda s: J.stream_latest_metric(s, out, mark).awaitTermination()
    )
    return J.current(spark, out, J.LATEST_METRIC).select(
        "run_id", "step", F.round("learning_rate", 9).alias("learning_rate")
    )


@check("stream_correction_progress", CORRECTION_PROGRESS)
def _(spark, sf):
    out, mark = new_folder(spark, "corrections"), new_folder(spark, "mark")
    in_three_drops(
        spark, correction_events(spark, sf), "total",
        lambda s: J.stream_correction_progress(s, out, mark).awaitTermination(),
    )
    return J.current(spark, out, J.CORRECTIONS)


@check(
    "job_durations",
    with_views(
        "job_events",
        body="""+ s AS (SELECT job_id, epoch_us(arg_min(ts, event_id) FILTER (status = 'running')) AS a,
 epoch_us(arg_min(ts, event_id) FILTER (status IN ('completed', 'failed', 'cancelled'))) AS b FROM job_events GROUP BY 1)
SELECT job_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / 1e6 END, 6)::DOUBLE AS seconds FROM s""",
    ),
)
def _(spark, sf):
    return V.job_durations(view(spark, sf, "job_events")).select(
        "job_id", F.round("seconds", 6).alias("seconds")
    )


@check(
    "metric_progress",
    f"""WITH m AS ({METRICS.format(events='events')}), p AS (SELECT *, CASE WHEN max_steps > 0 THEN printf('%.1f', (step / max_steps * 100)::DOUBLE)::DOUBLE ELSE 0 END::DOUBLE AS percent FROM m)
SELECT run_id, step, percent, 'step '||step||'/'||max_steps||' ('||CASE WHEN max_steps > 0 THEN printf('%.1f', percent) ELSE '0' END||'%)'
 ||coalesce(' | loss='||printf('%.4f', loss), '')||coalesce(' | lr='||printf('%.2e', learning_rate), '') AS message FROM p""",
)
def _(spark, sf):
    return V.metric_progress(metrics(spark, sf)).select("run_id", "step", "percent", "message")


@check(
    "latest_metric",
    f"WITH m AS ({METRICS.format(events='events')}) SELECT run_id, max(step) AS step, round(arg_max(learning_rate, step), 9) AS learning_rate FROM m GROUP BY 1",
)
def _(spark, sf):
    return V.latest_metric(metrics(spark, sf)).select(
        "run_id", "step", F.round("learning_rate", 9).alias("learning_rate")
    )


@check("correction_progress", CORRECTION_PROGRESS)
def _(spark, sf):
    return V.correction_progress(correction_events(spark, sf))


RUN_LOGS = """SELECT doc_id, text||chr(10)||CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Prompt tokens:     1,'||CAST(100 + doc_id % 900 AS VARCHAR(20))||chr(10) END
 ||'Completion tokens: '||CAST(n_chars AS VARCHAR(20))||chr(10)||'Total tokens: 7'||chr(10)||'Total tokens: 8'||chr(10)
 ||CASE WHEN doc_id % 2 = 0 THEN 'Total energy:      0.00'||CAST(doc_id AS VARCHAR(20))||' kWh' ELSE 'Total energy: none kWh' END AS text FROM {documents}"""


@check(
    "run_log",
    """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 1100 + doc_id % 900 END AS prompt_tokens, n_chars AS completion_tokens, 7::BIGINT AS total_tokens,
 CASE WHEN doc_id % 2 = 0 THEN CAST('0.00'||doc_id AS DOUBLE) END AS gpu_kwh FROM documents""",
)
def _(spark, sf):
    return D.parse_run_log(spark.sql(RUN_LOGS, documents=table(spark, sf, "documents")))


@check(
    "metric_buckets",
    "SELECT event_id, CASE WHEN value IS NULL THEN 'none' WHEN value / 50 >= 0.8 THEN 'high' WHEN value / 50 >= 0.6 THEN 'middle' ELSE 'low' END AS bucket FROM events",
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", S.metric_bucket(F.col("value") / 50).alias("bucket"))


# --- files -----------------------------------------------------------------------------------


def written_lines(spark, sf, files=None):
    """A folder of lines, each task's in a file of its own; a given number of files is for who asks for it.

    A file is written by one task, which reads all its lines: they come from a stored table by columns, not from a
    shuffle, since that takes a fraction of the bytes.
    """
    folder = new_folder(spark, "lines")
    lines = view(spark, sf, "lines")
    if not files:
        lines.select("value").write.text(folder)
        return folder
    placed = lines.withColumn("file", F.pmod(F.hash("doc_id"), F.lit(files)))
    stored = new_folder(spark, "placed")
    placed.write.partitionBy("file").option("compression", "zstd").parquet(stored)
    placed = spark.read.schema(placed.schema).parquet(stored)
    own = [placed.filter(F.col("file") == i).coalesce(1).sortWithinPartitions("doc_id") for i in range(files)]
    # A union of single partitions is a single one itself, unless this setting of the session says otherwise.
    setting = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(setting, "true")
    spark.conf.set(setting, "false")
    try:
        reduce(DataFrame.unionAll, own).select("value").write.text(folder)
    finally:
        spark.conf.set(setting, before)
    return folder


def field(name):
    v = strip("value")
    return f"CASE WHEN json_valid({v}) THEN json_extract_string({v}, '$.{name}') END"


@check("jsonl_tolerant", with_views("lines", body=f"SELECT {field('instruction')} AS instruction, {field('output')} AS output FROM lines WHERE doc_id % 5 IN (0, 3, 4)"))
def _(spark, sf):
    return I.read_jsonl_tolerant(spark, written_lines(spark, sf)).select("instruction", "output")


# Lines that a strict parser refuses: a name that comes twice, a number that is none; and text behind an object.
LENIENT = """SELECT doc_id, CASE doc_id % 4
 WHEN 0 THEN '{{"instruction": "first", "loss": NaN, "instruction": "'||head||'", "output": "'||body||'", "valid": "maybe"}}'
 WHEN 1 THEN '{{"output": "'||body||'", "extra": [1, {{"deep": -Infinity}}]}}'
 WHEN 2 THEN '{{"instruction": "'||head||'"}} {{"output": "'||body||'"}}'
 ELSE '[{{"instruction": "'||head||'"}}]' END AS value
""" + LINES[LINES.index("FROM (SELECT doc_id,") :]


@check("jsonl_lenient", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN split_part(text, chr(10), 1) END AS instruction, CASE WHEN doc_id % 4 < 2 THEN text END AS output, doc_id % 4 > 1 AS malformed FROM documents")
def _(spark, sf):
    lines = spark.sql(LENIENT, documents=table(spark, sf, "documents"))
    return I.parse_lines(lines).select("doc_id", "instruction", "output", "malformed")


@check("purity_lenient", "SELECT round(coalesce(count(*) FILTER (i AND length(trim(text)) >= 10) * 100.0 / nullif(count(*), 0), 0), 6)::DOUBLE AS purity FROM (SELECT text, doc_id % 4 = 0 AND length(trim(split_part(text, chr(10), 1))) >= 10 AND trim(split_part(text, chr(10), 1)) <> trim(text) AS i FROM documents)")
def _(spark, sf):
    lines = spark.sql(LENIENT, documents=table(spark, sf, "documents"))
    return stats.purity(lines).select(F.round("purity", 6).alias("purity"))


@check(
    "jsonl_counted",
    with_views("lines", body="SELECT count(*) AS lines, count(*) FILTER (doc_id % 5 IN (1, 2)) AS malformed, sum(CASE WHEN doc_id % 5 IN (0, 3, 4) THEN length(" + field("instruction") + ") END)::BIGINT AS chars, count(*) AS distinct_lines FROM lines"),
)
def _(spark, sf):
    folder = new_folder(spark, "counted")
    rows = view(spark, sf, "lines").repartition(4).sortWithinPartitions("doc_id")
    rows.select("value").write.text(folder)
    read = I.read_jsonl_counted(spark, f"{folder}/part-*")
    per_file = read.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("malformed").alias("bad"),
        F.min("line_no").alias("low"), F.max("line_no").alias("high"),
        F.countDistinct("line_no").alias("numbers"), F.sum(F.length("instruction")).alias("chars"),
    )
    return per_file.agg(
        F.sum("n").alias("lines"), F.sum("bad").alias("malformed"), F.sum("chars").alias("chars"),
        # Numbered 1..n in every file: as many different numbers as lines, none beyond.
        F.sum(F.when((F.col("low") == 1) & (F.col("high") == F.col("n")), F.col("numbers"))).alias("distinct_lines"),
    )


@check("json_documents", "SELECT doc_id, text, lang, true AS nulls_kept FROM documents")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang", F.lit(None).cast("string").alias("nothing"))
    read = F.from_json("value", "doc_id bigint, text string, lang string")
    return O.as_json(rows).select(read.alias("r"), F.contains("value", F.lit('"nothing":null')).alias("nulls_kept")).select(
        "r.*", "nulls_kept"
    )


@check("jsonl_strict", with_views("qa", body="SELECT instruction, output, is_valid AS valid, was_healed AS healed FROM qa"))
def _(spark, sf):
    folder = new_folder(spark, "strict")
    rows = view(spark, sf, "qa").select(
        "instruction", "output", F.col("is_valid").alias("valid"), F.col("was_healed").alias("healed"),
        F.array().cast("array<string>").alias("heal_methods"),
    )
    O.write_jsonl(rows, folder)
    return I.read_jsonl(spark, folder).drop("heal_methods")


@check("jsonl_append", with_views("qa", body="SELECT instruction, valid FROM (SELECT instruction, is_valid AS valid FROM qa UNION ALL SELECT instruction, is_valid FROM qa WHERE was_healed)"))
def _(spark, sf):
    folder = new_folder(spark, "append")
    rows = view(spark, sf, "qa").select("instruction", F.col("is_valid").alias("valid"), "was_healed")
    O.write_jsonl(rows.drop("was_healed"), folder)
    O.write_jsonl(rows.filter("was_healed").drop("was_healed"), folder, append=True)
    return I.read_jsonl(spark, folder, "instruction string, valid boolean")


@check("json_array", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    folder = new_folder(spark, "arrays")
    # Files of one array each, made of up to a hundred neighbouring documents.
    arrays = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(
        F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("value")
    )
    arrays.write.partitionBy("part").text(folder)
    return I.read_json_array(spark, f"{folder}/part=*", "doc_id bigint, text string")


@check("hub_dataset", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    folder = new_folder(spark, "hub")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.write.parquet(f"{folder}/train")
    docs.limit(0).write.parquet(f"{folder}/test")
    splits = {"test": f"{folder}/test", "train": f"{folder}/train"}
    return I.read_hub_dataset(spark, splits, "missing")


@check("file_inventory", with_views("lines", body="SELECT 3::BIGINT AS files, count(*) FILTER (value <> '') AS lines FROM lines"))
def _(spark, sf):
    folder = written_lines(spark, sf, 3)
    return I.list_files(spark, folder, "*.txt").agg(
        F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines")
    )


@check("collected_papers_sink", with_views("library", body="SELECT paper_id, title, year FROM library"))
def _(spark, sf):
    folder = new_folder(spark, "collected")
    O.write_collected(view(spark, sf, "library"), folder)
    return spark.read.json(folder).select("paper_id", "title", F.col("year").cast("int").alias("year"))


@check("held_out_sink", with_views("samples", body="SELECT count(*) FILTER (rn <= ceil(ceil(n * 0.4) * 0.5)) AS rows FROM (SELECT row_number() OVER () AS rn, count(*) OVER () AS n FROM samples)"))
def _(spark, sf):
    from sparkcurate.config import SplitRatios

    folder = new_folder(spark, "heldout")
    O.write_parquet(P.held_out(view(spark, sf, "samples"), "sample_id", SplitRatios()), folder)
    return spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("rows"))


@check("report_sink", with_views("judge", body="SELECT idx, judge_response, (SELECT count(*) FROM judge) AS attempted FROM judge"))
def _(spark, sf):
    folder = new_folder(spark, "report")
    rows = view(spark, sf, "judge")
    O.write_report(rows.agg(F.count(F.lit(1)).alias("attempted")), {"results": rows}, folder)
    header = spark.read.json(f"{folder}/header").first()
    return spark.read.json(f"{folder}/results").select(
        "idx", "judge_response", F.lit(header["attempted"]).cast("bigint").alias("attempted")
    )


_KEPT = decided().replace("FROM samples)", "FROM s2)", 1).replace(
    "+\nh0", "+\ns2 AS (SELECT doc_id AS sample_id, " + field("instruction") + " AS instruction, coalesce(" + field("output") + ", '') AS output FROM lines WHERE doc_id % 5 IN (0, 3, 4)),\nh0"
)


@check(
    "filter_lines",
    with_views(
        "lines",
        body=_KEPT + "SELECT total + (SELECT count(*) FROM lines WHERE doc_id % 5 IN (1, 2)) AS total, passed_original, passed_healed, failed_tags, failed_latex, failed_quality, heal_attempts, heal_success FROM (" + FUNNEL + ")",
    ),
)
def _(spark, sf):
    rows = I.parse_lines(view(spark, sf, "lines")).drop("healed", "heal_methods", "valid")
    return P.filter_samples(rows, malformed="malformed").stats.drop("rejected", "pass_pct", "heal_pct")


@check(
    "stream_filter",
    with_views("samples", body=decided() + "SELECT instruction, output, healed FROM d WHERE keep"),
)
def _(spark, sf):
    folder, out, mark = (new_folder(spark, n) for n in ("in", "out", "mark"))
    O.write_jsonl(view(spark, sf, "samples").select("instruction", "output"), folder)
    J.stream_filter(spark, folder, out, mark).awaitTermination()
    return spark.read.schema("instruction string, output string, healed boolean").json(out)
