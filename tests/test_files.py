"""Readers, writers and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from sparkcurate import session
from sparkcurate.plans.samples import filter_samples
from sparkcurate.sources import readers as I
from sparkcurate.sources import writers as O
from sparkcurate.streaming import jobs as J

GOOD = {"instruction": "q", "output": "<think>1. " + "x" * 120 + " $a$</think><answer>" + "y" * 12 + "</answer>", "valid": True}


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_line_numbers_over_many_splits(spark, tmp_path):
    paths = [write(tmp_path / f"f{n}.txt", [f"{n}-{i}" if i % 7 else "" for i in range(1, 3001)]) for n in range(3)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = I.read_lines(spark, paths[0].replace("f0", "f*"))
        rows = [r for r in lines.collect() if r.value]
        assert lines.count() == 9000
        assert len({r.file for r in rows}) == 3
        assert all(int(r.value.split("-")[1]) == r.line_no for r in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tolerant_and_counted(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [json.dumps(GOOD), "", "{broken", "[1]", "  " + json.dumps(GOOD) + " "])
    assert I.read_jsonl_tolerant(spark, path).count() == 2
    counted = I.read_jsonl_counted(spark, path).orderBy("line_no").collect()
    assert [r.malformed for r in counted] == [False, True, True, True, False]
    samples = I.read_jsonl_counted(spark, path).drop("healed", "heal_methods")
    result = filter_samples(samples, malformed="malformed")
    s = result.stats.first()
    assert (s.total, s.passed_original, s.rejected, s.failed_tags) == (5, 2, 3, 0)
    first = result.first_rejections("line_no").first()
    assert (first.line_no, first.issues) == (2, ["Invalid JSON"])


def test_strict_reader_fails(spark, tmp_path):
    path = write(tmp_path / "b.jsonl", [json.dumps(GOOD), "{broken"])
    with pytest.raises(Exception, match="[Mm]alformed"):
        I.read_jsonl(spark, path).collect()


def test_json_array_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"question": "a", "answer": "b"}, {"question": "c"}], indent=2))
    rows = I.read_json_array(spark, str(tmp_path / "c.json"), "question string, answer string").collect()
    assert [tuple(r) for r in rows] == [("a", "b"), ("c", None)]


def test_inventory_lists_empty_files(spark, tmp_path):
    write(tmp_path / "x.jsonl", ["a", "", " ", "b"])
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "other.txt").write_text("no")
    rows = I.list_files(spark, str(tmp_path)).collect()
    assert [(r.name, r.line_count) for r in rows] == [("empty", 0), ("x", 2)]


def test_split_choice():
    assert I.choose_split(["test", "train"], "test") == "test"
    assert I.choose_split(["test", "train"], "dev") == "train"
    assert I.choose_split(["b", "a"]) == "b"


def test_nulls_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    O.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":1,"b":null}'


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    write(folder / "1.jsonl", [json.dumps(GOOD), "{broken", json.dumps({**GOOD, "output": "bad"})])
    J.stream_filter(spark, str(folder), out, mark).awaitTermination()
    assert spark.read.json(out).count() == 1
    write(folder / "2.jsonl", [json.dumps({**GOOD, "instruction": "r"})])
    J.stream_filter(spark, str(folder), out, mark).awaitTermination()
    assert sorted(r.instruction for r in spark.read.json(out).collect()) == ["q", "r"]


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.scratch_dir(spark)
    assert named is None or folder == named.rstrip("/")
    stored = session.materialise(spark.range(5).withColumn("x", F.lit("a")))
    assert stored.count() == 5
    assert all(folder.split(":")[-1] in f for f in stored.inputFiles())


def test_stream_keeps_the_fields_of_a_sample(spark, tmp_path):
    sample = GOOD | {"source_paper": "s2:1", "source_title": "T", "year": 2020, "abstract": "A", "authors": ["x"]}
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.jsonl", [json.dumps(sample), "{bad", json.dumps({**sample, "output": "no"})])
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    J.stream_filter(spark, str(tmp_path / "in"), out, mark, schema=I.PAPER_SAMPLE_SCHEMA).awaitTermination()
    rows = spark.read.schema(I.PAPER_SAMPLE_SCHEMA + ", healed boolean").json(out).collect()
    assert [(r.source_paper, r.source_title, r.year, r.abstract, r.authors) for r in rows] == [("s2:1", "T", 2020, "A", ["x"])]
