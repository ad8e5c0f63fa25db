"""Stages of the pipeline over rows whose columns, ids and copies are unusual."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHING = ("lang_pred", "score", "removed_chars", "leaked_items", "_row", "key", "mark", "kept", "n_shingles", "node")


def text_of(i, n=40):
    return " ".join(f"word{i}x{k}" for k in range(n))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_other_columns_stay_as_they_are(spark, small, name, stage):
    some = small.withColumns({c: F.concat(F.lit(f"own {c} "), F.col("doc_id").cast("string")) for c in CLASHING})
    got = stage(spark, some, SF)
    assert got.columns == some.columns and [f.dataType for f in got.schema] == [f.dataType for f in some.schema]
    rows = got.collect()
    assert len(rows) > 150
    assert all(r[c] == f"own {c} {r.doc_id}" for r in rows for c in CLASHING)
    assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, small, SF).collect()}


def test_near_duplicates_go_by_id_and_text(spark):
    a, b, c = text_of(1), text_of(2), text_of(3)
    rows = [(5, a), (7, a), (7, b), (None, b), (None, c), (None, c + " end"), (9, c), (11, None), (11, None), (12, ""), (13, b), (13, b), (-4, text_of(4)), (3, text_of(4)), (20, text_of(5)), (20, text_of(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    want = [(5, a), (7, b), (9, c), (11, None), (11, None), (12, ""), (-4, text_of(4)), (20, text_of(5))]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_input(spark, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
