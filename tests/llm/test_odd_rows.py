"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkcurate.llm import bpe, language, leaks, licenses, lines, lm, near, pii, quality, records
from sparkcurate.llm.common import crc_mod

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OPERATORS = {
    "quality": lambda d: quality.quality_rules(d),
    "language": lambda d: language.identify(d),
    "lm": lambda d: lm.score_texts(d, crc_mod("doc_id", 5) != 1),
    "near": lambda d: near.near_duplicates(d),
    "lines": lambda d: lines.dedup_lines(d),
    "leaks": lambda d: leaks.with_leaks(d, d.select(F.col("doc_id").alias("item_id"), "text"), keep=["doc_id"]),
    "pii": lambda d: pii.find_pii(d),
    "licenses": lambda d: licenses.scan_licenses(d),
    "bpe": lambda d: bpe.decode_ids(bpe.encode_texts(d, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN),
}


def plain(df):
    return sorted(str(r.asDict()) for r in df.collect())


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_per_row(odd, empty, clashing, name):
    got = OPERATORS[name](odd)
    if name != "licenses":
        assert got.count() == odd.count()
    assert OPERATORS[name](empty).count() == 0
    own = [c for c in got.columns]
    assert plain(OPERATORS[name](clashing).select(*own)) == plain(got)


def by_key(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(odd, spark):
    rows = by_key(quality.quality_rules(odd))
    assert (rows[2].n_words, rows[2].base_failed, rows[3].n_words) == (0, True, 0)
    assert rows[4].n_words == 30_000 and rows[4].n_repeat_words == 0
    assert rows[9].word_chars == len("Ünïcodewörds漢字\U0001f600end x")
    text = "a b c d e f g h x a b c d e f g h"
    docs = spark.createDataFrame([(1, text, "s"), (2, "a\n\na\n \nb\na", "s")], "doc_id long, text string, source string")
    rows = by_key(quality.quality_rules(docs))
    assert rows[1].n_repeat_words == 16 and rows[2].n_dup_lines == 2


def test_a_bad_host_takes_its_documents_with_it(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i % 10 else "x", f"host{i % 7}") for i in range(700)]
    rows += [(1000 + i, good if i % 10 == 0 else "x", "bad") for i in range(300)]
    rows += [(5000, good, None), (5001, "x", "tiny")]
    got = by_key(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not any(r.kept for i, r in got.items() if 1000 <= i < 1300)
    assert all(r.kept == (i % 10 != 0) for i, r in got.items() if i < 700)
    assert got[5000].kept and not got[5001].kept


def test_language(odd, spark):
    rows = by_key(language.identify(odd))
    assert {i: rows[i].lang_pred for i in (1, 2, 3, 7)} == {1: "und", 2: "und", 3: "und", 7: "und"}
    assert rows[8].lang_pred in ("de", "en") and rows[None].held_out is False
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(nothing).collect()} == {"und"}


def test_lm_of_any_order_is_a_distribution(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a"), (3, "a a b")], "doc_id long, text string")
    for order in (1, 2, 3):
        settings = lm.Settings(order=order, block_tokens=4)
        # What may follow "a b": every known token, the end, and whatever is unknown.
        known = ["a", "b", "c"]
        tries = [(10, "a b")] + [(11 + i, f"a b {w}") for i, w in enumerate([*known, "zzz"])]
        every = docs.unionByName(spark.createDataFrame(tries, "doc_id long, text string"))
        rows = {r.doc_id: r for r in lm.score_texts(every, F.col("doc_id") < 10, settings=settings).collect()}
        assert rows[10].train_tokens == 12
        # The end token's share of every text is taken off by scoring the text without it.
        block = lambda p: 10**p
        prefix = _prefix_score(docs, order, ["a", "b"])
        ends = block(rows[10].score - prefix)
        nexts = sum(_token(docs, order, ["a", "b"], w) for w in [*known, "zzz"])
        assert ends + nexts == pytest.approx(1.0)


def _counts(docs, order):
    counts, n_docs = {}, 0
    for r in docs.collect():
        tokens = ["<s>"] * (order - 1) + r.text.split() + ["</s>"]
        n_docs += 1
        for k in range(1, order + 1):
            for i in range(order - 1, len(tokens)):
                gram = tuple(tokens[i - k + 1 : i + 1])
                counts[gram] = counts.get(gram, 0) + 1
    return counts, n_docs


def _token(docs, order, history, word, m=lm.Settings.strength):
    counts, n_docs = _counts(docs, order)
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)
    tokens = ["<s>"] * (order - 1) + history
    p = (counts.get((word,), 0) + 0.5) / (n + 0.5 * (v + 1))
    for k in range(2, order + 1):
        h = tuple(tokens[len(tokens) - k + 1 :])
        seen = n_docs if set(h) == {"<s>"} else counts.get(h, 0)
        p = (counts.get((*h, word), 0) + m * p) / (seen + m) if seen else p
    return p


def _prefix_score(docs, order, words):
    return sum(np.log10(_token(docs, order, words[:i], w)) for i, w in enumerate(words))


def test_near_families(spark):
    """A large family of edited copies, copies of copies, and a chain of which the ends are unlike."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for i in range(150):
        w = list(base)
        for p in rng.choice(120, rng.integers(1, 7), replace=False):
            w[p] = f"n{i}x{p}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        texts.append(" ".join(chain))
        chain[8 * i % 100] = f"d{i}"
        chain[8 * i % 100 + 1] = f"e{i}"
    texts += ["", None, "one two", "One two", "one  two\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from test_brute_force import jaccard_groups

    want = jaccard_groups(list(enumerate(texts)), 4)
    got = near.near_duplicates(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_sketches_are_full_and_agree_like_sets():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)])
    s = near.sketch([np.unique(a), np.unique(b), a[:1]], 512)
    assert (s != near.EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 2 / 3) < 0.08


def test_lines(spark):
    passage = ". ".join(f"This is sentence {i} of the passage and it has ten words" for i in range(6))
    rows = [
        (1, f"Head one\n{passage}.\nTail one"), (2, f"Start of two. {passage}. End of two\nlast"),
        (3, f"{passage}."), (4, "Short line\nShort line"), (5, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: "Start of two. End of two\nlast", 3: "", 4: "Short line\nShort line", 5: None}


def test_seeds_miss_nothing():
    """Every way to substitute at most a fifth of five to fourteen words leaves a mask whole."""
    for n in range(5, 15):
        for k in range(n // 5 + 1):
            for gone in itertools.combinations(range(n), k):
                good = [i not in gone for i in range(n)]
                assert any(
                    all(good[s + i] for i, c in enumerate(mask) if c == "1")
                    for mask in leaks.MASKS for s in range(n - len(mask) + 1)
                )


def test_leaks_in_blocks(spark, small):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = leaks.with_leaks(small, items, keep=["doc_id"])
    parts = leaks.with_leaks(small, items, keep=["doc_id"], settings=leaks.Settings(index_bytes=3000))
    assert plain(whole) == plain(parts)
    text = " ".join(f"t{i}" for i in range(200))
    edited = " ".join(f"t{i}" if i % 6 else "other" for i in range(70, 125))
    docs = spark.createDataFrame([(1, f"so {edited} on"), (2, "t1 t2 t3 t4 t5")], "doc_id long, text string")
    found = leaks.with_leaks(docs, spark.createDataFrame([(9, text), (8, None)], "item_id long, text string"))
    assert {r.doc_id: r.leaked_items for r in found.collect()} == {1: [9], 2: []}


def test_pii(spark):
    from test_brute_force import plain_spans

    tricky = [
        "a@b.c@d.e x@y z@y.z.w @q.r a.b+c%d@e-f.g-h", "1.2.3.4.5.6.7.8.9 256.1.1.1 0.0.0.0 1.2.3 007.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111", "+1 (234) 555-0199 +12 +1 ( ) 2 +1234567890123456",
        "a" * 30_000 + "@" + "b" * 30_000, "1" * 30_000, "." * 3000 + "@a.b", "12345678901234567890.1.1.1",
    ]
    for text in tricky:
        assert pii.base_spans(text) == plain_spans(text)
    secret = "api token = \"9f8e7d6c5b4a39281706f5e4d3c2b1a098765432\" end"
    rows = [(i, f"note {i} " + secret) for i in range(20)] + [(100 + i, f"plain words {i}") for i in range(20)]
    got = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s.kind for s in got[i]] == ["secret"] for i in range(20))
    assert not any(got[100 + i] for i in range(20))


def test_licenses(spark):
    long = licenses.NOTICES["MIT"][1].split(" ")
    half, most = " ".join(long[: len(long) // 2]), " ".join(long[:-4])
    rows = [(1, "Foo. RELEASED under the\nMIT license!"), (2, f"x {most} y"), (3, half), (4, "the MIT license"), (5, None)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.license) for r in found.collect()} == {(1, "MIT"), (2, "MIT")}
    for texts in licenses.NOTICES.values():
        for t in texts:
            kept = [s for s in licenses.notice_shingles(t) if not set(s.split()) & set(licenses.needed_words([t]))]
            assert 100 * len(kept) < licenses.PERCENT * len(licenses.notice_shingles(t))


def test_records_and_offsets(spark, odd, tmp_path):
    folder, index = str(tmp_path / "files"), str(tmp_path / "index")
    path = public_tokenizers.path("byte_bpe_50k.json")
    records.write_records(odd, folder, path, end_id=2, file_bytes=50_000)
    rows = records.write_index(spark, folder, index)
    assert rows.count() == odd.count()
    ordered = sorted(rows.collect(), key=lambda r: r.start)
    assert [r.key for r in ordered] == sorted((r.key for r in ordered), key=lambda k: -1 if k is None else k)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    some = rows.filter("key >= 4")
    read = records.read_records(spark, folder, wanted=some).collect()
    assert sorted(r.key for r in read) == sorted(r.key for r in some.collect())
    table = bpe.token_bytes(path)
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in read:
        assert r.ids[-1] == 2 and b"".join(table[i] for i in r.ids[:-1]).decode() == texts[r.key]
    data = records.frame(3, np.array([1, 2, 70_000], "<u4"), True) + records.END
    assert records.unframe(data, 0)[0] == 3 and records.unframe(data, 0)[1].tolist() == [1, 2, 70_000]
    for i in range(len(data)):
        with pytest.raises(ValueError):
            records.unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :], 0)


def test_bpe_cuts_and_offsets(spark):
    import base64

    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain_ = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [
        "a  b   c\n d \n e\t f", " lead and trail ", "  ", "it's we'll I'D 12 345x", "漢字 \U0001f600\U0001f600 é́",
        "x  y  z", "<|endoftext|> <|endoftext|>", "a" * 5000, "\n\n  \n", "tab\tone  two\r\n three",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    for r in bpe.decode_ids(coded, RANKS, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id]
        assert r.ids == plain_.encode_ordinary(text) and r.decoded.decode() == text
        assert len(r.ends) == len(r.ids) and r.ends[-1] == len(text)


def test_pipeline_stages(spark, odd, empty):
    for docs in (odd, empty):
        rows = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "/root/testdata/sf0.001")
            assert rows.schema.names == odd.schema.names
            rows = rows.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else rows.cache()
        last = corpus_pipeline.STAGES[-1][1](spark, rows, "/root/testdata/sf0.001")
        assert last.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
        assert (last.count() == 0) == (docs is empty)


def test_licenses_of_rows_without_a_key_and_of_repeated_ones(spark):
    bsd, apache = (licenses.NOTICES[n][0] for n in ("BSD", "Apache-2.0"))
    rows = [(None, f"Some words. {bsd}: and more"), (1, bsd), (1, f"x {apache} y"), (1, "nothing at all in here"), (2, bsd), (2, bsd), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((r.doc_id, r.license)) for r in licenses.scan_licenses(docs).select("doc_id", "license").distinct().collect())
    assert got == sorted(map(str, [(None, "BSD"), (1, "BSD"), (1, "Apache-2.0"), (2, "BSD")]))
    assert licenses.scan_licenses(docs.filter("doc_id = 2")).count() == 2 * licenses.scan_licenses(docs.filter("doc_id = 2").limit(1)).count()


def test_records_of_one_key_in_many_files(spark, tmp_path):
    rows = [(None, f"text {i % 7} of no key") for i in range(300)] + [(5, "the same text")] * 300 + [(i, f"own {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder, index = str(tmp_path / "files"), str(tmp_path / "index")
    records.write_records(docs, folder, path, end_id=2, file_bytes=1500)
    found = records.write_index(spark, folder, index).collect()
    assert len(found) == len(rows) and len({r.file for r in found}) > 6
    by_start = sorted(found, key=lambda r: r.start)
    keys = [-1 if r.key is None else r.key for r in by_start]
    assert keys == sorted(keys)
    assert [r.start for r in by_start] == [sum(x.n_tokens for x in by_start[:i]) for i in range(len(by_start))]


def test_records_of_an_empty_table_and_of_clashing_columns(spark, empty, clashing, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = {}
    for name, docs in (("empty", empty), ("clashing", clashing), ("odd", odd)):
        folder, index = str(tmp_path / name), str(tmp_path / f"{name}-index")
        records.write_records(docs, folder, path, end_id=2)
        counts[name] = sorted((str(r.key), r.n_tokens, r.ids_crc32) for r in records.write_index(spark, folder, index).collect())
    assert counts["empty"] == [] and counts["clashing"] == counts["odd"] and len(counts["odd"]) == odd.count()
