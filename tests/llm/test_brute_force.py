"""Operators over the smallest table against plain Python that follows their definitions."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from sparkcurate.llm.queries import ORACLE, QUERIES

from checks.compare import connect, normalised
from test_word_runs import kept_words, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    found = {}

    def rows(name):
        if name not in found:
            found[name] = {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}
        return found[name]

    return rows


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows_as_sql(spark, name):
    got = QUERIES[name](spark, SF)
    cursor = connect(SF).execute(ORACLE[name])
    want = normalised([d[0] for d in cursor.description], cursor.fetchall())
    assert normalised(got.columns, [tuple(r) for r in got.collect()]) == want


def test_language_on_held_out_documents(run, small):
    lang = {r.doc_id: r.lang for r in small.collect()}
    rows = run("op2_language")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def jaccard_groups(rows, size, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(run, small_rows):
    want = jaccard_groups(small_rows, 4)
    assert {i: (r.n_shingles, r.component_id) for i, r in run("op4_near").items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in run("op4_near").items())


def test_lines(run, small_rows):
    rows = run("op5_lines")
    assert {i: words(r.text) for i, r in rows.items()} == kept_words(small_rows, 50)
    texts = dict(small_rows)
    assert all(len(texts[i]) - len(r.text) == r.removed_chars for i, r in rows.items())


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and sum(
                    int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))
                ) % 10 == 0,
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii(run, small_rows):
    for i, text in small_rows:
        base = plain_spans(text)
        r, named = run("op7_pii")[i], [f"{k}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(","))


def test_records(run, small_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    at = 0
    for i, text in small_rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        r = run("op9_records")[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_bpe(run, small_rows):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in small_rows:
        ids, r = plain.encode_ordinary(text), run("op10_bpe")[i]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline(spark, small, small_rows):
    """The stages after language ID in plain Python over what that stage kept."""
    import corpus_pipeline
    import tiktoken

    docs = corpus_pipeline.identify_language(spark, small, SF)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert len(rows) >= 0.97 * small.count()
    deduped = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, SF).collect()}
    texts = dict(rows)
    assert {i: words(t) for i, t in deduped.items()} == {
        i: left for i, left in kept_words(rows, 50).items() if left or not words(texts[i])
    }
    groups = jaccard_groups(sorted(deduped.items()), 5)
    left = {i: deduped[i] for i, (_, root) in groups.items() if i == root}
    items = [t.encode().lower().split() for (t,) in connect(SF).execute("SELECT text FROM benchmark").fetchall()]
    clean = {i: t for i, t in left.items() if not any(holds(t.encode().lower().split(), item) for item in items)}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.ids for i, r in got.items()} == {i: plain.encode_ordinary(t) for i, t in clean.items()}
    assert all(r.decoded_sha256 == hashlib.sha256(clean[i].encode()).hexdigest() for i, r in got.items())


def holds(words, item, percent=80, stretch=13):
    if len(item) < 5:
        return bool(item) and any(words[i : i + len(item)] == item for i in range(len(words)))
    where = collections.defaultdict(list)
    for q, w in enumerate(item):
        where[w].append(q)
    shifts = collections.defaultdict(list)
    for p, w in enumerate(words):
        for q in where.get(w, ()):
            shifts[p - q].append(q)
    size = min(len(item), stretch)
    return any(
        100 * sum(a <= q < a + size for q in same) >= percent * size
        for same in shifts.values() if 100 * len(same) >= percent * size
        for a in range(len(item) - size + 1)
    )


def test_parts_of_items_and_short_ones(spark):
    import random

    from sparkcurate.llm import leaks

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, rng.choices(vocabulary, k=n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 13, 14, 25, 38, 60])]
    items[0] = (0, ["alone"])
    docs = []
    for i in range(200):
        item = list(items[i % len(items)][1])
        if i % 4 == 1 and len(item) > 20:
            item = item[5:18]  # a part
        elif i % 4 == 2:
            item.insert(len(item) // 2, "inserted")
        elif i % 4 == 3:
            item = [w if rng.random() < 0.85 else "other" for w in item]
        docs.append((i, rng.choices(vocabulary, k=rng.randint(0, 40)) + item + rng.choices(vocabulary, k=10)))
    got = leaks.with_leaks(
        spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"),
        settings=leaks.Settings(index_bytes=rng.choice([100, 16_000_000])),
    ).collect()
    plain = lambda w: [x.encode() for x in w]
    want = {i: [k for k, item in items if holds(plain(w), plain(item))] for i, w in docs}
    assert {r.doc_id: list(r.leaked_items) for r in got} == want and sum(map(bool, want.values())) > 100
