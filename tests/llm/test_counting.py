"""Token counts, ranked search and phrases against plain definitions and the library."""

import collections
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparkcurate.llm import bpe, phrases, records, search, tokens
from sparkcurate.llm.trie import DoubleArray

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def odd_texts(n, longest, seed=1):
    rng = random.Random(seed)
    parts = [
        "a", "b", "th", "e", " ", "  ", "▁", "\n", "\t", "é", "漢", "字", "١", "́", "<s>", "ing", "\U0001f600", "0",
        "12", ".", "==", "   ", "\xa0", "The", "tion",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_counts_of_whole_texts(library):
    texts = odd_texts(4000, 40) + [" " * n + "x" for n in range(40)] + [" " * n for n in range(40)]
    texts += ["ab" * 3000, "a" * 3001, "aaab " * 900, "\xa0 " * 50, "x" + " " * 500 + "y"]
    counter = tokens.Counter(tokens.load_model(PIECES))
    assert counter(texts) == [len(ids) for ids in library.encode(texts)]
    assert counter(texts) == [len(ids) for ids in library.encode(texts)]  # now from the table


def test_counts_of_every_prefix(library):
    model = tokens.load_model(PIECES)
    for text in odd_texts(300, 25, 2) + ["", " ", "   ", "  a  b ", "internationalisation of tokenisers"]:
        want = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert model.count_prefixes(text).tolist() == want


def test_a_table_that_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    texts = odd_texts(200, 20, 3)
    counter = tokens.Counter(tokens.load_model(PIECES))
    assert [counter([t])[0] for t in texts] == [len(ids) for ids in library.encode(texts)]


def test_token_query_and_budgets(spark, small, small_rows, library):
    from sparkcurate.llm.tokens import op11_tokens

    got = {r.doc_id: r for r in op11_tokens(spark, "/root/testdata/sf0.001").collect()}
    for i, text in small_rows:
        n = len(library.encode(text))
        r = got[i]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
        assert r.limit_chars == len(text) if n <= 4096 else len(library.encode(text[: r.limit_chars])) <= 4096
    stored = tokens.count_tokens(small.limit(20), PIECES, limit=50, prefixes=True)
    rows = stored.select(
        "doc_id", "limit_chars", "n_tokens", tokens.longest_prefix("prefix_tokens", 50).alias("fits"),
        tokens.tokens_of("prefix_tokens", 30).alias("of_30"), tokens.tokens_of("prefix_tokens", 10**6).alias("of_all"),
    ).collect()
    texts = dict(small_rows)
    for r in rows:
        text = texts[r.doc_id]
        assert (r.fits, r.of_30, r.of_all) == (r.limit_chars, len(library.encode(text[:30])), r.n_tokens)
        counts = [len(library.encode(text[:i])) for i in range(min(len(text), 400) + 1)]
        assert r.fits == max(i for i, n in enumerate(counts) if n <= 50)


def test_tokens_of_odd_rows(odd, empty, library):
    rows = tokens.count_tokens(odd, PIECES, limit=100).collect()
    assert len(rows) == odd.count() and tokens.count_tokens(empty, PIECES).count() == 0
    by_key = {r.doc_id: r for r in rows}
    assert (by_key[2].n_tokens, by_key[2].n_bytes, by_key[2].limit_chars) == (0, 0, 0)
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id] or "")) for r in rows)
    assert len(library.encode(texts[4][: by_key[4].limit_chars])) <= 100 < by_key[4].n_tokens


def test_double_array():
    rng = np.random.default_rng(3)
    for n, wide in ((0, 1), (1, 1), (4000, 60), (20000, 3000), (30000, 200_000)):
        keys = np.unique(np.minimum(rng.zipf(1.4, n), wide).astype(np.int64) << 32 | rng.integers(0, wide, n))
        rng.shuffle(keys)
        trie = DoubleArray(keys >> 32, keys & 0xFFFFFFFF)
        assert (trie.step(keys >> 32, keys & 0xFFFFFFFF) == np.arange(len(keys))).all()
        nodes, labels = rng.integers(-1, wide + 9, 5000), rng.integers(-1, wide + 9, 5000)
        there = set(keys.tolist())
        want = [a >= 0 and b >= 0 and (a << 32 | b) in there for a, b in zip(nodes.tolist(), labels.tolist())]
        assert ((trie.step(nodes, labels) >= 0) == np.array(want)).all()


def test_pieces_joined_or_alone():
    rng = random.Random(5)
    signs = "ab.,;:!?'\n\t \r  é漢١²́-0sS$\U0001f600"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(5000)] + ["x" * 5000 + ". y"]
    files = [("byte_bpe_50k.json", None), ("byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)]
    for name, pattern in files:
        path = public_tokenizers.path(name)
        encode = bpe.Encoder(bpe.load_tokenizer(path, pattern), bpe.token_bytes(path, pattern))
        want = bpe.load_tokenizer(path, pattern).encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == [e.ids for e in want]


@pytest.mark.parametrize("kept", [bpe.KEPT_PIECES, 20])
def test_plain_pieces_are_cut_and_asked_by_the_match(monkeypatch, kept):
    monkeypatch.setattr(bpe, "KEPT_PIECES", kept)
    rng = random.Random(6)
    signs = "aBreveltdms''  ..\n,$(19éЖ漢가²ा"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    plain = "Some words: isn't it 'dear' (so)?\nÇa n'est pas l'été... Слово 42nd $5,000.00, words: it's"
    files = [("byte_bpe_50k.json", None), ("byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)]
    for name, pattern in files:
        path = public_tokenizers.path(name)
        library = bpe.load_tokenizer(path, pattern)
        encode = bpe.Encoder(library, bpe.token_bytes(path, pattern))
        want = [e.ids for e in library.encode_batch([plain, *texts], add_special_tokens=False)]
        asked = []
        monkeypatch.setattr(encode, "_ask", lambda t, ask=encode._ask: (asked.extend(t), ask(t))[1])
        assert np.frombuffer(encode(plain), "<u4").tolist() == want[0] and not asked
        assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == want[1:]


def test_a_tokenizer_of_another_pattern_is_asked_for_every_piece():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = bpe.rank_tokenizer(path, r" ?[A-Z]?\p{Ll}+|[^\p{Ll}]")
    encode = bpe.Encoder(library, bpe.token_bytes(path, public_tokenizers.PATTERN))
    text = "Some oneTwo threeFour words oneTwo."
    assert not encode.plain and np.frombuffer(encode(text), "<u4").tolist() == library.encode(text).ids


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def best_documents(docs, items, top):
    found = [(i, collections.Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    n_docs, n_all = sum(n > 0 for *_, n in found), sum(n for *_, n in found)
    out = {}
    for item in {i for i, _ in items}:
        wanted = {x for i, t in items if i == item for x in terms_of(t)}
        scores = []
        for i, tf, n in found:
            score = 0
            for x in wanted & set(tf):
                df = sum(x in c for _, c, _ in found)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                m = 100 - 90 + (90 * n * n_docs) // n_all
                score += weight * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        for rank, (score, known, i) in enumerate(sorted(scores)[:top], 1):
            out[item, rank] = (i if known else None, -score)
    return out


@pytest.mark.parametrize("block_chars", [16_000_000, 60])
def test_search_against_brute_force(spark, block_chars):
    rng = random.Random(7)
    words = ["the", "The", "naïve", "x1", "漢字", "of", "a", "end.", "a-b", "C++", "Über", "é"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "..."), (None, "the w1 w2"), (3, "the w1 w2 w3"), (3, "the w1 w2 w3")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (1, "w29 w28"), (53, "the " * 9), (54, "Ünbekannt the")]
    got = search.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame(items, "item_id long, text string"), search.Settings(top=7, block_chars=block_chars),
    ).collect()
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == best_documents(docs, items, 7)
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})


def test_search_of_odd_rows(odd, empty, clashing):
    items = odd.select(F.col("doc_id").alias("item_id"), "text")
    got = search.search(odd, items)
    assert search.search(empty, items).count() == 0 and search.search(odd, items.limit(0)).count() == 0
    again = search.search(clashing, items.withColumn("rank", F.lit("own")).withColumn("score", F.lit("own")))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def phrases_by_hand(docs, least=10, top=2000, inside=50):
    counts, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found = collections.defaultdict(list)
    longer = [g for g, a in counts.items() if len(g) == 4 and a >= least]
    held = collections.Counter()
    for lang, x, y, z in longer:
        for pair in ((lang, x, y), (lang, y, z)):
            held[pair] = max(held[pair], counts[lang, x, y, z])
    for (lang, *w), a in counts.items():
        if len(w) > 1 and a >= least and not (len(w) == 2 and held[lang, *w] and 100 * held[lang, *w] >= inside * a):
            cuts = [(counts[lang, *w[:k]], counts[lang, *w[k:]]) for k in range(1, len(w))]
            score, _, (l, r) = min((1_000_000 * a * a // (l * r), k, (l, r)) for k, (l, r) in enumerate(cuts))
            found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {
        (lang, rank, p.decode(), -a, l, r, n[lang], -s)
        for lang, rows in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)
    }


@pytest.mark.parametrize(
    "settings", [phrases.Settings(), phrases.Settings(min_count=3, top=40, sent_entries=7, kept_entries=20)]
)
def test_phrases_against_brute_force(spark, settings):
    rng = random.Random(11)
    words = ["New", "york", "city", "the", "of", "Ürün", "x", "漢字", "a\xa0b"] + [f"w{i}" for i in range(12)]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! ", " ;"]
    docs = []
    for i in range(400):
        parts = rng.choices(words + ["New York City", "the of"], k=rng.randint(0, 30))
        docs.append(("".join(p + rng.choice(ends) for p in parts), rng.choice(["en", "de", None, "und"])))
    docs += [(None, "en"), ("", "en"), ("...", "fr"), ("same " * 500, "en"), ("one two three " * 20, None)] + [docs[0]] * 30
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    got = {tuple(r) for r in phrases.mine_phrases(df, settings).collect()}
    top = settings.top
    assert got == phrases_by_hand(docs, settings.min_count, top)


def test_phrases_of_odd_rows(odd, empty, clashing):
    settings = phrases.Settings(min_count=1)
    got = sorted(map(str, phrases.mine_phrases(odd, settings).collect()))
    assert got == sorted(map(str, phrases.mine_phrases(clashing, settings).collect()))
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert got == sorted(str(r) for r in phrases.mine_phrases(odd.select("text", "lang"), settings).collect())
    assert len(got) == len(phrases_by_hand(rows, 1))
    assert phrases.mine_phrases(empty).count() == 0


def test_tasks_of_a_worker_share_what_they_learned(spark, tmp_path, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = bpe.load_encoder(path, None)
    made = []

    def in_this_process(df, make, schema):
        work = [make() for _ in range(2)]  # two tasks
        made.extend(w(b) for w in work for b in df.select("key", "text").toArrow().to_batches())
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(records, "map_texts", in_this_process)
    docs = spark.createDataFrame([(1, "some words that are some words."), (2, None)], "doc_id long, text string")
    asked = []
    monkeypatch.setattr(encoder, "_learn", lambda pieces, learn=encoder._learn: (asked.append(pieces), learn(pieces)))
    records.write_records(docs, str(tmp_path / "files"), path, end_id=2)
    assert len(asked) == 1 and len(made) == 2 and made[0].equals(made[1])
