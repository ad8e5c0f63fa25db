"""Scalar Columns on hand-written text: scripts, boundaries, rounding, prompts."""

import math
import random

from pyspark.sql import functions as F

from sparkcurate.config import IssueTexts, Rules, SplitRatios, Task
from sparkcurate.functions import papers as C
from sparkcurate.functions import prompts as R
from sparkcurate.functions import scoring as S
from sparkcurate.functions import text as X
from sparkcurate.functions import validation as V
from sparkcurate.functions.numbers import rounded


def test_strip_removes_unicode_space(evaluate):
    assert evaluate(X.strip, ["\u2003\xa0 a b\u3000\n\x1c", "\t", "", None]) == ["a b", "", "", None]


def test_block(evaluate):
    texts = ["<Think>a\nb</THINK> <think>c</think>", "<think></think>", "<think>open", "😀<think>é😀</think>"]
    assert evaluate(lambda c: X.block(c, "think"), texts) == ["a\nb", "", None, "é😀"]
    assert evaluate(lambda c: X.block(c, "think", False), texts)[0] == "c"


def test_english(evaluate):
    cyrillic = "Это длинный русский текст the"
    mixed = "the quick brown fox jumps over the lazy dog and runs far away " + "я" * 3
    texts = ["short", "", cyrillic, mixed, "ceci est un texte sans mots anglais", "naïve éa àa çof theé longer text", "THE end of all things here"]
    assert evaluate(X.is_english, texts) == [True, True, False, True, False, False, True]


def test_last_sentences(evaluate):
    texts = ["One. Two! Three? Four.", "One. two. Three", "  Only one ", "A.B. C"]
    assert evaluate(X.last_sentences, texts) == ["Three? Four.", "One. two. Three", "Only one", "A.B. C"]


def test_query_keywords(evaluate):
    text = r"Explain $\psi$ and \frac{a}{b} the Hamiltonian of entangled qubits, entangled states and bosons"
    assert evaluate(X.query_keywords, [text, "what is it"]) == [
        ["hamiltonian", "entangled", "qubits", "states", "bosons"], [],
    ]


def test_keyword_ties_go_to_the_first(spark):
    from sparkcurate.operators.graph import top_keywords

    rows = [(1, "gamma beta beta alpha gamma delta the the the"), (2, ""), (3, "the of xx"), (4, "éclair zeta zeta_eta")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.keywords for r in top_keywords(df, F.col("t"), 3).collect()}
    assert got == {1: ["gamma", "beta", "alpha"], 2: [], 3: [], 4: ["zeta", "clair", "eta"]}


def test_keywords_against_counting(spark):
    from collections import Counter

    from sparkcurate.operators.graph import top_keywords

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aaa", "aaab", "baa", "ccc", "ddd", "eee", "fff"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in top_keywords(df, F.col("t"), 4).collect():
        assert r.keywords == [w for w, _ in Counter(r.t.split()).most_common(4)]


def test_rounding_matches_exact_value(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 20000) / rng.choice([7, 8, 20, 200, 2000]) for _ in range(3000)] + [5.35, 6.85, 0.25, 0.05]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, one, four in df.select("v", rounded(F.col("v")), rounded(F.col("v"), 4)).collect():
        assert (one, four) == (round(v, 1), round(v, 4))


def test_strip_math(evaluate):
    texts = [
        r"a $x$ b \$5 and \$6 c", r"\begin{align*}x\end{align*}y\begin{align}z\end{gather}", "\\[a\nb\\]c", "$a$$b$",
        r"$a\$b$",
    ]
    assert evaluate(V.strip_math, texts) == [
        r"a   b \$5 and \$6 c", r" y\begin{align}z\end{gather}", " c", "  ", r"$a\$b$",
    ]


def test_plain_text_symbols(evaluate):
    rules = Rules.physics()
    got = evaluate(
        lambda c: F.size(V.latex_issues(c, rules.plain_text_patterns, rules.texts)),
        ["$x$ psi_0", "$x$ psi", "$x$ épsi", "$x$ sigma_x H = 2 hbar", "$psi$", "$x$ psi\\"],
    )
    assert got == [0, 1, 0, 3, 0, 0]


def test_latex(evaluate):
    texts = ["$a$", "a $", r"cost \$5", r"\alpha", "\\[ x\n\\]", ""]
    none, odd = IssueTexts().no_latex, "Unclosed LaTeX $ delimiter"
    assert evaluate(V.latex_issues, texts) == [[], [none, odd], [none], [], [], [none]]


def test_rule_order_allows_equal_positions(evaluate):
    rules = Rules(require_tags=(("<a>", "</a>"), ("<a>", "</b>")))
    assert evaluate(lambda c: V.rule_issues(c, rules), ["</a><a></b>", "x<A>y</a></b>"]) == [
        ["tags out of order"], ["tags out of order"],
    ]


def test_labels(evaluate):
    rules = Rules.from_mapping(
        {"domain_checks": [{"name": "n", "pattern": "ham"}], "min_domain_score": 1, "require_latex": True}
    )
    tags = "<think></think><answer></answer>"
    got = evaluate(
        lambda c: V.quality_label(F.when(c.isNotNull(), V.detailed_flags(c, rules)), rules),
        [tags + "$ HAM", tags + "$", tags, "<think> $ham", None],
    )
    assert got == ["PASS", "MARGINAL", "FAIL", "FAIL", "ERROR"]


def test_judge_scores(evaluate):
    texts = ["factual_accuracy:  90\nCOMPLETENESS: 250 TECHNICAL_PRECISION: x", "", "FACTUAL_ACCURACY: " + "9" * 40]
    assert [tuple(r) for r in evaluate(S.judge_scores, texts)] == [(90, 100, 0), (0, 0, 0), (100, 0, 0)]
    assert evaluate(lambda c: S.overall_score(S.judge_scores(c)), texts[:1]) == [75.0]


def test_fenced_json(evaluate):
    texts = [
        'x ```json\n{"instruction": "a", "output": "b"}\n``` y ```no```', '{"instruction": "a", "output": null}',
        "```{broken```", "plain",
    ]
    got = evaluate(R.parsed_correction, texts)
    assert [tuple(g) if g else None for g in got] == [("a", "b"), ("a", None), None, None]


def test_templates_do_not_read_the_data(evaluate):
    got = evaluate(lambda c: R.render("{{x}} {a} {b}", a=c, b=F.lit("$1")), ["{b} \\1", None])
    assert got == ["{x} {b} \\1 $1", "{x}  $1"]


def test_progress_message(spark):
    df = spark.createDataFrame([(5, 10, 0.12345, 1e-5), (3, 0, None, None), (10, 10, None, 0.5)], "s int, m int, l double, r double")
    got = [r[0] for r in df.select(S.progress_message(F.col("s"), F.col("m"), F.col("l"), F.col("r"))).collect()]
    assert got == ["step 5/10 (50.0%) | loss=0.1235 | lr=1.00e-05", "step 3/0 (0%)", "step 10/10 (100.0%) | lr=5.00e-01"]


def test_paper_ids_and_links(spark):
    df = spark.createDataFrame([("1.2", "10/x", "p"), ("", "10/x", "p"), (None, "", "p"), (None, None, None)], "a string, d string, i string")
    got = [r[0] for r in df.select(C.paper_id(F.col("a"), F.col("d"), F.col("i"))).collect()]
    assert got == ["arxiv:1.2", "doi:10/x", "s2:p", "s2:unknown"]


def test_metric_texts(spark):
    df = spark.createDataFrame([(0.8,), (0.6,), (0.1,), (None,)], "v double")
    rows = df.select(S.metric_bucket(F.col("v")), S.metric_text(F.col("v"))).collect()
    assert [tuple(r) for r in rows] == [("high", "80.0%"), ("middle", "60.0%"), ("low", "10.0%"), ("none", "—")]


def test_config_from_mappings():
    task = Task.from_mapping({"generation": {"system_prompt": "s", "user_prompt_template": "{question}"}, "validation": {"require_tags": [["<a>", "</a>"]], "topics": ["x"]}})
    assert task.rules.require_tags == (("<a>", "</a>"),) and task.max_retries == 3
    assert math.isclose(sum(getattr(SplitRatios(), n) for n in ("train", "val", "test")), 1.0)


def test_scientific_text_rounds_the_exact_value(spark):
    import random

    from sparkcurate.functions.numbers import scientific

    rng = random.Random(2)
    values = [9.375e-06, 0.151 / 64, 1e-5, 9.995e-4, 9.9949e-4, 0.0, 1.0, 99.95, 12.25, 12.35, 123.5, 2e-4, -3.125e-3, 5e7, 1e-30]
    values += [round(rng.random() * 10 ** -rng.randint(0, 9), rng.randint(3, 12)) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[1] for r in df.select("i", scientific(F.col("v"))).orderBy("i").collect()]
    assert got == [f"{v:.2e}" for v in values]
