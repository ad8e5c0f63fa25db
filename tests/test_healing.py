"""One hand-written output per branch of the repairs."""

from pyspark.sql import functions as F

from sparkcurate.functions import tags as T
from sparkcurate.operators.filtering import heal_samples

LONG = "A long enough piece of reasoning. "


def heal(spark, *outputs):
    df = spark.createDataFrame(list(enumerate(outputs)), "i int, output string")
    return [
        (r.output, r.healed, r.heal_methods) for r in heal_samples(df).orderBy("i").collect()
    ]


def test_valid_output_is_left_alone(spark):
    good = "<think>a</think><answer>b</answer>"
    assert heal(spark, good) == [(good, False, [])]


def test_close_tag_needs_more_than_twenty_characters(spark):
    long, short = heal(
        spark, "<think>a</think><answer>" + "x" * 21 + "  ", "<think>a</think><answer>" + "x" * 20
    )
    assert long == ("<think>a</think><answer>" + "x" * 21 + "\n</answer>", True, ["answer:close_tag"])
    assert short[2] == ["answer:close_tag_fallback"]


def test_boxed_goes_before_phrase(spark):
    (out, _, methods) = heal(spark, r"<think>t</think> \boxed{1} then \boxed{ x_{1} }. The answer is forty.")[0]
    assert methods == ["answer:boxed_extraction"]
    assert out.startswith("<think>t</think>\n\n<answer>\nx_{1}\n</answer>")


def test_phrase(spark):
    (out, _, methods) = heal(spark, "<think>t</think> So the final answer is: forty two. Bye")[0]
    assert methods == ["answer:pattern_extraction"]
    assert "<answer>\n: forty two\n</answer>" in out


def test_answer_replacement_replaces_every_answer(spark):
    text = r"x $5 \1</think><answer></answer> \boxed{7} <ANSWER> b </ANSWER>"
    (out, _, methods) = heal(spark, text)[0]
    assert methods == ["think:add_open_tag", "answer:answer_replacement"]
    box = "<answer>\n7\n</answer>"
    assert out == "<think>\nx $5 \\1</think>" + box + r" \boxed{7} " + box


def test_think_closed_before_answer(spark):
    (out, _, methods) = heal(spark, "<THINK>a $1 <Answer>b</answer>")[0]
    assert methods == ["think:add_close_before_answer"]
    assert out == "<THINK>a $1 </think>\n\n<answer>b</answer>"


def test_think_closed_at_first_conclusion(spark):
    text = "<think>" + LONG + "Thus\nit holds. Hence more. rest"
    (out, _, methods) = heal(spark, text)[0]
    assert methods == ["think:add_close_at_conclusion", "answer:pattern_extraction"]
    assert out.startswith("<think>" + LONG + "Thus\nit holds.\n</think>\n\n<answer>\n")


def test_not_healed(spark):
    for text in ("", "no tags at all", "<think>never ends", "<answer>a b c</answer><think>t</think>"):
        assert heal(spark, text) == [(text, False, [])]


def test_healing_twice_changes_nothing(spark):
    texts = [
        "<think>a</think><answer>" + "x" * 30, "t</think><answer>b</answer>",
        r"<think>t</think> \boxed{3}", "<think>t <answer>b</answer>", None, "</think>",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, output string")
    first = heal_samples(df).select("i", "output")
    second = heal_samples(first).select("i", F.col("output").alias("again"))
    assert first.join(second, "i").filter("output <> again").count() == 0


def test_boxed_and_phrase(evaluate):
    assert evaluate(T.boxed_answer, [r"\boxed{ a } \boxed{b{c}d}", r"\boxed{}", "none"]) == [
        "b{c}d", None, None,
    ]
    texts = [
        "Answer: yes. Therefore, we win big. ", "x = 1\ny = long value;\n", "result is 'quoted'",
        "hence no", "nothing here",
    ]
    assert evaluate(T.final_answer, texts) == ["we win big", None, "quoted", None, None]


def test_multi_line_equation(evaluate):
    assert evaluate(T.final_answer, ["a = b + c,\nmore"]) == ["b + c"]


def test_tag_issues(evaluate):
    got = evaluate(
        lambda c: T.tag_issues(T.skeleton(c)),
        [
            "<think></think><answer></answer>", "<think><think></think><answer></answer>",
            "<answer></answer><think></think>", "",
        ],
    )
    assert got[0] == []
    assert got[1] == ["Unbalanced think tags: 2 opens, 1 closes"]
    assert got[2] == [T.ORDER_TEXT]
    assert got[3] == list(T.MISSING_TEXTS.values())
