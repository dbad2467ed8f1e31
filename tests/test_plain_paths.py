"""Texts of plain shapes are scored without patterns or lambdas, odd ones as before; frames read twice are made once."""

import pytest
from pyspark.sql import functions as F

from rewardframe.functions import extract, formats, maths, markup, rules
from rewardframe.operators import codetests, rewards, rollout


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _texts(spark):
    return spark.createDataFrame([("x", "1", "NUMBER")], "completion string, answer string, answer_type string")


@pytest.mark.parametrize("text, body", [
    ("<answer>a</answer>", "a"), ("<answer>a</answer> b</answer>", "a"), ("<answer>a<answer>b</answer>", "a<answer>b"),
    ("</answer><answer>a", None), ("<answer>a", None), ("<answer>a</answer><answer>é\n</answer><answer>", "é\n"), ("", None), (None, None),
])
def test_last_answer(one, text, body):
    assert one(lambda: extract.last_answer(F.col("c")), c=text) == body


def test_strict_answer_binds_nothing(spark, one):
    assert "lambda" not in _plan(_texts(spark).select(maths.strict_answer(F.col("completion"))))
    assert one(lambda: maths.strict_answer(F.col("c")), c=" <answer> (A)</answer> ") == "(A"
    assert one(lambda: maths.strict_answer(F.col("c")), c="<answer>f(A)</answer>") == "f(A)"


@pytest.mark.parametrize("text, reward, opened, clean", [
    ("<Reasoning>a</REASONING><answer>b</answer>", 1.0, 1, True),
    ("<reasoning x='1'><reasoning>a</reasoning><answer>b</answer>", 0.0, 2, True),
    ("<reasonings><reasoning>a</reasoning><answer>b</answer>", 1.0, 1, True),
    ("<reasoning>a < b</reasoning><answer>b</answer>", 1.0, 1, True),
    ("<reasoning>a </ answer x</reasoning><answer>b</answer>", 0.0, 1, False),
    ("<reasoning>　</reasoning><answer>b</answer>", 0.0, 1, True),
    ("<answer>b</answer><reasoning>a</reasoning>", 0.0, 1, True),
    ("<reasonİng>a</reasonİng><answer>b</answer>", 0.0, 0, True),
])
def test_strict_format_of_odd_tags(one, text, reward, opened, clean):
    got = one(lambda: formats.strict_format(F.col("c")), c=text)
    assert (got["reward"], got["open_reasoning"], got["nested_ok"]) == (reward, opened, clean)


def test_strict_format_counts_plain_tags_without_patterns(spark):
    plan = _plan(_texts(spark).select(formats.strict_format(F.col("completion"))["close_answer"].alias("n")))
    assert "regexp" not in plan


@pytest.mark.parametrize("text, score", [
    (" 　<think>a</think>\n<answer>b</answer>\x85", 1.0), ("<think>a</think>x<answer>b</answer>", 0.0),
    ("x<think>a</think><answer>b</answer>", 0.0), ("<think>a</think><answer>b</answer>x", 0.0), ("<think></answer>", 0.0),
    ("<think>" + "a" * 99 + "</think>\\boxed{1}<answer>b</answer> ", 1.0), ("<think>a</think>\\boxed{1}<answer>bcdef</answer> ", 0.0),
])
def test_xml_format(one, text, score):
    assert one(lambda: formats.xml_format(F.col("c")), c=text) == score


def test_composite_reward_binds_nothing(spark):
    assert "lambda" not in _plan(rewards.composite_rewards(_texts(spark)).select("reward"))


def _plain_rewards(df):
    """The router by the rules over (last answer, completion, gold), one by one."""
    pred, c, gold, kind = F.col("p"), F.col("completion"), F.col("answer"), F.col("answer_type")
    by_type = {
        "MATH_EXPRESSIONS": maths.math_match(c, gold), "HTML_CODE": markup.html_score(markup.html_code(c), gold),
        "SVG_CODE": markup.svg_score(markup.svg_code(c), gold), "BOOLEAN": rules.bool_match(pred, gold),
        "OCRTEXT": rules.ocr_match(pred, F.array(gold)), "BBOX": rules.box_iou(pred, gold),
    }
    score = F.lit(None).cast("double")
    for name, value in by_type.items():
        score = F.when(kind == name, value).otherwise(score)
    return df.withColumn("p", extract.last_answer(F.coalesce(c, F.lit("")))).withColumn("plain", score)


def test_paired_rules_score_as_the_rules_do(spark):
    bodies = [
        "", " ", "a", "Yes", "no, true", "A  b", "é　b", "1/2", "\\frac{1}{2}", "(1, 2)", "[1, 2, 3, 4]", "[ 1,2 ,\t3,5 ]", '<svg a="1"><b/></svg>',
        "<SVG a='1'><b/></SVG>", "<p>x</p><!-- c -->", "<p>x \n</p>", "<html>a</html>", "<!DOCTYPE HTML>a", "```html\n<p>x</p>```", "x\x7f", "\x85x", None,
    ]
    shapes = ["<answer>{}</answer>", "<answer>{}</answer> b</answer>", "<answer>a</answer><answer>{}</answer>", "see {}", "</answer><answer>{}"]
    kinds = ["MATH_EXPRESSIONS", "HTML_CODE", "SVG_CODE", "BOOLEAN", "OCRTEXT", "BBOX"]
    rows = [(s.format(a) if a is not None else None, b, k, "GENERAL") for a in bodies for b in bodies for s in shapes for k in kinds]
    df = spark.createDataFrame(rows, "completion string, answer string, answer_type string, problem_type string")
    got = _plain_rewards(rewards.routed_rewards(df.repartition(8), "TYPE_BASED_RULE")).select(*df.columns, "acc_reward", "plain").collect()
    assert [r for r in got if r["acc_reward"] != r["plain"]] == []


def test_routed_rewards_take_the_last_answer_once(spark):
    df = _texts(spark).withColumn("problem_type", F.lit("GENERAL"))
    assert _plan(rewards.routed_rewards(df, "TYPE_BASED_RULE").select("reward")).count("substring_index") == 2


def test_code_samples_are_made_once(spark):
    df = spark.createDataFrame([(1, "<answer>f(x)</answer>", '{"tests":[{"input":"1","output":"2"}]}')], "id long, completion string, answer string")
    runs = spark.createDataFrame([(1, 0, 0, " 2\n")], "id long, test int, return_code int, stdout string")
    out = codetests.code_rewards(df, runs, "id")
    assert "from_json" not in _plan(out).lower() and "parse_json" not in _plan(out).lower()
    assert [tuple(r) for r in out.collect()] == [(1, 1.0)]


@pytest.mark.parametrize("code", ["x", "OPEN(1)", "import os\nos.Remove(1)", "rm -f", None])
def test_calls_forbidden(one, code):
    found = one(lambda: F.size(extract.forbidden_calls(F.col("c"))) > 0, c=code)
    assert one(lambda: extract.calls_forbidden(F.col("c")), c=code) == found or code is None
