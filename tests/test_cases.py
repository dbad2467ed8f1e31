"""Literal cases for the rules' corners."""

import pytest
from pyspark.sql import functions as F

from rewardframe.functions import (
    charf1, chat, choices, distilling, enhanced, extract, formats, judging, markup, maths, rules, tokens,
)


def c(name):
    return F.col(name)


@pytest.mark.parametrize("text,want", [
    ("\\boxed{a}", "a"), ("\\boxed{a{b}c} and \\boxed{x{y}}", "x{y}"), ("\\boxed{open", ""), ("none", ""),
    ("\\boxed{1} \\boxed{2", "1"), ("\\boxed{a \\boxed{b} c}", "b"), ("\\boxed{}", ""), ("\\boxed{\\frac{1}{2}}!", "\\frac{1}{2}"),
])
def test_boxed(one, text, want):
    assert one(lambda: extract.boxed_answer(c("t")), t=text) == want


@pytest.mark.parametrize("text,want", [
    ("<answer></answer>\\boxed{4}", ""), ("so \\boxed{4}", "4"), ("The answer is 204.", "204"),
    ("it is 3.5 \nno number here", "3.5"), ("x12", ""), ("v1.5", "5"), ("<answer>a\nb</answer><answer>z</answer>", "a\nb"),
])
def test_tagged(one, text, want):
    assert one(lambda: extract.tagged_answer(c("t")), t=text) == want


@pytest.mark.parametrize("text,want", [
    ("A", "A"), ("The answer is (B).", "B"), ("(C) or (D)", "C"), ("x (D) then (C) then (D)", "C"),
    ("maybe E- or F_", "E"), ("take 2. B now", "B"), ("my choice is: G of it", "G"), ("none", ""), ("", ""),
    ("so it is H", "H"), ("The Answer is c", "A"), ("  'F'  ", "F"), ("xAyBz", "A"), ("xByAzB", "B"), ("xByAzBw", "A"),
])
def test_choice_letter(one, text, want):
    assert one(lambda: choices.choice_letter(c("t")), t=text) == want


@pytest.mark.parametrize("p,g,want", [
    ("B because", "B", 1.0), ("abcdefghij", "abcdefghi", 1.0), ("abc", "abcdef", 0.0), (" x ", "x", 1.0), ("", "", 1.0),
])
def test_relaxed(one, p, g, want):
    assert one(lambda: choices.relaxed_match(c("p"), c("g")), p=p, g=g) == want


@pytest.mark.parametrize("p,g,want", [
    ("so 12 or 13", "13", 1.0), (None, "", 1.0), ("no digits", "", 1.0), ("3.", "3", 0.0), ("x", None, 0.0),
])
def test_number(one, p, g, want):
    assert one(lambda: rules.number_match(c("p"), c("g")), p=p, g=g) == want


@pytest.mark.parametrize("p,g,want", [
    ("I know", "no", 1.0), ("not true", "yes", 1.0), ("maybe", "yes", 0.0), ("", "yes", 0.0), ("False", "no", 1.0),
])
def test_bool(one, p, g, want):
    assert one(lambda: rules.bool_match(c("p"), c("g")), p=p, g=g) == want


def test_choice_match(one):
    f = lambda: rules.choice_match(c("p"), c("g"))
    assert one(f, p=" (b) ", g="B") == 1.0
    assert one(f, p="()", g="") == 1.0
    assert one(f, p="", g="") == 0.0


def test_ocr_takes_the_best_target(one):
    f = lambda: rules.ocr_match(c("p"), c("t"))
    assert one(f, p=" Hello  World", t=["other", "hello world"]) == 1.0
    assert one(f, p="abcd", t=["abxy"]) == 0.5
    assert one(f, p="abcd", t=["wxyz"]) == 0.0


def test_box(one):
    f = lambda: rules.box_iou(c("p"), c("g"))
    assert one(f, p="at [0, 0, 2, 2]", g="[1, 0, 3, 2]") == pytest.approx(1 / 3)
    assert one(f, p="[1, 1, 1, 1]", g="[1,1,1,1]") == 0.0
    assert one(f, p="[1, 2, 3]", g="[1,1,1,1]") == 0.0
    assert one(f, p="[-.5, 0, 1e0, 1]", g="[-0.5, 0, 1, 1]") == 1.0
    assert one(f, p=None, g="[1,1,2,2]") == 0.0


def test_numbers_in(one):
    f = lambda: rules.numbers_in(c("t"))
    assert one(f, t="1,234 and -5 or 0 and 0.5 then 007, -05 and 2e3") == [1234.0, -5.0, 0.5, 7.0, 2000.0]


@pytest.mark.parametrize("text,want", [
    ("<think>a</think><answer>b</answer>", 1.0), ("<think>a</think> mid <answer>b</answer>", 1.0),
    ("<answer>b</answer><think>a</think>", 0.0), ("\\boxed{1}", 1.0), ("<think></answer>", 0.0),
    ("Compute the sum of the first numbers: 1 + 2 + 3 which gives\n6", 0.8),
])
def test_format_score(one, text, want):
    assert one(lambda: formats.format_score(c("t")), t=text) == want


def test_boxed_format(one):
    f = lambda: formats.boxed_format(c("t"))
    assert one(f, t="<think>x</think> \\boxed{4}") == 1.0
    assert one(f, t="<think>x</think><think>y</think> \\boxed{4}") == 0.0
    assert one(f, t="<think>x</think><answer>long answer</answer>\\boxed{4}") == 0.0
    assert one(f, t="\\boxed{4}<think>x</think>") == 0.0


def test_anchored_format(one):
    f = lambda: formats.anchored_format(c("t"))
    assert one(f, t="<Reasoning>\na</REASONING>\n\n<answer>\nb</answer>\n") == 1.0
    assert one(f, t="x<reasoning>a</reasoning><answer>b</answer>") == 0.0


def test_strict_format(one):
    f = lambda: formats.strict_format(c("t"))
    good = one(f, t="<reasoning> a </reasoning><answer>b</answer>")
    assert good["reward"] == 1.0 and good["single_pair_ok"] and good["order_ok"]
    assert one(f, t="<answer>b</answer><reasoning>a</reasoning>")["order_ok"] is False
    assert one(f, t="<reasoning> </reasoning><answer>b</answer>")["reward"] == 0.0
    nested = one(f, t="<reasoning>a <answer x></reasoning><answer>b</answer>")
    assert nested["nested_ok"] is False and nested["open_answer"] == 2


@pytest.mark.parametrize("p,g,want", [
    ("1/2", "0.5", "numeric"), ("\\frac{1}{2}", "1/2", "numeric"), ("(1, 2.001)", "(1,2)", "tuple"), ("X ", "x", "text"),
    ("", "1", "none"), ("1/0", "1", "none"), ("3.14159", "3.14", "numeric"), ("[1,b]", "[1,2]", "none"), ("x+1", "1+x", "none"),
])
def test_math_method(one, p, g, want):
    assert one(lambda: maths.math_method(c("p"), c("g")), p=p, g=g) == want


@pytest.mark.parametrize("tex,want", [
    ("\\sqrt3 + \\frac12", "\\sqrt{3}+\\frac{1}{2}"), ("\\frac12", "\\frac12"), ("0.5", "\\frac{1}{2}"), (".5", "\\frac{1}{2}"),
    ("3/4", "\\frac{3}{4}"), ("03/4", "03/4"), ("x=5", "5"), ("a=b=c", "a=b=c"), ("5\\text{ cm}", "5"), ("30^\\circ", "30"),
    ("\\sqrt{2}\\frac1", "\\sqrt{2}\\frac1"), ("", ""),
])
def test_latex_normal(one, tex, want):
    assert one(lambda: maths.latex_normal(c("t")), t=tex) == want


def test_math_answer(one):
    f = lambda: maths.math_answer(c("t"))
    assert one(f, t="so \\boxed{X = 12 km}") == "12"
    assert one(f, t="7}") == "7"


@pytest.mark.parametrize("text,want", [
    ("<answer>(A) </answer>", "A)"), ("<answer>(A)</answer>", "A"), ("I think\nFinal answer: 42\n", "42"),
    ("the value is 7.", "7"), ("we pick (C).", "c"), ("The answer is **12**\nthen the answer: 13", "13"), ("nothing here", ""),
    ("B\nbecause", "b"), ("Correct answer is option 5. Yes", "5"),
])
def test_lenient(one, text, want):
    assert one(lambda: maths.lenient_answer(c("t")), t=text) == want


def test_small_text_tools(one):
    assert one(lambda: maths.without_extra_zeros(c("t")), t="3.10") == "3.1"
    assert one(lambda: maths.without_extra_zeros(c("t")), t="5.0") == "5"
    assert one(lambda: maths.without_extra_zeros(c("t")), t="abc") == "abc"
    assert one(lambda: maths.formula(c("t")), t="so <<1+2=3>>") == "1+2=3"
    assert one(lambda: maths.formula(c("t")), t="<<a>> <<b>>") is None
    assert one(lambda: maths.in_area(c("t"), "algebra"), t="abstract_algebra_test.csv_1") is True
    assert one(lambda: maths.in_area(c("t"), "precalculus"), t="abstract_algebra_test.csv_1") is False


def test_svg_repair(one):
    f = lambda: markup.repaired_svg(c("t"))
    assert one(f, t="<svg><g><rect x='1'>ab</rect><pa") == "<svg><g><rect x='1'>ab</rect></g></svg>"
    assert one(f, t="<svg></svg>") == "<svg></svg>"
    assert one(f, t="  ") == "  "


def test_code_block(one):
    f = lambda: extract.python_block(c("t"))
    assert one(f, t=" x ```python\nprint(1)\n``` y") == "print(1)"
    assert one(f, t="```python\nprint(2)") == "print(2)"
    assert one(f, t=" plain ") == "plain"


def test_reply_lines(one):
    f = lambda: distilling.think_lines(c("t"))
    assert one(f, t="解释: one\n two \nAnswer: z") == ["one", "two"]
    assert one(f, t="<think>\n a \n\nanswer: x\n b</think>") == ["a", "b"]
    assert one(f, t="Answer: only") == []


def test_same_text_similarity(one):
    f = lambda: distilling.same_text_similarity(c("a"), c("b"))
    assert one(f, a="Ab, c!", b="abc") == 1.0
    assert one(f, a="!!", b="!!") == 0.0
    assert one(f, a="abcd", b="bcde") == 0.0


def test_boxed_answer_is_the_last_closed_box(one):
    f = lambda: extract.boxed_answer(c("t"))
    for t, want in (
        (r"\boxed{a}", "a"), (r"\boxed{a{b}c} \boxed{d", "a{b}c"), (r"\boxed{a\boxed{b}}", "b"), (r"\boxed{a\boxed{b}", "b"),
        (r"\boxed{a{b}", ""), (r"}\boxed{} {", ""), (r"\boxed{x}}{\boxed{\frac{1}{2}} y}", r"\frac{1}{2}"), ("none", ""), (r"a \boxed{{}", ""),
    ):
        assert one(f, t=t) == want, t


def test_many_boxes_are_read_in_linear_time(one):
    import time

    f = lambda: extract.boxed_answer(c("t"))
    one(f, t="x")
    start = time.perf_counter()
    assert one(f, t="\\boxed{some text {x}" * 50_000) == ""
    assert one(f, t="\\boxed{{some te}xt}" * 50_000) == "{some te}xt"
    assert time.perf_counter() - start < 8


def test_char_f1(one):
    f = lambda: charf1.char_f1(c("p"), c("g"))
    assert one(f, p="aab", g="abb") == pytest.approx(2 / 3)
    assert one(f, p="x", g="y") == 0.0
    assert one(f, p="x", g=" ") is None
    assert one(f, p="日本", g="日本") == 1.0


def test_conversation(one):
    f = lambda: chat.conversation(c("t"))["state"]
    assert one(f, t="not json") == "json_error"
    assert one(f, t='{"role":"user"}') == "non_standard"
    assert one(f, t='[{"content":"a"}]') == "non_standard"
    assert one(f, t='[{"content":5},{"content":"b"}]') == "empty_text"
    assert one(f, t='["a",{"content":"b"}]') == "empty_text"
    assert one(f, t='[{"content":"a"},{"content":"b"},{"content":"c"}]') == "ok"
    assert one(f, t=None) == "json_error"


def test_reasoning_parse(one):
    r = lambda: extract.reasoning_part(extract.clean_generated(c("t")))
    a = lambda: extract.answer_part(extract.clean_generated(c("t")))
    assert one(r, t="Reasoning: a\nb\n answer： c") == "a\nb"
    assert one(a, t="Reasoning: a\nb\n answer： c") == "c"
    assert one(r, t="plain") is None
    assert one(lambda: extract.shown_reasoning(c("t")), t="N/A") == extract.NO_REASONING_TEXT


def test_layered_answer(one):
    f = lambda: extract.layered_answer(c("t"))
    assert one(f, t="<answer> x </answer>") == "x"
    assert one(f, t="text\nthe choice is (B)\ntail") == "B"
    assert one(f, t="long line of many words here now 5\nx = 12") == "12"
    assert one(f, t="only words in this line\n\nAnswer: blue sky") == "blue sky"


def test_answer_check(one):
    f = lambda: enhanced.answer_check(c("p"), c("g"), c("k"))["method"]
    assert one(f, p=" Yes", g="yes ", k="ANY") == "exact_match"
    assert one(f, p="0.5", g="1/2", k="NUMBER") == "math_verify"
    assert one(f, p="(b)", g="B", k="MULTIPLE_CHOICE") == "all_failed"
    assert one(f, p="B.", g="B", k="MULTIPLE_CHOICE") == "choice_match"
    assert one(f, p="it is blue", g="blue", k="ANY") == "contained"
    assert one(f, p="x 7 y", g="z 7.0", k="NUMBER") == "numerical"


def test_rule_judge(one):
    f = lambda: judging.rule_judge(c("p"), c("t"), c("g"))["score"]
    assert one(f, p="", t="the cat", g="cat") == 1.0
    assert one(f, p="", t="the Cat", g=" cat") == 0.8
    assert one(f, p="", t="**boxed{Dog}", g="DOG ") == 0.8
    assert one(f, p="", t="**boxed{x}", g="dog") == 0.0
    assert one(f, p="", t="**boxed{", g="dog") == 0.5
    assert one(f, p="long prompt", t="cat", g="cat") == 0.9
    assert one(f, p="", t="x", g=None) == 0.5


def test_judge_replies(one):
    f = lambda: judging.judge_scores(c("t"))
    assert tuple(one(f, t='{"reasoning": 2, "answer": "0.5"}')) == (1.0, 0.5, 1.5, None)
    assert tuple(one(f, t='ok {"answer": 0.25} end')) == (0.0, 0.25, 0.25, None)
    assert one(f, t=" ")["error"] == "empty_response"
    assert one(f, t='[{"answer": 1}]')["error"] == "json_parse_failed"
    assert one(lambda: judging.judge_detail(c("t")), t="about 0.75 of 1.0")["score"] == 0.75
    assert one(lambda: judging.judge_int(c("t")), t=" 1\n") == 1
    assert one(lambda: judging.judge_int(c("t")), t="1.0") == 0


def test_detailed_reply(one):
    f = lambda: judging.detailed_result(c("t"))
    full = one(f, t='{"score": 0.5, "detailed_scores": {"format": 1, "reasoning": 0.2}, "explanation": "ok"}')
    assert (full["answer_score"], full["thinking_score"], full["format_score"]) == (0.5, 0.2, 1.0)
    assert full["confidence"] == 0.8 and full["explanation"] == "ok"
    assert one(f, t="broken")["score"] == 0.0 and one(f, t="broken")["confidence"] == 0.0


def test_loss_labels(spark):
    ids = [9, 1, 2, 5, 6, 3, 4, 7, 1, 2, 8]
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    got = df.select(tokens.loss_labels(F.col("ids"), [1, 2], [3, 4], 10).alias("v")).first()["v"]
    assert got == [-100, -100, -100, 5, 6, 3, 4, -100, -100, -100, -100]
    longer = df.select(tokens.loss_labels(F.col("ids"), [1, 2], [3, 4], 11).alias("v")).first()["v"]
    assert longer[-1] == 8


def test_image_runs(spark):
    df = spark.createDataFrame([([5, 5, 1, 5, 2, 5, 5, 5],), ([],)], "ids array<int>")
    got = [[tuple(x) for x in r["v"]] for r in df.select(tokens.image_runs(F.col("ids"), 5).alias("v")).collect()]
    assert got == [[(0, 2), (3, 1), (5, 3)], []]
