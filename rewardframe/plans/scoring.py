"""Queries over completions: extraction, rule rewards, formats, router (ids E1-E38)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import charf1, choices, extract, formats, markup, maths, rules
from ..functions.chat import chat_turns, eval_fields
from ..functions.text import WHITESPACE, join_list, json_quote, text
from ..operators.codetests import code_rewards, code_samples
from ..operators.judge import judged_by, request_key, unique_requests
from ..operators.rewards import (
    composite_rewards, judged_rewards, routed_rewards, rule_scores, type_based_answer, uses_judge,
)
from ..session import settled
from .registry import (
    BBOX_SQL, BOOL_SQL, CHOICE_SQL, CRITIC_SQL, HTML_CODE_SQL, HTML_SQL, MATH_SQL, NUMBER_SQL, OCR_SQL, RO,
    SCORED, STRING_SQL, SVG_CODE_SQL, SVG_SQL, THINK_BOX_SQL, WSC, bodies, flag_sql, math_method_sql, pred,
    q6, query, r6, strict_sql, times, trim,
)
from .views import Tables



def C():
    return F.col("completion")


def A():
    return F.col("answer")


def P():
    return F.col("p")



def _pred(t: Tables):
    return t("rollouts").withColumn("p", extract.last_answer(C()))



# --- extraction ----------------------------------------------------------------------------------

BOXED_SQL = (
    r"coalesce(list_extract(regexp_extract_all(completion, '\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}', 1), -1), '')"
)
_LINE_NUM = rf"(?:^|[^\p{{L}}\p{{N}}_])(\d+(?:\.\d+)?){WSC}*\.?{WSC}*$"
LINE_NUMBER_SQL = (
    f"coalesce(list_extract(list_filter(list_transform(string_split({trim('completion')}, chr(10)), "
    f"lambda l: regexp_extract(l, '{_LINE_NUM}', 1)), lambda x: x <> ''), -1), '')"
)
TAGGED_SQL = f"coalesce(list_extract({bodies('completion')}, 1), nullif({BOXED_SQL}, ''), {LINE_NUMBER_SQL})"


def plain_sql(x: str) -> str:
    return trim(f"(CASE WHEN ends_with({x}, '.') THEN left({x}, length({x}) - 1) ELSE {x} END)")


@query("e1_answer_bodies", f"""SELECT id, g, len({bodies('completion')}) AS n_bodies,
    coalesce({pred('completion')}, '<none>') AS last_body FROM rollouts""")
def _(t):
    b = extract.answer_bodies(C())
    return t("rollouts").select("id", "g", F.size(b).alias("n_bodies"),
                                F.coalesce(extract.last_answer(C()), F.lit("<none>")).alias("last_body"))


@query("e2_boxed_answer", f"SELECT id, g, {BOXED_SQL} AS boxed FROM rollouts")
def _(t):
    return t("rollouts").select("id", "g", extract.boxed_answer(C()).alias("boxed"))


@query("e3_tagged_answer", f"SELECT id, g, {TAGGED_SQL} AS answer_text FROM rollouts")
def _(t):
    return t("rollouts").select("id", "g", extract.tagged_answer(C()).alias("answer_text"))


@query("e4_plain_answer", f"""SELECT id, g, {plain_sql('completion')} AS plain, answer || ', ' || problem AS joined FROM rollouts""")
def _(t):
    return t("rollouts").select(
        "id", "g", extract.plain_answer(C()).alias("plain"), join_list(F.array("answer", "problem")).alias("joined")
    )


def _tier(forms: list[tuple[str, str]]) -> str:
    items = []
    for before, after in forms:
        for x in "ABCDEFGH":
            n = f"{before}{x}{after}"
            items.append(
                f"CASE WHEN contains(r, '{n}') THEN [length(r) - instr(reverse(r), '{n[::-1]}') + 1 - {len(n)}, {ord(x)}] END"
            )
    return f"chr(CAST(list_extract(list_min(list_filter([{', '.join(items)}], lambda v: v IS NOT NULL)), 2) AS INT))"


def _numbered() -> str:
    items = [
        f"CASE WHEN contains(r, '{i}. {x}') THEN [length(r) - instr(reverse(r), '{x} .{i}') + 1 - 4, {ord(x)}] END"
        for i, x in enumerate("ABCDEFGH", 1)
    ]
    return f"chr(CAST(list_extract(list_min(list_filter([{', '.join(items)}], lambda v: v IS NOT NULL)), 2) AS INT))"


def _core(x: str) -> str:
    out = trim(x)
    for ch in (",", ".", "!", "?", ";", ":", "''", '"'):
        out = f"trim({out}, '{ch}')"
    return out


_PHRASE = "|".join(choices.ANSWER_PHRASES)


def mcq_ctes(src: str) -> str:
    """Rows of ``src`` (pred, gold, ...) with the choice letter of the prediction, as ``m``."""
    return f"""m0 AS (SELECT *, ' ' || {_core('pred')} || ' ' AS r FROM {src}),
m AS (SELECT * EXCLUDE (r), CASE WHEN NOT regexp_matches({trim('r')}, '[A-H]') THEN '' ELSE coalesce(
  nullif(regexp_extract({trim('r')}, '^([A-H])', 1), ''), nullif(regexp_extract({trim('r')}, '([A-H])$', 1), ''),
  {_numbered()},
  CASE WHEN regexp_matches(lower(r), '{_PHRASE}') THEN nullif(regexp_extract(substr(r, instr(lower(r), regexp_extract(lower(r), '{_PHRASE}'))), '[A-H]'), '') END,
  {_tier([('(', ')')])}, {_tier([('', '.')])}, {_tier([('', ':')])}, {_tier([('', ')')])}, {_tier([('', ' ')])},
  {_tier([('', '-'), ('', '_'), ('', '=')])}, {_tier([('', '')])}, '') END AS letter FROM m0)"""


RELAXED_SQL = (
    f"CASE WHEN regexp_matches(gold, '^[A-H]$') THEN {flag_sql('letter = gold')} ELSE "
    + flag_sql(
        "(contains(gold, pred) AND length(pred) >= 0.9 * length(gold)) OR (contains(pred, gold) "
        f"AND length(gold) >= 0.9 * length(pred)) OR {trim('pred')} = {trim('gold')}"
    )
    + " END"
)


@query("e5_choice_letter", f"WITH {mcq_ctes('mcq')} SELECT id, letter FROM m")
def _(t):
    return t("mcq").select("id", choices.choice_letter(F.col("pred")).alias("letter"))


@query("e6_relaxed_match", f"WITH {mcq_ctes('mcq')} SELECT id, {RELAXED_SQL} AS score FROM m")
def _(t):
    return t("mcq").select("id", choices.relaxed_match(F.col("pred"), F.col("gold")).alias("score"))


_INNER = "substr(completion, 8, length(completion) - 16)"
THINK_ANSWER_SQL = (
    f"(starts_with(completion, '<think>') AND ends_with(completion, '</answer>') AND length(completion) >= 16 "
    f"AND instr({_INNER}, '</think>') > 0 AND contains(substr({_INNER}, instr({_INNER}, '</think>') + 8), '<answer>'))"
)
FORMAT_SQL = (
    f"(CASE WHEN {THINK_ANSWER_SQL} OR {BOXED_SQL} <> '' THEN 1.0 WHEN length({trim('completion')}) > 50 "
    rf"AND regexp_matches(completion, '[=+\-*/()\[\]\\]') AND {TAGGED_SQL} <> '' THEN 0.8 ELSE 0.0 END)"
)


@query("e7_rule_score", f"""WITH rs AS (SELECT id, g, {plain_sql(trim(TAGGED_SQL))} AS pred, {plain_sql('answer')} AS gold, {FORMAT_SQL} AS fs FROM rollouts),
    {mcq_ctes('rs')}, ac AS (SELECT *, CASE WHEN {RELAXED_SQL} > 0 OR {math_method_sql('pred', 'gold')} <> 'none' THEN 1.0 ELSE 0.0 END AS acc FROM m)
    SELECT id, g, pred AS predict_str, gold AS ground_truth, {q6('acc')} AS acc_score, {q6('fs')} AS format_score, {q6('0.9 * acc + 0.1 * fs')} AS score FROM ac""")
def _(t):
    return rule_scores(t("rollouts")).select(
        "id", "g", "predict_str", "ground_truth", r6(F.col("acc_score")).alias("acc_score"),
        r6(F.col("format_score")).alias("format_score"), r6(F.col("score")).alias("score"),
    )


@query("e8_format_score", f"SELECT id, g, CAST({FORMAT_SQL} AS DOUBLE) AS score FROM rollouts")
def _(t):
    return t("rollouts").select("id", "g", formats.format_score(C()).alias("score"))


# --- rule rewards --------------------------------------------------------------------------------

def _rule(name: str, sql: str, fn):
    @query(name, f"WITH {RO} SELECT id, g, {q6(sql)} AS score FROM ro")
    def _(t):
        return _pred(t).select("id", "g", r6(fn()).alias("score"))


_rule("e9_number", NUMBER_SQL, lambda: rules.number_match(P(), A()))
_rule("e10_string", STRING_SQL, lambda: rules.string_match(P(), A()))
_rule("e11_bool", BOOL_SQL, lambda: rules.bool_match(P(), A()))
_rule("e12_choice", CHOICE_SQL, lambda: rules.choice_match(P(), A()))
_rule("e13_critic", CRITIC_SQL, lambda: rules.exact_match(P(), A()))
_rule("e14_ocr", OCR_SQL, lambda: rules.ocr_match(P(), F.array(A())))
_rule("e15_bbox", BBOX_SQL, lambda: rules.box_iou(P(), A()))


@query("e16_html", f"SELECT id, {q6(HTML_SQL)} AS score FROM (SELECT *, {HTML_CODE_SQL} AS code FROM markup)")
def _(t):
    m = t("markup").withColumn("code", markup.html_code(C()))
    return m.select("id", r6(markup.html_score(F.col("code"), A())).alias("score"))


@query("e17_svg", f"SELECT id, {q6(SVG_SQL)} AS score FROM (SELECT *, {SVG_CODE_SQL} AS code FROM svgs)")
def _(t):
    m = t("svgs").withColumn("code", markup.svg_code(C()))
    return m.select("id", r6(markup.svg_score(F.col("code"), A())).alias("score"))


@query("e18_svg_repair", r"""WITH w AS (SELECT id, regexp_replace(completion, '<[^>]*$', '') AS s FROM svgs),
  tags AS (SELECT id, s, regexp_extract_all(s, '<([a-zA-Z]+)[^>]*>', 1) AS o, regexp_extract_all(s, '</([a-zA-Z]+)>', 1) AS c FROM w),
  seen AS (SELECT id, s, o, c, list_filter(list_transform(o, lambda t, i: CASE WHEN list_position(o, t) = i THEN t END), lambda t: t IS NOT NULL) AS d FROM tags),
  fixed AS (SELECT id, s || coalesce(array_to_string(list_reverse(list_transform(d, lambda t: repeat('</' || t || '>',
      CAST(greatest(0, len(list_filter(o, lambda x: x = t)) - len(list_filter(c, lambda x: x = t))) AS INT)))), ''), '') AS f FROM seen)
  SELECT id, CASE WHEN ends_with(trim(f, chr(10) || chr(32)), '</svg>') THEN f ELSE f || '</svg>' END AS repaired FROM fixed""")
def _(t):
    return t("svgs").select("id", markup.repaired_svg(C()).alias("repaired"))


@query("e19_math", f"SELECT id, g, {math_method_sql(strict_sql('completion'), 'answer')} AS method, {MATH_SQL} AS score FROM rollouts")
def _(t):
    r = t("rollouts").withColumn("method", maths.math_method(text(maths.strict_answer(C())), A()))
    return r.select("id", "g", "method", F.when(F.col("method") != "none", 1.0).otherwise(0.0).alias("score"))


LATEX = r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 8
  WHEN 0 THEN 'x = ' || chr(92) || 'tfrac' || k || '3' WHEN 1 THEN chr(92) || 'sqrt' || k || ' + ' || chr(92) || 'frac12' WHEN 2 THEN k || '/' || CAST(l_linenumber AS STRING)
  WHEN 3 THEN '.5' WHEN 4 THEN '$' || k || chr(92) || '%$' WHEN 5 THEN k || '^' || chr(92) || 'circ'
  WHEN 6 THEN k || chr(92) || 'text' || chr(123) || ' apples' || chr(125) ELSE chr(92) || 'left(' || k || ', .5' || chr(92) || 'right)' END AS tex
  FROM (SELECT *, CAST(l_linenumber AS STRING) AS k FROM lineitem) t"""


def _latex(t):
    li = t("lineitem")
    k = F.col("l_linenumber").cast("string")
    shape = F.col("l_suppkey") % 8
    forms = [
        F.concat(F.lit("x = \\tfrac"), k, F.lit("3")), F.concat(F.lit("\\sqrt"), k, F.lit(" + \\frac12")),
        F.concat(k, F.lit("/"), k), F.lit(".5"), F.concat(F.lit("$"), k, F.lit("\\%$")),
        F.concat(k, F.lit("^\\circ")), F.concat(k, F.lit("\\text{ apples}")),
    ]
    tex = F.concat(F.lit("\\left("), k, F.lit(", .5\\right)"))
    for i, f in enumerate(forms):
        tex = F.when(shape == i, f).otherwise(tex)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tex.alias("tex"))


@query("e20_latex_normal", rf"""WITH l AS ({LATEX}), a AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(tex,
    'tfrac', 'frac'), '\left', ''), '\right', ''), '^\circ', ''), '$', ''), '\%', ''), ' .', ' 0.') AS s FROM l),
  b AS (SELECT *, CASE WHEN contains(s, '\text' || chr(123) || ' ') THEN string_split(s, '\text' || chr(123) || ' ')[1] ELSE s END AS s1 FROM a),
  c AS (SELECT *, CASE WHEN starts_with(s1, '.') THEN '0' || s1 ELSE s1 END AS s2 FROM b),
  d AS (SELECT *, CASE WHEN len(string_split(s2, '=')) = 2 THEN string_split(s2, '=')[2] ELSE s2 END AS s3 FROM c),
  e AS (SELECT *, replace(regexp_replace(s3, '\\sqrt([^{{])', '\\sqrt{{\1}}'), ' ', '') AS s4 FROM d),
  f AS (SELECT *, CASE WHEN contains(s4, 'sqrt') THEN regexp_replace(s4, '\\frac([^{{])([^{{])', '\\frac{{\1}}{{\2}}') ELSE s4 END AS s5 FROM e),
  h AS (SELECT *, CASE WHEN s5 = '0.5' THEN '\frac{{1}}{{2}}' ELSE s5 END AS s6 FROM f)
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, regexp_replace(s6, '^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$', '\\frac{{\1}}{{\2}}') AS normal FROM h""")
def _(t):
    return _latex(t).withColumn("normal", maths.latex_normal(F.col("tex"))).drop("tex")


@query("e21_strict_answer", f"SELECT id, g, {strict_sql('completion')} AS strict FROM rollouts")
def _(t):
    return t("rollouts").select("id", "g", maths.strict_answer(C()).alias("strict"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced_sql(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, {_quoted(old)}, {_quoted(new)})"
    return x


def _first_sql(x: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_quoted(pattern)}) THEN regexp_extract({x}, {_quoted(pattern)}, 1) END"


def _tidy_sql(x: str) -> str:
    return trim(f"regexp_replace(regexp_replace({x}, '^option', ''), '(?s)^\\*\\*(.*)\\*\\*$', '\\1')")


def _last_part_sql(x: str, mark: str) -> str:
    return f"string_split({x}, {_quoted(mark)})[-1]"


def _after_only_sql(x: str, mark: str) -> str:
    return f"CASE WHEN len(string_split({x}, {_quoted(mark)})) = 2 THEN string_split({x}, {_quoted(mark)})[2] ELSE {x} END"


def _lenient_sql() -> str:
    """Steps of the lenient answer; matches of a lead-in are walked from left to right."""
    ends = [p.replace(r"\z", "$") for p in maths.OPTION_ENDS]
    starts = [p.replace(r"\A", "^") for p in maths.OPTION_STARTS[:2]]
    pair = r"CASE WHEN regexp_matches(t, '^\([A-Za-z]\) [A-Za-z]\n') AND substr(t, 2, 1) = substr(t, 5, 1) THEN substr(t, 2, 1) END"
    chosen = ", ".join([*[_first_sql("t", p) for p in ends + starts], pair])
    number = maths.ANY_NUMBER.replace(r"\A", "^").replace(r"\z", "$")
    tail = f"rtrim({trim(_last_part_sql('t', 'is'))}, '.')"
    tail = trim(f"regexp_replace({tail}, '^the ', '')")
    tail = trim(f"regexp_replace({tail}, '^:', '')")
    leads = ", ".join(f"({i + 2}, {_quoted(f'({lead})(.*?){end}')})" for i, (lead, end) in enumerate(maths.LEAD_INS))
    named = " || ".join(f"regexp_extract_all(best, {_quoted(p.replace(chr(92) + 'A', '^'))}, 1)" for p in maths.NAMED_OPTION)
    steps = [
        ("replace(lower(x), '{}', '')"), (f"coalesce({_first_sql('x', '(?s)oxed' + chr(92) + '{(.*)' + chr(92) + '}')}, x)"),
        (r"regexp_replace(x, '(?s)^([^{}]*)\}.*$', '\1')"), (_last_part_sql("x", "=")), (_last_part_sql("x", "\\approx")),
        (_replaced_sql("x", maths.ANSWER_CLEANUP)), (_replaced_sql("x", maths.FIRST_CLEANUP)), ("string_split(x, '\\text{ ')[1]"),
        (_replaced_sql("x", maths.DECIMAL_CLEANUP)), (r"regexp_replace(x, '^\.', '0.')"), (_after_only_sql("x", "=")),
        (_after_only_sql("x", "\\approx")), (r"regexp_replace(x, '(?s)\\sqrt([^{\\])', '\\sqrt{\1}', 'g')"), ("replace(x, ' ', '')"),
        (r"regexp_replace(x, '^0\.5$', '\\frac{1}{2}')"), (r"regexp_replace(x, '^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$', '\\frac{\1}{\2}')"),
        (r"regexp_replace(x, '\(([A-Za-z])\)', '\1', 'g')"), (r"regexp_replace(x, '\{([A-Za-z])\}', '\1', 'g')"),
        (f"ltrim(rtrim(x, '{WHITESPACE}.'), '{WHITESPACE}:')"),
    ]
    ctes = [
        f"src AS (SELECT id, g, {trim('completion')} AS t, {strict_sql('completion')} AS strict FROM rollouts)",
        f"sure AS (SELECT id, g, t, list_min(list_filter([{chosen}], lambda x: x IS NOT NULL)) AS chosen, {tail} AS tail FROM src WHERE strict = '')",
        f"led AS (SELECT id, g, t, rank, p, regexp_extract_all(t, p) AS m FROM sure, (VALUES {leads}) v(rank, p) WHERE contains(t, 'nswer') AND regexp_matches(t, p))",
        """walk AS (SELECT id, g, t, rank, p, m, 1 AS k, strpos(t, m[1]) AS place FROM led UNION ALL
          SELECT id, g, t, rank, p, m, k + 1, place + length(m[k]) - 1 + strpos(substr(t, place + length(m[k])), m[k + 1]) FROM walk WHERE k < len(m))""",
        f"""pool AS (SELECT id, g, 0 AS far, 0 AS rank, {_tidy_sql('chosen')} AS body FROM sure UNION ALL
          SELECT id, g, 0, 1, {_tidy_sql('tail')} FROM sure WHERE regexp_matches(tail, {_quoted(number)}) OR regexp_matches(tail, '^[A-Z]$') UNION ALL
          SELECT id, g, length(t) - (place + length(regexp_extract(m[k], p, 1)) - 1), rank, {_tidy_sql(trim('regexp_extract(m[k], p, 2)'))} FROM walk)""",
        "near AS (SELECT id, g, min(struct_pack(far := far, rank := rank, body := body)).body AS best FROM pool WHERE body <> '' GROUP BY id, g)",
        f"x0 AS (SELECT id, g, coalesce(list_min({named}), best) AS x FROM near)",
        *[f"x{i + 1} AS (SELECT id, g, {step} AS x FROM x{i})" for i, step in enumerate(steps)],
    ]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
    SELECT src.id, src.g, CASE WHEN strict <> '' THEN strict ELSE coalesce(x, '') END AS lenient
    FROM src LEFT JOIN x{len(steps)} f ON f.id = src.id AND f.g = src.g"""


# Braces of fractions beside a root are left to the literal cases: no completion here has both.
@query("e21_lenient_answer", _lenient_sql())
def _(t):
    return t("rollouts").select("id", "g", maths.lenient_answer(C()).alias("lenient"))


@query("e22_numbers", r"""SELECT id, len(ns) AS n_numbers, (round(coalesce(list_sum(ns), 0), 6) + CAST(0 AS DOUBLE)) AS total,
    CASE WHEN contains(kept, '.') THEN rtrim(rtrim(kept, '0'), '.') ELSE kept END AS bare, hot FROM (
    SELECT id, list_filter(list_transform(regexp_extract_all(replace(problem || ' ' || answer, ',', ''), '[+-]? *(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?'),
      lambda x: CASE WHEN NOT regexp_matches(replace(ltrim(trim(x), ' 0'), ' ', ''), '^[+-]0+[1-9]\d*$') THEN TRY_CAST(replace(ltrim(trim(x), ' 0'), ' ', '') AS DOUBLE) END),
      lambda v: v IS NOT NULL) AS ns, answer AS kept, contains('data/' || lower(answer_type) || '/' || id, '/number/') AS hot FROM gold)""")
def _(t):
    g = t("gold").withColumn("ns", rules.numbers_in(F.concat_ws(" ", "problem", "answer")))
    path = F.concat(F.lit("data/"), F.lower("answer_type"), F.lit("/"), F.col("id"))
    return g.select(
        "id", F.size("ns").alias("n_numbers"),
        r6(F.aggregate("ns", F.lit(0.0), lambda a, b: a + b)).alias("total"),
        maths.without_extra_zeros(A()).alias("bare"), maths.in_area(path, "number").alias("hot"),
    )


@query("e22_formula", """SELECT id, CASE WHEN answer_type = 'NUMBER' THEN problem END AS body FROM gold""")
def _(t):
    step = F.when(
        F.col("answer_type") == "NUMBER", F.concat(F.lit("so <<"), "problem", F.lit(">> holds"))
    ).otherwise(F.concat(F.lit("a << b << "), "problem"))
    return t("gold").select("id", maths.formula(step).alias("body"))


@query("e23_code_rewards", f"""WITH s AS (SELECT id, {pred('completion')} AS p, json_valid(answer) AS good,
    CASE WHEN json_valid(answer) THEN json_array_length(answer, '$.tests') END AS n, answer, k FROM codes),
  j AS (SELECT s.id, bool_and(coalesce(o.return_code = 0 AND {trim('o.stdout')} = json_extract_string(s.answer, '$.tests[' || CAST(o.test AS VARCHAR) || '].output'), FALSE)) AS ok
    FROM s JOIN outputs o ON o.id = s.id WHERE s.good GROUP BY s.id)
  SELECT s.id, {flag_sql("s.p IS NOT NULL AND s.good AND (s.n = 0 OR (s.k <> 3 AND j.ok))")} AS code_reward FROM s LEFT JOIN j ON j.id = s.id""")
def _(t):
    return code_rewards(t("codes"), t("outputs"), "id")


@query("e24_code_scan", f"""SELECT id, {trim(f"CASE WHEN k = 1 THEN regexp_extract({pred('completion')}, '```python\\n([\\s\\S]*?)```', 1) WHEN k = 2 THEN regexp_extract({pred('completion')}, '```python\\n([\\s\\S]*)$', 1) ELSE {pred('completion')} END")} AS code,
    CASE k WHEN 3 THEN 'open(,os.remove' ELSE '' END AS forbidden FROM codes WHERE k <> 0
    UNION ALL SELECT id, NULL, '' FROM codes WHERE k = 0""")
def _(t):
    return code_samples(t("codes")).select("id", "code", F.array_join("forbidden", ",").alias("forbidden"))


# --- formats -------------------------------------------------------------------------------------

_AFTER_THINK = "substr(completion, instr(completion, '<think>') + 7)"
_AFTER_CLOSE = f"substr({_AFTER_THINK}, instr({_AFTER_THINK}, '</think>') + 8)"
BOXED_FORMAT_SQL = flag_sql(
    f"contains(completion, '<think>') AND contains({_AFTER_THINK}, '</think>') "
    rf"AND regexp_matches({_AFTER_CLOSE}, '(?s)\\boxed\{{.*\}}') AND {times('completion', '<think>')} = 1 "
    f"AND {times('completion', '</think>')} = 1 "
    f"AND coalesce(list_sum(list_transform({bodies('completion')}, lambda b: length(b) + 9)), 0) / length(completion) <= 0.2"
)
XML_SQL = (
    f"greatest({flag_sql(f"regexp_matches(completion, '(?s)^{WSC}*<think>.*?</think>{WSC}*<answer>.*?</answer>{WSC}*$')")}, {BOXED_FORMAT_SQL})"
)
TAGS_SQL = "(" + " + ".join(
    f"CASE WHEN {times('completion', tag)} = 1 THEN 0.25 ELSE 0 END" for tag in formats.COUNTED_TAGS
) + ")"
TYPED_SQL = f"(CASE WHEN answer_type = 'NUMBER' THEN {NUMBER_SQL} ELSE {STRING_SQL} END)"


@query("e25_boxed_format", f"SELECT id, g, {BOXED_FORMAT_SQL} AS score FROM rollouts")
def _(t):
    return t("rollouts").select("id", "g", formats.boxed_format(C()).alias("score"))


@query("e26_think_box", f"SELECT id, g, {THINK_BOX_SQL} AS score FROM rollouts")
def _(t):
    return t("rollouts").select("id", "g", formats.think_has_box(C()).alias("score"))


@query("e27_xml_format", f"SELECT id, g, {XML_SQL} AS score FROM rollouts")
def _(t):
    return t("rollouts").select("id", "g", formats.xml_format(C()).alias("score"))


@query("e28_tag_count", f"SELECT id, g, CAST({TAGS_SQL} AS DOUBLE) AS score FROM rollouts")
def _(t):
    return t("rollouts").select("id", "g", formats.tag_count_score(C()).alias("score"))


@query("e29_typed_answer", f"WITH {RO} SELECT id, g, {TYPED_SQL} AS score FROM ro")
def _(t):
    return _pred(t).select("id", "g", type_based_answer(P(), A(), F.col("answer_type")).alias("score"))


@query("e30_composite", f"""WITH {RO} SELECT id, g, {q6(f"0.4 * {XML_SQL} + 0.2 * {TAGS_SQL} + 0.4 * {TYPED_SQL}")} AS reward FROM ro""")
def _(t):
    return composite_rewards(t("rollouts")).select("id", "g", r6(F.col("reward")).alias("reward"))


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(completion, '{pattern}'))"


_R, _AN = "(?is)<reasoning>(.*?)</reasoning>", "(?is)<answer>(.*?)</answer>"
_RB, _AB = f"regexp_extract(completion, '{_R}', 1)", f"regexp_extract(completion, '{_AN}', 1)"
_HR, _HA = f"regexp_matches(completion, '{_R}')", f"regexp_matches(completion, '{_AN}')"
_ANY = rf"(?i)</?{WSC}*(?:reasoning|answer)\b"
STRICT_PARTS = f"""{_HR} AS has_reasoning, {_HA} AS has_answer, {_n('(?i)<reasoning\\b[^>]*>')} AS open_reasoning,
  {_n('(?i)</reasoning>')} AS close_reasoning, {_n('(?i)<answer\\b[^>]*>')} AS open_answer, {_n('(?i)</answer>')} AS close_answer,
  ({_HR} AND {_HA} AND instr(completion, regexp_extract(completion, '{_R}')) < instr(completion, regexp_extract(completion, '{_AN}'))) AS order_ok,
  {trim(_RB)} <> '' AS reasoning_non_empty, {trim(_AB)} <> '' AS answer_non_empty,
  NOT regexp_matches({_RB}, '{_ANY}') AND NOT regexp_matches({_AB}, '{_ANY}') AS nested_ok, length(completion) AS text_len"""
STRICT_CTE = f"""parts AS (SELECT *, {STRICT_PARTS} FROM rollouts),
  strict AS (SELECT *, open_reasoning = 1 AND close_reasoning = 1 AND open_answer = 1 AND close_answer = 1 AND has_reasoning AND has_answer AS single_pair_ok FROM parts),
  graded AS (SELECT *, {flag_sql('single_pair_ok AND order_ok AND reasoning_non_empty AND answer_non_empty AND nested_ok')} AS fmt FROM strict)"""


@query("e31_strict_format", f"""WITH {STRICT_CTE} SELECT id, g, fmt AS reward, has_reasoning, has_answer, open_reasoning, close_reasoning,
  open_answer, close_answer, single_pair_ok, order_ok, reasoning_non_empty, answer_non_empty, nested_ok, text_len FROM graded""")
def _(t):
    return t("rollouts").select("id", "g", formats.strict_format(C()).alias("s")).select("id", "g", "s.*")


@query("e32_anchored_format", f"""SELECT id, g, {flag_sql(f"regexp_matches({trim('completion')}, '(?is)^<reasoning>.*?</reasoning>{WSC}*<answer>.*?</answer>$')")} AS score FROM rollouts""")
def _(t):
    return t("rollouts").select("id", "g", formats.anchored_format(C()).alias("score"))


@query("e33_answer_text", f"SELECT id, g, {trim(_AB)} AS answer_text FROM rollouts")
def _(t):
    return t("rollouts").select("id", "g", extract.answer_text(C()).alias("answer_text"))


# --- router --------------------------------------------------------------------------------------

@query("e34_router", f"""WITH {SCORED} SELECT id, g, {q6('acc_reward')} AS acc_reward, {q6('bbox_reward')} AS bbox_reward, {q6('reward')} AS reward FROM rewarded""")
def _(t):
    r = routed_rewards(t("rollouts"), "TYPE_BASED_RULE")
    return r.select("id", "g", *[r6(F.col(c)).alias(c) for c in ("acc_reward", "bbox_reward", "reward")])


def typed_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a remote judge that reads the problem type."""
    return pd.DataFrame({"score": (batch["problem_type"].str.len() / 40.0).clip(0, 1), "explanation": batch["problem_type"]})


@query("e35_judge_front", f"""WITH {SCORED}, j AS (SELECT problem, completion, answer, answer_type, min(problem_type) AS pt FROM rollouts WHERE answer_type = 'FREE_TEXT' GROUP BY ALL)
   SELECT s.id, s.g, s.answer_type = 'FREE_TEXT' AS judged,
   {q6("CASE WHEN s.answer_type = 'FREE_TEXT' THEN least(1.0, length(j.pt) / 40) ELSE s.reward END")} AS reward FROM rewarded s
   JOIN rollouts r ON r.id = s.id AND r.g = s.g
   LEFT JOIN j ON j.problem = r.problem AND j.completion = r.completion AND j.answer IS NOT DISTINCT FROM r.answer AND j.answer_type = r.answer_type""")
def _(t):
    rows = t("rollouts").withColumn("prompt", F.col("problem"))
    asked = unique_requests(rows.filter(uses_judge(F.col("answer_type"))), ("problem_type",))
    judged = settled(judged_by(asked, typed_judge, retries=0, context=("problem_type",)))
    r = judged_rewards(rows, judged, request_key())
    return r.select("id", "g", uses_judge(F.col("answer_type")).alias("judged"), r6(F.col("reward")).alias("reward"))


@query("e36_char_f1", f"""WITH q AS (SELECT id, {trim('assistant_text')} AS p, {trim('user_text')} AS gold FROM qa),
  pc AS (SELECT id, ch, count(*) AS n FROM (SELECT id, unnest(string_split(p, '')) AS ch FROM q) GROUP BY ALL),
  gc AS (SELECT id, ch, count(*) AS n FROM (SELECT id, unnest(string_split(gold, '')) AS ch FROM q) GROUP BY ALL),
  i AS (SELECT pc.id, sum(least(pc.n, gc.n)) AS both_n FROM pc JOIN gc ON gc.id = pc.id AND gc.ch = pc.ch GROUP BY pc.id)
  SELECT q.id, {q6("coalesce(2.0 * both_n / (length(p) + length(gold)), 0)")} AS f1 FROM q LEFT JOIN i ON i.id = q.id""")
def _(t):
    return t("qa").select("id", r6(charf1.char_f1(F.col("assistant_text"), F.col("user_text"))).alias("f1"))


@query("e37_eval_fields", "SELECT id, CASE WHEN id % 2 = 0 THEN assistant_text ELSE user_text END AS prompt, assistant_text AS gt FROM qa")
def _(t):
    u, a = json_quote(F.col("user_text")), json_quote(F.col("assistant_text"))
    even = F.concat(F.lit('[{"role": "user", "content": '), u, F.lit('}, {"role": "assistant", "content": '), a,
                    F.lit('}, {"role": "user", "content": '), a, F.lit("}]"))
    odd = F.concat(F.lit('[{"from": "human", "value": '), u, F.lit('}, {"from": "gpt", "value": '), a, F.lit("}]"))
    chats = t("qa").select("id", F.when(F.col("id") % 2 == 0, even).otherwise(odd).alias("conversations"))
    turns = chats.select("id", chat_turns(F.col("conversations")).alias("turns"))
    return turns.select("id", eval_fields(F.col("turns")).alias("f")).select("id", "f.prompt", "f.gt")


_CLEAN = trim(f"regexp_replace(regexp_replace(replace(completion, chr(13) || chr(10), chr(10)), '(?i)</?{WSC}*think{WSC}*>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_RTAIL = f"regexp_extract(c, '(?is)(?:^|\\n){WSC}*Reasoning{WSC}*[:：]{WSC}*(.*)$', 1)"
_RHEAD = f"regexp_extract({_RTAIL}, '(?is)^(.*?)(?:\\n{WSC}*Answer{WSC}*[:：]|$)', 1)"


@query("e38_reasoning_answer", f"""WITH x AS (SELECT id, {_CLEAN} AS c FROM essays)
  SELECT id, CASE WHEN regexp_matches(c, '(?is)(?:^|\\n){WSC}*Reasoning{WSC}*[:：]') THEN
      CASE WHEN lower({trim(_RHEAD)}) IN ('n/a', 'na', 'none', '无', '空', '') THEN '{extract.NO_REASONING_TEXT}' ELSE {trim(_RHEAD)} END END AS reasoning,
    CASE WHEN regexp_matches(c, '(?is)(?:^|\\n){WSC}*Answer{WSC}*[:：]') THEN {trim(f"regexp_extract(c, '(?is)(?:^|\\n){WSC}*Answer{WSC}*[:：](.*)$', 1)")} END AS final_answer,
    length(c) AS clean_len FROM x""")
def _(t):
    x = t("essays").select("id", extract.clean_generated(C()).alias("c"))
    c = F.col("c")
    return x.select(
        "id", extract.shown_reasoning(extract.reasoning_part(c)).alias("reasoning"),
        extract.answer_part(c).alias("final_answer"), F.length(c).alias("clean_len"),
    )


_ANSWER_PART = trim(f"regexp_extract(c, '(?is)(?:^|\\n){WSC}*Answer{WSC}*[:：](.*)$', 1)")


@query("e38_shown_answer", f"""WITH x AS (SELECT id, {_CLEAN} AS c FROM essays)
  SELECT id, CASE WHEN regexp_matches(c, '(?is)(?:^|\\n){WSC}*Answer{WSC}*[:：]') THEN CASE WHEN {_ANSWER_PART} = '' THEN '{extract.NO_ANSWER_TEXT}' ELSE {_ANSWER_PART} END END AS shown FROM x""")
def _(t):
    cleaned = t("essays").select("id", extract.clean_generated(C()).alias("c"))
    return cleaned.select("id", extract.shown_answer(extract.answer_part(F.col("c"))).alias("shown"))
