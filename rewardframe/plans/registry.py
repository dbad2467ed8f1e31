"""Registry of queries and the SQL fragments their counterparts share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import WHITESPACE
from ..session import ensure_checkpoint_dir
from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a job over the tables; ``sql`` is its DuckDB counterpart."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _wide_ints(fn(Tables(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def _wide_ints(df: DataFrame) -> DataFrame:
    """Counts and positions as bigint, as DuckDB gives them."""
    return df.select(*[
        F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, IntegerType) else F.col(f.name)
        for f in df.schema.fields
    ])


def scratch(spark: SparkSession) -> str:
    """New folder beside the checkpoints, which every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def r6(c: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# --- SQL fragments -------------------------------------------------------------------------------

_WS = "'" + WHITESPACE + "'"
WSC = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def q6(x: str) -> str:
    return f"(round({x}, 6) + CAST(0 AS DOUBLE))"


def trim(x: str) -> str:
    return f"trim({x}, {_WS})"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WSC}+'), lambda w: w <> '')"


def squeeze(x: str) -> str:
    return f"coalesce(array_to_string({words_sql(x)}, ' '), '')"


def bodies(x: str) -> str:
    return f"regexp_extract_all({x}, '(?s)<answer>(.*?)</answer>', 1)"


def pred(x: str) -> str:
    return f"list_extract({bodies(x)}, -1)"


def times(x: str, tag: str) -> str:
    return f"((length({x}) - length(replace({x}, '{tag}', ''))) // {len(tag)})"


def flag_sql(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"


def numeric_sql(x: str) -> str:
    s = f"replace(replace(replace(replace(lower({x}), '$', ''), ' ', ''), 'dfrac', 'frac'), 'tfrac', 'frac')"
    ratio = rf"^({NUM})/({NUM})$"
    frac = rf"^([+-]?)\\frac\{{({NUM})\}}\{{({NUM})\}}$"
    n = lambda p, g: f"TRY_CAST(regexp_extract({s}, '{p}', {g}) AS DOUBLE)"
    return (
        f"(CASE WHEN regexp_matches({s}, '^{NUM}$') THEN TRY_CAST({s} AS DOUBLE) "
        f"WHEN regexp_matches({s}, '{ratio}') THEN {n(ratio, 1)} / {n(ratio, 2)} "
        f"WHEN regexp_matches({s}, '{frac}') THEN (CASE WHEN regexp_extract({s}, '{frac}', 1) = '-' THEN -1 ELSE 1 END) "
        f"* {n(frac, 2)} / {n(frac, 3)} END)"
    )


def tuple_sql(x: str) -> str:
    """Comparable form of a bracketed list of numbers, the text itself otherwise."""
    items = f"string_split(substr({x}, 2, length({x}) - 2), ',')"
    vals = f"list_transform({items}, lambda e: CAST(round({numeric_sql('e')}, 2) AS VARCHAR))"
    shaped = (
        f"((starts_with({x}, '(') AND ends_with({x}, ')')) OR (starts_with({x}, '[') AND ends_with({x}, ']'))) "
        f"AND len({items}) > 1 AND len(list_filter({vals}, lambda v: v IS NULL)) = 0"
    )
    return f"(CASE WHEN {shaped} THEN left({x}, 1) || array_to_string({vals}, ',') || right({x}, 1) ELSE {x} END)"


def math_method_sql(a: str, b: str) -> str:
    a, b = f"lower({a})", f"lower({b})"
    return (
        f"(CASE WHEN replace({a}, ' ', '') = '' OR replace({b}, ' ', '') = '' THEN 'none' "
        f"WHEN {trim(a)} = {trim(b)} THEN 'text' WHEN {tuple_sql(a)} = {tuple_sql(b)} THEN 'tuple' "
        f"WHEN round({numeric_sql(a)}, 2) = round({numeric_sql(b)}, 2) THEN 'numeric' ELSE 'none' END)"
    )


def strict_sql(x: str) -> str:
    p = f"coalesce({pred(x)}, '')"
    return (
        f"(CASE WHEN regexp_matches({p}, '^{WSC}*\\([a-zA-Z]\\){WSC}*') "
        f"THEN {trim(f'substr({p}, 2, length({p}) - 2)')} ELSE {p} END)"
    )


def truth_sql(x: str) -> str:
    return (
        f"(CASE WHEN contains(lower({x}), 'yes') OR contains(lower({x}), 'true') THEN TRUE "
        f"WHEN contains(lower({x}), 'no') OR contains(lower({x}), 'false') THEN FALSE END)"
    )


def box_sql(x: str) -> str:
    n = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
    m = rf"regexp_extract({x}, '\[\s*{n}(?:\s*,\s*{n})*\s*\]')"
    return f"list_transform(string_split(trim({m}, '[]'), ','), lambda v: TRY_CAST(trim(v) AS DOUBLE))"


def iou_sql(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({a}) = 4 AND len({b}) = 4 THEN coalesce("
        f"greatest(0, least({a}[3], {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0, least({a}[4], {b}[4]) - greatest({a}[2], {b}[2])) / "
        f"nullif(({a}[3] - {a}[1]) * ({a}[4] - {a}[2]) + ({b}[3] - {b}[1]) * ({b}[4] - {b}[2]) - "
        f"greatest(0, least({a}[3], {b}[3]) - greatest({a}[1], {b}[1])) * greatest(0, least({a}[4], {b}[4]) - greatest({a}[2], {b}[2])), 0)"
        f", 0) ELSE 0.0 END)"
    )


def jaccard_sql(a: str, b: str, pattern: str, group: int) -> str:
    x = f"list_distinct(regexp_extract_all(lower({a}), '{pattern}', {group}))"
    y = f"list_distinct(regexp_extract_all(lower({b}), '{pattern}', {group}))"
    common = f"len(list_intersect({x}, {y}))"
    return f"(CASE WHEN len({y}) > 0 THEN {common} / (len({x}) + len({y}) - {common}) ELSE 0.0 END)"


def normal_markup_sql(x: str) -> str:
    flat = f"replace(regexp_replace({x}, '\\s+', ' ', 'g'), chr(34), chr(39))"
    return f"lower({trim(f"regexp_replace({flat}, '(?s)<!--.*?-->', '', 'g')")})"


_TOKEN = r'[\p{L}\p{N}_]+|[<>=/"]'
HTML_SQL = (
    f"(CASE WHEN {normal_markup_sql('code')} = {normal_markup_sql(trim('answer'))} THEN 1.0 "
    f"ELSE 0.6 * {jaccard_sql('code', trim('answer'), _TOKEN, 0)} "
    f"+ 0.4 * {jaccard_sql('code', trim('answer'), r'<(/?[\p{L}\p{N}_]+)', 1)} END)"
)
SVG_SQL = (
    f"(CASE WHEN NOT contains(lower(code), '<svg') THEN 0.0 "
    f"WHEN {normal_markup_sql('code')} = {normal_markup_sql(trim('answer'))} THEN 1.0 "
    f"ELSE 0.25 * ({jaccard_sql('code', trim('answer'), _TOKEN + '|#[0-9a-fA-F]+', 0)} "
    f"+ {jaccard_sql('code', trim('answer'), '<([a-zA-Z]+)[^>]*>', 1)}) END)"
)


def _last(x: str, pattern: str, group: int) -> str:
    return f"list_extract(regexp_extract_all({x}, '{pattern}', {group}), -1)"


HTML_CODE_SQL = trim(
    f"coalesce({pred('completion')}, {_last('completion', '(?is)(?:<!DOCTYPE html>|<html>).*?(?:</html>|$)', 0)}, "
    f"{_last('completion', '(?s)```(?:html)?\\s*(.*?)```', 1)}, completion)"
)
SVG_CODE_SQL = trim(
    f"coalesce(CASE WHEN contains(lower({pred('completion')}), '<svg') THEN {pred('completion')} END, "
    f"{_last('completion', '(?is)<svg[^>]*>.*?</svg>', 0)}, "
    f"CASE WHEN contains(lower({_last('completion', '(?s)```(?:svg|xml)?\\s*(.*?)```', 1)}), '<svg') "
    f"THEN {_last('completion', '(?s)```(?:svg|xml)?\\s*(.*?)```', 1)} END, completion)"
)

# Rule rewards over (p = last answer, completion, answer).
NUMBER_SQL = flag_sql(f"coalesce(list_extract(regexp_extract_all(p, '[0-9.]+'), -1), '') = {trim('answer')}")
STRING_SQL = flag_sql(f"p <> '' AND lower({trim('p')}) = lower({trim('answer')})")
BOOL_SQL = flag_sql(f"p <> '' AND {truth_sql('p')} = {truth_sql('answer')}")
CHOICE_SQL = flag_sql(f"p <> '' AND upper(left(trim({trim('p')}, '.()'), 1)) = upper(answer)")
CRITIC_SQL = flag_sql(f"{trim('p')} = {trim('answer')}")
_OCR_DIST = (
    f"(levenshtein({squeeze(f'lower({trim('answer')})')}, {squeeze(f'lower({trim('p')})')}) / "
    f"greatest(length(answer), length({squeeze(f'lower({trim('p')})')})))"
)
OCR_SQL = f"(CASE WHEN p <> '' AND 1 - {_OCR_DIST} >= 0.5 THEN 1 - {_OCR_DIST} ELSE 0.0 END)"
BBOX_SQL = iou_sql("pb", "gb")
MATH_SQL = flag_sql(f"{math_method_sql(strict_sql('completion'), 'answer')} <> 'none'")
FOUR = (
    r"\[\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*\]"
)
THINK_BOX_SQL = flag_sql(
    "len(list_filter(regexp_extract_all(completion, '(?s)<think>(.*?)</think>', 1), "
    f"lambda b: regexp_matches(b, '{FOUR}'))) > 0"
)
# Rows with the last answer, the markup and the boxes at hand.
RO = (
    f"ro AS (SELECT *, {pred('completion')} AS p, "
    f"CASE WHEN answer_type = 'SVG_CODE' THEN {SVG_CODE_SQL} ELSE {HTML_CODE_SQL} END AS code, "
    f"{box_sql('answer')} AS gb, {box_sql(f'coalesce({pred('completion')}, chr(32))')} AS pb FROM rollouts)"
)
ROUTED_SQL = (
    f"CASE answer_type WHEN 'NUMBER' THEN {NUMBER_SQL} WHEN 'MATH_EXPRESSIONS' THEN {MATH_SQL} "
    f"WHEN 'HTML_CODE' THEN {HTML_SQL} WHEN 'SVG_CODE' THEN {SVG_SQL} WHEN 'BOOLEAN' THEN {BOOL_SQL} "
    f"WHEN 'MULTIPLE_CHOICE' THEN {CHOICE_SQL} WHEN 'OCRTEXT' THEN {OCR_SQL} WHEN 'BBOX' THEN {BBOX_SQL} "
    f"WHEN 'CRITIC' THEN {CRITIC_SQL} ELSE {STRING_SQL} END"
)
# Reward of the rule router for every completion.
SCORED = (
    f"{RO},\nscored AS (SELECT id, g, n, step, prompt_type, problem_type, answer_type, "
    f"{ROUTED_SQL} AS acc_reward, CASE WHEN problem_type = 'SPATIAL_REASONING' THEN {THINK_BOX_SQL} ELSE 0.0 END AS bbox_reward FROM ro),\n"
    "rewarded AS (SELECT *, acc_reward + 0.5 * bbox_reward AS reward FROM scored)"
)


def advantage_sql(src: str, keys: str, value: str, eps: str, lo_hi: bool = True) -> str:
    z = f"(CASE WHEN sd > 0 THEN ({value} - mean) / (sd + {eps}) ELSE CAST(0 AS DOUBLE) END)"
    z = f"greatest(-10.0, least(10.0, {z}))" if lo_hi else z
    return (
        f"SELECT s.* EXCLUDE (mean, sd), {z} AS advantage FROM (SELECT *, "
        f"avg({value}) OVER (PARTITION BY {keys}) AS mean, stddev_samp({value}) OVER (PARTITION BY {keys}) AS sd FROM {src}) s"
    )
