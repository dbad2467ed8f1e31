"""Queries over judges: layered extraction, enhanced scores, replies, caches, stream (ids E39-E49, G)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enhanced, extract, judging
from ..functions.formats import think_has_box
from ..operators import cachestore, judge
from ..session import settled
from ..streaming.judging import answers, start_judging, start_window_counts, stream_metrics, window_counts
from .registry import (
    FOUR, flag_sql, math_method_sql, q6, query, r6, scratch, trim, words_sql,
)
from .views import Tables

# --- layered extraction and enhanced scores ------------------------------------------------------

_UP = f"list_reverse(list_transform(string_split({trim('completion')}, chr(10)), lambda l: {trim('l')}))"
_ENDS = r"(?: [A-H]\.|[A-H]\)|\*\*[A-H]\*\*|[A-H]:\*\*|[A-H]\.\*\*)$"
_NAMED = ", ".join(
    f"CASE WHEN contains(lower(l), '{p}') THEN nullif(regexp_extract(substr(l, instr(lower(l), '{p}') + {len(p)}), '[A-H]'), '') END"
    for p in extract.CHOICE_PHRASES
)
_CHOICE_LINE = f"coalesce(nullif(regexp_extract(regexp_extract(l, '{_ENDS}'), '[A-H]'), ''), {_NAMED})"
_OPS = " OR ".join(f"contains(l, '{op}')" for op in extract.ASSIGNING_OPERATORS)
_CLOSING_LINE = (
    rf"coalesce(CASE WHEN len({words_sql('l')}) <= 5 THEN nullif(regexp_extract(l, '-?\d+(?:\.\d+)?'), '') END, "
    f"CASE WHEN {_OPS} THEN {trim('list_extract(string_split(l, chr(61)), -1)')} END)"
)
_LAST = "coalesce(list_extract(list_filter(up, lambda l: l <> ''), 1), '')"
_BARE = (
    f"(CASE WHEN starts_with(lower({_LAST}), 'answer:') THEN {trim(f'substr({_LAST}, 8)')} "
    f"WHEN starts_with(lower({_LAST}), 'the answer is:') THEN {trim(f'substr({_LAST}, 15)')} "
    f"WHEN starts_with(lower({_LAST}), 'answer is:') THEN {trim(f'substr({_LAST}, 11)')} ELSE {_LAST} END)"
)
_TAG, _THINK = "(?s)<answer>(.*?)</answer>", "(?s)<think>(.*?)</think>"
LAYERED = f"""e0 AS (SELECT *, {_UP} AS up FROM essays),
e1 AS (SELECT *, list_extract(list_filter(list_transform(up, lambda l: {_CHOICE_LINE}), lambda x: x IS NOT NULL), 1) AS choice,
  list_extract(list_filter(list_transform(up[1:3], lambda l: {_CLOSING_LINE}), lambda x: x IS NOT NULL), 1) AS closing FROM e0),
e AS (SELECT id, prompt, answer, prompt_type, completion,
  CASE WHEN regexp_matches(completion, '{_THINK}') THEN {trim(f"regexp_extract(completion, '{_THINK}', 1)")} END AS thinking,
  CASE WHEN regexp_matches(completion, '{_TAG}') THEN {trim(f"regexp_extract(completion, '{_TAG}', 1)")}
    ELSE coalesce(choice, nullif(closing, ''), {_BARE}) END AS predicted FROM e1)"""


def _parts(t: Tables) -> DataFrame:
    thinking, predicted = enhanced.enhanced_parts(F.col("completion"))
    return t("essays").withColumn("thinking", thinking).withColumn("predicted", predicted)


@query("e39_layered_answer", f"WITH {LAYERED} SELECT id, thinking, predicted FROM e")
def _(t):
    return _parts(t).select("id", "thinking", "predicted")


def _signals(signals: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(low, '{s}') AS INT)" for s in signals) + ")"


_KEYS = f"list_filter(list_distinct({words_sql('lower(prompt)')}), lambda w: w NOT IN {enhanced.IGNORED_WORDS})"
_NW = f"len({words_sql('think')})"
QUALITY = f"""{LAYERED}, tq0 AS (SELECT *, coalesce(thinking, '') AS think, lower(coalesce(thinking, '')) AS low FROM e),
tq1 AS (SELECT *, CASE WHEN {_NW} < 20 THEN 0.3 WHEN {_NW} < 100 THEN 0.8 WHEN {_NW} < 200 THEN 1.0 ELSE 0.9 END AS f_length,
  least({_signals(enhanced.LOGIC_SIGNALS)} / 3, 1.0) AS f_logic, least({_signals(enhanced.MATH_SIGNALS)} / 2, 1.0) AS f_math,
  len(list_filter({_KEYS}, lambda w: contains(low, w))) / greatest(len({_KEYS}), 1) AS f_rel, length({trim('think')}) >= 10 AS enough FROM tq0),
tq AS (SELECT *, CASE WHEN enough THEN f_length * 0.2 + f_logic * 0.3 + f_rel * 0.3 + f_math * 0.2 ELSE 0.0 END AS overall FROM tq1)"""


@query("e40_thinking_quality", f"""WITH {QUALITY} SELECT id, {q6('overall')} AS overall, {q6('CASE WHEN enough THEN f_rel ELSE 0.0 END')} AS relevance,
    {q6('CASE WHEN enough THEN f_logic ELSE 0.0 END')} AS logic, CASE WHEN length(think) > 100 THEN left(think, 100) || '...' ELSE think END AS summary FROM tq""")
def _(t):
    q = _parts(t).withColumn("thinking", F.coalesce("thinking", F.lit("")))
    q = q.withColumn("q", enhanced.thinking_quality(F.col("thinking"), F.col("prompt")))
    return q.select(
        "id", *[r6(F.col(f"q.{c}")).alias(c) for c in ("overall", "relevance", "logic")],
        enhanced.thinking_summary(F.col("thinking")).alias("summary"),
    )


def _letter_sql(x: str) -> str:
    s = f"trim({trim(x)}, '.,!?;:')"
    once = ", ".join(
        f"CASE WHEN length({s}) - length(replace({s}, '{c}', '')) = 1 THEN '{c}' END" for c in "ABCDEFGH"
    )
    return f"coalesce(CASE WHEN regexp_matches({s}, '^[A-Ha-h]$') THEN upper({s}) END, {once})"


def check_sql(p: str, g: str, kind: str) -> str:
    num = lambda x: rf"TRY_CAST(list_extract(regexp_extract_all({x}, '-?\d+(?:\.\d+)?'), -1) AS DOUBLE)"
    numeric = f"{kind} IN {enhanced.NUMERIC_TYPES}"
    return (
        f"(CASE WHEN lower({trim(p)}) = lower({trim(g)}) THEN 'exact_match' "
        f"WHEN {numeric} AND {math_method_sql(p, g)} <> 'none' THEN 'math_verify' "
        f"WHEN {kind} = 'MULTIPLE_CHOICE' AND {_letter_sql(p)} = {_letter_sql(g)} THEN 'choice_match' "
        f"WHEN contains(lower({p}), lower({g})) AND length({g}) > 1 THEN 'contained' "
        f"WHEN {numeric} AND abs({num(p)} - {num(g)}) < 1e-6 THEN 'numerical' ELSE 'all_failed' END)"
    )


_CONF = "(CASE method WHEN 'exact_match' THEN 1.0 WHEN 'math_verify' THEN 0.95 WHEN 'choice_match' THEN 0.9 WHEN 'contained' THEN 0.7 WHEN 'numerical' THEN 0.8 ELSE 0.0 END)"


@query("e41_answer_check", f"""WITH c AS (SELECT id, g, {check_sql('p', 'answer', 'answer_type')} AS method FROM
    (SELECT *, coalesce(list_extract(regexp_extract_all(completion, '{_TAG}', 1), -1), completion) AS p FROM rollouts))
    SELECT id, g, method <> 'all_failed' AS correct, method, CAST({_CONF} AS DOUBLE) AS confidence FROM c""")
def _(t):
    p = F.coalesce(extract.last_answer(F.col("completion")), F.col("completion"))
    c = t("rollouts").withColumn("c", enhanced.answer_check(p, F.col("answer"), F.col("answer_type")))
    return c.select("id", "g", "c.correct", "c.method", "c.confidence")


ENHANCED = f"""{QUALITY}, en0 AS (SELECT *, {check_sql('predicted', 'answer', "'ANY'")} AS method FROM tq),
en1 AS (SELECT *, CASE WHEN method <> 'all_failed' THEN 1.0 ELSE 0.0 END AS ans,
  CASE WHEN prompt_type = 'thinking' THEN CASE WHEN thinking IS NOT NULL THEN 1.0 ELSE 0.0 END ELSE CASE WHEN predicted <> '' THEN 0.8 ELSE 0.0 END END AS fmt,
  CASE WHEN prompt_type = 'thinking' THEN overall ELSE 0.7 END AS th FROM en0),
en AS (SELECT *, CASE WHEN prompt_type = 'thinking' THEN 0.10 * fmt + 0.35 * th + 0.55 * ans ELSE 0.05 * fmt + 0.15 * th + 0.80 * ans END AS total FROM en1)"""


def _enhanced(t: Tables) -> DataFrame:
    score = enhanced.enhanced_score(
        F.col("thinking"), F.col("predicted"), F.col("prompt"), F.col("answer"), F.col("prompt_type"), F.lit("ANY")
    )
    return _parts(t).withColumn("s", score)


@query("e42_enhanced_score", f"""WITH {ENHANCED} SELECT id, {q6('total')} AS score, {q6('fmt')} AS format_score, {q6('th')} AS thinking_score,
    {q6('ans')} AS answer_score, method AS validation_method, CAST({_CONF} AS DOUBLE) AS confidence FROM en""")
def _(t):
    s = _enhanced(t).select("id", "s.*")
    return s.select(
        "id", *[r6(F.col(c)).alias(c) for c in ("score", "format_score", "thinking_score", "answer_score")],
        "validation_method", "confidence",
    )


@query("e43_score_explanation", f"""WITH {ENHANCED} SELECT id, '评分详情 (类型: ' || prompt_type || '):' || chr(10) || '- 格式分 (' || CASE WHEN prompt_type = 'thinking' THEN '10' ELSE '5' END || '%): ' || printf('%.2f', CAST(fmt AS DOUBLE)) || chr(10)
    || '  * ' || CASE WHEN prompt_type = 'thinking' THEN '使用' ELSE '不使用' END || '思考标签' || chr(10) || '- 思考分 (' || CASE WHEN prompt_type = 'thinking' THEN '35' ELSE '15' END || '%): ' AS head,
    method AS method, {trim('predicted')} = predicted AND predicted <> '' AS has_answer FROM en""")
def _(t):
    e = _enhanced(t)
    why = enhanced.score_explanation(F.col("s"), F.col("predicted"), F.col("answer"), F.col("prompt_type"))
    e = e.select("id", why.alias("why"), F.col("predicted"))
    head = F.regexp_extract("why", r"(?s)\A(.*?思考分 \(\d+%\): )", 1)
    return e.select(
        "id", head.alias("head"), F.regexp_extract("why", "验证方法: (\\w+)", 1).alias("method"),
        (F.col("why").contains(F.concat(F.lit('预测答案: "'), F.col("predicted"), F.lit('"'))) & (F.col("predicted") != "")).alias("has_answer"),
    )


# --- question types, built-in judge, replies -----------------------------------------------------

_HAS = lambda c, ws: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"


@query("e44_question_types", f"""SELECT id, CASE WHEN contains(lower(source), 'math') THEN 'math' WHEN {_HAS('q', judging.REASON_WORDS)} THEN 'reasoning'
    WHEN {_HAS('q', judging.CODE_WORDS)} THEN 'coding' ELSE 'general' END AS by_text,
    CASE WHEN kind IN {judging.MATH_TYPES} THEN 'math' WHEN kind IN {judging.CODE_TYPES} THEN 'coding' WHEN {_HAS('q', ('reason', 'explain'))} THEN 'reasoning' ELSE 'general' END AS by_answer
    FROM (SELECT doc_id AS id, source, text AS q, CASE doc_id % 4 WHEN 0 THEN 'NUMBER' WHEN 1 THEN 'SVG_CODE' ELSE 'ANY' END AS kind FROM documents)""")
def _(t):
    kind = F.when(F.col("doc_id") % 4 == 0, "NUMBER").when(F.col("doc_id") % 4 == 1, "SVG_CODE").otherwise("ANY")
    return t("documents").select(
        F.col("doc_id").alias("id"), judging.question_type_by_text(F.col("source"), F.col("text")).alias("by_text"),
        judging.question_type_by_answer(F.col("text"), kind).alias("by_answer"),
    )


RULE_JUDGE_SQL = f"""(CASE WHEN coalesce(answer, '') = '' THEN 0.5 WHEN contains(completion, answer) THEN 1.0 WHEN contains(lower(completion), {trim('lower(answer)')}) THEN 0.8 ELSE 0.0 END
   * CASE WHEN length(completion) < length(prompt) THEN 0.9 ELSE 1.0 END)"""
RULE_WHY_SQL = f"""(CASE WHEN coalesce(answer, '') = '' THEN 'Neutral score' WHEN contains(completion, answer) THEN 'Correct answer ''' || answer || ''' found in completion'
   WHEN contains(lower(completion), {trim('lower(answer)')}) THEN 'Answer variant found (subtle difference)' ELSE 'Answer ''' || answer || ''' not found in completion' END)"""


@query("e45_rule_judge", f"SELECT request_id, {q6(RULE_JUDGE_SQL)} AS score, {RULE_WHY_SQL} AS explanation FROM requests")
def _(t):
    v = judging.rule_judge(F.col("prompt"), F.col("completion"), F.col("answer"))
    return t("requests").withColumn("v", v).select("request_id", r6(F.col("v.score")).alias("score"), "v.explanation")


_TXT = f"{trim('reply')}"
_INNER = r"regexp_extract(s, '\{[\s\S]*?\}')"
_DOC = f"CASE WHEN json_valid(s) THEN CASE WHEN starts_with(s, '{{') THEN s END WHEN json_valid({_INNER}) AND {_INNER} <> '' THEN {_INNER} END"
_FIELD = lambda d, k: f"TRY_CAST(json_extract_string({d}, '$.{k}') AS DOUBLE)"
_UNIT = lambda k: f"(CASE WHEN d IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, coalesce({_FIELD('d', k)}, 0.0))) END)"


@query("e46_judge_scores", f"""WITH v AS (SELECT id, {_TXT} AS s FROM verdicts), w AS (SELECT id, s, {_DOC} AS d FROM v)
    SELECT id, {q6(_UNIT('reasoning'))} AS reasoning, {q6(_UNIT('answer'))} AS answer, {q6(f"{_UNIT('reasoning')} + {_UNIT('answer')}")} AS total,
      CASE WHEN s = '' THEN 'empty_response' WHEN d IS NULL THEN 'json_parse_failed' END AS error FROM w""")
def _(t):
    s = t("verdicts").select("id", judging.judge_scores(F.col("reply")).alias("s")).select("id", "s.*")
    return s.select("id", *[r6(F.col(c)).alias(c) for c in ("reasoning", "answer", "total")], "error")


_DEC = r"nullif(regexp_extract(s, '\d+\.\d+'), '')"
_WHOLE = "CASE WHEN json_valid(s) AND starts_with(s, '{') THEN s END"


def _detail_sql(key: str, default: str, dec: str) -> str:
    return f"(CASE WHEN d IS NOT NULL THEN coalesce({_FIELD('d', key)}, {default}) WHEN x IS NOT NULL THEN {dec} ELSE 0.0 END)"


DETAIL = f"""v AS (SELECT id, prompt_type, {_TXT} AS s FROM verdicts), w AS (SELECT *, {_WHOLE} AS d, {_DEC} AS x FROM v),
det AS (SELECT *, {_detail_sql('total_score', '0.0', 'CAST(x AS DOUBLE)')} AS score, {_detail_sql('reasoning_score', '0.0', '0.0')} AS rs,
  {_detail_sql('answer_score', '0.0', 'CAST(x AS DOUBLE)')} AS ans, {_detail_sql('format_score', '0.0', '0.0')} AS fs, {_detail_sql('confidence', '0.8', '0.6')} AS conf,
  CASE WHEN d IS NOT NULL THEN coalesce(json_extract_string(d, '$.explanation'), '') WHEN x IS NOT NULL THEN 'Parse error, extracted score: ' || x ELSE 'Failed to parse judge response' END AS why FROM w)"""


@query("e47_judge_detail", f"""WITH {DETAIL} SELECT id, {q6('score')} AS score, {q6('rs')} AS reasoning_score, {q6('ans')} AS answer_score, {q6('fs')} AS format_score,
    {q6('conf')} AS confidence, why AS explanation, CAST(CASE WHEN regexp_matches(s, '^[+-]?\\d+$') THEN CAST(s AS INT) ELSE 0 END AS BIGINT) AS whole FROM det""")
def _(t):
    v = t("verdicts").select("id", judging.judge_detail(F.col("reply")).alias("d"), judging.judge_int(F.col("reply")).alias("whole"))
    v = v.select("id", "d.*", "whole")
    return v.select(
        "id", *[r6(F.col(c)).alias(c) for c in ("score", "reasoning_score", "answer_score", "format_score", "confidence")],
        "explanation", "whole",
    )


@query("e48_weighted_judge", f"""WITH {DETAIL} SELECT id, {q6("CASE WHEN prompt_type = 'thinking' THEN 0.10 * fs + 0.35 * rs + 0.55 * ans ELSE 0.05 * fs + 0.15 * rs + 0.80 * ans END")} AS score FROM det""")
def _(t):
    v = t("verdicts").select("id", "prompt_type", judging.judge_detail(F.col("reply")).alias("d"))
    total = judging.weighted_judge(
        F.col("d.format_score"), F.col("d.reasoning_score"), F.col("d.answer_score"), F.col("prompt_type")
    )
    return v.select("id", r6(total).alias("score"))


@query("e48_detailed_result", f"""SELECT id, {q6('CASE WHEN k < 3 THEN CAST(v AS DOUBLE) ELSE 0.0 END')} AS score, {q6('CASE k WHEN 0 THEN CAST(v AS DOUBLE) ELSE 0.0 END')} AS thinking_score,
    {q6('CASE k WHEN 0 THEN 0.25 WHEN 1 THEN CAST(v AS DOUBLE) WHEN 2 THEN CAST(v AS DOUBLE) ELSE 0.0 END')} AS answer_score, {q6('CASE k WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.0 END')} AS format_score,
    {q6('CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN 0.8 ELSE 0.0 END')} AS confidence FROM details""")
def _(t):
    d = t("details").select("id", judging.detailed_result(F.col("reply")).alias("d")).select("id", "d.*")
    cols = ("score", "thinking_score", "answer_score", "format_score", "confidence")
    return d.select("id", *[r6(F.col(c)).alias(c) for c in cols])


@query("e49_standard_result", f"""WITH {ENHANCED} SELECT id, {q6('ans')} AS acc_reward, {q6('th')} AS thinking_reward, {q6('total')} AS reward,
    'enhanced_judge' AS source, method AS validation_method, prompt_type, {q6("CASE WHEN id % 3 = 0 THEN 0.5 * " + flag_sql(f"len(list_filter(regexp_extract_all(completion, '{_THINK}', 1), lambda b: regexp_matches(b, '{FOUR}'))) > 0") + " ELSE 0.0 END")} AS spatial FROM en""")
def _(t):
    e = _enhanced(t)
    kind = F.when(F.col("id") % 3 == 0, F.lit("SPATIAL_REASONING")).otherwise(F.lit("GENERAL"))
    box = think_has_box(F.col("completion"))
    std = judging.standard_result(F.col("s"), F.lit(""), F.col("prompt_type"))
    adapted = judging.judge_result(F.col("s.score"), F.lit(""), box, kind)
    e = e.select("id", std.alias("r"), adapted["bbox_reward"].alias("spatial"))
    return e.select(
        "id", *[r6(F.col(f"r.{c}")).alias(c) for c in ("acc_reward", "thinking_reward", "reward")],
        "r.source", "r.validation_method", "r.prompt_type", r6(F.col("spatial")).alias("spatial"),
    )


# --- keys, cache, batches ------------------------------------------------------------------------

KEY_SQL = "md5(prompt || '||' || completion || '||' || coalesce(answer, 'None') || '||' || answer_type)"
KEYED = f"keyed AS (SELECT *, {KEY_SQL} AS key FROM requests), uniq AS (SELECT DISTINCT key, prompt, completion, answer, answer_type FROM keyed)"


@query("g1_request_key", f"SELECT request_id, {KEY_SQL} AS key, md5({KEY_SQL}) AS again FROM requests")
def _(t):
    return t("requests").select("request_id", judge.request_key().alias("key"), F.md5(judge.request_key()).alias("again"))


@query("g2_scored_once", f"SELECT request_id, {KEY_SQL} AS key, {q6(RULE_JUDGE_SQL)} AS score FROM requests")
def _(t):
    return judge.scored_once(t("requests")).select("request_id", "key", r6(F.col("score")).alias("score"))


# Cache entries: the last sighting of every key in the first half of the month.
HALF, NOW = "2024-01-15 00:00:00", "2024-01-15 01:00:00"
CACHE = f"""{KEYED}, cache AS (SELECT key, max(ts) AS ts, length(key) / 64 AS score FROM keyed WHERE ts < TIMESTAMP '{HALF}' GROUP BY key)"""


def _cache(t: Tables) -> DataFrame:
    old = t("requests").filter(F.col("ts") < F.lit(HALF).cast("timestamp")).withColumn("key", judge.request_key())
    return old.groupBy("key").agg(F.max("ts").alias("ts")).withColumn("score", F.length("key") / 64)


def _now():
    return F.lit(NOW).cast("timestamp")


_TTL = 86_400
_FRESH = f"epoch(TIMESTAMP '{NOW}') - epoch(c.ts) < {_TTL}"


@query("g3_cache_lookup", f"""WITH {CACHE} SELECT request_id, c.key IS NOT NULL AS hit, c.score AS score FROM keyed k LEFT JOIN cache c ON c.key = k.key AND {_FRESH}""")
def _(t):
    return judge.cache_lookup(t("requests"), _cache(t), _now(), _TTL).select("request_id", "hit", "score")


@query("g3_cache_misses", f"""WITH {CACHE} SELECT key, prompt, completion FROM uniq WHERE key NOT IN (SELECT key FROM cache c WHERE {_FRESH})""")
def _(t):
    return judge.cache_misses(t("requests"), _cache(t), _now(), _TTL).select("key", "prompt", "completion")


@query("g4_cache_update", f"""WITH {CACHE}, fresh AS (SELECT key, 0.25 AS score, max(ts) AS ts FROM keyed WHERE ts >= TIMESTAMP '{HALF}' GROUP BY key),
    al AS (SELECT key, CAST(score AS DOUBLE) AS score, ts FROM cache UNION ALL SELECT key, CAST(score AS DOUBLE), ts FROM fresh),
    l AS (SELECT key, max(ts) AS ts, arg_max(score, ts) AS score FROM al GROUP BY key)
    SELECT key, score, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM l ORDER BY ts DESC, key LIMIT 700""")
def _(t):
    new = t("requests").filter(F.col("ts") >= F.lit(HALF).cast("timestamp")).withColumn("key", judge.request_key())
    scored = new.groupBy("key").agg(F.max("ts").alias("ts")).withColumn("score", F.lit(0.25))
    out = judge.cache_update(_cache(t), scored, 700)
    return out.select("key", "score", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("g4_cache_store", f"""WITH {CACHE}, fresh AS (SELECT key, 0.25 AS score, max(ts) AS ts FROM keyed WHERE ts >= TIMESTAMP '{HALF}' GROUP BY key),
    al AS (SELECT key, CAST(score AS DOUBLE) AS score, ts FROM cache UNION ALL SELECT key, CAST(score AS DOUBLE), ts FROM fresh),
    l AS (SELECT key, max(ts) AS ts, arg_max(score, ts) AS score FROM al GROUP BY key)
    SELECT key, score, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM l ORDER BY ts DESC, key LIMIT 700""")
def _(t):
    folder = scratch(t.spark)
    new = t("requests").filter(F.col("ts") >= F.lit(HALF).cast("timestamp")).withColumn("key", judge.request_key())
    cachestore.add_scores(_cache(t), folder, 8)
    cachestore.add_scores(new.groupBy("key").agg(F.max("ts").alias("ts")).withColumn("score", F.lit(0.25)), folder, 8)
    cachestore.compact(t.spark, folder, 2)
    cachestore.evict(t.spark, folder, 700)
    out = cachestore.read_scores(t.spark, folder)
    return out.select("key", "score", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("g5_request_batches", f"WITH {KEYED} SELECT key, prompt, CAST(floor((row_number() OVER (ORDER BY key) - 1) / 32) AS BIGINT) AS batch FROM uniq")
def _(t):
    return judge.request_batches(t("requests"), 32).select("key", "prompt", "batch")


def length_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """Stand-in for a remote judge: the share of the prompt's length, refusing some completions."""
    refused = batch["completion"].str.endswith("9")
    if refused.any():
        raise ValueError("refused")
    score = (batch["prompt"].str.len() / 10.0).clip(0, 1)
    return pd.DataFrame({"score": score, "explanation": "by length"})


@query("g6_judged_in_batches", f"""WITH {KEYED} SELECT key, CASE WHEN ends_with(completion, '9') THEN 0.0 ELSE least(1.0, length(prompt) / 10) END AS score,
    CASE WHEN ends_with(completion, '9') THEN 'Request failed: refused' ELSE 'by length' END AS explanation, ends_with(completion, '9') AS failed FROM uniq""")
def _(t):
    return judge.judged_by(judge.unique_requests(t("requests")), length_judge, retries=1, delay=0.0)


@query("g6_judged_with_ledger", f"""WITH {KEYED} SELECT key, CASE WHEN ends_with(completion, '9') THEN 0.0 ELSE least(1.0, length(prompt) / 10) END AS score,
    CAST(CASE WHEN ends_with(completion, '9') THEN 0 ELSE 1 END AS BIGINT) AS told FROM uniq""")
def _(t):
    # The second run finds the answers of the first, so every answered key was told once.
    folder = scratch(t.spark)
    ask = lambda: settled(judge.judged_by(judge.unique_requests(t("requests")), length_judge, retries=0, delay=0.0, ledger=folder, parts=8))
    ask()
    told = t.spark.read.schema("key string").json(f"{folder}/*").groupBy("key").agg(F.count("*").alias("told"))
    return ask().join(told, "key", "left").select("key", "score", F.coalesce("told", F.lit(0)).alias("told"))


def _with_failures(t: Tables) -> DataFrame:
    scores = judge.judged_by(judge.unique_requests(t("requests")), length_judge, retries=0, delay=0.0)
    return t("requests").withColumn("key", judge.request_key()).join(scores, "key")


@query("g7_rule_fallback", f"""SELECT request_id, {q6(f"CASE WHEN ends_with(completion, '9') THEN {RULE_JUDGE_SQL} ELSE least(1.0, length(prompt) / 10) END")} AS score,
    CASE WHEN ends_with(completion, '9') THEN 'rule_fallback' ELSE 'judge' END AS source FROM requests""")
def _(t):
    rule = judging.rule_judge(F.col("prompt"), F.col("completion"), F.col("answer"))["score"]
    rows = _with_failures(t).withColumn("judge_score", F.when(~F.col("failed"), F.col("score"))).withColumn("rule_reward", rule)
    return judge.with_fallback(rows).select("request_id", r6(F.col("score")).alias("score"), "source")


@query("g8_judge_metrics", f"""WITH {KEYED} SELECT CAST(n AS BIGINT) AS total_requests, {q6('(n - u) / n')} AS cache_hit_rate, {q6('ceil(u / 32) / n')} AS batch_rate, CAST(e AS BIGINT) AS errors
    FROM (SELECT (SELECT count(*) FROM keyed) AS n, (SELECT count(*) FROM uniq) AS u, (SELECT count(*) FROM uniq WHERE ends_with(completion, '9')) AS e)""")
def _(t):
    m = judge.judge_metrics(_with_failures(t))
    return m.select("total_requests", r6(F.col("cache_hit_rate")).alias("cache_hit_rate"), r6(F.col("batch_rate")).alias("batch_rate"), "errors")


# --- stream --------------------------------------------------------------------------------------

def request_stream(t: Tables, files: int = 8, per_trigger: int = 4) -> DataFrame:
    """The request table as a file stream: its rows, dealt over files without order, read as they arrive."""
    folder = scratch(t.spark)
    rows = t("requests")
    rows.repartition(files, F.xxhash64("request_id")).write.parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def judged_stream(t: Tables, stream: DataFrame, **how) -> str:
    out = scratch(t.spark)
    # The test tables are small: few buckets, so that a micro-batch opens few states.
    start_judging(stream, out, scratch(t.spark), **{"buckets": 16, **how}).awaitTermination()
    return out


@query("g9_judge_stream", f"SELECT request_id, {KEY_SQL} AS key, {q6(RULE_JUDGE_SQL)} AS score FROM requests")
def _(t):
    rows = answers(t.spark, judged_stream(t, request_stream(t)))
    return rows.select("request_id", "key", r6(F.col("score")).alias("score"))


# Entries expire within the month: a request is served by one only if that is young enough for it.
_STREAM_TTL = 4 * 86_400
_STREAM_FRESH = f"c.key IS NOT NULL AND epoch(k.ts) - epoch(c.ts) < {_STREAM_TTL}"


@query("g9_stream_with_cache", f"""WITH {CACHE} SELECT request_id, CASE WHEN {_STREAM_FRESH} THEN 'cache' ELSE 'judge' END AS source,
    {q6(f"CASE WHEN {_STREAM_FRESH} THEN c.score ELSE {RULE_JUDGE_SQL} END")} AS score FROM keyed k LEFT JOIN cache c ON c.key = k.key""")
def _(t):
    rows = answers(t.spark, judged_stream(t, request_stream(t), cache=_cache(t), ttl_seconds=_STREAM_TTL))
    return rows.select("request_id", "source", r6(F.col("score")).alias("score"))


@query("g9_user_judge_stream", f"""WITH {KEYED}, s AS (SELECT *, ends_with(completion, '9') AS bad FROM keyed) SELECT request_id,
    CASE WHEN bad THEN 0.0 ELSE least(1.0, length(prompt) / 10) END AS score FROM s""")
def _(t):
    rows = answers(t.spark, judged_stream(t, request_stream(t), judge=length_judge, retries=0, delay=0.0))
    return rows.select("request_id", "score")


@query("g9_stream_metrics", f"""WITH {CACHE}, j AS (SELECT k.key, {_STREAM_FRESH} AS hit FROM keyed k LEFT JOIN cache c ON c.key = k.key)
    SELECT CAST(count(*) AS BIGINT) AS requests, CAST(count(*) FILTER (hit) AS BIGINT) AS hits,
    CAST(count(*) FILTER (NOT hit) - count(DISTINCT key) FILTER (NOT hit) AS BIGINT) AS repeats,
    CAST(count(DISTINCT key) FILTER (NOT hit) AS BIGINT) AS judged, CAST(0 AS BIGINT) AS errors FROM j""")
def _(t):
    out = judged_stream(t, request_stream(t), cache=_cache(t), ttl_seconds=_STREAM_TTL)
    return stream_metrics(t.spark, out).select("requests", "hits", "repeats", "judged", "errors")


def counted_stream(t: Tables, stream: DataFrame, width: str = "1 day", delay: str = "1 hour", **how) -> str:
    out = scratch(t.spark)
    start_window_counts(stream, out, scratch(t.spark), width, delay, **how).awaitTermination()
    return out


@query("g9_window_counts", "SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d') AS window_start, count(*) AS requests FROM requests GROUP BY 1")
def _(t):
    # Files come in no order, so most rows are late by the delay; they count all the same.
    counts = window_counts(t.spark, counted_stream(t, request_stream(t)))
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "requests")
