"""Queries over chats: sources, parsing, distillation, rendering, tokens, splits (ids A, B, C, D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chat, distilling, prompts, tokens
from ..functions.text import LINE_BREAK, strip
from ..operators import split
from ..operators import permute
from ..operators.audit import audit, percentile_or_zero
from ..operators.quantiles import exact_percentiles
from ..operators.batches import assemble, collate
from ..operators.distill import candidates, distill_report, drop_counts, funnel, kept_chats
from ..sources import tables as src
from .registry import WSC, flag_sql, q6, query, r6, scratch, trim
from .views import Tables

# Image bytes: magic bytes by id, then the chat text.  Lists with one, blank, two and no images.
_MAGIC = ("89504E47", "FFD8", "474946383961", "524946460000000057454250", "00")
_MIME = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/jpeg")
_IMG_LEN = "(CASE id % 5 " + " ".join(f"WHEN {i} THEN {len(m) // 2}" for i, m in enumerate(_MAGIC)) + " END + strlen(conversations))"
_MIME_SQL = "(CASE id % 5 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MIME)) + " END)"
_BLOB_SQL = "((CASE id % 5 " + " ".join(f"WHEN {i} THEN unhex('{m}')" for i, m in enumerate(_MAGIC)) + " END) || encode(conversations))"
IMAGE_STATE_SQL = "(CASE WHEN n_images IN (0, 4) THEN 'no_image_bytes' WHEN n_images = 3 THEN 'multi' ELSE 'single' END)"


def _image() -> object:
    head = F.lit(None).cast("binary")
    for i, m in reversed(list(enumerate(_MAGIC))):
        head = F.when(F.col("id") % 5 == i, F.unhex(F.lit(m))).otherwise(head)
    return F.concat(head, F.encode("conversations", "utf-8"))


def chat_table(t: Tables) -> DataFrame:
    img, blank = F.col("_img"), F.lit(b"")
    none = F.array().cast("array<binary>")
    images = (
        F.when(F.col("n_images") == 0, none).when(F.col("n_images") == 1, F.array(img))
        .when(F.col("n_images") == 2, F.array(img, blank)).when(F.col("n_images") == 3, F.array(img, img))
    )
    return t("chats").withColumn("_img", _image()).withColumn("images", images).drop("_img", "n_images")


# --- sources and sinks ---------------------------------------------------------------------------

@query("a1_read_chats", f"""SELECT id, 'many' AS kind, CAST(CASE WHEN n_images = 4 THEN -1 WHEN n_images < 2 THEN n_images ELSE 2 END AS BIGINT) AS n,
      length(conversations) AS chars FROM chats
    UNION ALL SELECT id, 'one', CAST(CASE WHEN n_images IN (0, 4) THEN -1 ELSE 1 END AS BIGINT), length(conversations) FROM chats""")
def _(t):
    rows = chat_table(t).withColumnRenamed("images", "image_bytes")
    many, one = scratch(t.spark), scratch(t.spark)
    rows.write.parquet(many)
    rows.withColumn("image_bytes", F.get("image_bytes", F.lit(0))).write.parquet(one)

    def read(path: str, kind: str) -> DataFrame:
        return src.read_chats(t.spark, path).select(
            "id", F.lit(kind).alias("kind"), F.coalesce(F.size("images"), F.lit(-1)).alias("n"),
            F.length("conversations").alias("chars"),
        )

    return read(many, "many").unionByName(read(one, "one"))


@query("a2_rl_shards", "SELECT id, problem, answer, problem_type, answer_type, prompt_type FROM gold")
def _(t):
    folder = scratch(t.spark)
    rows = t("gold").select(
        "id", F.lit(None).cast("array<struct<bytes:binary>>").alias("images"), "problem", "answer",
        "problem_type", "answer_type", F.lit("lines").alias("source"), "prompt_type", "step",
    )
    rows.filter("step % 2 = 0").drop("step").write.parquet(f"{folder}/RL_part000001.parquet")
    rows.filter("step % 2 = 1").drop("step").write.parquet(f"{folder}/RL_part000002.parquet")
    return src.read_rl_shards(t.spark, folder).select(
        "id", "problem", F.get("answer", F.lit(0)).alias("answer"), "problem_type", "answer_type", "prompt_type"
    )


@query("a3_preview", f"""SELECT id, CASE WHEN json_valid(conversations) AND starts_with(conversations, '[') THEN CAST(json_array_length(CASE WHEN json_valid(conversations) THEN conversations ELSE '[]' END) AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS n_turns,
    CAST(CASE WHEN n_images = 4 THEN 0 WHEN n_images < 2 THEN n_images ELSE 2 END AS BIGINT) AS n_images,
    CASE WHEN n_images = 4 THEN '' WHEN n_images = 0 THEN '' WHEN n_images = 1 THEN CAST({_IMG_LEN} AS VARCHAR)
      WHEN n_images = 2 THEN CAST({_IMG_LEN} AS VARCHAR) || ',0' ELSE CAST({_IMG_LEN} AS VARCHAR) || ',' || CAST({_IMG_LEN} AS VARCHAR) END AS sizes,
    conversations AS raw, (SELECT count(*) FROM chats) AS total_rows FROM chats ORDER BY id LIMIT 20""")
def _(t):
    return src.preview(chat_table(t), "id", 20).select(
        "id", F.coalesce("n_turns", F.lit(-1)).alias("n_turns"), "n_images",
        F.coalesce(F.array_join(F.col("image_sizes").cast("array<string>"), ","), F.lit("")).alias("sizes"),
        "raw", "total_rows",
    )


@query("a4_spread_preview", """SELECT id, user_text FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY id) AS rn
    FROM (SELECT *, ntile(5) OVER (ORDER BY id) AS tile FROM qa)) WHERE rn = 1""")
def _(t):
    return src.spread_preview(t("qa"), "id").select("id", "user_text")


@query("a5_first_rows", "SELECT id, user_text FROM qa ORDER BY id LIMIT 100")
def _(t):
    path = scratch(t.spark)
    src.first_rows(t("qa"), "id", 100).write.parquet(path)
    return t.spark.read.parquet(path).select("id", "user_text")


@query("a6_lookup", "SELECT doc_id, n_chars, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    return src.lookup(t("documents"), t("labels"), "doc_id").select("doc_id", "n_chars", "source")


@query("a7_capped", """SELECT 'all' AS cap, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM qa
    UNION ALL SELECT 'fifty', count(*), CAST(sum(id) AS BIGINT) FROM (SELECT id FROM qa ORDER BY id LIMIT 50)""")
def _(t):
    ids = t("qa").select("id")
    total = lambda df, name: df.agg(
        F.lit(name).alias("cap"), F.count("*").alias("n"), F.sum("id").alias("ids")
    )
    return total(src.capped(ids, "id", 0), "all").unionByName(total(src.capped(ids, "id", 50), "fifty"))


# --- parsing and audit ---------------------------------------------------------------------------

PARSED = f"""j AS (SELECT *, CASE WHEN json_valid(conversations) THEN conversations ELSE '[]' END AS doc, json_valid(conversations) AS good FROM chats),
f AS (SELECT *, CASE WHEN json_type(doc, '$[0].content') = 'VARCHAR' THEN json_extract_string(doc, '$[0].content') ELSE '' END AS u0,
  CASE WHEN json_type(doc, '$[1].content') = 'VARCHAR' THEN json_extract_string(doc, '$[1].content') ELSE '' END AS a0 FROM j),
ps AS (SELECT id, n_images, conversations, u0, a0, {IMAGE_STATE_SQL} AS image_state,
  CASE WHEN NOT good THEN 'json_error' WHEN json_type(doc) <> 'ARRAY' OR json_array_length(doc) < 2 THEN 'non_standard'
    WHEN {trim('u0')} = '' OR {trim('a0')} = '' THEN 'empty_text' ELSE 'ok' END AS state FROM f),
parsed AS (SELECT id, n_images, conversations, image_state, state, CASE WHEN state = 'ok' THEN u0 END AS u, CASE WHEN state = 'ok' THEN a0 END AS a FROM ps),
nu AS (SELECT *, '<image>' || chr(10) || {trim("regexp_replace(coalesce(u, ''), '(?i)<\\s*image[^>]*>', '', 'g')")} AS new_user, {trim('a')} AS ref FROM parsed),
qs AS (SELECT *, {trim('substr(new_user, 8)')} AS question FROM nu)"""
_ASKS = "(contains({0}, '?') OR contains({0}, '？'))"
_HINTS = " OR ".join(f"contains(lower(question), '{h}')" for h in chat.CAPTION_HINTS)
CAPTION_SQL = f"(question = '' OR (NOT {_ASKS.format('question')} AND ({_HINTS})))"


@query("b1_conversation_state", f"WITH {PARSED} SELECT id, state, u AS user_text, a AS assistant_text FROM parsed")
def _(t):
    return t("chats").select("id", chat.conversation(F.col("conversations")).alias("c")).select(
        "id", "c.state", F.col("c.user").alias("user_text"), F.col("c.assistant").alias("assistant_text")
    )


@query("b2_image_state", f"SELECT id, {IMAGE_STATE_SQL} AS image_state FROM chats")
def _(t):
    return chat_table(t).select("id", chat.image_state(F.col("images")).alias("image_state"))


@query("b3_mime", f"SELECT id, {_MIME_SQL} AS mime FROM chats")
def _(t):
    return t("chats").select("id", chat.mime_type(_image()).alias("mime"))


@query("b4_data_url", f"""SELECT id, md5('data:' || {_MIME_SQL} || ';base64,' || to_base64({_BLOB_SQL})) AS url_md5,
    CASE WHEN {_IMG_LEN} >= 100 THEN md5('data:image/jpeg;base64,' || to_base64({_BLOB_SQL})) END AS checked_md5 FROM chats""")
def _(t):
    img = F.col("img")
    return t("chats").withColumn("img", _image()).select(
        "id", F.md5(chat.data_url(img)).alias("url_md5"), F.md5(chat.checked_data_url(img)).alias("checked_md5")
    )


_Q = lambda c, p: f"coalesce(quantile_cont({c}, {p}), 0)"


@query("b5_audit", f"""WITH {PARSED}, l AS (SELECT *, length({trim('u')}) AS ul, length({trim('a')}) AS al FROM parsed)
  SELECT count(*) AS total_samples, {q6("count(*) FILTER (state = 'ok') / greatest(count(*), 1)")} AS parseable_ratio,
    {q6("count(*) FILTER (image_state = 'single') / greatest(count(*), 1)")} AS single_image_ratio,
    {q6('coalesce(avg(ul), 0)')} AS user_length_mean, {q6(_Q('ul', 0.5))} AS user_length_p50, {q6(_Q('ul', 0.9))} AS user_length_p90,
    {q6('coalesce(avg(al), 0)')} AS assistant_length_mean, {q6(_Q('al', 0.5))} AS assistant_length_p50, {q6(_Q('al', 0.9))} AS assistant_length_p90,
    {q6("count(*) FILTER (regexp_matches(u, '(?i)<\\s*image[^>]*>')) / greatest(count(*) FILTER (state = 'ok'), 1)")} AS user_image_ratio,
    {q6(f"count(*) FILTER ({_ASKS.format('u')}) / greatest(count(*) FILTER (state = 'ok'), 1)")} AS user_question_ratio,
    count(*) FILTER (state = 'empty_text') AS anomaly_empty_text, count(*) FILTER (n_images IN (0, 4)) AS anomaly_no_image_bytes,
    count(*) FILTER (state IN ('json_error', 'non_standard')) AS anomaly_non_standard FROM l""")
def _(t):
    path = scratch(t.spark)
    src.write_chats(chat_table(t), path)
    a = audit(src.read_chats(t.spark, path))
    return a.select(*[
        r6(F.col(c)).alias(c) if dict(a.dtypes)[c] == "double" else F.col(c) for c in a.columns
    ])


@query("b6_percentile", f"""SELECT lang, {q6('quantile_cont(n_chars, 0.5)')} AS p50, {q6('quantile_cont(n_chars, 0.9)')} AS p90 FROM documents GROUP BY lang""")
def _(t):
    return t("documents").groupBy("lang").agg(
        r6(percentile_or_zero(F.col("n_chars"), 0.5)).alias("p50"),
        r6(percentile_or_zero(F.col("n_chars"), 0.9)).alias("p90"),
    )


@query("b6_exact_percentiles", f"""SELECT l_returnflag, l_linestatus, p, {q6("CASE p WHEN 0.5 THEN a WHEN 0.9 THEN b ELSE c END")} AS value FROM
    (SELECT l_returnflag, l_linestatus, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) AS a, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9) AS b,
     quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.99) AS c FROM lineitem GROUP BY ALL), (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) v(p)""")
def _(t):
    found = exact_percentiles(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.5, 0.9, 0.99])
    return found.select("l_returnflag", "l_linestatus", "p", r6(F.col("value")).alias("value"))


def _questions(t: Tables) -> DataFrame:
    conv = chat.conversation(F.col("conversations"))
    return t("chats").select("id", conv.alias("conv")).withColumn(
        "new_user", chat.normal_user(F.col("conv.user"))
    ).withColumn("question", chat.question_text(F.col("new_user")))


@query("b7_normal_user", f"WITH {PARSED} SELECT id, new_user, question FROM qs")
def _(t):
    return _questions(t).select("id", "new_user", "question")


@query("b8_question_mark", f"WITH {PARSED} SELECT id, {_ASKS.format('question')} AS asks FROM qs")
def _(t):
    return _questions(t).select("id", chat.is_question(F.col("question")).alias("asks"))


@query("b9_long_or_question", f"WITH {PARSED} SELECT id, question FROM qs WHERE {_ASKS.format('question')} OR length(question) > 15")
def _(t):
    return _questions(t).filter(chat.worth_asking(F.col("question"))).select("id", "question")


@query("b10_caption_like", f"WITH {PARSED} SELECT id, {CAPTION_SQL} AS caption FROM qs")
def _(t):
    return _questions(t).select("id", chat.looks_like_caption(F.col("question")).alias("caption"))


_RULES_SQL = "'" + prompts.DISTILL_RULES.replace("'", "''") + "'"
CALL_FREE_SQL = f"""(CASE WHEN state IN ('json_error', 'non_standard') THEN 'non_standard_structure' WHEN state = 'empty_text' THEN 'empty_text'
  WHEN image_state = 'no_image_bytes' THEN 'no_image_bytes' WHEN image_state = 'multi' THEN 'non_single_image'
  WHEN NOT ({_ASKS.format('question')} OR length(question) > 15) THEN 'not_question_or_too_short' WHEN {CAPTION_SQL} THEN 'caption_like' END)"""


@query("b11_distill_prompt", f"""WITH {PARSED} SELECT id, {CALL_FREE_SQL} AS early_reason, CASE WHEN {CALL_FREE_SQL} IS NULL THEN
    '<image>' || chr(10) || '问题：' || question || chr(10) || chr(10) || '参考答案：' || ref || chr(10) || chr(10) || {_RULES_SQL} END AS prompt FROM qs""")
def _(t):
    return candidates(chat_table(t)).select("id", "early_reason", "prompt")


# --- replies and funnel --------------------------------------------------------------------------

_LB = LINE_BREAK
_THINK, _LABEL = r"(?is)<think>(.*?)</think>", rf"(?is)^(.*?)(?:^|\n){WSC}*(?:Answer|答案|最终答案){WSC}*[:：]"
_LABEL_HIT = rf"(?i)(?:^|\n){WSC}*(?:Answer|答案|最终答案){WSC}*[:：]"
_PREFIX = rf"(?i)^{WSC}*(?:解释|原因分析|推理过程|思考过程|思路|分析过程){WSC}*[:：]{WSC}*"


def lines_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{_LB}'), lambda l: {trim('l')}), lambda l: l <> '')"


REPLIED = f"""r0 AS (SELECT id, latency, reply, {trim("coalesce(reply, '')")} AS txt FROM replies),
r1 AS (SELECT *, CASE WHEN regexp_matches(txt, '{_THINK}') THEN regexp_extract(txt, '{_THINK}', 1)
   ELSE regexp_replace({trim(f"CASE WHEN regexp_matches(txt, '{_LABEL_HIT}') THEN substr(txt, 1, instr(txt, regexp_extract(txt, '{_LABEL_HIT}')) - 1) ELSE txt END")}, '{_PREFIX}', '') END AS body FROM r0),
r2 AS (SELECT *, list_filter({lines_sql('body')}, lambda l: NOT regexp_matches(l, '(?i)^(?:answer|答案){WSC}*[:：]')) AS ls FROM r1)"""


@query("b12_parsed_reply", f"""WITH {REPLIED} SELECT r2.id, len(ls) AS n_lines,
    CASE WHEN len(ls) = 0 THEN 'no_think' END AS error, CASE WHEN len(ls) > 0 THEN '<think>' || chr(10) || array_to_string(ls, chr(10)) || chr(10) || '</think>' || chr(10) || chr(10) || 'Answer: ' || {trim('assistant_text')} END AS formatted
    FROM r2 JOIN qa ON qa.id = r2.id""")
def _(t):
    j = t("replies").join(t("qa").select("id", "assistant_text"), "id")
    j = j.withColumn("ls", distilling.think_lines(F.col("reply")))
    answer = strip(F.col("assistant_text"))
    error = F.when(F.size("ls") == 0, F.lit("no_think")).when(answer == "", F.lit("no_answer"))
    return j.select(
        "id", F.size("ls").alias("n_lines"), error.alias("error"),
        distilling.distilled_text(F.col("ls"), answer).alias("formatted"),
    )


@query("b13_answer_too_long", f"""SELECT id, length({trim('assistant_text')}) > greatest(1, floor(length({trim('user_text')}) * 1.2)) AND {trim('user_text')} <> '' AS too_long FROM qa""")
def _(t):
    return t("qa").select(
        "id", distilling.answer_too_long(F.col("assistant_text"), F.col("user_text"), 1.2).alias("too_long")
    )


@query("b14_answer_focused", f"SELECT id, regexp_matches(coalesce(reply, ''), '{distilling.ANSWER_FOCUSED}') AS focused FROM replies")
def _(t):
    return t("replies").select("id", F.coalesce(F.col("reply").rlike(distilling.ANSWER_FOCUSED), F.lit(False)).alias("focused"))


@query("b15_eval_style", f"SELECT id, regexp_matches(coalesce(reply, ''), '{distilling.EVAL_STYLE}') AS judging FROM replies")
def _(t):
    return t("replies").select("id", F.coalesce(F.col("reply").rlike(distilling.EVAL_STYLE), F.lit(False)).alias("judging"))


FUNNEL = f"""{PARSED}, {REPLIED},
f0 AS (SELECT qs.*, {CALL_FREE_SQL} AS early, r2.latency, r2.reply, coalesce(r2.ls, []) AS ls FROM qs LEFT JOIN r2 ON r2.id = qs.id),
f1 AS (SELECT *, CASE WHEN len(ls) > 0 AND ref <> '' THEN '<think>' || chr(10) || array_to_string(ls, chr(10)) || chr(10) || '</think>' || chr(10) || chr(10) || 'Answer: ' || ref END AS made FROM f0),
f2 AS (SELECT *, coalesce({lines_sql(f"regexp_extract(made, '{_THINK}', 1)")}, []) AS shown,
   CASE WHEN regexp_replace(lower(ref), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g') <> '' THEN 1.0 ELSE 0.0 END AS sim FROM f1),
fun AS (SELECT *, coalesce(early, CASE WHEN coalesce(reply, '') = '' THEN 'api_fail' WHEN len(ls) = 0 THEN 'no_think' WHEN ref = '' THEN 'no_answer'
   WHEN regexp_matches(array_to_string(shown, ' '), '{distilling.ANSWER_FOCUSED}') THEN 'answer_focused_explanation'
   WHEN regexp_matches(array_to_string(shown, ' '), '{distilling.EVAL_STYLE}') THEN 'explanation_eval_style'
   WHEN length(made) < 40 OR len(shown) < 1 THEN 'too_short' WHEN sim < 0.85 THEN 'inconsistent_answer' ELSE 'keep' END) AS drop_reason FROM f2)"""


def _funnel(t: Tables) -> DataFrame:
    return funnel(chat_table(t), t("replies"))


@query("b16_min_length", f"WITH {FUNNEL} SELECT id, coalesce(length(made), -1) AS chars, len(shown) AS n_lines, coalesce(length(made) < 40 OR len(shown) < 1, TRUE) AS short FROM fun")
def _(t):
    f = _funnel(t)
    n = F.length("new_assistant")
    return f.select("id", F.coalesce(n, F.lit(-1)).alias("chars"), "n_lines", F.coalesce((n < 40) | (F.col("n_lines") < 1), F.lit(True)).alias("short"))


@query("b17_same_text", f"""SELECT a.id, {flag_sql("regexp_replace(lower(a.text), '[^0-9a-z\\x{4e00}-\\x{9fff}]', '', 'g') <> '' AND regexp_replace(lower(a.text), '[^0-9a-z\\x{4e00}-\\x{9fff}]', '', 'g') = regexp_replace(lower(b.text), '[^0-9a-z\\x{4e00}-\\x{9fff}]', '', 'g')")} AS same
    FROM (SELECT doc_id AS id, text FROM documents) a LEFT JOIN (SELECT doc_id - 1 AS id, text FROM documents) b ON a.id = b.id""")
def _(t):
    # Each document against the one after it; the last one of a run of ids has none, which is no equal.
    d = t("documents")
    a = d.select(F.col("doc_id").alias("id"), F.col("text").alias("one"))
    b = d.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("two"))
    same = distilling.same_text_similarity(F.col("one"), F.coalesce("two", F.lit("")))
    return a.join(b, "id", "left").select("id", same.alias("same"))


@query("b18_drop_funnel", f"WITH {FUNNEL} SELECT id, drop_reason FROM fun")
def _(t):
    return _funnel(t).select("id", "drop_reason")


@query("b18_drop_counts", f"WITH {FUNNEL} SELECT drop_reason, count(*) AS n FROM fun GROUP BY drop_reason")
def _(t):
    return drop_counts(_funnel(t))


_N = "count(*) FILTER (drop_reason = '{}')".format
_CALLED = "count(*) FILTER (early IS NULL)"


@query("b19_distill_report", f"""WITH {FUNNEL} SELECT count(*) AS total, {_N('keep')} AS keep, {q6(f"{_N('keep')} / greatest(count(*), 1)")} AS keep_ratio, {_CALLED} AS api_called,
   {q6(f"{_N('answer_focused_explanation')} / greatest({_CALLED}, 1)")} AS answer_focused_explanation_rate,
   {q6("coalesce(avg(latency) FILTER (early IS NULL), 0)")} AS avg_api_latency_sec, {q6("coalesce(avg(len(shown)) FILTER (drop_reason = 'keep'), 0)")} AS avg_think_lines,
   {q6(f"{_N('keep')} / greatest({_N('keep')} + {_N('inconsistent_answer')}, 1)")} AS answer_consistency_rate,
   {q6("coalesce(avg(sim) FILTER (drop_reason IN ('keep', 'inconsistent_answer')), 0)")} AS avg_answer_similarity,
   {_N('caption_like')} AS drop_caption_like, {_N('api_fail')} AS drop_api_fail, {_N('no_think')} AS drop_no_think FROM fun""")
def _(t):
    r = distill_report(_funnel(t))
    keep = ("total", "keep", "api_called", "drop_caption_like", "drop_api_fail", "drop_no_think")
    rates = ("keep_ratio", "answer_focused_explanation_rate", "avg_api_latency_sec", "avg_think_lines",
             "answer_consistency_rate", "avg_answer_similarity")
    return r.select(*keep, *[r6(F.col(c)).alias(c) for c in rates])


def _json_text(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


REWRITTEN = f"""'[{{"role": "user", "content": ' || {_json_text('new_user')} || '}}, {{"role": "assistant", "content": ' || {_json_text('made')} || '}}]'"""


@query("b20_rewritten_chat", f"WITH {FUNNEL} SELECT id, {REWRITTEN} AS conversations FROM fun WHERE drop_reason = 'keep'")
def _(t):
    kept = _funnel(t).filter("drop_reason = 'keep'")
    return kept.select("id", distilling.chat_json(F.col("new_user"), F.col("new_assistant")).alias("conversations"))


@query("b21_distill_job", f"""WITH {FUNNEL} SELECT id, {REWRITTEN} AS conversations,
    CAST(CASE WHEN n_images = 1 THEN 1 ELSE 2 END AS BIGINT) AS n_images, {_IMG_LEN.replace('conversations', 'old')} AS image_bytes FROM (SELECT *, conversations AS old FROM fun) WHERE drop_reason = 'keep'""")
def _(t):
    # The whole job: funnel, survivors written under the input columns, read back.
    chats = chat_table(t)
    path = scratch(t.spark)
    src.write_kept(kept_chats(chats, funnel(chats, t("replies"))), chats.columns, path)
    return t.spark.read.parquet(path).select(
        "id", "conversations", F.size("images").alias("n_images"), F.length(F.get("images", F.lit(0))).alias("image_bytes")
    )


@query("a8_write_kept", "SELECT id, length(conversations) AS chars FROM chats")
def _(t):
    chats, path = chat_table(t), scratch(t.spark)
    src.write_kept(chats, chats.columns, path)
    return t.spark.read.parquet(path).select("id", F.length("conversations").alias("chars"))


@query("a9_report_json", f"""WITH {FUNNEL} SELECT count(*) AS total, {_N('keep')} AS keep, {q6(f"{_N('keep')} / greatest(count(*), 1)")} AS keep_ratio FROM fun""")
def _(t):
    path = scratch(t.spark)
    src.write_report(distill_report(_funnel(t)), path)
    return t.spark.read.json(path).select("total", "keep", r6(F.col("keep_ratio")).alias("keep_ratio"))


# --- rendering -----------------------------------------------------------------------------------

def percent_sql(seed: str, x: str) -> str:
    h = f"md5('{seed}-' || CAST({x} AS VARCHAR))"
    part = lambda i: f"('0x' || substr({h}, {8 * i + 1}, 8))::BIGINT"
    return f"(({part(0)} * 336 + {part(1)} * 1616 + {part(2)} * 7296 + {part(3)}) % 10000)"


_PICK = "list_extract([" + ", ".join(
    "'" + p.replace("{name}", "Ada").replace("'", "''") + "'" for p in prompts.SYSTEM_PROMPTS
) + f"], {percent_sql('system-pick', 'id')} % 10 + 1)"


def _turns(t: Tables) -> DataFrame:
    return t("dialogs").withColumn("turns", chat.chat_turns(F.col("conversations")))


@query("c1_system_prompt", f"""SELECT id, CASE WHEN shape IN (0, 2) AND {percent_sql('system', 'id')} < 2000 THEN {_PICK}
    WHEN shape = 1 THEN 'be kind <image>' WHEN shape = 3 THEN 'sys' ELSE user_text END AS first_text,
    CAST(CASE shape WHEN 2 THEN 5 WHEN 1 THEN 3 WHEN 3 THEN 3 ELSE 2 END + CASE WHEN shape IN (0, 2) AND {percent_sql('system', 'id')} < 2000 THEN 1 ELSE 0 END AS BIGINT) AS n_turns FROM dialogs""")
def _(t):
    x = _turns(t).withColumn("turns", chat.with_system_prompt(F.col("turns"), F.col("id"), "Ada"))
    return x.select("id", F.get("turns", F.lit(0))["content"].alias("first_text"), F.size("turns").alias("n_turns"))


_PADS = f"repeat('{prompts.IMAGE_PAD}', 64)"


_PADDED = f"replace({{}}, '<image>', {_PADS})".format


@query("c2_image_pads", f"""SELECT id, md5(CASE shape WHEN 1 THEN 'be kind <image>' || chr(10) || {_PADDED("'<image> ' || user_text")} || chr(10) || '<think>' || chr(10) || {_PADDED('user_text')} || chr(10) || '</think>' || chr(10) || chr(10) || {_PADDED('assistant_text')}
    WHEN 2 THEN {_PADDED('user_text')} || chr(10) || {_PADDED('assistant_text')} || chr(10) || 'r1' || chr(10) || 'r2' || chr(10) || {_PADDED('assistant_text')}
    WHEN 3 THEN 'sys' || chr(10) || {_PADDED('user_text')} || chr(10)
    ELSE {_PADDED('user_text')} || chr(10) || {_PADDED('assistant_text')} END) AS contents FROM dialogs""")
def _(t):
    x = _turns(t).withColumn("turns", chat.with_image_pads(F.col("turns")))
    contents = F.array_join(F.transform("turns", lambda v: F.coalesce(v["content"], F.lit(""))), "\n")
    return x.select("id", F.md5(contents).alias("contents"))


@query("c3_tools", """SELECT id, CASE WHEN shape = 3 THEN '[{"name":"f1"},{"name":"f2"}]' END AS tools FROM dialogs""")
def _(t):
    return _turns(t).select("id", chat.chat_tools(F.col("turns")).alias("tools"))


def _turn_sql(role: str, body: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {body} || '<|im_end|>' || chr(10)"


def _think_sql(think: str, body: str) -> str:
    return _turn_sql("assistant", f"'<think>' || chr(10) || {think} || chr(10) || '</think>' || chr(10) || chr(10) || {body}")


_nl = "ltrim({0}, chr(10))".format
_HEAD = "'" + prompts.TOOLS_HEAD.replace("'", "''") + "'"
_FOOT = "'" + prompts.TOOLS_FOOT.replace("'", "''") + "'"
RENDERED = f"""(CASE shape
  WHEN 1 THEN {_turn_sql('system', "'be kind <image>'")} || {_turn_sql('user', "'<image> ' || user_text")} || {_think_sql("trim(user_text, chr(10))", _nl('assistant_text'))}
  WHEN 2 THEN {_turn_sql('user', 'user_text')} || {_think_sql("''", _nl('assistant_text'))}
    || '<|im_start|>user' || chr(10) || '<tool_response>' || chr(10) || 'r1' || chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) || 'r2' || chr(10) || '</tool_response><|im_end|>' || chr(10)
    || {_think_sql("'why'", _nl('assistant_text'))}
  WHEN 3 THEN '<|im_start|>system' || chr(10) || 'sys' || chr(10) || chr(10) || {_HEAD} || chr(10) || '{{"name":"f1"}}' || chr(10) || '{{"name":"f2"}}' || {_FOOT}
    || {_turn_sql('user', 'user_text')} || {_think_sql("''", """'<tool_call>' || chr(10) || '{"name": "f1", "arguments": 7}' || chr(10) || '</tool_call>' || chr(10) || '<tool_call>' || chr(10) || '{"name": "f2", "arguments": {"b":2}}' || chr(10) || '</tool_call>'""")}
  ELSE {_turn_sql('user', 'user_text')} || {_think_sql("''", _nl('assistant_text'))} END)"""


def _rendered(t: Tables) -> DataFrame:
    x = _turns(t)
    return x.withColumn("chat", chat.render_chat(F.col("turns"), chat.chat_tools(F.col("turns"))))


@query("c4_render_chat", f"SELECT id, {RENDERED} AS chat FROM dialogs")
def _(t):
    return _rendered(t).select("id", "chat")


@query("c4_generation_prompts", f"""SELECT id, {RENDERED} || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) AS open_think,
    {RENDERED} || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS no_think FROM dialogs""")
def _(t):
    # The one open block lets the model think, the empty one makes it answer at once.
    ready = lambda x, thinks: chat.render_chat(x, chat.chat_tools(x), generation_prompt=True, open_thinking=thinks)
    return _turns(t).select("id", ready(F.col("turns"), True).alias("open_think"), ready(F.col("turns"), False).alias("no_think"))


@query("c5_drop_empty_think", f"""SELECT id, CASE WHEN {percent_sql('think', 'id')} >= 2000
    THEN replace({RENDERED}, '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10), '') ELSE {RENDERED} END AS chat FROM dialogs""")
def _(t):
    return _rendered(t).select("id", chat.without_empty_think(F.col("chat"), F.col("id")).alias("chat"))


_INSTR = "'" + prompts.FORMAT_INSTRUCTION + "'"


@query("c6_rl_prompt", f"""SELECT id, '<|im_start|>user' || chr(10) || {_PADS} || ' ' || problem || {_INSTR} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) AS prompt FROM gold""")
def _(t):
    imaged = F.concat(F.lit(" <image> "), F.col("problem"), F.lit(" "))
    return t("gold").select("id", chat.rl_prompt(imaged).alias("prompt"))


def _fill_sql(template: str, **fields: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in fields.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


@query("c7_prompts", f"""SELECT id, md5({_fill_sql(prompts.BINARY_PROMPT, answer='assistant_text', prediction='user_text')}) AS short_judge,
    md5({_fill_sql(prompts.BINARY_PROMPT_WITH_QUESTION, question='user_text', answer='assistant_text', prediction='user_text')}) AS full_judge,
    md5('标准答案:' || chr(10) || assistant_text || chr(10) || '当前模型回答:' || chr(10) || user_text || chr(10) || chr(10) || '{prompts.TWO_SCORE_REQUEST}') AS two_score,
    md5({_fill_sql(prompts.TWO_PART_SYSTEM, question_type="'math'")}) AS two_part,
    md5('Question: ' || user_text || chr(10) || chr(10) || 'Ground Truth Answer: ' || assistant_text || chr(10) || chr(10) || 'Model Completion:' || chr(10) || user_text || chr(10) || chr(10) || chr(10) || '{prompts.DETAILED_REQUEST.strip()}') AS detailed,
    md5({_fill_sql(prompts.DETAILED_SYSTEM + prompts.DETAILED_EXTRA['coding'], question_type="'programming'")}) AS detailed_head FROM qa""")
def _(t):
    u, a = F.col("user_text"), F.col("assistant_text")
    return t("qa").select(
        "id", F.md5(prompts.binary_prompt(a, u)).alias("short_judge"), F.md5(prompts.binary_prompt(a, u, u)).alias("full_judge"),
        F.md5(prompts.two_score_prompt(a, u)).alias("two_score"), F.md5(prompts.two_part_system(F.lit("math"))).alias("two_part"),
        F.md5(prompts.detailed_user(u, a, F.lit(None).cast("string"), u)).alias("detailed"),
        F.md5(prompts.detailed_system(F.lit("coding"))).alias("detailed_head"),
    )


_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"


@query("c7_image_prompts", f"""SELECT id, md5('Question: ' || coalesce(asked, 'See prediction below') || chr(10) || 'Ground Truth Answer: ' || assistant_text || chr(10) || 'Model Completion/Prediction:' || chr(10) || user_text
      || chr(10) || chr(10) || {_QUOTED(prompts.TWO_PART_REQUEST)}) AS two_part_user,
    md5(replace(CASE WHEN asked IS NULL THEN {_QUOTED(prompts.DEFAULT_IMAGE_PROMPT)} ELSE {_QUOTED(prompts.COT_PROMPT)} END, '<image>', {_PADS})) AS image_prompt
    FROM (SELECT *, CASE WHEN id % 3 = 0 THEN NULL ELSE user_text END AS asked FROM qa)""")
def _(t):
    u, a = F.col("user_text"), F.col("assistant_text")
    asked = F.when(F.col("id") % 3 != 0, u)
    return t("qa").select(
        "id", F.md5(prompts.two_part_user(asked, a, u)).alias("two_part_user"),
        F.md5(prompts.image_prompt(asked.isNotNull())).alias("image_prompt"),
    )


# --- token arrays --------------------------------------------------------------------------------

START, END = [ord(c) for c in "<a>"], [ord(c) for c in "</a>"]
MAX_LEN, PAD = 600, 0


def _ids(column: str):
    return F.transform(F.split(column, ""), F.ascii)


def _total(arr):
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda s, x: s + x)


def codes_sql(x: str) -> str:
    return f"list_transform(string_split({x}, ''), lambda ch: CASE WHEN ch = '' THEN 0 ELSE unicode(ch) END)"


def sum_sql(x: str) -> str:
    return f"CAST(coalesce(list_sum({codes_sql(x)}), 0) AS BIGINT)"


def _spelled(arr):
    """Whole array as one value: order and place of every element count."""
    return F.md5(F.array_join(arr.cast("array<string>"), ","))


def spelled_sql(*lists: str) -> str:
    return f"md5(array_to_string({' || '.join(lists)}, ','))"


def list_sql(x: str) -> str:
    return f"CAST({codes_sql(x)} AS BIGINT[])"


def times_sql(value: int, n: str) -> str:
    return f"list_transform(range(CAST({n} AS BIGINT)), lambda i: CAST({value} AS BIGINT))"


def _labelled(t: Tables) -> DataFrame:
    ids = t("spoken").withColumn("ids", tokens.pad_right(_ids("t"), MAX_LEN, PAD))
    return ids.withColumn("labels", tokens.loss_labels(F.col("ids"), START, END, MAX_LEN))


CUT = f"c AS (SELECT id, batch, left(t, {MAX_LEN}) AS cut, t FROM spoken)"
# Padding follows an open answer, so its pads are labelled too and count zero in the sums.
SEG = f"""{CUT}, s AS (SELECT *, regexp_extract_all(cut, '(?s)<a>(.*?)(?:</a>|$)', 1) AS bodies,
  regexp_extract_all(cut, '(?s)<a>((?:.*?)(?:</a>|$))', 1) AS segs FROM c)"""


@query("c8_pad_right", f"WITH {CUT} SELECT id, CAST({MAX_LEN} AS BIGINT) AS n, {spelled_sql(list_sql('cut'), times_sql(PAD, f"greatest(0, {MAX_LEN} - length(t))"))} AS ids, greatest(0, {MAX_LEN} - length(t)) AS pads FROM c")
def _(t):
    ids = t("spoken").select("id", tokens.pad_right(_ids("t"), MAX_LEN, PAD).alias("ids"))
    return ids.select(
        "id", F.size("ids").alias("n"), _spelled(F.col("ids")).alias("ids"),
        F.size(F.filter("ids", lambda x: x == PAD)).alias("pads"),
    )


@query("c9_loss_labels", f"""WITH {SEG} SELECT id, {sum_sql("array_to_string(segs, '')")} AS label_total,
    length(array_to_string(segs, '')) + CASE WHEN regexp_matches(cut, '(?s)<a>') AND NOT ends_with(regexp_extract(cut, '(?s)^.*(</a>)'), '</a>') THEN {MAX_LEN} - length(cut)
      WHEN instr(reverse(cut), reverse('<a>')) > 0 AND len(bodies) > 0 AND NOT ends_with(list_extract(segs, -1), '</a>') THEN {MAX_LEN} - length(cut) ELSE 0 END AS n_labels FROM s""")
def _(t):
    lab = F.filter("labels", lambda x: x != tokens.IGNORE)
    return _labelled(t).select("id", _total(lab).alias("label_total"), F.size(lab).alias("n_labels"))


@query("c10_prompt_length", f"""WITH {CUT} SELECT id, CASE WHEN instr(cut, '<a>') > 0 AND instr(cut, '<a>') + 2 < {MAX_LEN} THEN instr(cut, '<a>') + 2 ELSE length(cut) END AS prompt_len FROM c""")
def _(t):
    return _labelled(t).select("id", tokens.prompt_length(F.col("ids"), F.col("labels"), PAD).alias("prompt_len"))


@query("c11_labelled_ids", f"""WITH {SEG} SELECT id, {spelled_sql(list_sql("array_to_string(segs, '')"))} AS ids FROM s""")
def _(t):
    got = tokens.labelled_ids(F.col("ids"), F.col("labels"))
    return _labelled(t).select("id", _spelled(F.filter(got, lambda x: x != PAD)).alias("ids"))


# The first full stop plays the end token.
@query("c12_completion_mask", f"""WITH x AS (SELECT id, assistant_text AS s, CASE WHEN contains(assistant_text, '.') THEN left(assistant_text, instr(assistant_text, '.')) ELSE assistant_text END AS cut FROM qa)
    SELECT id, {spelled_sql(list_sql('cut'))} AS cut, {spelled_sql(times_sql(1, 'length(cut)'), times_sql(0, 'length(s) - length(cut)'))} AS mask FROM x""")
def _(t):
    x = t("qa").select("id", _ids("assistant_text").alias("ids"))
    cut, mask = tokens.until_eos(F.col("ids"), ord(".")), tokens.completion_mask(F.col("ids"), ord("."))
    return x.select("id", cut.alias("cut"), mask.alias("mask")).select(
        "id", _spelled(F.col("cut")).alias("cut"), _spelled(F.col("mask")).alias("mask"),
    )


@query("c13_collate", f"""WITH x AS (SELECT id, batch, left(user_text, 300) AS cut FROM spoken),
    w AS (SELECT *, max(length(cut)) OVER (PARTITION BY batch) AS width FROM x)
    SELECT id, {spelled_sql(times_sql(PAD, 'width - length(cut)'), list_sql('cut'))} AS ids, {spelled_sql(times_sql(0, 'width - length(cut)'), times_sql(1, 'length(cut)'))} AS mask FROM w""")
def _(t):
    x = t("spoken").select("id", "batch", _ids("user_text").alias("ids"))
    return collate(x, "batch", "ids", 300, PAD).select(
        "id", _spelled(F.col("input_ids")).alias("ids"), _spelled(F.col("attention_mask")).alias("mask"),
    )


@query("c14_assemble", f"""WITH w AS (SELECT *, max(length(user_text)) OVER (PARTITION BY batch) + max(length(assistant_text)) OVER (PARTITION BY batch) AS width FROM spoken)
    SELECT id, {spelled_sql(list_sql("user_text || assistant_text"), times_sql(PAD, "width - length(user_text) - length(assistant_text)"))} AS ids,
      {spelled_sql(times_sql(1, "length(user_text) + length(assistant_text)"), times_sql(0, "width - length(user_text) - length(assistant_text)"))} AS mask,
      {spelled_sql(times_sql(tokens.IGNORE, "length(user_text)"), list_sql("assistant_text"), times_sql(tokens.IGNORE, "width - length(user_text) - length(assistant_text)"))} AS labels FROM w""")
def _(t):
    x = t("spoken").select("id", "batch", _ids("user_text").alias("p"), _ids("assistant_text").alias("c"))
    return assemble(x, "batch", "p", "c", PAD).select(
        "id", _spelled(F.col("full_ids")).alias("ids"), _spelled(F.col("attention_mask")).alias("mask"),
        _spelled(F.col("labels")).alias("labels"),
    )


# Runs of the letter e play the image marker.
@query("c15_image_slots", """SELECT id, len(regexp_extract_all(assistant_text, 'e+')) AS runs, length(assistant_text) - length(replace(assistant_text, 'e', '')) AS slots,
    least(len(regexp_extract_all(assistant_text, 'e+')), n_images) AS paired, instr(assistant_text, 'e') - 1 AS first_at FROM qa""")
def _(t):
    x = t("qa").select("id", "n_images", tokens.image_runs(_ids("assistant_text"), ord("e")).alias("runs"))
    return x.select(
        "id", F.size("runs").alias("runs"), _total(F.transform("runs", lambda r: r["n"])).alias("slots"),
        F.least(F.size("runs"), "n_images").alias("paired"),
        F.coalesce(F.get("runs", F.lit(0))["at"], F.lit(-1)).alias("first_at"),
    )


@query("c16_placeholder_rows", "SELECT id, n_images NOT IN (0, 4) AS has_image FROM chats")
def _(t):
    return chat_table(t).select(
        "id", (F.coalesce(F.size(chat.real_images(F.col("images"))), F.lit(0)) > 0).alias("has_image")
    )


# --- splits and plans ----------------------------------------------------------------------------

@query("d1_split", f"""SELECT id, CASE WHEN {percent_sql('split', 'id')} < 200 THEN 'val' ELSE 'train' END AS part FROM gold""")
def _(t):
    i = F.col("id")
    part = F.when(split.in_split(i, "val"), "val").when(split.in_split(i, "train"), "train")
    return t("gold").filter(split.in_split(i, "all")).select("id", part.alias("part"))


@query("d2_epoch_plan", """WITH o AS (SELECT id, row_number() OVER (ORDER BY md5('44-' || id), id) - 1 AS position, count(*) OVER () AS n FROM gold),
    p AS (SELECT id, unnest(range(position, CAST(ceil(n / 7) * 7 AS BIGINT), n)) AS position FROM o),
    q AS (SELECT id, position, position % 7 AS shard, CAST(floor(floor(position / 7) / 32) AS BIGINT) AS batch FROM p)
    SELECT * FROM q WHERE batch >= 3""")
def _(t):
    return split.epoch_plan(t("gold"), "id", 42, 2, 32, shards=7, skip_batches=3)


# The bijection step by step: even rounds move the column of the grid, odd ones its row, until the cell is a row number.
@query("d2_epoch_bijection", """WITH RECURSIVE g AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row, count(*) OVER () AS n FROM gold),
    dim AS (SELECT DISTINCT n, w, CAST(ceil(n / w) AS BIGINT) AS h FROM (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS w FROM g)),
    net(id, l, r, step) AS (
      SELECT id, row % w, row // w, 0 FROM g, dim UNION ALL
      SELECT id, CASE WHEN step % 2 = 0 THEN (l + ('0x' || md5('44-' || step % 6 || '-' || r)[1:12])::BIGINT) % w ELSE l END,
        CASE WHEN step % 2 = 1 THEN (r + ('0x' || md5('44-' || step % 6 || '-' || l)[1:12])::BIGINT) % h ELSE r END, step + 1
      FROM net, dim WHERE step = 0 OR step % 6 > 0 OR r * w + l >= n),
    o AS (SELECT id, r * w + l AS position, n FROM net, dim WHERE step > 0 AND step % 6 = 0 AND r * w + l < n),
    p AS (SELECT id, unnest(range(position, CAST(ceil(n / 7) * 7 AS BIGINT), n)) AS position FROM o),
    q AS (SELECT id, position, position % 7 AS shard, CAST(floor(floor(position / 7) / 32) AS BIGINT) AS batch FROM p)
    SELECT * FROM q WHERE batch >= 3""")
def _(t):
    rows = permute.numbered(t("gold"), "id")
    return permute.epoch_order(rows, rows.count(), 42, 2, 32, shards=7, skip_batches=3).drop("row")


@query("d3_repeat_prompts", """SELECT id, g, CAST(id % 1000 AS BIGINT) * 4 + g AS slot FROM (SELECT id, unnest(generate_series(0, 3)) AS g FROM qa)""")
def _(t):
    rows = t("qa").select("id", (F.col("id") % 1000).alias("row"))
    return split.repeat_prompts(rows, 4).select("id", "g", "slot")


@query("d3_generation_major", """SELECT id, g, batch, g * n + row AS slot FROM (SELECT id, batch, row, count(*) OVER (PARTITION BY batch) AS n FROM
    (SELECT id, CAST(floor(position / 64) AS BIGINT) AS batch, position % 64 AS row FROM (SELECT id, row_number() OVER (ORDER BY md5('9-' || id), id) - 1 AS position FROM gold))), (SELECT unnest(generate_series(0, 3)) AS g)""")
def _(t):
    # All prompts of a batch once, then all of them again: g-th answers stand together.
    plan = split.epoch_plan(t("gold"), "id", 9, 0, 64).select("id", "batch", (F.col("position") % 64).alias("row"))
    sizes = plan.groupBy("batch").agg(F.count("*").alias("batch_rows"))
    return split.repeat_prompts(plan.join(sizes, "batch"), 4, "generation").select("id", "g", "batch", "slot")


