"""Inputs derived from the driver tables, written once in SQL for Spark and DuckDB.

``{name}`` is a driver table or another view.  Two spellings differ between the engines:
``EACH(a, b)`` yields one row per number, ``JS(x)`` quotes a text as a JSON string.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


VIEWS: dict[str, str] = {}

# One sample per line item: problem, gold answer, answer type.
VIEWS["gold"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
         || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS id,
       l_orderkey + l_linenumber + l_partkey AS n, CAST(floor(l_orderkey / 64) AS BIGINT) AS step,
       'How many units in line ' || CAST(l_linenumber AS STRING) || '?' AS problem,
       CASE (l_orderkey + l_linenumber) % 11
         WHEN 0 THEN CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING)
         WHEN 1 THEN l_returnflag
         WHEN 2 THEN CASE WHEN l_discount > 0.05 THEN 'yes' ELSE 'no' END
         WHEN 3 THEN 'part ' || CAST(l_partkey AS STRING) || ' flag ' || l_linestatus
         WHEN 4 THEN '[' || CAST(l_linenumber AS STRING) || ', 1, ' || CAST(l_linenumber + 10 AS STRING) || ', 11]'
         WHEN 5 THEN l_linestatus
         WHEN 6 THEN CASE WHEN l_suppkey % 2 = 0
                THEN chr(92) || 'frac' || chr(123) || CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) || chr(125) || chr(123) || '4' || chr(125)
                ELSE '(' || CAST(l_linenumber AS STRING) || ', 1/2)' END
         WHEN 7 THEN 'line ' || l_returnflag || l_linestatus
         WHEN 8 THEN '<p class="x">part <b>' || CAST(l_partkey AS STRING) || '</b></p>'
         WHEN 9 THEN '<svg><rect width="' || CAST(l_partkey AS STRING) || '"/></svg>'
         ELSE 'supplier ' || CAST(l_suppkey AS STRING) END AS answer,
       CASE (l_orderkey + l_linenumber) % 11
         WHEN 0 THEN 'about ' || CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) || ' units'
         WHEN 1 THEN '(' || lower(l_returnflag) || ')'
         WHEN 2 THEN 'True, I know'
         WHEN 3 THEN 'Part  ' || CAST(l_partkey AS STRING) || ' flog ' || l_linestatus
         WHEN 4 THEN '[' || CAST(l_linenumber AS STRING) || ', 2.5, ' || CAST(l_linenumber + 12 AS STRING) || ', 9]'
         WHEN 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_quantity / 4 AS STRING)
                ELSE '(' || CAST(l_linenumber AS STRING) || '.0, 0.5)' END
         WHEN 8 THEN '<P class=' || chr(39) || 'x' || chr(39) || '>part  <b>' || CAST(l_partkey AS STRING) || '</b></P><!-- c -->'
         WHEN 9 THEN '<svg><rect width="' || CAST(l_suppkey AS STRING) || '"/><g></g></svg>'
         ELSE lower(l_linestatus) END AS alt,
       CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN 'NUMBER' WHEN 1 THEN 'MULTIPLE_CHOICE' WHEN 2 THEN 'BOOLEAN'
         WHEN 3 THEN 'OCRTEXT' WHEN 4 THEN 'BBOX' WHEN 5 THEN 'ANY' WHEN 6 THEN 'MATH_EXPRESSIONS'
         WHEN 7 THEN 'CRITIC' WHEN 8 THEN 'HTML_CODE' WHEN 9 THEN 'SVG_CODE' ELSE 'FREE_TEXT' END AS answer_type,
       CASE WHEN l_suppkey % 2 = 0 THEN 'thinking' ELSE 'normal' END AS prompt_type,
       CASE WHEN (l_orderkey + l_linenumber) % 11 = 4 THEN 'SPATIAL_REASONING' ELSE 'GENERAL' END AS problem_type
FROM {lineitem}
"""

# Four completions per sample in twelve shapes.
VIEWS["rollouts"] = """
SELECT id, CAST(g AS BIGINT) AS g, n, step, problem, answer, answer_type, prompt_type, problem_type,
       CASE (n + g * 3) % 12
         WHEN 0 THEN '<think>first [1, 1, 11, 11] so' || chr(10) || 'therefore</think>' || chr(10) || '<answer>' || answer || '</answer>'
         WHEN 1 THEN '<think>x</think><answer>wrong 7</answer>'
         WHEN 2 THEN '<think>x</think><answer> ' || answer || 'x </answer>'
         WHEN 3 THEN '<answer>' || upper(answer) || '</answer>'
         WHEN 4 THEN '<think>a</think><think>b</think><answer>no</answer><answer>' || answer || '</answer>'
         WHEN 5 THEN 'The value is ' || chr(92) || 'boxed' || chr(123) || answer || chr(125)
         WHEN 6 THEN ''
         WHEN 7 THEN '<answer>' || answer || '</answer><think>late</think>'
         WHEN 8 THEN '<think>we check since the units are first' || chr(10) || 'counted, therefore</think>So the final answer is below: '
                || chr(92) || 'boxed' || chr(123) || answer || chr(125)
         WHEN 9 THEN '<think>y</think>' || chr(10) || '<answer>' || alt || '</answer>'
         WHEN 10 THEN '<reasoning> because ' || problem || '</reasoning>' || chr(10) || '<answer> ' || answer || ' </answer>' || chr(10)
         ELSE 'Let x = 3 * (4 + 5) and then look at the figure in detail.' || chr(10) || 'The answer is ' || alt || '.'
       END AS completion
FROM (SELECT *, EACH(0, 3) AS g FROM {gold}) t
"""

# User turn with the assistant turn after it.
VIEWS["qa"] = """
SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id, u.turn,
       u.text || CASE WHEN (u.conv_id + u.turn) % 3 = 0 THEN '?' ELSE '' END AS user_text,
       a.text AS assistant_text, CAST((u.conv_id + u.turn) % 5 AS INT) AS n_images
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""

# Chat JSON in good and broken shapes.
VIEWS["chats"] = """
SELECT id, n_images,
       CASE (conv_id + turn) % 13
         WHEN 0 THEN '[' || chr(123) || '"role":'
         WHEN 1 THEN chr(123) || '"role":"user","content":' || u || chr(125)
         WHEN 2 THEN '[' || chr(123) || '"role":"user","content":' || u || chr(125) || ']'
         WHEN 3 THEN '[' || chr(123) || '"role":"user","content":5' || chr(125) || ',' || chr(123) || '"role":"assistant","content":' || a || chr(125) || ']'
         WHEN 4 THEN '[' || chr(123) || '"role":"user","content":' || u || chr(125) || ',' || chr(123) || '"role":"assistant","content":"  "' || chr(125) || ']'
         WHEN 5 THEN '[5,' || chr(123) || '"role":"assistant","content":' || a || chr(125) || ']'
         ELSE '[' || chr(123) || '"role":"user","content":' || u || chr(125) || ',' || chr(123) || '"role":"assistant","content":' || a || chr(125) || ']'
       END AS conversations
FROM (SELECT id, conv_id, turn, n_images, JS(asked) AS u, JS(assistant_text) AS a
      FROM (SELECT *, CASE (conv_id + turn) % 13
              WHEN 6 THEN '< IMAGE tag> ' || user_text || ' <image>'
              WHEN 7 THEN 'Please describe this image: ' || replace(user_text, '?', '.')
              WHEN 8 THEN ' Hi there '
              ELSE user_text END AS asked FROM {qa}) x) t
"""

# Distilled replies in the shapes the reply rules tell apart.
VIEWS["replies"] = """
SELECT id, CAST(conv_id % 7 AS DOUBLE) / 4 AS latency,
       CASE (conv_id * 3 + turn) % 11
         WHEN 0 THEN '<think>' || chr(10) || ' step one ' || chr(10) || user_text || chr(10) || '</think>' || chr(10) || 'Answer: ' || assistant_text
         WHEN 1 THEN '解释: ' || user_text || chr(10) || 'Answer: x'
         WHEN 2 THEN ''
         WHEN 3 THEN NULL
         WHEN 4 THEN 'Answer: only'
         WHEN 5 THEN '<think>根据答案 ' || user_text || '</think>'
         WHEN 6 THEN '<THINK>看起来合理 ' || user_text || '</THINK>'
         WHEN 7 THEN '<think>ok</think>'
         WHEN 8 THEN chr(10) || '思路：look at ' || user_text || chr(10) || 'answer: nope' || chr(10) || '最终答案：z'
         ELSE '<think>' || user_text || '</think>' || chr(10) || '答案： z' END AS reply
FROM {qa}
"""

# A page against the next one, or against a reshaped copy of itself.
VIEWS["markup"] = """
SELECT a.page_id AS id,
       CASE a.page_id % 4 WHEN 0 THEN replace(a.html, '<p>', '<P>')
         WHEN 1 THEN 'see <answer>' || coalesce(b.html, a.html) || '</answer>'
         WHEN 2 THEN 'Here:' || chr(96) || chr(96) || chr(96) || 'html' || chr(10) || replace(a.html, '!DOCTYPE', '!-- x --') || chr(96) || chr(96) || chr(96)
         ELSE coalesce(b.html, a.html) END AS completion,
       a.html AS answer
FROM {pages} a LEFT JOIN {pages} b ON b.page_id = a.page_id + 1
"""

# The same pages as SVG-like markup; every third completion breaks off halfway.
VIEWS["svgs"] = """
SELECT id, CASE id % 3 WHEN 0 THEN substr(mine, 1, CAST(floor(length(mine) / 2) AS INT))
             WHEN 1 THEN '<answer>' || mine || '</answer>' ELSE other END AS completion, mine AS answer
FROM (SELECT a.page_id AS id,
             replace(replace(replace(a.html, '<!DOCTYPE html>', ''), '<html', '<svg'), '</html>', '</svg>') AS mine,
             replace(replace(replace(coalesce(b.html, a.html), '<!DOCTYPE html>', ''), '<html', '<svg'), '</html>', '</svg>') AS other
      FROM {pages} a LEFT JOIN {pages} b ON b.page_id = a.page_id + 1) t
"""

# Free-form multiple-choice answers.
VIEWS["mcq"] = """
SELECT o_orderkey AS id,
       CASE o_orderkey % 16
         WHEN 0 THEN 'The answer is (' || x || ').' WHEN 1 THEN x WHEN 2 THEN x || '.'
         WHEN 3 THEN x || ': because of it' WHEN 4 THEN 'either (' || x || ') or (' || y || ') fits'
         WHEN 5 THEN 'it could be ' || x || ') fits' WHEN 6 THEN 'maybe ' || x || '- or ' || y || '_ here'
         WHEN 7 THEN 'take ' || CAST(1 + o_custkey % 8 AS STRING) || '. ' || x || ' now'
         WHEN 8 THEN 'my choice is clear: ' || x || ' not ' || y || ' at all' WHEN 9 THEN 'none of them' WHEN 10 THEN ''
         WHEN 11 THEN 'so it is ' || x WHEN 12 THEN 'option ' || x || '= or ' || y || ' ok'
         WHEN 13 THEN 'see ' || x || ' and ' || y || ' both, ok?' WHEN 14 THEN ' "' || y || '" ' ELSE 'w' || x || 'y' || y || 'z' END AS pred,
       CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE x END AS gold
FROM (SELECT *, chr(CAST(65 + o_custkey % 8 AS INT)) AS x, chr(CAST(65 + o_orderkey % 8 AS INT)) AS y FROM {orders}) t
"""

# Long completions from whole documents.
VIEWS["essays"] = """
SELECT doc_id AS id, 'what is the ' || lang || ' ' || source || ' text about' AS prompt, lang AS answer,
       CASE WHEN doc_id % 2 = 0 THEN 'thinking' ELSE 'normal' END AS prompt_type,
       CASE doc_id % 8
         WHEN 0 THEN 'Reasoning: ' || text || chr(10) || 'Answer: ' || lang
         WHEN 1 THEN '<think>' || text || ' first, therefore check</think>' || chr(10) || chr(10) || chr(10) || chr(10) || 'reasoning：' || lang || chr(10) || ' ANSWER ： ' || source
         WHEN 2 THEN 'Reasoning: N/A' || chr(13) || chr(10) || 'Answer:' || text
         WHEN 3 THEN text
         WHEN 4 THEN '<think>' || text || '</think><answer> ' || lang || ' </answer>'
         WHEN 5 THEN text || chr(10) || 'The answer is: ' || lang
         WHEN 6 THEN '<think>short</think>' || text || chr(10) || 'value 42'
         ELSE text || chr(10) || 'the choice is (B)' END AS completion
FROM {documents}
"""

# Judge requests with many duplicates.
VIEWS["requests"] = """
SELECT event_id AS request_id, CAST(ts AS TIMESTAMP) AS ts, 'user ' || CAST(user_id % 20 AS STRING) AS prompt,
       event_type || ' ' || CAST(CAST(floor(value) AS BIGINT) % 10 AS STRING) AS completion,
       CASE WHEN event_id % 9 = 4 THEN NULL ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS answer, 'ANY' AS answer_type
FROM {events}
"""

# Scored candidates per group; equal scores occur.
VIEWS["cands"] = """
SELECT user_id AS grp, event_id AS cand, floor(value * 2) / 40 AS score, event_type FROM {events}
"""

# Samples with code answers, tests and recorded outputs.
VIEWS["codes"] = """
SELECT o_orderkey AS id, o_orderkey % 7 AS k,
       chr(123) || '"tests":[' || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE
         chr(123) || '"input":"' || CAST(o_custkey AS STRING) || '","output":"' || CAST(o_custkey * 2 AS STRING) || '"' || chr(125) || ',' ||
         chr(123) || '"input":"' || o_orderstatus || '","output":' || CAST(o_custkey AS STRING) || chr(125) END || ']' ||
         CASE WHEN o_orderkey % 11 = 3 THEN '' ELSE chr(125) END AS answer,
       CASE o_orderkey % 7
         WHEN 0 THEN 'no tags'
         WHEN 1 THEN '<answer>' || chr(96) || chr(96) || chr(96) || 'python' || chr(10) || 'def solution(x): return x' || chr(10) || chr(96) || chr(96) || chr(96) || ' done</answer>'
         WHEN 2 THEN '<answer>' || chr(96) || chr(96) || chr(96) || 'python' || chr(10) || 'def solution(x): return x * 2</answer>'
         WHEN 3 THEN '<answer>import OS; os.remove(x); open(x)</answer>'
         ELSE '<answer> def solution(x): return x + x </answer>' END AS completion
FROM {orders}
"""

VIEWS["outputs"] = """
SELECT id, CAST(test AS INT) AS test, CASE WHEN id % 17 = 5 THEN 1 ELSE 0 END AS return_code,
       CASE WHEN test = 0 THEN ' ' || CAST(o_custkey * 2 AS STRING) || chr(10)
            WHEN id % 3 = 0 THEN 'bad' ELSE CAST(o_custkey AS STRING) END AS stdout
FROM (SELECT o_orderkey AS id, o_custkey, EACH(0, 1) AS test FROM {orders}) t
"""

# Judge replies: good, embedded, broken.
VIEWS["verdicts"] = """
SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'thinking' ELSE 'normal' END AS prompt_type,
       CASE event_id % 8
         WHEN 0 THEN chr(123) || '"reasoning": ' || v || ', "answer": 0.5, "total_score": ' || v || ', "explanation": "' || event_type || '"' || chr(125)
         WHEN 1 THEN 'Sure: ' || chr(123) || '"reasoning": "0.25", "answer": ' || v || chr(125) || ' ok'
         WHEN 2 THEN '' WHEN 3 THEN 'score ' || v || ' of 1.0' WHEN 4 THEN '[1, 2]' WHEN 5 THEN ' 1 '
         WHEN 6 THEN chr(123) || '"answer": null, "answer_score": 0.75, "reasoning_score": 0.5, "format_score": 1.0, "confidence": 0.9' || chr(125)
         ELSE chr(123) || broken END AS reply
FROM (SELECT event_id, event_type, CAST(floor(value) / 64 AS STRING) AS v, event_type || ' broken' AS broken FROM {events}) t
"""

# Judge replies with nested detail scores.
VIEWS["details"] = """
SELECT event_id AS id, event_id % 5 AS k, v,
       CASE event_id % 5
         WHEN 0 THEN '{"score": ' || v || ', "explanation": "' || event_type || '", "detailed_scores": {"format": 0.5, "accuracy": 0.25, "reasoning": ' || v || '}, "confidence": 0.9}'
         WHEN 1 THEN '{"score": ' || v || ', "detailed_scores": {"format": 1}}'
         WHEN 2 THEN '{"score": ' || v || ', "detailed_scores": null}'
         WHEN 3 THEN '{"explanation": "no score"}' ELSE 'score: ' || v END AS reply
FROM (SELECT event_id, event_type, CAST(floor(value) / 64 AS STRING) AS v FROM {events}) t
"""

# Chats with system, tool and reasoning turns.
VIEWS["dialogs"] = """
SELECT id, shape, user_text, assistant_text, CASE shape
  WHEN 0 THEN '[{"role":"user","content":' || u || '},{"role":"assistant","content":' || a || '}]'
  WHEN 1 THEN '[{"role":"system","content":"be kind <image>"},{"role":"user","content":' || i || '},{"role":"assistant","content":' || th || '}]'
  WHEN 2 THEN '[{"role":"user","content":' || u || '},{"role":"assistant","content":' || a || '},{"role":"tool","content":"r1"},'
    || '{"role":"tool","content":"r2"},{"role":"assistant","reasoning_content":"why","content":' || a || '}]'
  WHEN 3 THEN '[{"role":"system","content":"sys","functions":[{"name":"f1"},{"name":"f2"}]},{"role":"user","content":' || u
    || '},{"role":"assistant","content":"","tool_calls":[{"name":"f1","arguments":"7"},{"function":{"name":"f2","arguments":{"b":2}}}]}]'
  ELSE '[{"role":"user","content":' || u || ',"tools":"x"},{"role":"assistant","content":' || a || '}]' END AS conversations
FROM (SELECT id, shape, user_text, assistant_text, JS(user_text) AS u, JS(assistant_text) AS a, JS(imaged) AS i, JS(thought) AS th
      FROM (SELECT *, (conv_id + turn) % 5 AS shape, '<image> ' || user_text AS imaged,
              '<think>' || chr(10) || user_text || chr(10) || '</think>' || chr(10) || chr(10) || assistant_text AS thought FROM {qa}) x) t
"""

# Texts that become token arrays of code points: two answers between markers, the second one open.
VIEWS["spoken"] = """
SELECT id, CAST(floor(id / 4000) AS BIGINT) AS batch, user_text, assistant_text,
       'u ' || user_text || '<a>' || assistant_text || '</a> v <a><a>' || user_text || CASE WHEN id % 2 = 0 THEN '</a> w' ELSE '' END AS t
FROM {qa}
"""

# Log-probabilities of a policy and a reference over 64 tokens, with mask and advantage.
VIEWS["logps"] = """
SELECT a.vec_id AS id, a.label AS grp, a.embedding AS pi, b.embedding AS ref, a.label % 3 - 0.5 AS advantage
FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id
"""

_REF = re.compile(r"\{(\w+)\}")
_EACH = re.compile(r"EACH\((\d+), (\d+)\)")
_JS = re.compile(r"JS\((\w+)\)")


def _spark_text(sql: str) -> str:
    # Braces other than references are doubled, as the SQL formatter asks.
    bits = re.split(r"(\{\w+\})", sql)
    sql = "".join(b if _REF.fullmatch(b) else b.replace("{", "{{").replace("}", "}}") for b in bits)
    sql = _EACH.sub(r"explode(sequence(\1, \2))", sql)
    return _JS.sub(r"substr(to_json(array(\1)), 2, length(to_json(array(\1))) - 2)", sql)


def _duck_text(sql: str) -> str:
    sql = _EACH.sub(r"unnest(generate_series(\1, \2))", sql)
    sql = _JS.sub(r"CAST(to_json(\1) AS VARCHAR)", sql)
    return _REF.sub(r"\1", sql).strip()


class Tables:
    """Driver tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(VIEWS[name])

    def sql(self, sql: str) -> DataFrame:
        return self.spark.sql(_spark_text(sql), **{ref: self(ref) for ref in set(_REF.findall(sql))})


def with_views(sql: str) -> str:
    """SQL for DuckDB: the query with the views it names as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(" ".join(r for r in _REF.findall(body)))
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = [f"{name} AS (\n{_duck_text(VIEWS[name])}\n)" for name in needed]
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
