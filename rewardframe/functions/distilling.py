"""Rules on distilled replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, clean_lines, first_match, json_quote, strip, text

# Reply patterns and banned wording.
THINK_BODY = r"(?is)<think>(.*?)</think>"
ANSWER_LABEL = r"(?i)(?:\A|\n)" + WS + "*(?:Answer|答案|最终答案)" + WS + "*[:：]"
LABEL_PREFIX = r"(?i)\A" + WS + "*(?:解释|原因分析|推理过程|思考过程|思路|分析过程)" + WS + "*[:：]" + WS + "*"
ANSWER_LINE = r"(?i)\A(?:answer|答案)" + WS + "*[:：]"
ANSWER_FOCUSED = "参考答案|标准答案|上文答案|该答案|根据答案|答案中提到"
EVAL_STYLE = "合理|正确|符合"


def think_lines(reply: Column) -> Column:
    """Reasoning lines of a reply: its think block, else the text before the answer label."""
    txt = strip(text(reply))
    at = F.regexp_instr(txt, F.lit(ANSWER_LABEL))
    before = F.when(at > 0, F.substring(txt, F.lit(1), at - 1)).otherwise(txt)
    plain = F.regexp_replace(strip(before), LABEL_PREFIX, "")
    body = F.coalesce(first_match(txt, THINK_BODY), plain)
    return F.filter(clean_lines(body), lambda ln: ~ln.rlike(ANSWER_LINE))


def distilled_text(kept_lines: Column, answer: Column) -> Column:
    """Think block and answer line of a distilled sample; null without reasoning or answer."""
    ans = strip(text(answer))
    whole = F.concat(
        F.lit("<think>\n"), F.array_join(kept_lines, "\n"), F.lit("\n</think>\n\nAnswer: "), ans
    )
    return F.when((F.size(kept_lines) > 0) & (ans != ""), whole)


def explanation_lines(distilled: Column) -> Column:
    return clean_lines(F.coalesce(first_match(distilled, THINK_BODY), F.lit("")))


def answer_too_long(pred: Column, ref: Column, ratio: float) -> Column:
    """Longer than ``ratio`` times the reference; a ratio of zero or less turns the rule off."""
    if ratio <= 0:
        return F.lit(False)
    p, r = strip(text(pred)), strip(text(ref))
    limit = F.greatest(F.lit(1), F.floor(F.length(r) * ratio))
    return (p != "") & (r != "") & (F.length(p) > limit)


def similarity_text(c: Column) -> Column:
    """Lower-case digits, Latin letters and CJK only."""
    return F.regexp_replace(F.lower(text(c)), r"[^0-9a-z\x{4e00}-\x{9fff}]", "")


def same_text_similarity(a: Column, b: Column) -> Column:
    """Similarity where the answer is carried over from the reference: equal non-empty texts are 1."""
    na, nb = similarity_text(a), similarity_text(b)
    return F.when((na != "") & (na == nb), 1.0).otherwise(0.0)


def chat_json(user: Column, assistant: Column) -> Column:
    """Two-turn chat as JSON text, non-ASCII kept, a blank after every comma and colon."""
    return F.concat(
        F.lit('[{"role": "user", "content": '), json_quote(user),
        F.lit('}, {"role": "assistant", "content": '), json_quote(assistant), F.lit("}]"),
    )
