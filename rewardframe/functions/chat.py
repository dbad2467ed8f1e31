"""Conversation parsing, image columns, chat rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import stable_percent
from .prompts import (
    EMPTY_THINK, FORMAT_INSTRUCTION, IM_END, IM_START, IMAGE_PAD, SYSTEM_PROMPTS, TOOLS_FOOT, TOOLS_HEAD,
)
from .text import has_any, last_of, let, lstrip, rstrip, strip, strip_chars, swap, text

# The turn schema, image tags and caption hints.
CALL_SCHEMA = "array<struct<name:string,arguments:string,function:struct<name:string,arguments:string>>>"
TURN_FIELDS = {
    "role": "string", "content": "string", "from": "string", "value": "string",
    "reasoning_content": "string", "tools": "string", "functions": "string", "tool_calls": CALL_SCHEMA,
}
TURN_SCHEMA = "array<struct<" + ",".join(f"`{k}`:{v}" for k, v in TURN_FIELDS.items()) + ">>"
IMAGE_TAG = r"(?i)<\s*image[^>]*>"
CAPTION_HINTS = (
    "描述这张图片", "描述图片", "请描述", "image caption", "describe this image", "caption",
)
MAGIC_MIME = (("89504E47", "image/png"), ("FFD8", "image/jpeg"), ("474946383761", "image/gif"),
              ("474946383961", "image/gif"))
DEFAULT_MIME = "image/jpeg"
MIN_IMAGE_BYTES = 100


def _string_field(doc: Column, path: str) -> Column:
    """String at a path of a variant; empty for a missing or non-string value."""
    v = F.try_variant_get(doc, path, "variant")
    return F.when(
        F.schema_of_variant(v) == "STRING", F.try_variant_get(doc, path, "string")
    ).otherwise(F.lit(""))


def conversation(c: Column) -> Column:
    """Struct (user, assistant, state) from the first two items of a chat JSON list.

    State is ``json_error``, ``non_standard`` (not a list of two), ``empty_text`` or ``ok``; the
    texts are null unless the state is ``ok``.
    """
    n = F.coalesce(F.json_array_length(c), F.lit(0))

    def parts(doc: Column) -> Column:
        return F.struct(
            doc.isNull().alias("bad"), _string_field(doc, "$[0].content").alias("user"),
            _string_field(doc, "$[1].content").alias("assistant"),
        )

    def judged(p: Column) -> Column:
        blank = (strip(p["user"]) == "") | (strip(p["assistant"]) == "")
        state = (
            F.when(p["bad"], F.lit("json_error")).when(n < 2, F.lit("non_standard"))
            .when(blank, F.lit("empty_text")).otherwise(F.lit("ok"))
        )
        return F.struct(p["user"].alias("user"), p["assistant"].alias("assistant"), state.alias("state"))

    def finished(p: Column) -> Column:
        ok = p["state"] == "ok"
        return F.struct(
            F.when(ok, p["user"]).alias("user"), F.when(ok, p["assistant"]).alias("assistant"),
            p["state"].alias("state"),
        )

    return let(let(let(F.try_parse_json(c), parts), judged), finished)


def chat_turns(c: Column) -> Column:
    """Turns of a chat JSON list as an array of structs; null when the text is not a list."""
    return F.when(F.json_array_length(c).isNotNull(), F.from_json(c, TURN_SCHEMA))


def as_image_list(c: Column, is_array: bool) -> Column:
    """Image bytes as a list, whether the column holds one image or many."""
    return c if is_array else F.when(c.isNotNull(), F.array(c))


def real_images(images: Column) -> Column:
    return F.filter(images, lambda b: F.length(b) > 0)


def image_lengths(images: Column) -> Column:
    return F.transform(images, F.length)


def image_state(images: Column) -> Column:
    return image_state_of(image_lengths(images))


def image_state_of(lengths: Column) -> Column:
    """Image state from the images' lengths alone."""
    n = F.coalesce(F.size(F.filter(lengths, lambda n: n > 0)), F.lit(0))
    return (
        F.when(n <= 0, F.lit("no_image_bytes")).when(n == 1, F.lit("single")).otherwise(F.lit("multi"))
    )


def mime_type(img: Column) -> Column:
    """MIME type from magic bytes, jpeg when unknown."""
    head = F.substring(img, 1, 16)
    out = F.lit(DEFAULT_MIME)
    webp = (F.substring(img, 1, 4) == F.encode(F.lit("RIFF"), "utf-8")) & F.contains(
        head, F.encode(F.lit("WEBP"), "utf-8")
    )
    out = F.when(webp, F.lit("image/webp")).otherwise(out)
    for magic, mime in reversed(MAGIC_MIME):
        out = F.when(F.substring(img, 1, len(magic) // 2) == F.unhex(F.lit(magic)), F.lit(mime)).otherwise(out)
    return out


def data_url(img: Column, mime: Column | None = None) -> Column:
    """Base64 data URL on one line."""
    body = F.regexp_replace(F.base64(img), r"[\r\n]", "")
    return F.concat(F.lit("data:"), mime_type(img) if mime is None else mime, F.lit(";base64,"), body)


def checked_data_url(img: Column, mime: str = DEFAULT_MIME) -> Column:
    """Data URL of a given type; null for images too small to be valid."""
    return F.when(F.length(img) >= MIN_IMAGE_BYTES, data_url(img, F.lit(mime)))


def is_question(c: Column) -> Column:
    return has_any(c, ("?", "？"))


def normal_user(c: Column) -> Column:
    """User text with image tags dropped and one image line in front."""
    return F.concat(F.lit("<image>\n"), strip(F.regexp_replace(text(c), IMAGE_TAG, "")))


def question_text(normal: Column) -> Column:
    """The question behind the image line of :func:`normal_user`."""
    return strip(F.substring(normal, F.lit(len("<image>") + 1), F.length(normal)))


def looks_like_caption(c: Column) -> Column:
    return let(
        F.lower(strip(text(c))),
        lambda low: (low == "") | (~is_question(low) & has_any(low, CAPTION_HINTS)),
    )


def worth_asking(c: Column, min_len: int = 15) -> Column:
    """A question, or longer than ``min_len``."""
    return let(c, lambda q: is_question(q) | (F.length(q) > min_len))


def with_system_prompt(
    turns: Column, sample_id: Column, name: str, ratio: float = 0.2, seed: str = "system"
) -> Column:
    """Turns with a system prompt in front for a stable share of the samples.

    Chats that start with a system turn or carry tools stay as they are.  The coin and the prompt
    choice are hashes of the sample id, so reruns and repartitioning give the same chats.
    """
    prompts = F.array(*[F.lit(p.replace("{name}", name)) for p in SYSTEM_PROMPTS])
    pick = F.get(prompts, stable_percent(f"{seed}-pick", sample_id) % len(SYSTEM_PROMPTS))
    given = {"role": F.lit("system"), "content": pick}
    first = F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in TURN_FIELDS.items()])
    bare = (F.get(turns, F.lit(0))["role"] != "system") & ~F.exists(
        turns, lambda t: F.coalesce(t["tools"], F.lit("")) != ""
    )
    coin = stable_percent(seed, sample_id) < int(ratio * 10000)
    return F.when(coin & bare, F.concat(F.array(first), turns)).otherwise(turns)


def with_image_pads(turns: Column, pads: int = 64) -> Column:
    """Image marks of non-system turns replaced by a run of pad tokens."""
    run = IMAGE_PAD * pads
    return F.transform(
        turns,
        lambda t: t.withField(
            "content", F.when(t["role"] != "system", swap(t["content"], "<image>", run)).otherwise(t["content"])
        ),
    )


def chat_tools(turns: Column) -> Column:
    """Tool definitions (JSON text) of a leading system turn, else null."""
    first = F.get(turns, F.lit(0))
    return F.when((first["role"] == "system") & (first["functions"] != ""), first["functions"])


def _assistant(t: Column) -> Column:
    raw = text(t["content"])
    split = t["reasoning_content"].isNull() & raw.contains("</think>")
    before = rstrip(F.substring_index(raw, "</think>", 1), "\n")
    inner = lstrip(F.substring_index(before, "<think>", -1), "\n")
    reasoning = F.coalesce(t["reasoning_content"], F.when(split, inner), F.lit(""))
    content = F.when(split, lstrip(F.substring_index(raw, "</think>", -1), "\n")).otherwise(raw)

    def call(x: Column, i: Column) -> Column:
        name = F.coalesce(x["function"]["name"], x["name"])
        args = F.coalesce(x["function"]["arguments"], x["arguments"])
        gap = F.when((i > 0) | (content != ""), F.lit("\n")).otherwise(F.lit(""))
        return F.concat(
            gap, F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}\n</tool_call>")
        )

    calls = F.coalesce(F.array_join(F.transform(t["tool_calls"], call), ""), F.lit(""))
    return F.concat(
        F.lit(f"{IM_START}assistant\n<think>\n"), strip_chars(reasoning, "\n"), F.lit("\n</think>\n\n"),
        lstrip(content, "\n"), calls, F.lit(f"{IM_END}\n"),
    )


def render_chat(
    turns: Column, tools: Column | None = None,
    generation_prompt: bool = False, open_thinking: bool = False,
) -> Column:
    """Chat text of an array of turns.

    Assistant turns always carry a think block, neighbouring tool turns share one user turn, and
    tool definitions go into the system header.
    """
    return let(turns, lambda v: _chat_text(v, tools, generation_prompt, open_thinking))


def _chat_text(
    turns: Column, tools: Column | None, generation_prompt: bool, open_thinking: bool
) -> Column:
    first = F.get(turns, F.lit(0))
    leads = first["role"] == "system"

    def turn(t: Column, i: Column) -> Column:
        body = text(t["content"])
        prev, nxt = F.get(turns, i - 1)["role"], F.get(turns, i + 1)["role"]
        opens = F.when((i == 0) | (prev != "tool"), F.lit(f"{IM_START}user")).otherwise(F.lit(""))
        closes = F.when(nxt.isNull() | (nxt != "tool"), F.lit(f"{IM_END}\n")).otherwise(F.lit(""))
        return (
            F.when(
                (t["role"] == "user") | ((t["role"] == "system") & (i > 0)),
                F.concat(F.lit(IM_START), t["role"], F.lit("\n"), body, F.lit(f"{IM_END}\n")),
            )
            .when(t["role"] == "assistant", _assistant(t))
            .when(
                t["role"] == "tool",
                F.concat(opens, F.lit("\n<tool_response>\n"), body, F.lit("\n</tool_response>"), closes),
            )
            .otherwise(F.lit(""))
        )

    plain = F.when(
        leads, F.concat(F.lit(f"{IM_START}system\n"), text(first["content"]), F.lit(f"{IM_END}\n"))
    ).otherwise(F.lit(""))
    if tools is None:
        head = plain
    else:
        listed = F.array_join(
            F.transform(F.from_json(tools, "array<string>"), lambda x: F.concat(F.lit("\n"), x)), ""
        )
        intro = F.when(leads, F.concat(text(first["content"]), F.lit("\n\n"))).otherwise(F.lit(""))
        with_tools = F.concat(
            F.lit(f"{IM_START}system\n"), intro, F.lit(TOOLS_HEAD), listed, F.lit(TOOLS_FOOT)
        )
        head = F.when(tools.isNotNull(), with_tools).otherwise(plain)
    out = F.concat(head, F.array_join(F.transform(turns, turn), ""))
    if generation_prompt:
        think = "<think>\n" if open_thinking else EMPTY_THINK
        out = F.concat(out, F.lit(f"{IM_START}assistant\n{think}"))
    return out


def without_empty_think(c: Column, sample_id: Column, keep_ratio: float = 0.2, seed: str = "think") -> Column:
    """Empty think blocks dropped, except for a stable share of the samples."""
    drop = stable_percent(seed, sample_id) >= int(keep_ratio * 10000)
    return F.when(drop, swap(c, EMPTY_THINK, "")).otherwise(c)


def rl_prompt(problem: Column, pads: int = 64, with_format: bool = True) -> Column:
    """User-only chat prompt of a problem, ready for generation."""
    body = strip(swap(text(problem), "<image>", IMAGE_PAD * pads))
    tail = FORMAT_INSTRUCTION if with_format else ""
    return F.concat(
        F.lit(f"{IM_START}user\n"), body, F.lit(f"{tail}{IM_END}\n{IM_START}assistant\n{EMPTY_THINK}")
    )


def last_turn_text(turns: Column, role: str, alias: str) -> Column:
    """Content of the last turn of a role, under either key style; null when there is none."""
    hit = last_of(F.filter(turns, lambda t: (t["role"] == role) | (t["from"] == alias)))
    return F.coalesce(F.when(hit["content"] != "", hit["content"]), hit["value"])


def eval_fields(turns: Column, prompt: Column | None = None, gold: Column | None = None) -> Column:
    """Struct (prompt, gt): given columns, else the last user and last assistant turn.

    A gold column that is given but empty stays empty; only an absent one is looked up.
    """
    asked = last_turn_text(turns, "user", "human")
    given = prompt if prompt is not None else F.lit(None).cast("string")
    p = F.when(strip(text(given)) != "", given).otherwise(F.coalesce(asked, given, F.lit("")))
    g = gold if gold is not None else last_turn_text(turns, "assistant", "gpt")
    return F.struct(p.cast("string").alias("prompt"), g.cast("string").alias("gt"))
