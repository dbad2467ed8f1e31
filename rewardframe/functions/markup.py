"""Similarity of generated and reference HTML or SVG, and repair of cut-off SVG."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import last_answer
from .text import WORD, all_matches, both, has_any, last_match, let, strip, swap, text

# Token, tag and code-block patterns.
HTML_TOKEN = WORD + r'+|[<>=/"]'
SVG_TOKEN = WORD + r'+|[<>=/"]|#[0-9a-fA-F]+'
HTML_TAG = "<(/?" + WORD + "+)"
SVG_TAG = r"<([a-zA-Z]+)[^>]*>"
HTML_DOCUMENT = r"(?is)(?:<!DOCTYPE html>|<html>).*?(?:</html>|\z)"
SVG_DOCUMENT = r"(?is)<svg[^>]*>.*?</svg>"
HTML_FENCE = r"(?s)```(?:html)?\s*(.*?)```"
SVG_FENCE = r"(?s)```(?:svg|xml)?\s*(.*?)```"
CLOSE_TAG = r"</([a-zA-Z]+)>"


def html_code(completion: Column, body: Column | None = None) -> Column:
    """Markup of a completion: last answer body, last document, last fenced block, or all of it.

    ``body`` is the last answer body where a caller has it already.
    """
    c = text(completion)
    body = last_answer(c) if body is None else body
    opened = F.lower(c).contains("html>")
    return strip(F.coalesce(
        body, F.when(opened, last_match(c, HTML_DOCUMENT, 0)), F.when(c.contains("```"), last_match(c, HTML_FENCE, 1)), c
    ))


def svg_code(completion: Column, body: Column | None = None) -> Column:
    """As :func:`html_code`; answer bodies and fenced blocks count only when they hold an svg tag."""
    c = text(completion)
    body = last_answer(c) if body is None else body
    fenced = F.when(c.contains("```"), last_match(c, SVG_FENCE, 1))
    return strip(F.coalesce(
        F.when(F.lower(body).contains("<svg"), body),
        F.when(F.lower(c).contains("</svg>"), last_match(c, SVG_DOCUMENT, 0)),
        F.when(F.lower(fenced).contains("<svg"), fenced),
        c,
    ))


def normalized(markup: Column) -> Column:
    """One space per whitespace run, single quotes, no comments, lower case."""
    flat = swap(F.regexp_replace(markup, r"\s+", " "), '"', "'")
    return F.lower(strip(F.regexp_replace(flat, r"(?s)<!--.*?-->", "")))


def normalized_read(markup: Column) -> Column:
    """As :func:`normalized`, for a column that is only read: each pattern runs where it has something to find."""
    runs = has_any(markup, ("  ", "\n", "\t", "\r", "\x0b", "\x0c"))
    noted = markup.contains("<!--") | runs
    return F.when(noted, normalized(markup)).otherwise(F.lower(strip(swap(markup, '"', "'"))))


def overlap(a: Column, b: Column, pattern: str, group: int) -> Column:
    """Jaccard index of the distinct pattern matches; 0.0 for an empty reference ``b``."""

    def index(sets: Column) -> Column:
        mine, theirs = F.get(sets, F.lit(0)), F.get(sets, F.lit(1))
        joint = F.size(F.array_intersect(mine, theirs)) / F.size(F.array_union(mine, theirs))
        return F.when(F.size(theirs) > 0, joint).otherwise(F.lit(0.0))

    return let(both(a, b, lambda c: all_matches(F.lower(c), pattern, group)), index)


def same_markup(made: Column, ref: Column) -> Column:
    return (made == ref) | (normalized_read(made) == normalized_read(ref))


def html_score(code: Column, gold: Column) -> Column:
    """1.0 for equal normalised markup, else 0.6 token overlap + 0.4 tag overlap."""
    return let(F.struct(code.alias("made"), strip(gold).alias("ref")), lambda x: html_score_of(x["made"], x["ref"]))


def html_score_of(made: Column, ref: Column) -> Column:
    """As :func:`html_score`, given the stripped texts as columns that are only read."""
    mixed = 0.6 * overlap(made, ref, HTML_TOKEN, 0) + 0.4 * overlap(made, ref, HTML_TAG, 1)
    return F.when(same_markup(made, ref), F.lit(1.0)).otherwise(mixed)


def svg_score(code: Column, gold: Column, image: Column | None = None) -> Column:
    """1.0 for equal normalised markup, else token, tag and (optional) picture similarity.

    ``image`` is a similarity column computed elsewhere; without it the term counts zero.
    """
    picture = F.coalesce(image, F.lit(0.0)) if image is not None else F.lit(0.0)
    return let(
        F.struct(code.alias("made"), strip(gold).alias("ref")), lambda x: svg_score_of(x["made"], x["ref"], picture)
    )


def svg_score_of(made: Column, ref: Column, picture: Column | float = 0.0) -> Column:
    """As :func:`svg_score`, given the stripped texts as columns that are only read."""
    mixed = 0.5 * picture + 0.25 * (overlap(made, ref, SVG_TOKEN, 0) + overlap(made, ref, SVG_TAG, 1))
    return (
        F.when(~F.lower(made).contains("<svg"), F.lit(0.0))
        .when(same_markup(made, ref), F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)))
    )


def repaired_svg(svg: Column) -> Column:
    """Cut-off tag removed, open tags closed last-seen first, a closing svg tag ensured."""

    def closing(x: Column) -> Column:
        def missing(tag: Column) -> Column:
            surplus = F.size(F.filter(x["opened"], lambda t: t == tag)) - F.size(
                F.filter(x["closed"], lambda t: t == tag)
            )
            return F.array_repeat(F.concat(F.lit("</"), tag, F.lit(">")), F.greatest(surplus, F.lit(0)))

        tail = F.reverse(F.flatten(F.transform(F.array_distinct(x["opened"]), missing)))
        return F.concat(x["whole"], F.array_join(tail, ""))

    def tags(whole: Column) -> Column:
        return let(
            F.struct(
                whole.alias("whole"), all_matches(whole, SVG_TAG, 1).alias("opened"),
                all_matches(whole, CLOSE_TAG, 1).alias("closed"),
            ),
            closing,
        )

    fixed = let(
        let(F.regexp_replace(svg, r"<[^>]*\z", ""), tags),
        lambda f: F.when(strip(f).endswith("</svg>"), f).otherwise(F.concat(f, F.lit("</svg>"))),
    )
    return F.when(strip(svg) == "", svg).otherwise(fixed)
