"""Spelling variants of words, by permuterm rotations.

Every word gets a terminator; all rotations of the marked word are sorted.  Two words that differ in one
replaced code point have rotations that end in that code point and are alike before it.  A word and the
word with one code point more have them too: the whole rotation of the shorter one is the longer one's
up to the added code point.  So both are prefix ranges that skip the edited character, and after the
sort they are groups of rows with one key.

A group holds at most one word for each character that can be skipped, and one whole rotation, so groups
are bounded by the alphabet.  A scan of a group emits one row per member: how many neighbours it has there
and the most frequent of them.  No pairs are written.  Two words meet in one group only: the place of a
replaced character is fixed, and a character added to a run of equal ones counts at the head of the run.

Defined cases: a null or empty text has no words; the id of a null document is spelled "null"; repeated rows
count each; ties of the best neighbour go to the smallest word in code-point order; words without
neighbours have n_near 0 and are their own root; an empty table gives an empty result; further columns are left
alone.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle, sorted_side, tidy

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST = 6  # code points of a word
OCCURRENCES = 5
TYPO = 199  # one of so many (document, run) is misspelled
FACTOR = 5  # a form is so many times as frequent as its variant
END = "$"  # terminator: not in any word


def word_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: str = RUN, least: int = LEAST,
    occurrences: int = OCCURRENCES, typo: int = TYPO,
) -> DataFrame:
    """(word, n) of the words with at least ``least`` code points and ``occurrences`` occurrences."""
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(run.removesuffix("+") + f"{{{least},}}"), F.lit(0))).alias("run"),
    )
    low = ascii_lower(F.col("run"))
    h = F.crc32(F.concat("id", F.lit(":"), low).cast("binary"))
    at = (F.col("h") % F.length("low")).cast("int")
    shorter = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.length("low")))
    words = runs.select(low.alias("low"), h.alias("h")).select(F.when(F.col("h") % typo == 0, shorter).otherwise(F.col("low")).alias("word"))
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def rotations(words: DataFrame) -> DataFrame:
    """Rows (key, word, n, whole, head) of all rotations of the marked words.

    ``whole``: the key is the whole rotation; else its last character is skipped, and ``head`` tells
    whether that is the first of a run of equal characters.
    """
    size = F.length("word")
    marked = words.select("word", "n", F.concat("word", F.lit(END)).alias("marked"), F.explode(F.sequence(F.lit(0), size)).alias("at"))
    # The rotation that begins after ``at`` characters ends in the character ``at`` (from 1); 0 is the marked word itself.
    turned = F.concat(F.substring("marked", F.col("at") + 1, size + 1), F.substring("marked", F.lit(1), F.col("at")))
    last, before = F.substring("marked", F.col("at"), F.lit(1)), F.substring("marked", F.col("at") - 1, F.lit(1))
    head = (F.col("at") == 1) | (last != before)
    whole = F.struct(F.col("turned").alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("head"))
    part = F.struct(F.substring("turned", F.lit(1), size).alias("key"), F.lit(False).alias("whole"), F.col("head"))
    keys = F.when(F.col("at") == 0, F.array(whole)).otherwise(F.array(whole, part))
    return marked.withColumn("turned", turned).withColumn("head", head).select("word", "n", F.explode(keys).alias("k")).select("k.key", "word", "n", "k.whole", "k.head")


def neighbours(words: DataFrame) -> DataFrame:
    """Rows (word, near, best) of each group of rotations: how many neighbours, and the best of them.

    ``best`` is (-n, word), so that the smallest is the most frequent.
    """
    best = lambda members, unlike: F.array_min(F.transform(F.filter(members, unlike), lambda m: F.struct((-m["n"]).alias("rank"), m["word"].alias("word"))))
    count = lambda members, like: F.size(F.filter(members, like)).cast("bigint")
    members = F.col("members")
    near = lambda m: (lambda o: (o["word"] != m["word"]) & F.when(m["whole"], o["head"]).otherwise(~o["whole"] | m["head"]))
    ordered = rotations(words).repartitionByRange("key").sortWithinPartitions("key")
    groups = (
        ordered.groupBy("key").agg(F.collect_list(F.struct("word", "n", "whole", "head")).alias("members"))
        .filter(F.size("members") > 1)
    )
    rows = groups.select(F.explode(F.transform(members, lambda m: F.struct(
        m["word"].alias("word"), count(members, near(m)).alias("near"), best(members, near(m)).alias("best"),
    ))).alias("r"))
    return rows.select("r.*").filter("near > 0")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last of the forms that follow from a word.

    Each round joins the table with itself and so doubles the steps; a form is ``FACTOR`` times as
    frequent as its word, so chains, and rounds, are few.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = settle(now.join(after, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if now.filter("moved").limit(1).count() == 0:
            return now.select("word", "root")
        now = now.select("word", "root")


@tidy
def group_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: str = RUN, least: int = LEAST,
    occurrences: int = OCCURRENCES, typo: int = TYPO, factor: int = FACTOR,
) -> DataFrame:
    """One row per word: word, n, n_near (words one edit away), form (the most frequent of them if it
    is ``factor`` times as frequent, else null), form_n, root (the form of the form and so on)."""
    words = settle(word_counts(docs, doc_id, text, run, least, occurrences, typo))
    met = neighbours(words).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    form_n = -F.col("best.rank")
    found = words.join(met, "word", "left").withColumn("ok", F.coalesce(form_n >= factor * F.col("n"), F.lit(False)))
    only: functools.partial[Column] = functools.partial(F.when, F.col("ok"))
    found = settle(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        only(F.col("best.word")).alias("form"), only(form_n).alias("form_n"),
    ))
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(sorted_side(ends), "word", "left").withColumn("root", F.coalesce("root", "word"))
