"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for every host the distinct documents that hold a line are
counted.  Lines above the limit are boilerplate and are taken out of every document but the first
that holds them; documents that lose too much of their text are rejected.

Documents with equal host and text count once, so exact copies alone make no line boilerplate.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of
its own; repeated rows are judged alike, each row by itself; ties for the first holder go to the
smallest id (null last), then to the smallest content key; further columns are left alone; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, computed, digest, packed, settle, sorted_side, tidy, words

MAX_DOCS = 100  # distinct documents of a host that may share a line
MAX_LOST = 70  # per cent of its words that a document may lose
WINDOW = 5
_SYMBOLS = "#*$%&|<>"


#: What most lines do not hold: digits that change, white space other than spaces.
_UNEVEN = r"[1-9\x09-\x0D]"


def normal_line(line: Column) -> Column:
    """Line in lower case, digits as 0 and single spaces; empty for a line without words.

    A cheap search tells the lines that need replacing from the others.
    """
    low = F.lower(line)
    even = F.regexp_replace(F.regexp_replace(low, "[1-9]", "0"), SPACES, " ")
    return F.trim(F.when(F.contains(line, F.lit("  ")) | line.rlike(_UNEVEN), even).otherwise(low))


def repeated_words(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Adds the number of words inside 5-word windows found twice or more, from word hashes.

    Only texts that repeat a window at all sort their windows by hash, so that equal ones meet.
    """
    n = F.size(hashes)
    h = df.withColumn(
        "_windows",
        F.when(n >= WINDOW, F.transform(
            F.slice(hashes, F.lit(1), F.greatest(n - WINDOW + 1, F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WINDOW)]),
        )).otherwise(F.array().cast("array<bigint>")),
    )
    sort = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    h = h.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), sort))
    same = lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i)["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))))
    h = h.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["p"]))))
    covered = F.transform("_starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1), p + WINDOW) - p))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return h.withColumn(out, F.coalesce(total, F.lit(0).cast("bigint"))).drop("_windows", "_sorted", "_starts")


def with_stats(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("_words", words(F.col(text))).withColumn("_lines", full)
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = repeated_words(df, "_hashes", "n_repeat_words")
    n = F.size("_words").cast("bigint")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    own = [c for c in df.columns if c not in ("_words", "_hashes", "_lines", "n_repeat_words")]
    spaces = "".join(map(chr, [32, *range(9, 14)]))
    return df.select(*own, computed(
        n.alias("n_words"),
        F.length(F.translate(body, spaces, "")).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.col("n_repeat_words"), failed.alias("base_failed"),
    ))


@tidy
def boilerplate(docs: DataFrame, doc_id: str, text: str, host: str, max_docs: int) -> DataFrame:
    """Lines to take out of each text: key (of host and text), lost_words, lost_lines (line hashes)."""
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(WORD))
    held = (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(host).alias("host"))
        .withColumn("key", digest(F.col("host"), F.col("text")))
        .select("id", "key", "host", F.posexplode_outer(lines).alias("place", "raw")).filter("raw IS NOT NULL")
        .select("id", "key", "host", "place", F.xxhash64(normal_line(F.col("raw"))).alias("line"), F.regexp_count("raw", F.lit(WORD)).alias("n"))
        # Rows with one key hold the same line at the same place: it counts once, however many rows there are.
        .groupBy("key", "host", "line", "place").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.max("n").alias("n"))
        .groupBy("key", "host", "line").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    )
    held = settle(held)
    common = (
        held.groupBy("host", "line")
        .agg(F.count("*").alias("docs"), F.min(F.struct("first", "key"))["key"].alias("holder"))
        .filter(F.col("docs") > max_docs)
    )
    common = settle(common).select(F.col("host").alias("chost"), F.col("line").alias("cline"), "holder")
    return (
        held.join(common, F.col("host").eqNullSafe(F.col("chost")) & (F.col("line") == F.col("cline")))
        .filter(F.col("key") != F.col("holder"))
        .groupBy("key").agg(F.sum("n").alias("lost_words"), F.collect_list("line").alias("lost_lines"))
    )


def judge(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
    max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST,
) -> DataFrame:
    """One row per document: ``doc`` (its columns), the base figures, lost_words, lost_lines, kept.

    ``kept`` is false if the base rules fail or if more than ``max_lost`` per cent of the words
    stand in boilerplate lines.
    """
    lost = boilerplate(docs, doc_id, text, host, max_docs)
    rows = docs.select(packed(docs).alias("doc"), F.col(text).alias("_text"), digest(F.col(host), F.col(text)).alias("key"))
    # The figures come first, so that the join carries no text beyond ``doc``.
    judged = with_stats(rows, "_text").drop("_text").join(sorted_side(lost), "key", "left").drop("key")
    judged = judged.withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("bigint"))
    enough = 100 * F.col("lost_words") <= max_lost * F.col("n_words")
    return judged.withColumn("kept", ~F.col("base_failed") & enough)


def without_lines(text: Column, lost: Column) -> Column:
    """Text without the lines whose hash is listed; the very text where none is."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(lost, F.xxhash64(normal_line(x))))
    return F.when(lost.isNull(), text).otherwise(F.array_join(kept, "\n"))
