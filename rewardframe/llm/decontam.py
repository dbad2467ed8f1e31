"""Benchmark decontamination by size-partitioned MinHash containment search.

Sets are distinct 5-word shingles, words lower-cased.  Documents are partitioned by the size class of
their set; in each class the hash space is cut into so many bins that the items can be found inside
sets of that size, and a document's signature is its smallest hash in every bin (one permutation
hashing).  A document is a candidate for an item if a value of its signature is a shingle of the item.
The longer the documents of a class, the more bins it has, so the chance to miss an item at the limit
stays under ``MISS`` whatever the document's length.  Where an item has too few shingles for that,
every hash of a document is in its signature.  Candidates are verified by exact shingle containment.

Defined cases: null and empty texts, and items without words, match nothing; with fewer than five
words the whole sequence is one shingle; repeated rows (documents or items) give repeated results;
empty tables give an empty result; further columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, digest, packed, settle, sorted_side, tidy, unpacked, words

N_WORDS = 5
PERCENT = 80  # of an item's shingles that a document must hold
MISS = 1e-4  # chance to miss an item at the limit
BROADCAST_ROWS = 1_000_000  # of the items' (item, hash) table, 40 bytes each
_HALF = 1 << 62


def shingles(words_: Column) -> Column:
    """Distinct 5-word shingles as texts; the whole sequence if it is shorter."""
    n = F.size(words_)
    long = F.transform(F.slice(words_, F.lit(1), F.greatest(n - N_WORDS + 1, F.lit(0))), lambda w, i: F.array_join(F.slice(words_, i + 1, N_WORDS), " "))
    return F.when(n >= N_WORDS, F.array_distinct(long)).when(n > 0, F.array(F.array_join(words_, " "))).otherwise(F.array().cast("array<string>"))


def with_hashes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``hashes``: sorted hashes of the shingles (0 .. 2^62), with repeats, and ``n``, their number."""
    df = df.withColumn("_w", F.transform(words(ascii_lower(F.col(text))), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    own = lambda h: F.shiftrightunsigned(h, 2)
    long = F.transform(
        F.slice("_w", F.lit(1), F.greatest(n - N_WORDS + 1, F.lit(0))),
        lambda x, i: own(F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, N_WORDS)])),
    )
    short = F.array(own(F.xxhash64("_w")))
    df = df.withColumn("hashes", F.when(n >= N_WORDS, F.sort_array(long)).when(n > 0, short).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn("n", F.size("hashes")).drop("_w")


def size_class(n: Column) -> Column:
    """Smallest c with n <= 2^c."""
    return F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def load(n_item: int, percent: int) -> float:
    """Mean number of a document's shingles in a bin, if items have ``n_item`` shingles or more.

    A shingle is the smallest of its bin with chance (1 - e^-x) / x, and the item has ``percent`` of
    its shingles in the document.  0 stands for every shingle, for items with very few.
    """
    held = max(1, math.ceil(n_item * percent / 100))
    x = 16.0
    while x > 0.2 and (1 - (1 - math.exp(-x)) / x) ** held > MISS:
        x /= 2
    return x if x > 0.2 else 0.0


def signature(hashes: str, n: Column, x: float) -> Column:
    """Smallest hash of every bin, from sorted hashes of a set in the size class of ``n``; every hash if ``x`` is 0."""
    if not x:
        return F.array_distinct(hashes)
    m = F.greatest(F.pow(F.lit(2.0), size_class(n)) / x, F.lit(1.0))
    width = F.greatest(F.floor(F.lit(float(_HALF)) / m), F.lit(1)).cast("bigint")
    return F.filter(hashes, lambda h, i: (i == 0) | (F.get(hashes, F.greatest(i - 1, F.lit(0))) < h - h % width))


def candidates(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs (key, item) of text keys, where a signature value of the document is in the item.

    Both frames have key and text.
    """
    hashed = with_hashes(items.select(F.col("key").alias("item"), F.col("text").alias("_t")), "_t").withColumn("hashes", F.array_distinct("hashes"))
    # An item that repeats its shingles can be hit by the distinct ones alone.
    sized = settle(hashed.select("item", F.size("hashes").alias("n"), F.explode_outer("hashes").alias("v")).filter("v IS NOT NULL").distinct())
    least, rows = sized.agg(F.min("n"), F.count("*")).first()
    texts = with_hashes(docs.select("key", F.col("text").alias("_t")), "_t")
    if not least:
        return docs.select("key", F.col("key").alias("item")).limit(0)
    # Bins without any item hash can't match; a small item table is sent to the documents.
    side = sized.select("item", "v")
    side = F.broadcast(side) if rows <= BROADCAST_ROWS else side
    # The outer form: a filter inferred for the inner one would be evaluated below, hash by hash.
    return texts.select("key", F.explode_outer(signature("hashes", F.col("n"), load(least, percent))).alias("v")).join(side, "v").select("key", "item").distinct()


@tidy
def leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", percent: int = PERCENT,
) -> DataFrame:
    """Verified pairs of text keys: key, item, n_item (shingles of the item), n_shared."""
    d = docs.select(digest(F.col(text)).alias("key"), F.col(text).alias("text"))
    i = items.select(digest(F.col(item_text)).alias("key"), F.col(item_text).alias("text"))
    pairs = settle(candidates(d, i, percent))
    sets = lambda df: df.withColumn("_w", words(ascii_lower(F.col("text")))).withColumn("set", shingles(F.col("_w")))
    # One text per key, as copies carry the same words: each task passes on one, before keys are dealt.  An inner join
    # of distinct keys: a semi join would be moved below, where all copies of a text meet.
    asked = settle(pairs.select("key").distinct())
    doc_texts = d.dropDuplicates(["key"]).join(sorted_side(asked), "key")
    item_sets = sets(i.join(pairs.select(F.col("item").alias("key")).distinct(), "key", "left_semi").distinct()).select(F.col("key").alias("item"), F.col("set").alias("item_set"))
    # A document's shingles are built once and serve all its items, then only counts go on.
    listed = settle(pairs.join(item_sets, "item").groupBy("key").agg(F.collect_list(F.struct("item", "item_set")).alias("items")))
    both = sets(doc_texts.join(sorted_side(listed), "key")).select("key", "set", F.explode("items").alias("i"))
    return (
        both.select("key", F.col("i.item").alias("item"), F.size("i.item_set").cast("bigint").alias("n_item"), F.size(F.array_intersect("set", "i.item_set")).cast("bigint").alias("n_shared"))
        .filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
    )


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT,
) -> DataFrame:
    """One row per document and test item it holds: doc_id, item_id, n_item, n_shared."""
    found = leaks(docs, items, text, item_text, percent)
    d = docs.select(F.col(doc_id).alias("doc_id"), digest(F.col(text)).alias("key"))
    i = items.select(F.col(item_id).alias("item_id"), digest(F.col(item_text)).alias("item"))
    return d.join(found, "key").join(i, "item").select("doc_id", "item_id", "n_item", "n_shared")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents that hold no test item, with their columns."""
    bad = settle(leaks(docs, items, text, item_text, percent).select("key").distinct())
    rows = docs.select(packed(docs).alias("row"), digest(F.col(text)).alias("key"))
    return unpacked(rows.join(sorted_side(bad), "key", "left_anti"), docs)
