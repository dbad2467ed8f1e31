"""Line dedup by distinct-site spread.

For every normalised line a HyperLogLog sketch of the sites that hold it grows by aggregation.  Lines
well above the limit are boilerplate, lines well below are not; lines near it get an exact count of
their sites.  Boilerplate lines leave every document.

Defined cases: a null or empty text has no lines; blank lines never count and always stay; a null
site is a site of its own; repeated rows change no count of sites; an empty table gives an empty
result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, computed, digest, packed, settle, sorted_side
from .quality import normal_line, without_lines

MIN_SITES = 6  # a line on so many sites or more is boilerplate
LOG_BUCKETS = 12
MARGIN = 5 * 1.04 / 2 ** (LOG_BUCKETS / 2)  # five standard errors of the sketch


#: Start of a line with a word, whatever else ends lines.
_FULL = r"(?md)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D]"


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """key (of the text), site and line hash of every line that holds a word."""
    return (
        # The keys first: beside the generator they would be computed again for every line.
        docs.select(digest(F.col(text)).alias("key"), digest(F.col(site)).alias("site"), F.col(text).alias("text"))
        .select("key", "site", F.explode(F.split("text", "\n", -1)).alias("raw"))
        .filter(F.col("raw").rlike(WORD))
        .select("key", "site", F.xxhash64(normal_line(F.col("raw"))).alias("line"))
    )


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines (line) on at least ``min_sites`` sites, of rows (line, site)."""
    spread = settle(
        lines.groupBy("line").agg(F.hll_sketch_agg("site", LOG_BUCKETS).alias("sketch"))
        .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - MARGIN))
    )
    sure = spread.filter(F.col("sites") > min_sites * (1 + MARGIN)).select("line")
    near = spread.filter(F.col("sites") <= min_sites * (1 + MARGIN)).select("line")
    exact = (
        lines.join(near, "line", "left_semi").distinct()
        .groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites).select("line")
    )
    return sure.union(exact)


def drop_site_lines(
    docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES,
) -> DataFrame:
    """One row per document: ``doc`` (its columns), n_lines, n_removed, cleaned.

    ``cleaned`` is the text without its boilerplate lines, null for a null text.
    """
    # A text holds a line on all its sites, so each (text, site) counts its lines once.
    held = settle(_lines(docs, text, site).distinct())
    bad = settle(boilerplate_lines(held.select("line", "site"), min_sites))
    lost = held.select("key", "line").distinct().join(bad, "line").groupBy("key").agg(F.collect_list("line").alias("lost"))
    lost = settle(lost)
    rows = docs.select(packed(docs).alias("doc"), digest(F.col(text)).alias("key"))
    body = F.col(f"doc.`{text}`")
    rows = rows.join(sorted_side(lost), "key", "left").select("doc", body.alias("_text"), F.col("lost").isNotNull().alias("_lost"), computed(without_lines(body, F.col("lost")).alias("cleaned")))
    count = lambda c: F.coalesce(F.regexp_count(c, F.lit(_FULL)), F.lit(0)).cast("bigint")
    # Most texts lose no line, and their lines are counted once.
    n: Column = count(F.col("_text"))
    gone: Column = F.when(F.col("_lost"), n - count(F.col("cleaned"))).otherwise(F.lit(0).cast("bigint"))
    return rows.select("doc", n.alias("n_lines"), gone.alias("n_removed"), "cleaned")
