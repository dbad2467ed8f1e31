"""From raw documents to token records: filter, deduplicate, decontaminate, mix, write.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
the documents.  Between stages the frame is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardframe.llm import decontam, jaccard, mixing, quality, records
from rewardframe.llm.common import settle, table, unpacked
from rewardframe.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines.

    ``n_chars``, where there is such a column, follows a text that lost lines.
    """
    judged = quality.judge(docs).filter("kept")
    text = quality.without_lines(F.col("doc.text"), F.col("lost_lines"))
    own = {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(F.col("lost_lines").isNull(), F.col("doc.n_chars")).otherwise(F.length(text))
    return judged.select(*[own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs, keep=True)
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return unpacked(mixed.select("doc", F.explode(times).alias("copy")), docs, "doc")


def record_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records, written and read back: doc_id, start, n_tokens, ids_crc32, file, place."""
    return records.export(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", record_stage),
]

#: The Jaccard join's groups and the tokenizer are beyond SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
