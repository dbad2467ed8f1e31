"""Chat and training-sample tables in Parquet, previews, lookups; evaluation records in JSON lines."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.chat import as_image_list, chat_turns, image_lengths
from ..operators.bloom import maybe_in
from ..operators.ranks import order_rank
from ..operators.select import first_k
from ..session import settled

# Column names, the shard pattern, and the evaluation record.
RL_COLUMNS = (
    "id", "images", "problem", "answer", "problem_type", "answer_type", "source", "prompt_type",
)
RL_SHARDS = "RL_part*.parquet"
EVAL_SCHEMA = (
    "idx bigint, prompt string, pred string, gt string, latency_s double, has_image boolean, "
    "conversations array<struct<role:string,content:string>>, "
    "score struct<format:double,accuracy:double>"
)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Chat table with images as a list, also where the file holds one image per row; a table of
    ``write_chats`` as it is."""
    df = spark.read.parquet(path)
    if "images" in df.columns:
        return df
    if "image_bytes" not in df.columns:
        return df.withColumn("images", F.lit(None).cast("array<binary>"))
    is_array = isinstance(df.schema["image_bytes"].dataType, ArrayType)
    return df.withColumn("images", as_image_list(F.col("image_bytes"), is_array)).drop("image_bytes")


def read_rl_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The eight sample columns of all shards in a folder; the answer is always a list."""
    try:
        df = spark.read.parquet(f"{folder.rstrip('/')}/{RL_SHARDS}")
    except AnalysisException as e:
        raise FileNotFoundError(f"no {RL_SHARDS} in {folder}") from e
    df = df.select(*RL_COLUMNS)
    if isinstance(df.schema["answer"].dataType, StringType):
        df = df.withColumn("answer", F.when(F.col("answer").isNotNull(), F.array("answer")))
    return df.withColumn("id", F.col("id").cast("string"))


def preview(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """First n rows by key: turns (null where the chat is not a list of turns), the number of list
    items (null where it does not parse), the raw chat, image count and sizes, and the table's size."""
    total = df.agg(F.count("*")).scalar()
    return first_rows(df, key, n).select(
        key,
        chat_turns(F.col("conversations")).alias("turns"),
        F.json_array_length("conversations").alias("n_turns"),
        F.col("conversations").alias("raw"),
        F.coalesce(F.size("images"), F.lit(0)).alias("n_images"),
        F.transform("images", F.length).alias("image_sizes"),
        total.alias("total_rows"),
    )


def spread_preview(df: DataFrame, key: str, parts: int = 5) -> DataFrame:
    """First row of each of ``parts`` equal stretches of the table in key order.

    Only the key column is ranked; the few rows are then looked up.
    """
    n = df.agg(F.count("*")).scalar()
    ranked = order_rank(df.select(key), [key], "_at")
    starts = F.lit(False)
    for i in range(parts):
        first = F.floor(n / parts) * i + F.least(F.lit(i), F.pmod(n, F.lit(parts)))
        starts = starts | ((F.col("_at") == first) & (F.lit(i) < n))
    return df.join(ranked.filter(starts).select(key), key)


def first_rows(df: DataFrame, key: str, k: int = 100) -> DataFrame:
    """The first k rows in the order of a unique key: a filter on the key, so that images are read for
    those rows alone and never shuffled."""
    return first_k(df, [key], k)


def capped(df: DataFrame, key: str, max_samples: int | None) -> DataFrame:
    """At most ``max_samples`` rows in key order; none or zero keeps all."""
    return first_rows(df, key, max_samples) if max_samples else df


def lookup(df: DataFrame, ids: DataFrame | list, key: str = "id") -> DataFrame:
    """Rows of the given ids; a list becomes a filter the Parquet scan can push down.

    A table of ids becomes a Bloom filter that is tested right above the scan, so that the exact join
    shuffles rows that are looked up, and hardly any others.
    """
    if isinstance(ids, list):
        return df.filter(F.col(key).isin(ids))
    wanted = ids.select(key).distinct()
    return maybe_in(df, wanted, key).join(wanted, key, "left_semi")


def write_kept(df: DataFrame, columns: list[str], path: str) -> None:
    """Kept rows under the unchanged input columns."""
    df.select(*columns).write.mode("overwrite").parquet(path)


def write_chats(df: DataFrame, path: str) -> None:
    """Chats with the lengths of their images beside them, for jobs that need no more than those."""
    df.withColumn("image_lengths", image_lengths(F.col("images"))).write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One-row report as JSON."""
    report.write.mode("overwrite").json(path)


def append_records(df: DataFrame, path: str, batch_id: str | None = None, compression: str = "none") -> None:
    """Records appended as JSON lines: generations, judge calls, evaluation records.  Readers tell compressed files
    (gzip and others) by their names.

    With a ``batch_id`` they are appended once however often the append is repeated: rows go to a folder of
    this attempt, then a manifest of the batch names that folder.  ``read_records`` takes what manifests name, so
    an attempt that was cut off, or came second, adds nothing.
    """
    if batch_id is None:
        df.write.mode("append").json(path, compression=compression)
        return
    spark = df.sparkSession
    if batch_id in {b for b, _ in _committed(spark, path)}:
        return
    folder = f"attempts/{uuid.uuid4().hex}"
    df.write.json(f"{path}/{folder}", compression=compression)
    manifest = spark.createDataFrame([(batch_id, folder)], "batch_id string, folder string").coalesce(1)
    # Refused if a manifest of the batch is there by now: the other attempt counts.
    manifest.write.mode("ignore").json(f"{path}/manifests/batch={hashlib.sha256(batch_id.encode()).hexdigest()[:32]}")


def _committed(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(batch id, folder) of all complete appends: as many rows as there were batches."""
    try:
        rows = spark.read.schema("batch_id string, folder string").json(f"{path}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [(r["batch_id"], r["folder"]) for r in rows.select("batch_id", "folder").collect()]


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all complete appends under batch ids."""
    folders = [f"{path}/{folder}" for _, folder in sorted(_committed(spark, path))]
    return spark.read.schema(schema).json(folders) if folders else spark.createDataFrame([], schema)


def read_eval_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_SCHEMA).json(path)


def generations(df: DataFrame, step: Column, text: str, order: list[str], epoch: int = 1) -> DataFrame:
    """(epoch, step, position, text) rows: the texts of each step, numbered from 0 in a total order."""
    # The texts are shuffled once: each range of (step, order) is numbered as it is sorted, and only a step that goes on
    # from an earlier range, at most one a range, gets the number of its rows there added.
    rows = df.select(step.alias("step"), *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)], F.col(text).alias("text"))
    keys = ["step", *[f"_order{i}" for i in range(len(order))]]
    ordered = rows.filter(F.col("step").isNotNull()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = StructType([ordered.schema["step"], *_PLACED])
    placed = settled(ordered.select("step", "text").mapInArrow(_placed, schema), "zstd")
    sizes = placed.groupBy("step", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("step").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("step", "_block", F.sum("_n").over(before).alias("_offset")).filter("_offset > 0")
    return placed.join(F.broadcast(offsets), ["step", "_block"], "left").select(
        F.lit(epoch).alias("epoch"), "step", (F.col("position") + F.coalesce("_offset", F.lit(0))).alias("position"), "text"
    )


_PLACED = [StructField("text", StringType()), StructField("_block", IntegerType()), StructField("position", LongType())]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by step, numbered from 0 within each step."""
    block, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        steps = batch.column(0)
        starts = np.ones(n, "bool")
        starts[1:] = pc.not_equal(steps.slice(1), steps.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts[0] = steps[0].as_py() != last
        at = np.arange(n)
        position = at - np.maximum.accumulate(np.where(starts, at, 0))
        if not starts[0]:
            position[: starts.argmax() or n] += seen
        last, seen = steps[n - 1].as_py(), int(position[-1]) + 1
        columns = [steps, batch.column(1), pa.array(np.full(n, block, "int32")), pa.array(position)]
        yield pa.RecordBatch.from_arrays(columns, names=["step", "text", "_block", "position"])


def generation_records(rows: DataFrame) -> DataFrame:
    """One (epoch, step, num_samples, gen_texts) record per step, of rows from ``generations``.

    An export for readers of that form: a step is one training batch and must fit a record.
    """
    place = F.struct("position", "text")
    return rows.groupBy("epoch", "step").agg(
        F.count("*").alias("num_samples"),
        F.transform(F.array_sort(F.collect_list(place)), lambda s: s["text"]).alias("gen_texts"),
    )
