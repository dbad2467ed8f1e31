"""Helpers shared by the operators: words, keys, settled tables, shared files."""

from __future__ import annotations

import contextvars
import functools
import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Tables settled by the job that runs, if it is to remove them.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("settled", default=None)
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text, an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def digest(*parts: Column) -> Column:
    """16-byte content key; null and empty differ, and part borders count."""
    tagged = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.unhex(F.md5(F.concat(*tagged)))


def shared_folder(spark: SparkSession) -> str:
    """New folder name beside the checkpoints, which the driver and all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def work_folder(spark: SparkSession) -> str:
    """New shared folder that goes with the settled tables of the job that runs, if it removes them."""
    path, scope = shared_folder(spark), _scope.get()
    if scope is not None:
        scope.append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """The frame written as a table in the shared folder.

    Lineage ends there, several readers share one run, and a later join shuffles both of its sides
    plainly, so that adaptive execution can split a hot key.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(job: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Settles the result of a job and removes the tables that the job settled on its way.

    For jobs with a narrow result: it is written once more.
    """

    @functools.wraps(job)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        outer, paths = _scope.get(), []
        _scope.set(paths)
        try:
            out = job(df, *args, **named)
            _scope.set(outer)
            return settle(out)
        finally:
            _scope.set(outer)
            for path in paths:
                place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)

    return run


def sorted_side(df: DataFrame) -> DataFrame:
    """Side of a join with rows that carry texts, to be shuffled and sorted at every size.

    Its size follows the corpus, so a plan that broadcasts it while it is small would change under
    way; a shuffle of both sides also lets adaptive execution split a hot key.
    """
    return df.hint("merge")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(job: Callable[..., DataFrame], rows: int = 1000) -> Callable[..., DataFrame]:
    """Runs a job over a frame with at most so many rows in an Arrow batch, so that a batch of whole
    texts fits beside the work on it.  For jobs that settle whatever passes through Python."""

    @functools.wraps(job)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        conf = df.sparkSession.conf
        before = conf.get(_BATCH)
        conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
        try:
            return job(df, *args, **named)
        finally:
            conf.set(_BATCH, before)

    return run


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(df: DataFrame, docs: DataFrame, row: str = "row") -> DataFrame:
    """The columns of ``docs`` again, from the struct made by ``packed``."""
    return df.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def computed(*columns: Column) -> Column:
    """Columns computed at this place in the plan, whatever is filtered above.

    They come out of a generator with one row.  A filter on them stays above it; pushed below, it would
    evaluate the array expressions again, and those inside lambdas once per element.
    """
    return F.inline(F.array(F.struct(*columns)))
