"""Code-test rewards from a table of executed outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import calls_forbidden, forbidden_calls, last_answer, python_block
from ..functions.text import strip
from ..session import settled

TESTS_SCHEMA = "struct<tests:array<struct<input:string,output:string>>>"


def code_samples(df: DataFrame) -> DataFrame:
    """Adds the extracted ``code`` (null without an answer tag) and its forbidden calls."""
    return df.withColumn("code", python_block(last_answer(F.col("completion")))).withColumn(
        "forbidden", forbidden_calls(F.col("code"))
    )


def code_rewards(df: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, code_reward): 1.0 when every test ran cleanly and printed the expected text.

    ``df`` holds key, completion and answer (the tests as JSON); ``outputs`` holds
    (key, test, return_code, stdout) from wherever the code was executed.  No code runs here.  The samples are
    written out once without their texts: their tests and their rewards are read from there, and what Spark infers of the
    tests (that there are some) doesn't parse the JSON again.
    """
    body = F.col("_body")
    samples = settled(df.withColumn("_body", last_answer(F.col("completion"))).select(
        key,
        (body.isNotNull() & ~calls_forbidden(python_block(body))).alias("runnable"),
        body.isNotNull().alias("has_code"),
        F.when(F.try_parse_json("answer").isNotNull(), F.from_json("answer", TESTS_SCHEMA)["tests"]).alias("tests"),
    ))
    tests = samples.select(key, "runnable", F.posexplode("tests").alias("test", "t"))
    judged = (
        tests.join(outputs, [key, "test"], "left")
        .withColumn(
            "ok",
            F.col("runnable") & (F.col("return_code") == 0) & (strip(F.col("stdout")) == F.col("t.output")),
        )
        .groupBy(key).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all_ok"))
    )
    empty = F.col("has_code") & (F.size("tests") == 0)
    passed = F.coalesce("all_ok", empty, F.lit(False))
    return samples.join(judged, key, "left").select(
        key, F.when(passed, 1.0).otherwise(0.0).alias("code_reward")
    )
