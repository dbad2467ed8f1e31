"""Jobs on small tables: logged values, skew, order independence, brute force."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rewardframe.operators import candidates, judge, rollout, split
from rewardframe.operators.ranks import hash_rank, order_rank, running_sum
from rewardframe.sources import tables

STEP_1 = [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 1]
STEP_4 = [0, 0, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0]


def rewards(spark):
    rows = [(s, f"{s}-{i // 4}", i % 4, float(r)) for s, rs in ((1, STEP_1), (4, STEP_4)) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, "step int, prompt string, g int, reward double")


def test_logged_steps(spark):
    adv = rollout.group_advantages(rewards(spark), "prompt")
    m = {r["step"]: r for r in rollout.step_metrics(adv, ["step"]).collect()}
    assert m[1]["reward_mean"] == pytest.approx(0.1875) and m[1]["reward_std"] == pytest.approx(0.4031, abs=1e-4)
    assert m[4]["reward_mean"] == pytest.approx(0.3125) and m[4]["reward_std"] == pytest.approx(0.4787, abs=1e-4)
    assert (m[1]["advantage_min"], m[1]["advantage_max"]) == (pytest.approx(-1.5), pytest.approx(0.5))
    assert (m[4]["advantage_min"], m[4]["advantage_max"]) == (pytest.approx(-0.5), pytest.approx(1.5))


def test_group_of_one_has_no_advantage(spark):
    df = spark.createDataFrame([("a", 3.0)], "prompt string, reward double")
    assert rollout.group_advantages(df, "prompt").first()["advantage"] == 0.0


def test_zero_steps_are_skipped(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 0.5), (2, -0.5)], "step int, advantage double")
    assert {r["step"] for r in rollout.useful_steps(df, "step").collect()} == {2}


def hot_table(spark):
    """One group holds a third of all rows, with many equal scores."""
    rnd = random.Random(5)
    rows = [(0 if i % 3 == 0 else 1 + i % 40, i, rnd.choice([0.0, 1.0, 2.0, rnd.random() * 3])) for i in range(3000)]
    return spark.createDataFrame(rows, "grp int, cand int, score double"), rows


def by_group(rows):
    out = {}
    for g, c, s in rows:
        out.setdefault(g, []).append((s, c))
    return out


def test_top_k_on_a_hot_group(spark):
    df, rows = hot_table(spark)
    want = set()
    for g, items in by_group(rows).items():
        cut = sorted((s for s, _ in items), reverse=True)[min(7, len(items)) - 1]
        want |= {(g, c) for s, c in items if s >= cut}
    got = candidates.top_k(df, "grp", "score", 7).collect()
    assert {(r["grp"], r["cand"]) for r in got} == want and len(got) == len(want)


def test_nucleus_on_a_hot_group(spark):
    df, rows = hot_table(spark)
    want = set()
    for g, items in by_group(rows).items():
        items.sort(key=lambda x: (-x[0], x[1]))
        total, cum = sum(math.exp(s) for s, _ in items), 0.0
        for s, c in items:
            if cum <= 0.8 - 1e-12:
                want.add((g, c))
            cum += math.exp(s) / total
    got = {(r["grp"], r["cand"]) for r in candidates.nucleus(df, "grp", "cand", "score", 0.8).collect()}
    assert got == want


def test_running_sum_matches_any_partitioning(spark):
    df, rows = hot_table(spark)
    want, acc = {}, {}
    for g, c, s in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        acc[g] = acc.get(g, 0.0) + s
        want[c] = acc[g]
    for n in (1, 7):
        out = running_sum(df.repartition(n), ["grp"], [F.desc("score"), F.asc("cand")], F.col("score"), "cum")
        got = {r["cand"]: r["cum"] for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_positions_are_dense(spark):
    df = spark.range(5000).repartition(9)
    ranked = hash_rank(df, F.md5(F.col("id").cast("string")), ["id"]).collect()
    assert sorted(r["position"] for r in ranked) == list(range(5000))
    assert all(r["position"] == r["id"] for r in order_rank(df, ["id"]).collect())


def test_no_window_over_a_group(spark):
    df, _ = hot_table(spark)
    for job in (
        rollout.group_advantages(df.withColumnRenamed("score", "reward"), "grp"),
        candidates.with_log_softmax(df, "grp", "score"),
    ):
        plan = job._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_top_k_opens_no_window_over_a_group(spark):
    df, _ = hot_table(spark)
    plan = candidates.top_k(df, "grp", "score", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"))
    part = lambda s: {r["id"] for r in df.filter(split.in_split(F.col("id"), s, 0.1)).collect()}
    train, val = part("train"), part("val")
    assert not train & val and len(train | val) == 4000 and 300 < len(val) < 500
    import hashlib

    want = {i for i in train | val if int(hashlib.md5(f"split-{i}".encode()).hexdigest(), 16) % 10000 < 1000}
    assert val == want
    with pytest.raises(ValueError):
        split.in_split(F.col("id"), "test")


def test_epoch_plan_does_not_depend_on_partitioning(spark):
    df = spark.range(103).select("id")
    plans = [
        sorted(tuple(r) for r in split.epoch_plan(df.repartition(n), "id", 42, 1, 8, shards=4).collect())
        for n in (1, 5)
    ]
    assert plans[0] == plans[1] and len(plans[0]) == 104
    counts = pd.DataFrame(plans[0], columns=["id", "position", "shard", "batch"]).groupby("shard").size()
    assert set(counts) == {26}
    assert split.batch_count(103, 8) == 13 and split.batch_count(103, 8, 20) == 0
    assert split.resume_step(100, 4, 8) == 50 and split.resume_step(100, 4, 4) == 100


def test_judge_retries_and_isolates_failures(spark):
    rows = [(f"p{i}", "bad" if i == 3 else "fine", "a", "ANY") for i in range(40)]
    df = spark.createDataFrame(rows, "prompt string, completion string, answer string, answer_type string")

    def picky(batch):
        if (batch["completion"] == "bad").any():
            raise RuntimeError("cannot judge")
        return pd.DataFrame({"score": [0.5] * len(batch), "explanation": ["ok"] * len(batch)})

    uniq = judge.unique_requests(df.union(df))
    got = judge.judged_by(uniq, picky, retries=1, delay=0.0).collect()
    assert len(got) == 40 and sum(r["failed"] for r in got) == 1
    assert {r["score"] for r in got if r["failed"]} == {0.0}
    m = judge.judge_metrics(
        df.union(df).withColumn("key", judge.request_key()).withColumn("failed", F.lit(False))
    ).first()
    assert m["total_requests"] == 80 and m["cache_hit_rate"] == 0.5


def test_first_rows_and_missing_shards(spark, tmp_path):
    df = spark.range(50).withColumn("blob", F.lit(b"x"))
    assert sorted(r["id"] for r in tables.first_rows(df, "id", 4).collect()) == [0, 1, 2, 3]
    assert tables.capped(df, "id", None).count() == 50
    with pytest.raises(FileNotFoundError):
        tables.read_rl_shards(spark, str(tmp_path))


def test_generations_are_numbered_rows(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    rows = tables.generations(df.repartition(7), F.col("id") % 2, "text", ["id"])
    assert sorted((r["step"], r["position"], r["text"]) for r in rows.collect()) == sorted((i % 2, i // 2, f"t{i}") for i in range(1000))
    records = tables.generation_records(rows).collect()
    assert sorted((r["step"], r["num_samples"], r["gen_texts"][3]) for r in records) == [(0, 500, "t6"), (1, 500, "t7")]


def test_epoch_plan_fills_every_shard(spark):
    for n, shards in ((2, 8), (1, 5), (7, 3), (8, 4), (0, 4)):
        plan = split.epoch_plan(spark.range(n), "id", 1, 1, 4, shards=shards).groupBy("shard").count().collect()
        assert len(plan) == (shards if n else 0) and {r["count"] for r in plan} <= {-(-n // shards)}


def test_batches_beyond_the_limit_are_refused(spark):
    df = spark.createDataFrame([("p", "c", "a", "t")], "prompt string, completion string, answer string, answer_type string")
    with pytest.raises(ValueError):
        judge.request_batches(df, 256)
    with pytest.raises(ValueError):
        judge.judged_by(judge.unique_requests(df), lambda x: x, batch_size=129)


def test_top_k_beyond_a_thousand(spark):
    from rewardframe.operators.candidates import top_k

    df = spark.range(6000).select(F.lit(1).alias("g"), "id", (F.col("id") % 3000).alias("score"))
    kept = top_k(df, "g", "score", 2001).collect()
    assert len(kept) == 2002 and min(r["score"] for r in kept) == 1999


def test_judge_sees_context_and_halves_failing_batches(spark):
    rows = [(f"p{i}", "c", "a", "t", "math" if i % 2 else "ocr") for i in range(20)]
    df = spark.createDataFrame(rows, "prompt string, completion string, answer string, answer_type string, problem_type string")

    def by_type(part):
        if (part["prompt"] == "p7").any():
            raise ValueError("no p7")
        return part.assign(score=(part["problem_type"] == "math").astype(float), explanation="")

    asked = judge.unique_requests(df, ("problem_type",))
    got = judge.judged_by(asked, by_type, retries=0, context=("problem_type",)).join(asked, "key").collect()
    assert {r["prompt"]: r["score"] for r in got} == {f"p{i}": float(i % 2) if i != 7 else 0.0 for i in range(20)}
    assert [r["prompt"] for r in got if r["failed"]] == ["p7"]


@pytest.mark.parametrize(("files", "per_trigger"), [(1, 1), (4, 1), (40, 3)])
def test_stream_answers_every_request(spark, files, per_trigger):
    from rewardframe.plans import judging as plan
    from rewardframe.plans.views import Tables
    from rewardframe.streaming import judging as stream

    t = Tables(spark, "/root/testdata/sf0.001")
    out = plan.judged_stream(t, plan.request_stream(t, files, per_trigger))
    want = judge.scored_once(t("requests")).select("request_id", "score")
    got = stream.answers(spark, out).select("request_id", "score")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    figures = stream.stream_metrics(spark, out).first()
    assert figures["requests"] == want.count() and figures["judged"] == judge.unique_requests(t("requests")).count()
    folder = plan.counted_stream(t, plan.request_stream(t, files, per_trigger), every=3)
    assert stream.window_counts(spark, folder).agg(F.sum("requests")).first()[0] == want.count()


def test_late_and_repeated_requests_are_answered(spark, tmp_path):
    from rewardframe.streaming import judging as stream

    schema = "request_id bigint, prompt string, completion string, answer string, answer_type string, ts timestamp"
    days = ((1, "a", "2024-01-30"), (2, "b", "2024-01-29"), (3, "a", "2024-01-01"), (4, "c", "2023-01-01"))
    for i, p, day in days:
        row = [(i, p, "yes", "yes", "t", f"{day} 00:00:00")]
        spark.createDataFrame(row, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp")) \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        requests = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.start_judging(requests, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["request_id"] for r in stream.answers(spark, str(tmp_path / "out")).collect()) == [1, 2, 3, 4]
    figures = stream.stream_metrics(spark, str(tmp_path / "out")).first()
    assert (figures["requests"], figures["judged"], figures["repeats"]) == (4, 3, 1)


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def skewed(spark):
    """Lowers the bounds of skew splitting and turns broadcasts off; 90 % of the rows are in one group."""
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    rows = spark.range(300_000, numPartitions=12).select(
        "id", F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("grp"), (F.xxhash64("id") % 1000 / 100.0).alias("reward")
    )
    yield rows
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_groups_are_split(skewed):
    from rewardframe.operators import candidates, rollout

    assert "skew=true" in _plan(rollout.group_advantages(skewed, "grp").select("id", "advantage"))
    assert "skew=true" in _plan(candidates.with_log_softmax(skewed, "grp", "reward").select("id", "logp"))
    assert "skew=true" in _plan(candidates.top_k(skewed, "grp", "reward", 900).select("id"))
    texts = skewed.select("id", F.col("grp").cast("string").alias("prompt"), F.lit("c").alias("completion"), F.lit("a").alias("answer"), F.lit("t").alias("answer_type"))
    assert "skew=true" in _plan(judge.scored_once(texts).select("id", "score"))



def test_audits_of_stored_chats_read_no_images(spark, tmp_path):
    from rewardframe.operators import audit, distill

    chat = '[{"role": "user", "content": "what is in the picture?"}, {"role": "assistant", "content": "a cat"}]'
    rows = [(1, chat, [b"x" * 9]), (2, chat, [b"x", b"y"]), (3, "no json", [b""]), (4, chat, None)]
    df = spark.createDataFrame(rows, "id bigint, conversations string, images array<binary>")
    tables.write_chats(df, str(tmp_path / "chats"))
    stored = tables.read_chats(spark, str(tmp_path / "chats"))
    assert audit.audit(stored).collect() == audit.audit(df).collect()
    reasons = distill.candidates(stored).select("id", "early_reason")
    assert sorted(reasons.collect()) == sorted(distill.candidates(df).select("id", "early_reason").collect())
    for job in (audit.audit(stored), reasons):
        assert "binary" not in job._jdf.queryExecution().executedPlan().toString()
