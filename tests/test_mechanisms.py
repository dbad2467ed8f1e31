"""Selection, bijections, Bloom filters, percentiles, ledgers, manifests, the judge pool and window counts."""

import os
import random
import re
import sys
import time

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rewardframe.functions import extract, maths
from rewardframe.operators import bloom, cachestore, judge, permute, quantiles, select, split
from rewardframe.sources import tables
from rewardframe.streaming import judging as stream


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # judges below run in workers

# --- first k -------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 7, 2500, 4999, 5000])
def test_first_k(spark, k):
    rng = random.Random(k)
    data = [(rng.choice([None, rng.randint(0, 300)]), f"{i:05d}", None if i % 3 else i) for i in range(5000)]
    df = spark.createDataFrame(data, "a int, b string, c int").repartition(6)
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[k - 1]
    assert select.kth_key(df, ["a", "b"], k, sample=60, bound=40) == want[:2]
    assert select.first_k(df, ["a", "b"], k).count() == k
    assert select.kth_key(df, ["b"], k, sample=60, bound=40) == (f"{k - 1:05d}",)


def test_first_k_of_short_and_empty_tables(spark):
    df = spark.range(5).select(F.col("id").alias("key"))
    assert select.first_k(df, ["key"], 9).count() == 5 and select.first_k(df, ["key"], 0).count() == 0
    assert select.first_k(df.limit(0), ["key"], 3).count() == 0 and select.kth_key(df, ["key"], 0) is None


def test_first_rows_shuffle_no_images(spark, tmp_path):
    path = str(tmp_path / "chats")
    spark.range(4000).select("id", F.repeat(F.lit("x"), 500).cast("binary").alias("images")).write.parquet(path)
    kept = tables.first_rows(spark.read.parquet(path), "id", 40)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 40 and "Exchange" not in plan and "PushedFilters: [Or(IsNull(id),LessThanOrEqual(id,39))]" in plan


# --- epochs --------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 100, 1000])
def test_epoch_order_is_a_bijection(spark, n):
    places = spark.range(n).select(F.col("id").alias("row"), permute.place_of(F.col("id"), n, "5").alias("place")).collect()
    assert sorted(r["place"] for r in places) == list(range(n))
    assert all(permute.row_at(r["place"], n, "5") == r["row"] for r in places)


def test_epochs_differ_and_batches_stand_alone(spark):
    rows = permute.numbered(spark.range(0, 2060, 2).select("id"), "id")
    first, second = (permute.epoch_order(rows, 1030, 42, e, 16, shards=4) for e in (1, 2))
    assert first.join(second, ["id", "position"]).count() < 40
    counts = {r["shard"]: r["count"] for r in first.groupBy("shard").count().collect()}
    assert set(counts.values()) == {258}
    for shard, batch in ((0, 0), (3, 7), (2, 16)):
        want = [r["row"] for r in second.filter(f"shard = {shard} AND batch = {batch}").orderBy("position").collect()]
        assert permute.batch_rows(1030, 42, 2, 16, shard, batch, shards=4) == want
        assert permute.one_batch(rows, 1030, 42, 2, 16, shard, batch, shards=4).count() == len(set(want))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_epoch_order_deals_like_the_epoch_plan(spark):
    df = spark.range(103).select("id")
    rows = permute.numbered(df, "id")
    own = permute.epoch_order(rows, 103, 42, 1, 8, shards=4, skip_batches=2).select("position", "shard", "batch")
    assert own.exceptAll(split.epoch_plan(df, "id", 42, 1, 8, shards=4, skip_batches=2).select("position", "shard", "batch")).count() == 0


# --- Bloom filter --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 300, 40_000])
def test_bloom_filter(spark, n):
    ids = spark.range(n).select((F.col("id") * 7).alias("id"))
    df = spark.range(100_000).select(F.col("id"), F.lit("x").alias("block"))
    left = bloom.maybe_in(df, ids, "id")
    assert left.columns == df.columns
    hits = df.join(ids, "id", "left_semi").count()
    assert left.join(ids, "id", "left_semi").count() == hits
    assert left.count() - hits <= 0.01 * 100_000
    assert tables.lookup(df, ids.union(ids), "id").count() == hits


def test_bloom_filter_of_strings_and_nulls(spark):
    ids = spark.createDataFrame([("a",), (None,), ("b",)], "id string")
    df = spark.createDataFrame([("a", 1), (None, 2), ("c", 3), ("b", 4)], "id string, v int")
    assert sorted(r["v"] for r in tables.lookup(df, ids, "id").collect()) == [1, 4]
    assert tables.lookup(df, ids.limit(0), "id").count() == 0


def test_large_bloom_filters_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(bloom, "LARGEST", 4095)
    df = spark.range(50)
    assert tables.lookup(df, spark.range(5), "id").count() == 5 and bloom.maybe_in(df, spark.range(5), "id").count() == 50


# --- percentiles ---------------------------------------------------------------------------------


@pytest.mark.parametrize(("accuracy", "inside"), [(2000, 100_000), (40, 50)])
def test_exact_percentiles(spark, accuracy, inside):
    rng = random.Random(accuracy)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(0, 1), 3.0, float(rng.randint(0, 5))])) for _ in range(6000)]
    data += [("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0), *[("ties", 7.0)] * 400]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    got = {(r["g"], r["p"]): r["value"] for r in quantiles.exact_percentiles(df, ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0], accuracy, inside).collect()}
    frame = pd.DataFrame(data, columns=["g", "x"]).dropna(subset=["x"])
    for g, own in frame.groupby("g", dropna=False)["x"]:
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got.pop((None if pd.isna(g) else g, p)) == pytest.approx(own.quantile(p), abs=1e-12)
    assert not got


def test_exact_percentiles_of_a_whole_table(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert [r["value"] for r in quantiles.exact_percentiles(df, [], "x", [0.5, 0.995]).orderBy("p").collect()] == [50.0, 99.5]
    assert quantiles.exact_percentiles(df.limit(0), [], "x", [0.5]).count() == 0


# --- calls and records made once -----------------------------------------------------------------


def _requests(spark, n):
    rows = [(f"p{i}", "fine", "a", "ANY") for i in range(n)]
    return spark.createDataFrame(rows, "prompt string, completion string, answer string, answer_type string")


def test_a_rerun_makes_no_second_call(spark, tmp_path):
    seen, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    seen.mkdir()

    def slow(batch):
        if "p37" in set(batch["prompt"]) and not os.path.exists(tmp_path / "again"):
            os._exit(1)  # the worker dies in the middle of its task
        for p in batch["prompt"]:
            with open(seen / p, "a") as f:
                f.write("x")
        return pd.DataFrame({"score": [0.5] * len(batch), "explanation": ["ok"] * len(batch)})

    asked = judge.unique_requests(_requests(spark, 80))
    run = lambda: judge.judged_by(asked, slow, retries=0, batch_size=4, concurrent=1, ledger=ledger, parts=2).collect()
    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        run()
    before = len(os.listdir(seen))
    (tmp_path / "again").write_text("")
    got = run()
    assert 0 < before < 80 and len(got) == 80 and {r["score"] for r in got} == {0.5}
    assert sorted(os.listdir(seen)) == sorted(f"p{i}" for i in range(80))
    # What was answered before was not asked again; a call cut off in the ledger's own write might be.
    assert all((seen / f"p{i}").read_text() == "x" for i in range(80))
    assert len(run()) == 80 and all((seen / f"p{i}").read_text() == "x" for i in range(80))


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "records"), "id bigint"
    assert tables.read_records(spark, path, schema).count() == 0
    for batch, n in (("one", 5), ("two", 3), ("one", 5), ("two/../x", 2), ("two", 3)):
        tables.append_records(spark.range(n), path, batch)
    assert tables.read_records(spark, path, schema).count() == 10
    # An attempt without a manifest does not count.
    spark.range(100).write.json(f"{path}/attempts/left-over")
    assert tables.read_records(spark, path, schema).count() == 10


def _files(folder):
    return {d: sorted(f for f in os.listdir(f"{folder}/{d}") if f.startswith("part")) for d in os.listdir(folder) if d.startswith("bucket")}


def test_cache_store_touches_changed_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "cache")
    assert cachestore.read_scores(spark, folder).count() == 0 and cachestore.compact(spark, folder) == []
    entries = lambda ids, hour, score: spark.createDataFrame([(f"k{i}", score, hour) for i in ids], "key string, score double, h int").select(
        "key", "score", F.timestamp_seconds(F.col("h") * 3600 + F.length("key")).alias("ts"))
    cachestore.add_scores(entries(range(200), 5, 0.5), folder, 16)
    before = _files(folder)
    cachestore.add_scores(entries([3], 6, 0.75), folder, 16)
    changed = [b for b, fs in _files(folder).items() if fs != before[b]]
    assert len(before) == 16 and len(changed) == 1
    assert cachestore.compact(spark, folder, 2) == [int(changed[0].split("=")[1])]
    after = _files(folder)
    assert {b: fs for b, fs in after.items() if b not in changed} == {b: fs for b, fs in before.items() if b not in changed}
    got = {r["key"]: r["score"] for r in cachestore.read_scores(spark, folder).collect()}
    assert len(got) == 200 and got["k3"] == 0.75 and got["k4"] == 0.5
    asked = spark.createDataFrame([("k3",), ("k4",), ("new",)], "key string")
    hits = cachestore.lookup_scores(asked, folder, F.timestamp_seconds(F.lit(6 * 3600 + 60)), 3600, 16).collect()
    assert {(r["key"], r["score"]) for r in hits if r["hit"]} == {("k3", 0.75)} and len(hits) == 3


@pytest.mark.parametrize("size", [0, 1, 150, 199, 200, 500])
def test_cache_store_evicts_the_oldest(spark, tmp_path, size):
    folder = str(tmp_path / "cache")
    rng = random.Random(size)
    rows = [(f"k{i}", 0.5, rng.randint(0, 4) * 3600 + rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, score double, s int").withColumn("ts", F.timestamp_seconds("s"))
    cachestore.add_scores(df, folder, 4)
    assert cachestore.evict(spark, folder, size) == max(0, 200 - size)
    want = {k for k, _, _ in sorted(rows, key=lambda r: (-r[2], r[0]))[:size]}
    assert {r["key"] for r in cachestore.read_scores(spark, folder).collect()} == want


# --- judge pool ----------------------------------------------------------------------------------

SCHEMA = "request_id bigint, prompt string, completion string, answer string, answer_type string, ts timestamp"


def _add(spark, folder, ids, prompt=lambda i: f"p{i}"):
    rows = [(i, prompt(i), "c", "a", "t") for i in ids]
    df = spark.createDataFrame(rows, "request_id bigint, prompt string, completion string, answer string, answer_type string")
    df.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(folder)


def _sizes(batch):
    return pd.DataFrame({"score": [float(len(batch))] * len(batch), "explanation": [""] * len(batch)})


@pytest.mark.parametrize(("ttl", "judged"), [(3600, 1), (1, 2)])
def test_scores_expire(spark, tmp_path, ttl, judged):
    folder = str(tmp_path / "in")
    for i in (1, 2):
        _add(spark, folder, [i], lambda _: "same")
        requests = spark.readStream.schema(SCHEMA).parquet(folder)
        stream.start_judging(requests, str(tmp_path / "out"), str(tmp_path / "check"), judge=_sizes, ttl_seconds=ttl, buckets=2).awaitTermination()
        time.sleep(1.5)
    figures = stream.stream_metrics(spark, str(tmp_path / "out")).first()
    assert (figures["requests"], figures["judged"], figures["judge_batches"]) == (2, judged, judged)


def test_calls_are_made_by_size_or_by_time(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _add(spark, folder, range(70))
    _add(spark, folder, range(100, 110), lambda i: f"p{i - 100}")  # repeats
    requests = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.start_judging(requests, out, str(tmp_path / "check"), judge=_sizes, interval="100 milliseconds", wait_ms=2000, buckets=1)
    try:
        end, rows = time.time() + 90, []
        while time.time() < end and len(rows) < 80:
            time.sleep(1)
            try:
                rows = stream.answers(spark, out).collect()
            except AnalysisException:  # nothing answered so far
                rows = []
    finally:
        query.stop()
    assert len(rows) == 80 and sum(r["calls"] for r in rows) == 3 and sum(r["judged"] for r in rows) == 70
    assert {r["score"] for r in rows if r["judged"]} == {32.0, 6.0}
    late = [r for r in rows if r["score"] == 6.0]
    assert late and max(r["waited_ms"] for r in late) >= 2000
    assert len({r["key"] for r in rows}) == 70 and len({r["request_id"] for r in rows}) == 80


# --- windows -------------------------------------------------------------------------------------


@pytest.mark.parametrize("every", [2, 50])
def test_late_rows_count(spark, tmp_path, every):
    folder = str(tmp_path / "in")
    hours = [10, 3, 12, 1, 12, 30, 2, 29]
    for h in hours:
        spark.range(5).select(F.timestamp_seconds(F.lit(1_700_006_400 + h * 3600) + F.col("id")).alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    requests = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    stream.start_window_counts(requests, out, str(tmp_path / "check"), "1 hour", "1 hour", every=every).awaitTermination()
    rows = stream.window_counts(spark, out, "1 hour").collect()
    assert {(r["window_start"].timestamp() - 1_700_006_400) // 3600: r["requests"] for r in rows} == {h: 5 * hours.count(h) for h in hours}
    assert sum(r["requests"] for r in rows) == 40 and 10 <= sum(r["late"] for r in rows) <= 20
    assert sum(r["closed"] for r in rows) >= 5


# --- gated accuracy ------------------------------------------------------------------------------


def test_gated_accuracy_of_a_judge_table_and_of_a_column(spark):
    from rewardframe.operators.rewards import gated_accuracy, needs_judging

    good = "<REASONING>why</REASONING><ANSWER>{}</ANSWER>"
    texts = [good.format(4), good.format(5), "no tags 4", None]
    df = spark.createDataFrame([(i, t, "4") for i, t in enumerate(texts)], "id int, completion string, answer string")
    hit = F.col("completion").contains(F.col("answer")).cast("double")
    by_column = gated_accuracy(df, hit, ["id"])
    by_table = gated_accuracy(df, needs_judging(df).select("id", hit.alias("accuracy")), ["id"])
    columns = ["id", "format_reward", "accuracy", "reward", "skipped", "reason"]
    got = sorted(tuple(r) for r in by_column.select(*columns).collect())
    assert got == sorted(tuple(r) for r in by_table.select(*columns).collect()) and len(got) == 4
    assert "Join" not in by_column._jdf.queryExecution().optimizedPlan().toString()


def test_only_judged_rows_are_joined(spark):
    from rewardframe.operators.rewards import judged_rewards, routed_rewards

    rows = [("1", "<answer>4</answer>", "4", "NUMBER"), ("2", "<answer>x</answer>", "y", "ESSAY"), ("3", "<answer>z</answer>", "z", "ESSAY"),
            ("4", None, None, None), ("2", "<answer>x</answer>", "y", "ESSAY"), (None, "<answer>q</answer>", "q", "JUDGE")]
    df = spark.createDataFrame(rows, "k string, completion string, answer string, answer_type string").withColumn("problem_type", F.lit("GENERAL"))
    judged = spark.createDataFrame([("2", 0.25), ("1", 0.5)], "key string, score double")
    keyed = df.join(judged.withColumnRenamed("key", "k"), "k", "left")
    want = routed_rewards(keyed, judge=F.col("score")).select(*df.columns, "acc_reward", "bbox_reward", "reward")
    got = judged_rewards(df, judged, F.col("k"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    by_rule = plan[: plan.index("Join LeftOuter")]
    assert by_rule.startswith("Union") and "GENERAL_CODE" in by_rule  # the rules' rows are scored outside of the join


def test_places_are_computed_by_batches(spark):
    from rewardframe.operators import permute

    n = 1000
    df = spark.range(-1, n).select(F.when(F.col("id") >= 0, F.col("id")).alias("row"))
    placed = df.withColumn("place", permute.place_of(F.col("row"), n, "s"))
    got = {r["row"]: r["place"] for r in placed.collect()}
    assert got.pop(None) is None and sorted(got.values()) == list(range(n))
    assert all(permute.row_at(p, n, "s") == row for row, p in got.items())
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan


def test_useful_steps_shuffle_no_rows(spark):
    from rewardframe.operators import rollout

    rows = [(1, 0.0), (1, 0.0), (2, 0.5), (2, -0.5), (3, None), (4, None), (4, 1.0), (None, 2.0), (5, float("nan")), (2, 0.5)]
    df = spark.createDataFrame(rows, "step int, advantage double")
    out = rollout.useful_steps(df, "step")
    assert sorted(r["step"] for r in out.collect()) == [2, 2, 2, 4, 4, 5]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_generations_are_shuffled_once(spark, tmp_path):
    from rewardframe.sources import tables

    rows = [(None if i % 50 == 7 else 0 if i % 3 else i % 40, i, None if i % 11 == 0 else f"t{i}") for i in range(4000)]
    df = spark.createDataFrame(rows, "s int, id int, text string").repartition(5)
    out = tables.generations(df, F.col("s"), "text", ["id"])
    want = {}
    for s, i, x in rows:
        if s is not None:
            want.setdefault(s, []).append(x)
    got = sorted((r["step"], r["position"], r["text"] or "") for r in out.collect())
    assert got == sorted((s, k, x or "") for s, xs in want.items() for k, x in enumerate(xs))
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    tables.append_records(out, str(tmp_path / "r"), compression="gzip")
    tables.append_records(out, str(tmp_path / "r"))
    assert spark.read.schema("epoch bigint, step bigint, position bigint, text string").json(str(tmp_path / "r")).count() == 2 * len(got)


def test_equal_text_needs_no_edit_distance(spark):
    from rewardframe.functions import rules

    rows = [("A  b", "a b"), ("a\u00a0\tb ", " A b"), ("abcd", "abce"), ("abcd", "wxyz"), ("", "a"), (None, "a"), ("a", None), ("[1,2,3,4]", "1,2"), ("[0,0,2,2]", "[0,0,2,1]")]
    df = spark.createDataFrame(rows, "p string, g string")
    got = df.select("p", "g", rules.ocr_match(F.col("p"), F.array("g")).alias("ocr"), rules.box_iou(F.col("p"), F.col("g")).alias("box")).collect()
    assert [r["ocr"] for r in got] == [1.0, 1.0, 0.75, 0.0, 0.0, 0.0, 0.0, 0.0, pytest.approx(8 / 9)]
    assert [r["box"] for r in got] == [0.0] * 8 + [0.5]


def test_boxes_and_line_numbers_without_cutting_the_text(spark):
    """Equal to plain Python on random texts; most texts are not cut into tokens or lines."""
    rng = random.Random(4)
    parts = ["\\boxed{", "{", "}", "a", "\\", " ", "\n", "12", "3.5", ".", "x7", "\u00a0", "\u2003"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]

    def boxed(t: str) -> str:
        for m in reversed(list(re.finditer(r"\\boxed\{", t))):
            depth = 1
            for i in range(m.end(), len(t)):
                depth += {"{": 1, "}": -1}.get(t[i], 0)
                if depth == 0:
                    return t[m.end():i]
        return ""

    def number(t: str) -> str:
        found = [re.search(r"(?<!\w)(\d+(?:\.\d+)?)(?!\w)\s*\.?\s*\Z", ln) for ln in t.strip().split("\n")]
        return next((m[1] for m in reversed(found) if m), "")

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", extract.boxed_answer(F.col("t")).alias("b"), extract.last_line_number(F.col("t")).alias("n")).collect()
    assert all(r["b"] == boxed(r["t"]) and r["n"] == number(r["t"]) for r in got)
    # The conditions that spare the cutting are in the expressions.
    plan = df.select(extract.tagged_answer(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert extract._LINE_ENDS_IN_DIGIT in plan and "substring_index" in plan


def test_answers_that_cannot_agree_are_not_computed(spark):
    """Methods as by the plain definition; numbers and tuples are read only where both texts may be such."""
    texts = ["1", "1.0", " 1", "$1", "-1", "1/2", ".5", "\\frac{1}{2}", "(1,2)", "(1.0, 2)", "[1,2]", "( 1,2)", "(1,2) ", "a", "A", " a", "", "  ", "\t", "x 1", "\xa01", ":1"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.lower("a"), F.lower("b")
    plain = (
        F.when((F.replace(a, F.lit(" "), F.lit("")) == "") | (F.replace(b, F.lit(" "), F.lit("")) == ""), "none")
        .when(maths.strip(a) == maths.strip(b), "text").when(maths.rounded_tuple(a) == maths.rounded_tuple(b), "tuple")
        .when(F.round(maths.numeric_value(a), 2) == F.round(maths.numeric_value(b), 2), "numeric").otherwise("none")
    )
    method = maths.math_method(F.col("a"), F.col("b"))
    got = df.select("a", "b", method.alias("m"), plain.alias("p")).collect()
    assert all(r["m"] == r["p"] for r in got) and {r["m"] for r in got} == {"none", "text", "tuple", "numeric"}
    assert "< :" in df.select(method)._jdf.queryExecution().optimizedPlan().toString()


def test_options_are_looked_for_at_the_ends(spark):
    texts = ["it is (B).", "x" * 50 + " (C)", "so **D**.", "(a) a\nrest " + "y" * 40, "E\nrest", "(f)\nrest", "(a) b\nrest", " (G) not at the end", "none"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", maths.lenient_answer(F.col("t")).alias("v"))
    assert [r["v"] for r in got.orderBy("k").collect()] == ["b", "c", "d", "a", "e", "f", "", "", ""]
    assert "-6, 6)" in got._jdf.queryExecution().optimizedPlan().toString()
