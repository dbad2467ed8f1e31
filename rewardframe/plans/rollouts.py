"""Queries over rollouts: advantages, losses, metrics, candidates (ids F, A10, A11, flagship)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import judging
from ..operators import candidates as cand
from ..operators import rollout
from ..operators.rewards import gated_accuracy, routed_rewards
from ..operators.split import epoch_plan
from ..session import settled
from ..sources import tables as src
from .registry import SCORED, advantage_sql, flag_sql, q6, query, r6, scratch
from .scoring import STRICT_CTE
from .views import Tables


def scored_rollouts(t: Tables) -> DataFrame:
    """Routed rewards of all completions as a narrow table the group statistics read twice."""
    r = routed_rewards(t("rollouts"), "TYPE_BASED_RULE")
    return settled(r.select("id", "g", "step", "reward"))


ADV = f"{SCORED},\nadv AS ({advantage_sql('rewarded', 'id', 'reward', '1e-8')})"


@query("flagship", f"""WITH {ADV} SELECT step, count(*) AS n, {q6('avg(reward)')} AS reward_mean, {q6('coalesce(stddev_samp(reward), 0)')} AS reward_std,
    {q6('avg(advantage)')} AS advantage_mean, {q6('min(advantage)')} AS advantage_min, {q6('max(advantage)')} AS advantage_max FROM adv GROUP BY step""")
def _(t):
    adv = rollout.group_advantages(scored_rollouts(t), "id")
    m = rollout.step_metrics(adv, ["step"])
    return m.select("step", "n", *[r6(F.col(c)).alias(c) for c in m.columns if c not in ("step", "n")])


@query("f1_group_advantages", f"WITH {ADV} SELECT id, g, {q6('advantage')} AS advantage FROM adv")
def _(t):
    a = rollout.group_advantages(scored_rollouts(t), "id")
    return a.select("id", "g", r6(F.col("advantage")).alias("advantage"))


@query("f2_batch_advantages", f"""WITH {SCORED}, a0 AS ({advantage_sql('rewarded', 'id', 'reward', '1e-4')}),
    a1 AS (SELECT id, g, step, advantage AS x FROM a0), a2 AS ({advantage_sql('a1', 'step', 'x', '1e-8', False)})
    SELECT id, g, {q6('advantage')} AS advantage FROM a2""")
def _(t):
    a = rollout.batch_advantages(scored_rollouts(t), "id", "step")
    return a.select("id", "g", r6(F.col("advantage")).alias("advantage"))


@query("f3_useful_steps", f"""WITH {ADV} SELECT id, g, step FROM adv WHERE step IN (SELECT step FROM adv GROUP BY step HAVING sum(abs(advantage)) <> 0)""")
def _(t):
    adv = rollout.group_advantages(scored_rollouts(t), "id").select("id", "g", "step", "advantage")
    return rollout.useful_steps(settled(adv), "step").select("id", "g", "step")


@query("f4_expand_gold", "SELECT r.id, r.g, length(r.completion) AS chars, o.answer AS gold FROM rollouts r JOIN gold o ON o.id = r.id")
def _(t):
    done = t("rollouts").select("id", "g", F.length("completion").alias("chars"))
    return rollout.with_gold(done, t("gold").select("id", F.col("answer").alias("gold")), "id")


@query("f5_gated_accuracy", f"""WITH {STRICT_CTE} SELECT id, g, fmt AS format_reward, CASE WHEN fmt > 0 THEN {flag_sql('contains(completion, answer)')} ELSE CAST(0 AS DOUBLE) END AS accuracy,
    CASE WHEN fmt > 0 THEN 0.5 + {flag_sql('contains(completion, answer)')} ELSE CAST(0 AS DOUBLE) END AS reward, CASE WHEN fmt = 0 THEN 'format_reward_zero' END AS reason FROM graded""")
def _(t):
    judge = F.floor(judging.rule_judge(F.lit(""), F.col("completion"), F.col("answer"))["score"]).cast("double")
    out = gated_accuracy(t("rollouts"), judge, ["id", "g"], w_format=0.5)
    return out.select("id", "g", "format_reward", "accuracy", "reward", "reason")


# --- token arrays: log-probabilities made from the embeddings ------------------------------------

_MASK = "list_transform(pi, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)"
LOGPS = f"""m AS (SELECT id, grp, CAST(advantage AS DOUBLE) AS advantage, list_transform(pi, lambda x: CAST(x AS DOUBLE)) AS pi, list_transform(ref, lambda x: CAST(x AS DOUBLE) * 0.75 - 0.125) AS ref, {_MASK} AS mask FROM logps),
z AS (SELECT id, grp, advantage, unnest(pi) AS p, unnest(ref) AS r, unnest(mask) AS k FROM m),
k AS (SELECT id, any_value(grp) AS grp, any_value(advantage) AS advantage, sum(p * k) / greatest(sum(k), 1e-8) AS mean_pi, sum((p - r) * k) / greatest(sum(k), 1.0) AS signed,
  sum((exp(r - p) - (r - p) - 1.0) * k) / greatest(sum(k), 1.0) AS kl,
  sum(((exp(r - p) - (r - p) - 1.0) * 0.02 - advantage) * k) / greatest(sum(k), 1.0) AS loss FROM z GROUP BY id)"""


def _logps(t: Tables) -> DataFrame:
    pi = F.col("embedding").cast("array<double>")
    return t("embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("grp"),
        (F.col("label") % 3 - 0.5).alias("advantage"), pi.alias("pi"),
        F.transform(pi, lambda x: x * 0.75 - 0.125).alias("ref"),
        F.transform(pi, lambda x: F.when(x > 0, 1.0).otherwise(0.0)).alias("mask"),
    )


@query("f6_masked_mean", f"WITH {LOGPS} SELECT id, {q6('mean_pi')} AS mean_pi FROM k")
def _(t):
    return _logps(t).select("id", r6(rollout.masked_mean(F.col("pi"), F.col("mask"))).alias("mean_pi"))


@query("f7_sequence_kl", f"WITH {LOGPS} SELECT {q6('avg(signed)')} AS kl, count(*) AS n FROM k")
def _(t):
    kl = rollout.sequence_kl(F.col("pi"), F.col("ref"), F.col("mask"))
    return _logps(t).agg(r6(F.avg(kl)).alias("kl"), F.count("*").alias("n"))


@query("f8_token_loss", f"WITH {LOGPS} SELECT CAST(grp AS BIGINT) AS grp, {q6('avg(loss)')} AS loss, {q6('avg(kl)')} AS kl_mean, {q6('avg(signed)')} AS kl_signed FROM k GROUP BY grp")
def _(t):
    out = rollout.loss_and_kl(_logps(t), 0.02, ["grp"])
    return out.select("grp", *[r6(F.col(c)).alias(c) for c in ("loss", "kl_mean", "kl_signed")])


@query("f9_step_metrics", f"""WITH {ADV} SELECT a.step, count(*) AS n, {q6('avg(reward)')} AS reward_mean, {q6('coalesce(stddev_samp(reward), 0)')} AS reward_std,
    {q6('avg(advantage)')} AS advantage_mean, {q6('avg(length(r.completion))')} AS response_length FROM adv a JOIN rollouts r ON r.id = a.id AND r.g = a.g GROUP BY a.step""")
def _(t):
    r = routed_rewards(t("rollouts"), "TYPE_BASED_RULE")
    rows = settled(r.select("id", "g", "step", "reward", F.length("completion").alias("chars")))
    m = rollout.step_metrics(rollout.group_advantages(rows, "id"), ["step"], length="chars")
    return m.select("step", "n", *[r6(F.col(c)).alias(c) for c in ("reward_mean", "reward_std", "advantage_mean", "response_length")])


@query("f10_validation_reward", f"""WITH {SCORED}, o AS (SELECT id, floor((row_number() OVER (ORDER BY md5('7-' || id), id) - 1) / 16) AS batch FROM gold)
    SELECT {q6('avg(s.reward)')} AS mean_reward, count(*) AS n FROM o JOIN rewarded s ON s.id = o.id WHERE o.batch < 20 AND s.g = 0""")
def _(t):
    plan = epoch_plan(t("gold"), "id", 7, 0, 16).select("id", "batch")
    first = routed_rewards(t("rollouts").filter("g = 0"), "TYPE_BASED_RULE").select("id", "reward")
    v = rollout.validation_reward(first.join(plan.filter("batch < 20"), "id"), "batch", "reward", 20)
    return v.select(r6(F.col("mean_reward")).alias("mean_reward"), "n")


@query("f11_compare_methods", f"""WITH {SCORED} SELECT prompt_type, {q6('avg(bbox_reward)')} AS mean_format, {q6('avg(acc_reward)')} AS mean_accuracy, count(*) AS n FROM rewarded GROUP BY prompt_type""")
def _(t):
    m = rollout.compare_methods(routed_rewards(t("rollouts"), "TYPE_BASED_RULE"), "prompt_type", "bbox_reward", "acc_reward")
    return m.select("prompt_type", r6(F.col("mean_format")).alias("mean_format"), r6(F.col("mean_accuracy")).alias("mean_accuracy"), "n")


@query("f12_eval_summary", f"SELECT count(*) AS samples, {q6('coalesce(sum(latency), 0)')} AS total_s, {q6('coalesce(sum(latency), 0) / greatest(count(*), 1)')} AS mean_s FROM replies")
def _(t):
    s = rollout.eval_summary(t("replies"), "latency")
    return s.select("samples", r6(F.col("total_s")).alias("total_s"), r6(F.col("mean_s")).alias("mean_s"))


# --- candidates ----------------------------------------------------------------------------------

SOFTMAX = """mx AS (SELECT *, max(score) OVER (PARTITION BY grp) AS top FROM cands),
sm AS (SELECT *, score - top - ln(sum(exp(score - top)) OVER (PARTITION BY grp)) AS logp FROM mx)"""


@query("f13_log_softmax", f"WITH {SOFTMAX} SELECT grp, cand, {q6('logp')} AS logp FROM sm")
def _(t):
    return cand.with_log_softmax(t("cands"), "grp", "score").select("grp", "cand", r6(F.col("logp")).alias("logp"))


@query("f13_target_logp", f"""WITH {SOFTMAX}, tg AS (SELECT grp, min(cand) AS target FROM cands GROUP BY grp)
    SELECT tg.grp, target, {q6("CASE WHEN target % 5 = 0 THEN 0.0 ELSE logp END")} AS logp FROM tg JOIN sm ON sm.grp = tg.grp AND sm.cand = tg.target""")
def _(t):
    rows = t("cands")
    targets = rows.groupBy("grp").agg(F.min("cand").alias("target")).withColumn("ignored", F.col("target") % 5 == 0)
    out = cand.target_logp(rows, targets, "grp", "cand", "score")
    return out.select("grp", "target", r6(F.col("logp")).alias("logp"))


@query("f14_top_k", "SELECT grp, cand, score FROM (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score DESC) AS r FROM cands) WHERE r <= 5")
def _(t):
    return cand.top_k(t("cands"), "grp", "score", 5).select("grp", "cand", "score")


@query("f15_nucleus", f"""WITH {SOFTMAX}, c AS (SELECT *, sum(exp(logp)) OVER (PARTITION BY grp ORDER BY score DESC, cand ROWS UNBOUNDED PRECEDING) AS cum FROM sm)
    SELECT grp, cand, {q6('exp(logp)')} AS prob FROM c WHERE cum - exp(logp) <= 0.9""")
def _(t):
    return cand.nucleus(t("cands"), "grp", "cand", "score", 0.9).select("grp", "cand", r6(F.col("prob")).alias("prob"))


# --- records as JSON lines -----------------------------------------------------------------------

@query("a10_append_records", """SELECT id, latency, CASE WHEN coalesce(reply, '') = '' THEN FALSE ELSE TRUE END AS ok FROM replies
    UNION ALL SELECT id, -1.0, TRUE FROM qa""")
def _(t):
    path = scratch(t.spark)
    src.append_records(t("replies").select("id", "latency", (F.coalesce("reply", F.lit("")) != "").alias("ok")), path)
    src.append_records(t("qa").select("id", F.lit(-1.0).alias("latency"), F.lit(True).alias("ok")), path)
    return t.spark.read.schema("id bigint, latency double, ok boolean").json(path)


@query("a10_append_once", """SELECT id, latency, CASE WHEN coalesce(reply, '') = '' THEN FALSE ELSE TRUE END AS ok FROM replies
    UNION ALL SELECT id, -1.0, TRUE FROM qa""")
def _(t):
    path = scratch(t.spark)
    for _ in range(2):  # as after a job that did not hear of its own success
        src.append_records(t("replies").select("id", "latency", (F.coalesce("reply", F.lit("")) != "").alias("ok")), path, "replies")
        src.append_records(t("qa").select("id", F.lit(-1.0).alias("latency"), F.lit(True).alias("ok")), path, "qa")
    return src.read_records(t.spark, path, "id bigint, latency double, ok boolean")


@query("a10_generations", """SELECT step, CAST(1 AS BIGINT) AS epoch, count(*) AS num_samples, md5(string_agg(completion, '|' ORDER BY id, g)) AS texts FROM rollouts GROUP BY step""")
def _(t):
    path = scratch(t.spark)
    src.append_records(src.generations(t("rollouts"), F.col("step"), "completion", ["id", "g"]), path, compression="gzip")
    back = src.generation_records(t.spark.read.schema("epoch bigint, step bigint, position bigint, text string").json(path))
    return back.select("step", "epoch", "num_samples", F.md5(F.array_join("gen_texts", "|")).alias("texts"))


@query("a11_eval_records", f"""SELECT r.id AS idx, q.user_text AS prompt, coalesce(r.reply, '') AS pred, r.latency AS latency_s, CAST(0.5 AS DOUBLE) AS accuracy FROM replies r JOIN qa q ON q.id = r.id""")
def _(t):
    path = scratch(t.spark)
    rows = t("replies").join(t("qa").select("id", "user_text"), "id").select(
        F.col("id").alias("idx"), F.col("user_text").alias("prompt"), F.coalesce("reply", F.lit("")).alias("pred"),
        F.col("latency").alias("latency_s"), F.struct(F.lit(1.0).alias("format"), F.lit(0.5).alias("accuracy")).alias("score"),
    )
    src.append_records(rows, path)
    return src.read_eval_records(t.spark, path).select("idx", "prompt", "pred", "latency_s", "score.accuracy")
