"""Queries over training runs, evaluation summaries, splits and reward models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import feedback as fb
from ..operators import preference as pr
from ..operators import reward as RW
from ..operators import training as TR
from ..session import checkpoint_path
from ..sources.fixtures import chat_tables
from .catalog import register
from .oracle_fixtures import with_fixtures as W

SPLIT_SQL = "(((feedback_id % 1000003) * 2654435761 + 0) % 4294967296) % 100 < 20"

_PROGRESS = """
ev as (select session_id, epoch - 1 as epoch, step % 100 as step, 7 as n_epochs, 100 as steps_per_epoch,
              concat('{"eval_loss": ', printf('%.4f', eval_loss), '}') as metrics, created_s as ts_s
       from training_steps)"""


def _progress_events(t):
    s = t.training_steps
    return s.select("session_id", (F.col("epoch") - 1).alias("epoch"), (F.col("step") % 100).alias("step"),
                    F.lit(7).alias("n_epochs"), F.lit(100).alias("steps_per_epoch"),
                    F.concat(F.lit('{"eval_loss": '), F.format_string("%.4f", "eval_loss"), F.lit("}")).alias("metrics"),
                    F.col("created_s").alias("ts_s"))


@register("training_progress", W("""
select session_id,
       arg_max(round((epoch * steps_per_epoch + step + 1) * 100.0 / (n_epochs * steps_per_epoch), 6),
               (ts_s, epoch, step, metrics)) as progress,
       arg_max(metrics, (ts_s, epoch, step, metrics)) as metrics, max(ts_s) as updated_s
from ev group by session_id""", "training_steps", ctes=_PROGRESS))
def q_training_progress(spark, sf_dir):
    return TR.training_progress(_progress_events(chat_tables(spark, sf_dir)))


@register("epoch_stats", W("""
select epoch, count(*) as n_steps, round(avg(eval_loss), 6) as mean_loss, round(min(eval_loss), 6) as min_loss,
       round(max(eval_loss), 6) as max_loss
from training_steps group by epoch""", "training_steps"))
def q_epoch_stats(spark, sf_dir):
    return TR.epoch_stats(chat_tables(spark, sf_dir).training_steps)


@register("checkpoint_retention", W("""
select session_id, step, created_s, eval_loss, rank from (
  select session_id, step, created_s, eval_loss,
         row_number() over (partition by session_id order by step desc, created_s desc, eval_loss asc) as rank
  from training_steps) where rank <= 5""", "training_steps"))
def q_checkpoint_retention(spark, sf_dir):
    s = chat_tables(spark, sf_dir).training_steps.select("session_id", "step", "created_s", "eval_loss")
    return TR.checkpoint_retention(s, 5)


@register("best_checkpoint", W("""
select session_id, arg_min(step, (eval_loss, step)) as best_step, round(min(eval_loss), 6) as best_eval_loss
from training_steps group by session_id""", "training_steps"))
def q_best_checkpoint(spark, sf_dir):
    return TR.best_checkpoint(chat_tables(spark, sf_dir).training_steps)


_EVAL = """
rated as (select message_id, sum(score_centi) as sum_centi, count(*) as n_ratings
          from feedback where score_centi is not null group by message_id),
qa as (select u.id as query_id, u.content as query, a.content as response, r.sum_centi, r.n_ratings
       from messages u join messages a on a.conversation_id = u.conversation_id and a.created_s > u.created_s
       join rated r on r.message_id = a.id where u.role = 'user' and a.role = 'assistant'),
ev as (select query_id, response, round(s::double / n / 100.0, 6) as avg_score, s::double / n as exact
       from (select query_id, query, response, sum(sum_centi) as s, sum(n_ratings) as n
             from qa group by query_id, query, response having sum(n_ratings) >= 2)
       order by exact desc, query_id, response limit 100)"""


_FD = """
fd as (select f.id as feedback_id, u.content as query, a.content as response, f.score_centi / 100.0 as feedback_score
       from feedback f join messages a on a.id = f.message_id and a.role = 'assistant'
       join messages u on u.conversation_id = a.conversation_id and u.turn = a.turn - 1 and u.role = 'user'
       where f.score_centi is not null)"""


@register("train_test_split", W(f"select feedback_id, {SPLIT_SQL} as is_test from fd",
                                "feedback", "messages", ctes=_FD))
def q_train_test_split(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    d = fb.feedback_dataset(t.messages, t.feedback)
    return TR.train_test_split(d, "feedback_id", 20, 0).select("feedback_id", "is_test")


@register("reward_mse", W(f"""
select round(avg(power(m.mean_label - fd.feedback_score, 2)), 6) as mse, count(*) as n
from fd, (select avg(feedback_score) as mean_label from fd where not ({SPLIT_SQL})) m
where {SPLIT_SQL}""", "feedback", "messages", ctes=_FD))
def q_reward_mse(spark, sf_dir):
    """Held-out MSE of the mean-label baseline (the yardstick of the reward model)."""
    t = chat_tables(spark, sf_dir)
    d = TR.train_test_split(fb.feedback_dataset(t.messages, t.feedback), "feedback_id", 20, 0)
    mean_label = d.filter(~F.col("is_test")).agg(F.avg("feedback_score")).scalar()
    return TR.mse(d.filter("is_test").withColumn("prediction", mean_label), "prediction", "feedback_score")


# Least squares of the score on the response's size, fitted on the rows not held out.
MODEL_CTES = _EVAL + "," + _FD + f""",
model as (select regr_slope(feedback_score, length(response) / 1000.0) as slope,
                 regr_intercept(feedback_score, length(response) / 1000.0) as base,
                 avg(feedback_score) as mean_label, count(*) as n_train
          from fd where not ({SPLIT_SQL}))"""
MEAN_REWARD_SQL = """
select coalesce(round(avg(base + slope * length(response) / 1000.0), 6), 0.0) as mean_reward, count(response) as n_samples
from (select * from ev order by exact desc, query_id, response limit 50), model"""


def _split(t):
    return TR.train_test_split(fb.feedback_dataset(t.messages, t.feedback), "feedback_id", 20, 0)


def mean_reward(t):
    """Mean model reward of the 50 best rated pairs of the evaluation set."""
    model = RW.fit_least_squares(_split(t))
    ranked = RW.least_squares_scores(model, pr.evaluation_dataset(t.messages, t.feedback, 2, 100))
    exact = F.col("sum_centi") / F.col("n_ratings")
    return TR.evaluate_summary(ranked, [exact.desc(), "query_id", "response"], "reward", 50)


@register("evaluate_summary", W(MEAN_REWARD_SQL, "feedback", "messages", ctes=MODEL_CTES))
def q_evaluate_summary(spark, sf_dir):
    return mean_reward(chat_tables(spark, sf_dir))


@register("reward_model_eval", W(f"""
select any_value(n_train)::bigint as n_train, count(*) as n_test,
       round(avg(power(base + slope * length(response) / 1000.0 - feedback_score, 2)), 6) as mse,
       round(avg(power(mean_label - feedback_score, 2)), 6) as baseline_mse
from fd, model where {SPLIT_SQL}""", "feedback", "messages", ctes=MODEL_CTES))
def q_reward_model_eval(spark, sf_dir):
    d = _split(chat_tables(spark, sf_dir))
    train = d.filter(~F.col("is_test")).agg(F.avg("feedback_score").alias("mean_label"), F.count(F.lit(1)).alias("n_train"))
    pred = RW.least_squares_scores(RW.fit_least_squares(d), d.filter("is_test")).crossJoin(F.broadcast(train))    # one row
    label = F.col("feedback_score")
    return pred.agg(F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"),
                    F.round(F.avg(F.pow(F.col("reward") - label, 2)), 6).alias("mse"),
                    F.round(F.avg(F.pow(F.col("mean_label") - label, 2)), 6).alias("baseline_mse"))


@register("score_pairs", W(f"""
select feedback_id, round(base + slope * length(response) / 1000.0, 6) as reward
from fd, model where {SPLIT_SQL}""", "feedback", "messages", ctes=MODEL_CTES))
def q_score_pairs(spark, sf_dir):
    """Rewards of the held-out pairs."""
    d = _split(chat_tables(spark, sf_dir))
    scored = RW.least_squares_scores(RW.fit_least_squares(d), d.filter("is_test").select("feedback_id", "query", "response"))
    return scored.select("feedback_id", F.round("reward", 6).alias("reward"))


@register("score_pairs_reloaded", W(f"""
select feedback_id, round(base + slope * length(response) / 1000.0, 6) as reward
from fd, model where {SPLIT_SQL}""", "feedback", "messages", ctes=MODEL_CTES))
def q_score_pairs_reloaded(spark, sf_dir):
    """``score_pairs`` with the model saved to the checkpoint folder and loaded again."""
    d = _split(chat_tables(spark, sf_dir))
    path = checkpoint_path(spark, f"parley-model-{uuid.uuid4().hex}")
    RW.save_model(RW.fit_least_squares(d), path)
    scored = RW.least_squares_scores(RW.load_model(path), d.filter("is_test").select("feedback_id", "query", "response"))
    return scored.select("feedback_id", F.round("reward", 6).alias("reward"))


@register("reward_text_scores", W(f"""
select feedback_id, true as scored from fd where {SPLIT_SQL}""", "feedback", "messages", ctes=_FD))
def q_reward_text_scores(spark, sf_dir):
    """The held-out pairs scored on their texts; SQL can tell which pairs get a score, not its value."""
    d = _split(chat_tables(spark, sf_dir))
    model, _ = RW.train_reward_model(d)
    scored = RW.score_pairs(model, d.filter("is_test").select("feedback_id", "query", "response"))
    return scored.select("feedback_id", (F.col("reward").isNotNull() & ~F.isnan("reward")).alias("scored"))


@register("preference_from_rewards", W("""
select a.query, a.response as response_a, b.response as response_b,
       case when a.sum_centi * b.feedback_count > b.sum_centi * a.feedback_count then 1 else 0 end as preference,
       case when slope * (length(a.response) - length(b.response)) > 0 then 1 else 0 end as predicted,
       round(1.0 / (1.0 + exp(slope * (length(b.response) - length(a.response)) / 1000.0)), 6) as p_a_preferred
from scores a join scores b on a.query = b.query and a.response <> b.response, model
where abs(a.sum_centi * b.feedback_count - b.sum_centi * a.feedback_count) > 20 * a.feedback_count * b.feedback_count""",
    "feedback", "messages", ctes=MODEL_CTES + """,
scores as (select query, response, sum(sum_centi) as sum_centi, sum(n_ratings) as feedback_count
           from qa group by query, response having sum(n_ratings) >= 2)"""))
def q_preference_from_rewards(spark, sf_dir):
    """P(a over b) from the reward model's scores of both responses."""
    t = chat_tables(spark, sf_dir)
    model = RW.fit_least_squares(_split(t))
    pairs = pr.preference_pairs(pr.response_scores(t.messages, t.feedback, 2), 20, ordered=True)
    scored = RW.least_squares_scores(model, pairs, response="response_a", out="reward_a")
    scored = RW.least_squares_scores(model, scored, response="response_b", out="reward_b")
    p = RW.preference_probability(F.col("reward_a"), F.col("reward_b"))
    return scored.select("query", "response_a", "response_b", "preference",
                         (F.col("reward_a") > F.col("reward_b")).cast("int").alias("predicted"),
                         F.round(p, 6).alias("p_a_preferred"))


@register("pairwise_preference", "with recursive " + W("""
select query, response_a, response_b, preference, case when round(p, 9) > 0.5 then 1 else 0 end as predicted, round(p, 6) as p_a_preferred
from (select pairs.*, 1.0 / (1.0 + exp(-(wa * size_a + wb * size_b))) as p
      from pairs, (select wa, wb from newton order by step desc limit 1) where is_test)""", "feedback", "messages", ctes=MODEL_CTES + """,
scores as (select query, response, sum(sum_centi) as sum_centi, sum(n_ratings) as feedback_count
           from qa group by query, response having sum(n_ratings) >= 2),
pairs as (select a.query, a.response as response_a, b.response as response_b,
                 case when a.sum_centi * b.feedback_count > b.sum_centi * a.feedback_count then 1 else 0 end as preference,
                 length(a.response) / 1000.0::double as size_a, length(b.response) / 1000.0::double as size_b,
                 ('0x' || substr(md5(a.query), 1, 4))::int % 100 < 20 as is_test
          from scores a join scores b on a.query = b.query and a.response <> b.response
          where abs(a.sum_centi * b.feedback_count - b.sum_centi * a.feedback_count) > 20 * a.feedback_count * b.feedback_count),
newton as (
  select 0 as step, 0.0::double as wa, 0.0::double as wb
  union all
  select step + 1, wa + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), wb + (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  from (select step, wa, wb, sum((preference - p) * size_a) - wa as ga, sum((preference - p) * size_b) - wb as gb,
               sum(p * (1 - p) * size_a * size_a) + 1 as haa, sum(p * (1 - p) * size_a * size_b) as hab,
               sum(p * (1 - p) * size_b * size_b) + 1 as hbb
        from (select n.*, t.*, 1.0 / (1.0 + exp(-(wa * size_a + wb * size_b))) as p from newton n, pairs t where not is_test) x
        where step < 6 group by step, wa, wb) y)""").removeprefix("with "))
def q_pairwise(spark, sf_dir):
    """P(a over b) for the pairs of held-out queries, fitted on the others' pairs."""
    t = chat_tables(spark, sf_dir)
    pairs = RW.held_out_queries(RW.pair_sizes(pr.preference_pairs(pr.response_scores(t.messages, t.feedback, 2), 20, ordered=True)))
    weights = RW.fit_pairwise(pairs.filter("not is_test"))
    return RW.pairwise_scores(weights, pairs.filter("is_test")).select(
        "query", "response_a", "response_b", "preference", "predicted", F.round("p_a_preferred", 6).alias("p_a_preferred"))
