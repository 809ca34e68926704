"""Reward model: disjoint split, finite held-out error, save / load round trip."""

import math
import os

from pyspark.sql import functions as F

from parley.operators import feedback as FB
from parley.operators import reward as RW
from parley.operators import training as TR
from parley.sources.fixtures import chat_tables

from conftest import SF_SMALL


def test_reward_model_fit_save_load(spark, scratch):
    t = chat_tables(spark, SF_SMALL)
    d = TR.train_test_split(FB.feedback_dataset(t.messages, t.feedback), "feedback_id", 30, 0)
    model, metrics = RW.train_reward_model(d)
    m = metrics.collect()[0]
    assert m.n_train + m.n_test == d.count() and m.n_test > 0
    assert math.isfinite(m.mse)
    path = os.path.join(scratch, "reward_model")
    RW.save_model(model, path)
    again = RW.load_model(path)
    a = RW.score_pairs(model, d.select("feedback_id", "query", "response")).orderBy("feedback_id")
    b = RW.score_pairs(again, d.select("feedback_id", "query", "response")).orderBy("feedback_id")
    assert [r.reward for r in a.collect()] == [r.reward for r in b.collect()]


def test_planted_signal_beats_mean(spark):
    # label = +1 when the response mentions "good", −1 otherwise: learnable
    words = ["good answer here", "bad answer here", "good reply", "poor reply", "good", "awful"]
    rows = [(i, f"q{i % 7}", words[i % len(words)], 1.0 if "good" in words[i % len(words)] else -1.0)
            for i in range(300)]
    d = spark.createDataFrame(rows, "feedback_id bigint, query string, response string, feedback_score double")
    d = TR.train_test_split(d, "feedback_id", 20, 0)
    _, metrics = RW.train_reward_model(d)
    m = metrics.collect()[0]
    assert m.mse < m.baseline_mse


def test_newton_steps_equal_the_optimum(spark):
    """The gradient of the penalised likelihood vanishes, and the held-out label is met better than by chance."""
    import numpy as np
    from pyspark.sql import functions as F
    from parley.operators import reward as R
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 3))
    y = (r.random(600) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.5]))))).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "f1 double, f2 double, f3 double, preference int")
    w = np.array(R.fit_pairwise(df, ("f1", "f2", "f3"), ridge=0.5, steps=9))
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-(x @ w)))) - 0.5 * w).max() < 1e-6
    s = R.pairwise_scores(w.tolist(), df, ("f1", "f2", "f3"))
    assert s.filter(F.col("predicted") == F.col("preference")).count() > 420
    assert R.fit_pairwise(df.limit(0), ("f1", "f2")) == [0.0, 0.0]


def test_queries_are_held_out_whole(spark):
    from parley.operators import reward as R
    df = spark.createDataFrame([(f"q{i % 50}", i) for i in range(500)], "query string, i long")
    sides = {(r.query, r.is_test) for r in R.held_out_queries(df).collect()}
    assert len(sides) == 50 and 0 < sum(t for _, t in sides) < 30


def test_sample_of_any_size_is_the_first_rows_in_key_order(spark):
    from parley.operators import preference as PR
    pool = spark.createDataFrame([(f"q{i % 90}", i % 37) for i in range(700)] + [("same", 1)] * 5, "query string, conversation_id long")
    full = [tuple(r) for r in PR.training_batch(pool, 10000).select("sample_key", "conversation_id", "query").collect()]
    for n, digits in ((0, 1), (1, 4), (70, 1), (350, 2), (704, 4), (705, 1), (9999, 4)):
        got = PR.training_sample(pool, n, digits=digits).select("sample_key", "conversation_id", "query")
        assert sorted(map(tuple, got.collect())) == full[:n], n


def test_merged_sketches_keep_their_bound(spark):
    from pyspark.sql import functions as F
    from parley.operators import chunks as CH
    rows = spark.range(60000).select((F.col("id") % 300).alias("minute"), (F.col("id") % 2).alias("m"),
                                     F.pmod(F.xxhash64("id"), F.lit(90000)).alias("inference_time_ms"))
    merged = CH.merge_sketches(CH.latency_sketches(rows, ["m", "minute"]), ["m"])
    for q in (0.05, 0.5, 0.95, 0.99):
        for r in merged.select("m", "n", CH.sketch_quantile(q).alias("x")).collect():
            own = rows.filter(F.col("m") == r.m)
            below, upto = (own.filter(c).count() / r.n for c in (F.col("inference_time_ms") < r.x, F.col("inference_time_ms") <= r.x))
            assert r.n == 30000 and below <= q + CH.RANK_ERROR and upto >= q - CH.RANK_ERROR


def test_text_fits_take_one_task_a_core(spark):
    """Each task of a pass shuffles a gradient of all features, so passes have no more tasks than cores."""
    sc = spark.sparkContext
    rows = [(i, f"q{i % 7} word{i % 31}", f"answer {i % 13}", (i % 5) - 2.0, i % 2) for i in range(400)]
    d = spark.createDataFrame(rows, "feedback_id bigint, query string, response string, feedback_score double, preference int").repartition(40)
    pairs = d.select("query", F.col("response").alias("response_a"), F.lit("other").alias("response_b"), "preference")
    for name, fit in (("reward", lambda: RW.train_reward_model(TR.train_test_split(d, "feedback_id", 20, 0))),
                      ("pairwise", lambda: RW.train_pairwise_model(pairs, num_features=256, max_iter=5))):
        sc.setJobGroup(f"fit-{name}", name)
        fit()
        sc.setLocalProperty("spark.jobGroup.id", None)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"fit-{name}")]
        tasks = [sc.statusTracker().getStageInfo(s).numTasks for j in jobs if j for s in j.stageIds]
        wide = [n for n in tasks if n > sc.defaultParallelism]
        assert len(tasks) > 5 and len(wide) <= 1, (name, tasks)   # the rows are persisted once
