"""Hot keys: one conversation / one limiter key holding a third of the rows.

Results must be whole and equal to a brute-force computation, also when AQE
splits the skewed partitions (thresholds lowered so the split really happens
on test-sized data)."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators import feedback as FB
from parley.operators import preference as PR
from parley.operators import requests as RQ
from parley.sources.fixtures import chat_tables

from conftest import SF_SMALL

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _hot_messages(spark):
    """Every conversation with id % 3 == 0 is folded into conversation 0, with
    dense positions in time order: one conversation holds a third of the rows."""
    m = chat_tables(spark, SF_SMALL).messages
    hot = F.col("conversation_id") % 3 == 0
    m = m.withColumn("conversation_id", F.when(hot, F.lit(0).cast("bigint")).otherwise(F.col("conversation_id")))
    w = Window.partitionBy("conversation_id").orderBy("created_s", "id")
    return m.withColumn("turn", (F.row_number().over(w) - 1).cast("bigint"))


def test_previous_user_pairs_with_hot_conversation(spark, skew_conf):
    m = _hot_messages(spark)
    f = chat_tables(spark, SF_SMALL).feedback
    got = sorted((r.feedback_id, r.query, r.response) for r in FB.feedback_dataset(m, f).collect())
    pm, pf = m.toPandas(), f.toPandas()
    pm = pm.sort_values(["conversation_id", "turn"])
    prev = pm.assign(turn=pm["turn"] + 1)[["conversation_id", "turn", "role", "content"]] \
             .rename(columns={"role": "prev_role", "content": "query"})
    j = pm.merge(prev, on=["conversation_id", "turn"])
    j = j[(j["role"] == "assistant") & (j["prev_role"] == "user")]
    r = pf[pf["score_centi"].notna()].merge(j, left_on="message_id", right_on="id")
    want = sorted(zip(r["id_x"], r["query"], r["content"]))
    assert got == want and len(got) > 0
    share = pm["conversation_id"].eq(0).mean()
    assert share > 0.3


def test_evaluation_pairs_with_hot_conversation(spark, skew_conf):
    m = _hot_messages(spark)
    f = chat_tables(spark, SF_SMALL).feedback
    got = {(r.query, r.response): (r.sum_centi, r.feedback_count)
           for r in PR.response_scores(m, f, min_count=1).collect()}
    pm, pf = m.toPandas(), f.toPandas()
    rated = pf[pf["score_centi"].notna()].groupby("message_id")["score_centi"].agg(["sum", "count"])
    u = pm[pm["role"] == "user"]
    a = pm[pm["role"] == "assistant"].merge(rated, left_on="id", right_index=True)
    j = u.merge(a, on="conversation_id", suffixes=("_u", "_a"))
    j = j[j["created_s_a"] > j["created_s_u"]]
    g = j.groupby(["content_u", "content_a"]).agg(s=("sum", "sum"), n=("count", "sum"))
    want = {k: (int(v.s), int(v.n)) for k, v in g.iterrows()}
    assert got == want and len(got) > 0


def test_rate_limiter_hot_key_is_whole(spark, skew_conf):
    r = chat_tables(spark, SF_SMALL).requests
    # a third of all requests come from one user on one endpoint
    r = r.withColumn("user_id", F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")))
    got = {row.id: (row.allowed, row.remaining) for row in RQ.rate_limit_decisions(r, 5, 3600).collect()}
    pdf = r.select("id", "user_id", "endpoint", F.unix_micros("ts").alias("t")).toPandas()
    want = {}
    for _, g in pdf.sort_values(["t", "id"]).groupby(["user_id", "endpoint"], sort=False):
        count, last = 0, None
        for i, t in zip(g["id"], g["t"]):
            if last is not None and t - last >= 3600 * 10**6:
                count = 0
            if count < 5:
                want[i] = (True, 5 - count - 1)
                count, last = count + 1, t
            else:
                want[i] = (False, 0)
    assert got == want and len(got) == pdf.shape[0]
    assert isinstance(pdf, pd.DataFrame)


def _brute_limiter(pdf, limit, ttl_s, keys):
    want = {}
    for _, g in pdf.sort_values(["t", "id"]).groupby(keys, sort=False):
        count, last = 0, None
        for i, t in zip(g["id"], g["t"]):
            if last is not None and t - last >= ttl_s * 10**6:
                count = 0
            if count < limit:
                want[i] = (True, limit - count - 1)
                count, last = count + 1, t
            else:
                want[i] = (False, 0)
    return want


@pytest.mark.parametrize("ttl_s,span", [(60, 64), (3600, 2), (7200, 1), (86400, 3)])
def test_limiter_buckets_equal_brute_force(spark, ttl_s, span):
    r = chat_tables(spark, SF_SMALL).requests
    r = r.withColumn("user_id", F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("user_id")))
    got = {row.id: (row.allowed, row.remaining) for row in RQ.rate_limit_decisions(r, 3, ttl_s, bucket_ttls=span).collect()}
    pdf = r.select("id", "user_id", "endpoint", F.unix_micros("ts").alias("t")).toPandas()
    assert got == _brute_limiter(pdf, 3, ttl_s, ["user_id", "endpoint"])


@pytest.mark.parametrize("limit", [1, 4, 25])
def test_gap_free_key_spread_over_buckets(spark, limit):
    """One key without an idle gap, over many buckets; a null key beside it."""
    n, ttl_s = 3000, 60
    r = spark.range(n).select("id", F.when(F.col("id") % 10 != 0, F.lit(1)).alias("user_id"), F.lit("/x").alias("endpoint"),
                              F.timestamp_micros(F.col("id") * 7_000_000 + F.pmod(F.xxhash64("id"), F.lit(5_000_000))).alias("ts"))
    got = RQ.rate_limit_decisions(r, limit, ttl_s, bucket_ttls=8).collect()
    pdf = r.select("id", F.coalesce("user_id", F.lit(-1)).alias("user_id"), "endpoint", F.unix_micros("ts").alias("t")).toPandas()
    assert {x.id: (x.allowed, x.remaining) for x in got} == _brute_limiter(pdf, limit, ttl_s, ["user_id", "endpoint"])
    assert n * 7 / (8 * ttl_s) > 40   # buckets of the dense key


def test_bucket_maps_equal_the_fold_for_any_state():
    import numpy as np
    rng = np.random.default_rng(3)
    for trial in range(400):
        limit, ttl = int(rng.integers(1, 6)), int(rng.integers(2, 40))
        ts = np.sort(rng.integers(100, 100 + int(rng.integers(1, 400)), int(rng.integers(1, 60))))
        m = RQ._bucket_map(ts, limit, ttl)
        states = [(0, None)] + [(int(rng.integers(1, limit + 1)), int(ts[0] - rng.integers(0, ttl + 3))) for _ in range(8)]
        for state in states:
            assert RQ._through(state, m, limit, ttl) == RQ.rate_limit_fold(ts, limit, ttl, state)[2], (trial, state)


def test_rate_limiter_takes_text_ids_and_jumps(spark):
    import numpy as np
    r = chat_tables(spark, SF_SMALL).requests.withColumn("id", F.concat(F.lit("r-"), F.lpad(F.col("id").cast("string"), 8, "0")))
    got = {row.id: (row.allowed, row.remaining) for row in RQ.rate_limit_decisions(r, 3, 7200).collect()}
    pdf = r.select("id", "user_id", "endpoint", F.unix_micros("ts").alias("t")).toPandas()
    assert got == _brute_limiter(pdf, 3, 7200, ["user_id", "endpoint"])
    rng = np.random.default_rng(1)
    for limit, ttl in ((1, 5), (3, 50), (7, 400)):
        ts = np.sort(rng.integers(0, 3000, 400))
        one = RQ.rate_limit_fold(ts, limit, ttl)
        state, parts = None, []
        for cut in np.array_split(ts, 9):   # the state carries across batches
            a, rem, state = RQ.rate_limit_fold(cut, limit, ttl, state)
            parts.append((a, rem))
        assert (np.concatenate([p[0] for p in parts]) == one[0]).all() and (np.concatenate([p[1] for p in parts]) == one[1]).all()
        count, last = 0, None
        for i, t in enumerate(ts.tolist()):
            if last is not None and t - last >= ttl:
                count = 0
            assert one[0][i] == (count < limit)
            if count < limit:
                count, last = count + 1, t
