"""Operators on the message table without positions, and keys that hold most
rows: whole results, and work that spreads over tasks with AQE off."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parley.operators import feedback as FB
from parley.operators import history as H
from parley.operators import preference as PR
from parley.operators import prompts as P
from parley.operators import requests as RQ
from parley.operators import skew as S
from parley.sources.fixtures import chat_tables

from conftest import SF_SMALL


@pytest.fixture()
def no_aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _one_conversation(spark):
    """All messages of even conversations in one, some at the same time, some at none."""
    m = chat_tables(spark, SF_SMALL).messages.drop("turn")
    cid = F.when(F.col("conversation_id") % 2 == 0, F.lit(0).cast("bigint")).otherwise(F.col("conversation_id"))
    at = F.when(F.col("id") % 17 == 0, F.lit(None)).when(F.col("id") % 5 == 0, F.lit(1000)).otherwise(F.col("created_s")).cast("bigint")
    return m.withColumn("conversation_id", cid).withColumn("created_s", at)


def test_positions_over_range_partitions(spark, no_aqe):
    m = _one_conversation(spark)
    got = S.numbered_in_group(m.select("id", "conversation_id", "created_s"), "conversation_id",
                              [F.col("created_s").asc_nulls_last(), F.col("id").asc()], "turn")
    w = Window.partitionBy("conversation_id").orderBy(F.col("created_s").asc_nulls_last(), "id")
    want = {r.id: r.turn for r in m.select("id", (F.row_number().over(w) - 1).alias("turn")).collect()}
    assert {r.id: r.turn for r in got.collect()} == want
    ranged = m.repartitionByRange("conversation_id", "created_s", "id").filter("conversation_id = 0")
    assert ranged.select(F.spark_partition_id()).distinct().count() >= 4


def test_positions_of_null_groups_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, None, 3), (3, 7, None), (4, 7, 1), (5, 7, 1)], "id long, g long, t long")
    got = S.numbered_in_group(rows, "g", [F.col("t").asc_nulls_last(), F.col("id").asc()], "place")
    assert {r.id: r.place for r in got.collect()} == {2: 0, 1: 1, 4: 0, 5: 1, 3: 2}
    assert S.numbered_in_group(rows.limit(0), "g", [F.col("t").asc()], "place").count() == 0


def test_message_operators_need_no_positions(spark):
    t = chat_tables(spark, SF_SMALL)
    plain = t.messages.drop("turn")

    def rows(df):
        return sorted(map(str, df.collect()))
    for f in (lambda m: FB.feedback_dataset(m, t.feedback), lambda m: FB.previous_message(m).select("id", "prev_id", "prev_role"),
              lambda m: PR.evaluation_dataset(m, t.feedback), lambda m: PR.response_scores(m, t.feedback),
              lambda m: PR.response_scores(m, t.feedback, pairing="next"), H.regenerate_requests, P.hallucination_check,
              lambda m: PR.preference_pairs(PR.response_scores(m, t.feedback))):
        assert rows(f(plain)) == rows(f(t.messages))


@pytest.mark.parametrize("tile", [1, 7, 100000])
def test_tiled_query_answer_pairs(spark, tile):
    m, f = _one_conversation(spark), chat_tables(spark, SF_SMALL).feedback
    got = sorted((r.query_id, r.message_id, r.sum_centi) for r in PR.query_answer_pairs(m, f, tile=tile).collect())
    pm, pf = m.toPandas(), f.toPandas()
    rated = pf[pf["score_centi"].notna()].groupby("message_id")["score_centi"].sum()
    a = pm[pm["role"] == "assistant"].merge(rated, left_on="id", right_index=True)
    j = pm[pm["role"] == "user"].merge(a, on="conversation_id", suffixes=("_u", "_a"))
    j = j[j["created_s_a"] > j["created_s_u"]]
    assert got == sorted(zip(j["id_u"], j["id_a"], j["score_centi"])) and len(got) > 100


def test_pairs_of_one_conversation_spread(spark, no_aqe):
    m, f = _one_conversation(spark), chat_tables(spark, SF_SMALL).feedback
    pairs = PR.query_answer_pairs(m, f, tile=2).filter("conversation_id = 0")
    assert pairs.select(F.spark_partition_id()).distinct().count() >= 8


def _scores(spark, n=300):
    return spark.createDataFrame([("hot" if i % 3 else f"q{i % 7}", f"r{i}", (i * 37) % 201 - 100, i % 4 + 1) for i in range(n)],
                                 "query string, response string, sum_centi long, feedback_count long")


@pytest.mark.parametrize("tile", [1, 16, 100000])
@pytest.mark.parametrize("gap", [0, 20, 75])
def test_tiled_preference_pairs(spark, tile, gap):
    s = _scores(spark)
    rows = [tuple(r) for r in s.collect()]
    for ordered in (True, False):
        want = sorted((q, a, b, int(x * d > y * c)) for q, a, x, c in rows for p, b, y, d in rows
                      if q == p and (a != b if ordered else a < b) and abs(x * d - y * c) > gap * c * d)
        assert sorted(tuple(r) for r in PR.preference_pairs(s, gap, ordered, tile).collect()) == want


def test_preference_pairs_of_one_query_spread(spark, no_aqe):
    hot = PR.preference_pairs(_scores(spark), 20, tile=16).filter("query = 'hot'")
    assert hot.select(F.spark_partition_id()).distinct().count() >= 8


def test_composed_maps_equal_the_fold_in_any_grouping():
    rng = np.random.default_rng(9)
    for trial in range(300):
        limit, ttl, width = int(rng.integers(1, 6)), int(rng.integers(2, 40)), int(rng.integers(40, 120))
        ts = np.sort(rng.integers(0, int(rng.integers(50, 900)), int(rng.integers(1, 120))))
        buckets = [ts[ts // width == b] for b in np.unique(ts // width)]
        maps = [RQ._bucket_map(b, limit, ttl) for b in buckets]
        left = maps[0]
        for m in maps[1:]:
            left = RQ._compose(left, m, limit, ttl)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = RQ._compose(m, right, limit, ttl)
        for state in [(0, None)] + [(int(rng.integers(1, limit + 1)), int(ts[0] - rng.integers(0, ttl + 3))) for _ in range(6)]:
            want = RQ.rate_limit_fold(ts, limit, ttl, state)[2]
            assert RQ._through(state, left, limit, ttl) == want == RQ._through(state, right, limit, ttl), (trial, state)


@pytest.mark.parametrize("limit, span", [(1, 2), (4, 3), (25, 5), (4, 1000)])
def test_gap_free_key_through_spans(spark, limit, span):
    n, ttl_s = 3000, 60
    r = spark.range(n).select("id", F.lit(1).alias("user_id"), F.lit("/x").alias("endpoint"),
                              F.timestamp_micros(F.col("id") * 7_000_000 + F.pmod(F.xxhash64("id"), F.lit(5_000_000))).alias("ts"))
    got = {x.id: (x.allowed, x.remaining) for x in RQ.rate_limit_decisions(r, limit, ttl_s, bucket_ttls=4, span_buckets=span).collect()}
    ts = np.array([x.t for x in r.select(F.unix_micros("ts").alias("t")).orderBy("id").collect()])
    order = np.argsort(ts, kind="stable")
    allowed, remaining, _ = RQ.rate_limit_fold(ts[order], limit, ttl_s * 10**6)
    assert got == {int(i): (bool(a), int(b)) for i, a, b in zip(order, allowed, remaining)}


def test_maps_of_one_key_spread(spark, no_aqe):
    maps = spark.range(2000).select(F.lit("k").alias("_k"), F.col("id").alias("_bucket"), F.lit(1).cast("bigint").alias("n"),
                                    (F.col("id") * 64_000_000).alias("end_us"), F.array(F.col("id") * 64_000_000).alias("head"),
                                    F.array(F.lit(1).cast("bigint")).alias("counts"), F.array(F.col("id") * 64_000_000).alias("lasts"))
    entries = RQ.bucket_entries(maps, 3, 1_000_000, 64)
    assert entries.count() == 2000 and entries.select(F.spark_partition_id()).distinct().count() >= 8


def test_requests_without_a_time_get_a_null_decision(spark):
    r = spark.sql("select * from values (1, 1, '/x', timestamp'2025-01-01'), (2, 1, '/x', null) as t(id, user_id, endpoint, ts)")
    assert sorted((x.id, x.allowed, x.remaining) for x in RQ.rate_limit_decisions(r, 2, 60).collect()) == [(1, True, 1), (2, None, None)]
