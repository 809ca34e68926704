"""Sources and sinks: topic files round trip, appends with defaults, caches."""

import os

import pytest

from pyspark.sql import functions as F

from parley.operators import tasks as TK
from parley.sources import sinks, topics
from parley.sources.fixtures import chat_tables

from conftest import SF_SMALL


def test_topic_file_round_trip(spark, scratch):
    t = chat_tables(spark, SF_SMALL)
    rec = TK.encode_requests(t.agent_tasks)
    path = os.path.join(scratch, "topics")
    topics.write_topics(rec, path=path)
    back = topics.read_topics(spark, ["training_requests", "evaluation_requests"], path=path, streaming=False)
    assert sorted(back.select("topic", "key", "value").collect()) == sorted(rec.collect())
    dec = TK.decode_requests(back)
    assert dec.filter(F.col("task_id").isNull()).count() == 0
    assert {r.type for r in dec.select("type").distinct().collect()} == {"rlhf_training", "supervised_training", "model_evaluation"}


def test_new_rows_get_defaults(spark):
    req = spark.createDataFrame([(1, "trainer", "start_rlhf_training", '{"a": 1}', None),
                                 (2, "support", "analyze_user_feedback", "{}", 9)],
                                "id bigint, agent_type string, task_type string, input_data string, priority int")
    rows = {r.id: r for r in sinks.new_tasks(req, 100).collect()}
    assert rows[1].priority == 5 and rows[1].status == "pending" and rows[1].started_s is None
    assert rows[2].priority == 9
    conv = spark.createDataFrame([(1, 7, None, "be nice")],
                                 "id bigint, user_id bigint, model_version string, system_prompt string")
    c = sinks.new_conversations(conv, 50).collect()[0]
    assert c.model_version == "deepseek-v1.0" and c.is_archived is False and c.title is None


def test_cache_expiry(spark, scratch):
    df = spark.range(5).withColumnRenamed("id", "x")
    root = os.path.join(scratch, "cache")
    sinks.write_cache(df, root, "batch_1", as_of=1000, ttl_s=3600)
    assert sinks.read_cache(spark, root, "batch_1", as_of=4599).count() == 5
    assert sinks.read_cache(spark, root, "batch_1", as_of=4600).count() == 0


def test_append_and_json_export(spark, scratch):
    t = chat_tables(spark, SF_SMALL)
    path = os.path.join(scratch, "messages")
    sinks.append_parquet(t.messages.limit(10), path)
    sinks.append_parquet(t.messages.limit(10), path)
    assert spark.read.parquet(path).count() == 20
    out = os.path.join(scratch, "backup")
    from parley.operators.feedback import feedback_backup
    b = feedback_backup(t.feedback, t.messages, as_of=10**9, days=100000)
    sinks.write_json(b, out)
    assert spark.read.json(out).count() == b.count()


def test_append_checked_and_blank_messages(spark, scratch):
    from parley.functions.text import composite_key
    from parley.operators.quality import FEEDBACK_TYPES
    fb = spark.createDataFrame([(1, "thumbs_up", 50), (2, "meh", 10), (3, "report", 300)],
                               "id bigint, feedback_type string, score_centi bigint")
    bad = ~F.col("feedback_type").isin(*FEEDBACK_TYPES) | ~F.col("score_centi").between(-100, 100)
    rejected = sinks.append_checked(fb, os.path.join(scratch, "fb"), bad)
    assert sorted(r.id for r in rejected.collect()) == [2, 3]
    assert [r.id for r in spark.read.parquet(os.path.join(scratch, "fb")).collect()] == [1]
    msgs = spark.createDataFrame([(1, "hi"), (2, "  \n\t"), (3, None), (4, " ")], "id bigint, content string")
    assert [r.id for r in sinks.new_messages(msgs).collect()] == [1]
    k = spark.range(1).select(composite_key("rate_limit", F.lit(7).cast("string"), "/api/chat").alias("k"))
    assert k.collect()[0].k == "rate_limit:7:/api/chat"


def test_a_repeated_append_adds_nothing(spark, scratch):
    from parley.sources import sinks as K
    table, schema = scratch + "/messages", "id bigint, content string"
    one, two = (spark.createDataFrame(rows, schema) for rows in ([(1, "a"), (2, "b")], [(3, "c")]))
    assert K.read_published(spark, table, schema).count() == 0
    K.publish(one, table, "b1")
    K.publish(two, table, "b2")
    K.publish(one, table, "b1")   # the first run's answer was lost
    assert sorted(map(tuple, K.read_published(spark, table, schema).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    # a run that died between its rows and its manifest row
    two.write.parquet(table + "/batch-dead")
    assert K.read_published(spark, table, schema).count() == 3
    K.publish(two, table, "b3")
    assert K.read_published(spark, table, schema, "b3").count() == 1 and K.read_published(spark, table, schema, "none").count() == 0
    assert K.drop_unpublished(spark, table, older_than_s=3600) == 0
    assert K.drop_unpublished(spark, table, older_than_s=-10) == 2   # the dead run's and b1's first version
    assert K.read_published(spark, table, schema).count() == 4


def test_a_checked_append_may_be_repeated(spark, scratch):
    from parley.sources import sinks as K
    schema = "id bigint, feedback_type string, score_centi bigint"
    rows = spark.createDataFrame([(1, "thumbs_up", 100), (2, "nonsense", 0), (3, "rating", 500)], schema)
    for _ in range(2):
        assert sorted(r.id for r in K.append_checked(rows, scratch + "/fb", K.feedback_violation(), "day-1").collect()) == [2, 3]
    assert [r.id for r in K.read_published(spark, scratch + "/fb", schema).collect()] == [1]


def test_a_cache_is_replaced_as_a_whole(spark, scratch, monkeypatch):
    from parley.sources import sinks as K
    old, new = spark.range(3), spark.range(10, 15)
    K.write_cache(old, scratch, "k", 100, 50)
    before = K.read_cache(spark, scratch, "k", 120)
    monkeypatch.setattr(K, "MANIFEST", "no schema at all")
    with pytest.raises(Exception):
        K.write_cache(new, scratch, "k", 110, 50)   # dies before it publishes
    monkeypatch.undo()
    assert K.read_cache(spark, scratch, "k", 120).count() == 3
    K.write_cache(new, scratch, "k", 110, 50)
    assert before.count() == 3   # a reader under way keeps its version
    assert K.read_cache(spark, scratch, "k", 120).count() == 5 and K.read_cache(spark, scratch, "k", 160).count() == 0


def test_rewrites_leave_other_buckets_alone(spark, scratch):
    from parley.operators.history import last_login
    from parley.sources import sinks as K
    path = scratch + "/users"
    users = spark.range(200).select("id", F.lit(None).cast("bigint").alias("last_login_s"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"))
    K.write_keyed(users, path, "id", 16)

    def files():
        return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    logins = spark.createDataFrame([(5, 900), (5, 950), (77, 40)], "id bigint, ts_s bigint")
    touched = K.rewrite_keyed(spark, path, logins, "id", lambda rows, ch: last_login(rows, ch.withColumnRenamed("id", "user_id")), 16)
    after = files()
    assert 1 <= len(touched) <= 2
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert changed and all(any(f"_bucket={b}/" in f for b in touched) for f in changed)
    got = {r.id: r.last_login_s for r in spark.read.parquet(path).collect()}
    assert len(got) == 200 and {i: t for i, t in got.items() if t is not None} == {5: 950, 77: 40}
    assert K.rewrite_keyed(spark, path, logins.limit(0), "id", None, 16) == []
