"""Stream = batch: the stateful and windowed stream forms, fed from a file
source in several micro-batches, give the batch operators' answers."""

import os

import pytest
from pyspark.sql import functions as F

from parley.operators import chunks as CH
from parley.operators import requests as RQ
from parley.sources.fixtures import chat_tables
from parley.streaming import stateful as ST
from parley.streaming import windows as SW

from conftest import SF_SMALL


def _link_in_order(src, dst, i):
    """The file source reads files in modification-time order: stamp them."""
    os.link(src, dst)
    os.utime(dst, (1_600_000_000 + i, 1_600_000_000 + i))


def _run(df, scratch, name):
    out, ck = os.path.join(scratch, name), os.path.join(scratch, name + "_ck")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
           .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.read.parquet(out)


def _requests_stream(spark, scratch):
    t = chat_tables(spark, SF_SMALL)
    src = os.path.join(scratch, "requests_src")
    # one file per day → several micro-batches in time order
    (t.requests.withColumn("day", F.date_format("ts", "yyyyMMdd"))
       .repartition("day").write.partitionBy("day").json(src))
    schema = "id bigint, user_id bigint, endpoint string, status int, latency_ms bigint, ts timestamp"
    files = sorted(os.path.join(r, f) for r, _, fs in os.walk(src) for f in fs if f.endswith(".json"))
    flat = os.path.join(scratch, "requests_flat")
    os.makedirs(flat)
    for i, f in enumerate(files):
        _link_in_order(f, os.path.join(flat, f"{i:05d}.json"), i)
    return t.requests, spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(flat)


@pytest.mark.parametrize("watermark", [None, "1 hour"])
def test_rate_limiter_stream_equals_batch(spark, scratch, watermark):
    batch_in, stream_in = _requests_stream(spark, scratch)
    got = _run(ST.rate_limit_stream(stream_in, 5, 86400, watermark=watermark), scratch, "rl")
    want = RQ.rate_limit_decisions(batch_in, 5, 86400)
    cols = ["user_id", "endpoint", "id", "allowed", "remaining"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    assert got.count() == batch_in.count()


def test_window_counts_stream_equals_batch(spark, scratch):
    batch_in, stream_in = _requests_stream(spark, scratch)
    got = _run(SW.requests_per_window_stream(stream_in), scratch, "win")
    want = RQ.requests_per_window(batch_in)
    g, w = sorted(got.collect()), sorted(want.collect())
    # append mode holds back windows the watermark has not closed yet
    assert set(g) <= set(w) and len(w) - len(g) <= 5


def test_chunk_assembly_stream_equals_batch(spark, scratch):
    t = chat_tables(spark, SF_SMALL)
    chunks = CH.build_sse_lines(t.messages, finished_when=F.col("message_id") % 5 != 0,
                                malformed_when=F.col("seq") % 11 == 5, empty_when=F.col("seq") % 13 == 6,
                                last_text_when=F.col("message_id") % 3 == 0)
    src = os.path.join(scratch, "chunks_src")
    # some lines arrive after the finish marker of their message, in a later file
    (chunks.withColumn("part", F.when(F.col("seq") % 7 == 1, 2).otherwise(F.least(F.floor(F.col("seq") / 40), F.lit(1))))
           .repartition(3, "part").sortWithinPartitions("part").write.partitionBy("part").json(src))
    flat = os.path.join(scratch, "chunks_flat")
    os.makedirs(flat)
    for p in range(3):
        d = os.path.join(src, f"part={p}")
        for i, f in enumerate(sorted(x for x in os.listdir(d) if x.endswith(".json"))):
            _link_in_order(os.path.join(d, f), os.path.join(flat, f"{p}_{i:04d}.json"), p * 1000 + i)
    stream_in = (spark.readStream.schema("message_id bigint, seq bigint, line string")
                 .option("maxFilesPerTrigger", 1).json(flat))
    got = _run(ST.assemble_chunks_stream(stream_in, None), scratch, "chunks")
    want = CH.assemble_chunks(chunks, flag_gaps=True)
    assert sorted(got.collect()) == sorted(want.collect())


def test_messages_with_gaps_are_flushed(spark, scratch):
    """A missing first line, a missing middle line, lines sent twice, one without an end."""
    def say(text, end=False):
        reason = '"stop"' if end else "null"
        return f'data: {{"choices":[{{"delta":{{"content":"{text}"}},"finish_reason":{reason}}}]}}'
    lines = [(1, 0, say("a")), (1, 1, say("b")), (1, 1, say("b")), (1, 2, "data: [DONE]"),
             (2, 1, say("x")), (2, 2, say("y")), (2, 3, "data: [DONE]"), (3, 0, say("p")), (3, 2, say("r", True)),
             (4, 0, say("open")), (5, 0, say("m")), (5, 0, say("n")), (5, 1, say("o")), (5, 2, "data: [DONE]"), (5, 3, say("late"))]
    df = spark.createDataFrame(lines, "message_id bigint, seq bigint, line string")
    want = sorted(map(tuple, CH.assemble_chunks(df, flag_gaps=True).collect()))
    assert want == [(1, "ab", False), (2, "xy", True), (3, "pr", True), (5, "no", False)]
    src = os.path.join(scratch, "gap_src")
    df.repartition(2, "seq").write.json(src)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(src)
    out = []
    q = (ST.assemble_chunks_stream(s, 4000).writeStream.foreachBatch(lambda b, i: out.extend(map(tuple, b.collect())))
           .option("checkpointLocation", os.path.join(scratch, "gap_ck")).trigger(processingTime="1 second").start())
    import time
    until = time.time() + 90
    while time.time() < until and (len(out) < 4 or q.lastProgress["stateOperators"][0]["numRowsTotal"] > 0):
        time.sleep(1)
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert sorted(out) == want and left == 0


def test_stuck_tasks_stream_equals_batch(spark, scratch):
    t = chat_tables(spark, SF_SMALL)
    # task events as timestamps; every task starts with a 'running' event
    ev = t.task_events.select("task_id", "status", F.timestamp_seconds(F.col("ts_s") * 10).alias("ts"))
    src = os.path.join(scratch, "task_src")
    # files hold consecutive time ranges, so no event is behind the watermark
    ev.withColumn("part", F.floor(F.unix_seconds("ts") / 200000)).repartition("part") \
      .write.partitionBy("part").json(src)
    flat = os.path.join(scratch, "task_flat")
    os.makedirs(flat)
    files = sorted((int(r.rsplit("=", 1)[1]), os.path.join(r, f))
                   for r, _, fs in os.walk(src) for f in fs if f.endswith(".json"))
    for i, (_, f) in enumerate(files):
        _link_in_order(f, os.path.join(flat, f"{i:05d}.json"), i)
    stream_in = spark.readStream.schema("task_id bigint, status string, ts timestamp") \
        .option("maxFilesPerTrigger", 2).json(flat)
    got = _run(ST.stuck_tasks_stream(stream_in, hours=1.0, watermark="0 seconds"), scratch, "stuck")
    last_wm = ev.agg(F.max(F.unix_seconds("ts"))).scalar()
    want = ST.stuck_tasks_batch(ev, hours=1.0, as_of_s=last_wm)
    g = {r.task_id for r in got.collect()}
    w = {r.task_id for r in want.collect()}
    assert g == w and len(w) > 0


def test_gauges_equal_the_batch_at_every_watermark(spark, scratch):
    from parley.operators.tasks import live_gauges
    t, ttl = chat_tables(spark, SF_SMALL), 86400
    e = t.raw("events").select(F.concat_ws(":", "event_type", (F.col("event_id") % 40).cast("string")).alias("key"), "value",
                               F.col("ts").cast("timestamp").alias("ts"))
    src = os.path.join(scratch, "gauges")
    # one file for each range of days, so that no sample is behind the watermark
    e.withColumn("day", F.floor(F.unix_seconds("ts") / 86400)).repartition("day").write.partitionBy("day").json(src)
    flat = os.path.join(scratch, "gauges_flat")
    os.makedirs(flat)
    files = sorted((int(r.rsplit("=", 1)[1]), os.path.join(r, f)) for r, _, fs in os.walk(src) for f in fs if f.endswith(".json"))
    for i, (_, f) in enumerate(files):
        _link_in_order(f, os.path.join(flat, f"{i:05d}.json"), i)
    s = spark.readStream.schema("key string, value double, ts timestamp").option("maxFilesPerTrigger", 4).json(flat)
    batches = []
    q = (ST.live_gauges_stream(s, ttl).writeStream.foreachBatch(lambda b, i: batches.append(b.collect()))
           .option("checkpointLocation", os.path.join(scratch, "g_ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    import datetime
    progress = [p for p in q.recentProgress if p["stateOperators"]]
    plain = e.select("key", "value", F.unix_seconds("ts").alias("ts_s")).toPandas()
    plain_df = spark.createDataFrame(plain)
    held, checked, tombstones = {}, 0, 0
    assert len(batches) == len(progress) > 3
    for rows, p in zip(batches, progress):
        for r in sorted(rows, key=lambda r: r.live):   # an expiry comes before a newer value
            if r.live:
                held[r.key] = (r.ts_s, r.value)
            else:
                tombstones += 1
                if held[r.key][0] == r.ts_s:
                    del held[r.key]
        at = int(datetime.datetime.fromisoformat(p["eventTime"]["watermark"].replace("Z", "+00:00")).timestamp())
        assert p["stateOperators"][0]["numRowsTotal"] <= 2 * len(held) + 2
        if at > 0 and checked < 4 and not p["numInputRows"]:   # a batch without input has caught up with its watermark
            checked += 1
            want = live_gauges(plain_df, at, ttl)
            assert {k: v[0] for k, v in held.items() if v[0] <= at} == {r.key: r.ts_s for r in want.collect()}
    assert tombstones > 0 and checked > 0


def _alerts_in(spark, scratch, n_files=8):
    """Two endpoints: one with long and short error bursts and silent stretches, one quiet;
    a last request far on closes all windows."""
    rows, at = [], 1_700_000_000 // 60 * 60
    for m in range(240):
        if 100 <= m < 115:
            continue   # no requests at all
        burst = 20 <= m < 40 or 60 <= m < 62 or 90 <= m < 100 or 150 <= m < 158 or m % 37 == 5
        for k in range(4):
            rows.append((at + 60 * m + 13 * k, "/a", 500 if burst else 200, 9000 if burst else 40))
        rows.append((at + 60 * m + 7, "/b", 200, 30))
    rows += [(at + 60 * 1000, e, 200, 1) for e in ("/a", "/b")]
    src = os.path.join(scratch, "alerts")
    os.makedirs(src)
    size = -(-len(rows) // n_files)
    import json
    rows.sort()
    for i in range(n_files):
        path = os.path.join(src, f"{i}.json")
        with open(path, "w") as f:
            for ts, e, st, ms in rows[i * size:(i + 1) * size]:
                f.write(json.dumps({"ts": f"{pd_time(ts)}", "endpoint": e, "status": st, "latency_ms": ms}) + "\n")
        os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))
    schema = "ts timestamp, endpoint string, status int, latency_ms bigint"
    return spark.read.schema(schema).json(src), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)


def pd_time(s):
    import pandas as pd
    return pd.Timestamp(s, unit="s").strftime("%Y-%m-%dT%H:%M:%S.000Z")


@pytest.mark.parametrize("kind", ["errors", "latency"])
def test_alert_streams_equal_the_batch(spark, scratch, kind):
    batch_in, stream_in = _alerts_in(spark, scratch)
    if kind == "errors":
        want = RQ.alert_error_rate(batch_in, 0.02, 120)
        out = SW.alert_error_rate_stream(stream_in, 0.02, 120, watermark="1 minute")
    else:
        want = RQ.alert_latency(batch_in, 5.0, 300)
        out = SW.alert_latency_stream(stream_in, 5.0, 300, watermark="1 minute")
    got, states = [], []
    q = (out.writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", os.path.join(scratch, "a_ck"))
           .trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    firing = sorted(tuple(r)[:2] + tuple(r)[3:] for r in got if r.event == "firing")
    assert firing == sorted(map(tuple, want.collect())) and len(firing) > 10
    ended = sorted((r.endpoint, r.window_end_s) for r in got if r.event == "resolved")
    assert ended == sorted(map(tuple, RQ.resolved(want, ["endpoint"], 60).collect())) and len(ended) >= 3
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if len(p["stateOperators"]) == 2]
    assert kept[-1] <= 2 and all(len(p["stateOperators"]) == 2 for p in q.recentProgress if p["numInputRows"])


def test_route_stream_writes_each_route(spark, scratch):
    from parley.operators import tasks as TK
    t = chat_tables(spark, SF_SMALL)
    rec = TK.encode_requests(t.agent_tasks)
    src = os.path.join(scratch, "topic_src")
    rec.repartition(2).write.json(src)
    s = spark.readStream.schema("topic string, key string, value string").option("maxFilesPerTrigger", 1).json(src)
    sinks = {r: os.path.join(scratch, f"route_{r}") for r in ("rlhf", "evaluation")}
    rest = os.path.join(scratch, "route_rest")
    q = SW.route_stream(TK.decode_requests(s), sinks, os.path.join(scratch, "route_ck"), rest)
    q.processAllAvailable()
    q.stop()
    want = TK.route_requests(TK.decode_requests(rec))
    for r, p in sinks.items():
        got = spark.read.parquet(p).drop("batch_id")
        assert sorted(got.select(want.columns).collect()) == sorted(want.filter(F.col("route") == r).collect())
    others = spark.read.parquet(rest).drop("batch_id").select(want.columns).collect()
    assert sorted(others) == sorted(want.filter("route = 'supervised'").collect()) and len(others) > 0


def test_runner_uses_shared_checkpoint_folder(spark, scratch):
    from parley.session import checkpoint_path
    from parley.streaming.runner import start_parquet
    batch_in, stream_in = _requests_stream(spark, scratch)
    out = os.path.join(scratch, "runner_out")
    q = start_parquet(SW.requests_per_window_stream(stream_in), out, "runner_test_counts",
                      trigger={"availableNow": True})
    q.awaitTermination(300)
    assert q.exception() is None
    assert os.path.isdir(checkpoint_path(spark, "runner_test_counts").replace("file:", ""))
    assert spark.read.parquet(out).count() > 0


def test_error_rate_stream_equals_batch(spark, scratch):
    batch_in, stream_in = _requests_stream(spark, scratch)
    got = _run(SW.error_rate_stream(stream_in), scratch, "err")
    want = RQ.error_rate_windows(batch_in)
    g, w = set(got.collect()), set(want.collect())
    # closed windows only: the last few windows are held back by the watermark
    assert g <= w and len(w) - len(g) <= 10
    # the hold ("for: 2m") applied to the streamed windows gives the batch alerts
    thr = 0.005
    fired = got.filter(F.col("errors") > thr * 300)
    held = RQ.held(fired.select("endpoint", "window_start_s"), ["endpoint"], "window_start_s", 60, 120)
    alerts = {(r.endpoint, r.window_start_s + 300) for r in held.collect()}
    batch_alerts = {(r.endpoint, r.window_end_s) for r in RQ.alert_error_rate(batch_in, thr, 120).collect()}
    last_closed = max(r.window_end_s for r in got.select("window_end_s").collect())
    assert alerts == {a for a in batch_alerts if a[1] <= last_closed}


def test_latency_stream_equals_batch(spark, scratch):
    batch_in, stream_in = _requests_stream(spark, scratch)
    got = set(_run(SW.latency_stream(stream_in), scratch, "lat").collect())
    want = set(RQ.latency_windows(batch_in).collect())
    assert got <= want and len(want) - len(got) <= 10
