"""Hand-made edge tables (5–20 rows each) for the operators' boundary cases."""

from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import chunks as CH
from parley.operators import feedback as FB
from parley.operators import history as H
from parley.operators import preference as PR
from parley.operators import requests as RQ
from parley.operators import tasks as TK

MSG = "id bigint, conversation_id bigint, turn bigint, role string, content string, created_s bigint"
FBK = "id bigint, message_id bigint, user_id bigint, feedback_type string, score_centi bigint, created_s bigint"


def test_title_rules(spark):
    rows = [("one two three four five",), ("one two three four five six",), ("",), ("   ",),
            ("a\tb\nc",), ("x" * 50,), ("x" * 51,), ("word joined other",),
            ("abcdefghij abcdefghij abcdefghij abcdefghij abcdefghij abc",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.title("t")).collect()]
    assert got[0] == "one two three four five"
    assert got[1] == "one two three four five..."
    assert got[2] == "" and got[3] == "   "
    assert got[4] == "a b c"
    assert got[5] == "x" * 50
    assert got[6] == "x" * 50 + "..."
    assert got[7] == "word joined other"          # NBSP splits words, as Go/JS/Python do
    assert got[8] == ("abcdefghij " * 5)[:50] + "..."  # 5-word title, then cut at 50
    assert all(len(g) <= 53 for g in got)


def test_format_duration(spark):
    ms = [0, 999, 1000, 59999, 60000, 61000, 125000]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in ms], "ms bigint")
           .select(T.format_duration("ms")).collect()]
    assert got == ["0ms", "999ms", "1s", "59s", "1m", "1m 1s", "2m 5s"]


def test_prompt_unknown_role_skipped(spark):
    from parley.operators.prompts import render_prompts
    m = spark.createDataFrame([(1, 1, 0, "system", "S", 0), (2, 1, 1, "user", "Q", 1),
                               (3, 1, 2, "tool", "X", 2), (4, 1, 3, "assistant", "A", 3)], MSG)
    p = render_prompts(m).collect()[0]["prompt"]
    assert p == "S\n\n### Instruction:\nQ\n\n### Response:\nA\n\n### Response:\n"


def test_feedback_dataset_previous_user(spark):
    m = spark.createDataFrame([
        (10, 1, 0, "user", "u1", 0), (11, 1, 1, "user", "u2", 60), (12, 1, 2, "assistant", "a1", 120),
        (20, 2, 0, "system", "s", 0), (21, 2, 1, "assistant", "a2", 60),
        (30, 3, 0, "assistant", "a3", 0), (31, 3, 1, "user", "last", 60)], MSG)
    f = spark.createDataFrame([(1, 12, 7, "thumbs_up", 50, 200), (2, 21, 7, "thumbs_up", 10, 200),
                               (3, 30, 7, "report", -20, 200), (4, 12, 8, "thumbs_down", None, 200)], FBK).selectExpr("*", "cast(null as string) as feedback_text")
    rows = FB.feedback_dataset(m, f).collect()
    assert [(r.query, r.response, r.score_centi) for r in rows] == [("u2", "a1", 50)]


def test_feedback_stats_null_average_is_zero(spark):
    m = spark.createDataFrame([(1, 1, 0, "assistant", "a", 0)], MSG)
    c = spark.createDataFrame([(1, 5)], "id bigint, user_id bigint")
    f = spark.createDataFrame([(1, 1, 9, "report", None, 0), (2, 1, 9, "report", None, 0),
                               (3, 1, 9, "thumbs_up", 0, 0)], FBK).selectExpr("*", "cast(null as string) as feedback_text")
    got = {r.feedback_type: (r.avg_score, r.feedback_count) for r in FB.feedback_stats(f, m, c).collect()}
    assert got == {"report": (0.0, 2), "thumbs_up": (0.0, 1)}


def test_preference_exact_threshold(spark):
    s = spark.createDataFrame([
        ("q", "a", 0.8, 1, 80), ("q", "b", 0.6, 1, 60), ("q", "c", 0.59, 1, 59),  # 0.80-0.60 is exactly 0.2
        ("q", "d", 0.6, 1, 60), ("r", "x", 0.1, 2, 20)],
        "query string, response string, avg_score double, feedback_count bigint, sum_centi bigint")
    pairs = {(r.response_a, r.response_b, r.preference) for r in PR.preference_pairs(s).collect()}
    assert ("a", "b", 1) not in pairs and ("a", "d", 1) not in pairs
    assert ("a", "c", 1) in pairs and ("c", "a", 0) in pairs
    # symmetric with complementary labels
    assert all((b, a, 1 - p) in pairs for a, b, p in pairs)
    one_way = PR.preference_pairs(s, ordered=False).collect()
    assert len(one_way) * 2 == len(pairs)


def test_evaluation_strictly_later_and_min_count(spark):
    m = spark.createDataFrame([
        (1, 1, 0, "user", "q", 100), (2, 1, 1, "assistant", "same-time", 100),
        (3, 1, 2, "assistant", "later", 160), (4, 1, 3, "assistant", "once", 170)], MSG)
    f = spark.createDataFrame([(1, 2, 1, "t", 10, 0), (2, 2, 1, "t", 20, 0), (3, 3, 1, "t", 30, 0),
                               (4, 3, 1, "t", 50, 0), (5, 4, 1, "t", 90, 0)], FBK).selectExpr("*", "cast(null as string) as feedback_text")
    rows = PR.evaluation_dataset(m, f).collect()
    assert [(r.response, r.avg_score) for r in rows] == [("later", 0.4)]


def test_rate_limiter_idle_reset(spark):
    base = 1_700_000_000
    # limit 2 / ttl 60 s: a, a, DENY, idle 59 s after last accept → still denied,
    # 60 s after last accept → reset and allowed.
    t = [0, 10, 20, 69, 70, 71]
    df = spark.createDataFrame([(i, 1, "/api/chat", base + s) for i, s in enumerate(t)],
                               "id bigint, user_id bigint, endpoint string, s bigint") \
        .withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r.id, r.allowed, r.remaining) for r in RQ.rate_limit_decisions(df, 2, 60).collect())
    assert got == [(0, True, 1), (1, True, 0), (2, False, 0), (3, False, 0), (4, True, 1), (5, True, 0)]


def test_histogram_quantile_edges(spark):
    df = spark.createDataFrame([(1, "/x", 200, ms, 1_700_000_000) for ms in [20000] * 20] +
                               [(2, "/y", 200, ms, 1_700_000_000) for ms in [1, 2, 3, 4, 300, 300, 300]],
                               "id bigint, endpoint string, status int, latency_ms bigint, s bigint") \
        .withColumn("ts", F.timestamp_seconds("s"))
    got = {r.endpoint: r.p95_s for r in RQ.latency_windows(df).select("endpoint", "p95_s").distinct().collect()}
    assert got["/x"] == 10.0                       # all in +Inf → highest finite bound
    # rank 6.65 of 7 falls in (250, 500] holding 3 observations after 4
    assert abs(got["/y"] - (0.25 + 0.25 * (6.65 - 4) / 3)) < 1e-6


def test_chunks_edge_cases(spark):
    ok = 'data: {"choices":[{"delta":{"content":"%s"},"finish_reason":null}]}'
    fin = 'data: {"choices":[{"delta":{},"finish_reason":"stop"}]}'
    rows = [(1, 0, ok % "Hel"), (1, 1, ""), (1, 2, "data: {bad"), (1, 3, ok % "lo"), (1, 4, fin),
            (1, 5, ok % "late"), (1, 6, "data: [DONE]"),
            (2, 0, ok % "never"),                                   # no finish → not emitted
            (3, 0, 'data: {"error":"x"}'), (3, 1, 'data: {"choices":[]}'), (3, 2, "data: [DONE]")]
    df = spark.createDataFrame(rows, "message_id bigint, seq bigint, line string")
    got = {r.message_id: r.content for r in CH.assemble_chunks(df).collect()}
    assert got == {1: "Hello", 3: ""}
    stats = {r.message_id: r.n_malformed for r in CH.chunk_stats(df).collect()}
    assert stats[1] == 1 and stats[3] == 0     # valid JSON without choices is skipped, not malformed


def test_unknown_task_types(spark):
    tasks = spark.createDataFrame([
        (1, "trainer", "mystery", '{"user_id": 1}'), (2, "evaluator", "mystery", "{}"),
        (3, "evaluator", "toxicity_check", '{"content": "I HATE this", "content_id": "c1"}'),
        (4, "evaluator", "hallucination_detection", '{"response": "abcdefg", "context": "abc"}')],
        "id bigint, agent_type string, task_type string, input_data string")
    conv = spark.createDataFrame([(1, 1, 0, False)], "id bigint, user_id bigint, created_s bigint, is_archived boolean")
    msgs = spark.createDataFrame([(1, 1, 0, "assistant", "a", 0)], MSG)
    fb = spark.createDataFrame([], FBK).selectExpr("*", "cast(null as string) as feedback_text")
    out = {r.id: r for r in TK.dispatch_tasks(tasks, conv, fb, msgs, 10**6).collect()}
    assert out[1].status == "completed" and out[1].output_data == '{"status":"submitted"}'
    assert out[2].status == "failed" and out[2].error_message.startswith("unsupported")
    assert out[3].output_data == '{"is_toxic":true,"confidence":0.95,"content_id":"c1"}'
    assert out[4].output_data == '{"has_hallucination":true,"confidence":0.8,"response_id":null}'


def test_parse_int_like_js(spark):
    raw = [("42",), ("  7tok",), ("abc",), ("0",), (None,), ("-5",), ("99999",)]
    df = spark.createDataFrame([(i, None, r[0]) for i, r in enumerate(raw)],
                               "id bigint, temperature double, max_tokens_raw string")
    got = [(r.max_tokens, r.generation_tokens, r.max_tokens_ok)
           for r in TK.request_params(df).orderBy("id").collect()]
    assert got == [(42, 42, True), (7, 7, True), (4096, 512, True), (4096, 512, True),
                   (4096, 512, True), (-5, -5, False), (99999, 512, False)]


def test_normalize_sqlite_feedback(spark):
    lite = spark.createDataFrame([(1, 1, 1, 1, "good", 0), (2, 1, 1, -1, None, 0), (3, 1, 1, 0, "meh", 0)],
                                 "id bigint, message_id bigint, user_id bigint, score bigint, comment string, created_s bigint")
    got = [(r.feedback_type, r.score_centi) for r in FB.normalize_feedback(lite).orderBy("id").collect()]
    assert got == [("thumbs_up", 100), ("thumbs_down", -100), ("regenerate", 0)]


def test_archive_is_idempotent(spark):
    c = spark.createDataFrame([(1, 1, 0, False), (2, 1, 10**6, False), (3, 1, 0, True)],
                              "id bigint, user_id bigint, created_s bigint, is_archived boolean")
    once = H.archive_conversations(c, 10**6, 1).drop("archived_now")
    twice = H.archive_conversations(once, 10**6, 1)
    assert H.archive_counts(twice).collect()[0].archived_conversations == 0
    assert sorted(r.is_archived for r in once.collect()) == [False, True, True]


def test_split_is_disjoint_and_stable(spark):
    from parley.operators.training import train_test_split
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    a = train_test_split(df, "k").collect()
    b = train_test_split(df, "k").collect()
    assert a == b
    share = sum(r.is_test for r in a) / len(a)
    assert 0.15 < share < 0.25


def test_pairing_next_and_latest_context(spark):
    m = spark.createDataFrame([
        (1, 1, 0, "user", "q1", 0), (2, 1, 1, "assistant", "a1", 60),
        (3, 1, 2, "user", "q2", 120), (4, 1, 3, "assistant", "a2", 180)], MSG)
    f = spark.createDataFrame([(1, 2, 1, "t", 10, 0), (2, 4, 1, "t", 30, 0)], FBK).selectExpr("*", "cast(null as string) as feedback_text")
    later = {(r.query, r.response) for r in PR.query_answer_pairs(m, f, "later").collect()}
    nxt = {(r.query, r.response) for r in PR.query_answer_pairs(m, f, "next").collect()}
    assert later == {("q1", "a1"), ("q1", "a2"), ("q2", "a2")}
    assert nxt == {("q1", "a1"), ("q2", "a2")}
    first = [r.content for r in H.conversation_context(m, 2).orderBy("position").collect()]
    last = [r.content for r in H.conversation_context(m, 2, latest=True).orderBy("position").collect()]
    assert first == ["q1", "a1"] and last == ["a2", "q2"]


def test_conversation_documents_nested_matches_flat(spark):
    m = spark.createDataFrame([(1, 1, 0, "user", "q", 0), (2, 1, 1, "assistant", "a", 5),
                               (3, 2, 0, "user", "x", 1)], MSG)
    c = spark.createDataFrame([(1, 7, None, 5), (2, 8, "t", 1)],
                              "id bigint, user_id bigint, title string, updated_s bigint")
    nested = {r.conversation_id: [x.message_id for x in r.messages]
              for r in H.conversation_documents(c, m, nested=True).collect()}
    flat = H.conversation_documents(c, m).collect()
    assert nested == {1: [1, 2], 2: [3]}
    assert [r.message_id for r in flat] == [1, 2, 3]


def test_sse_render_parse_round_trip(spark):
    """Rendering answers as SSE lines and assembling them gives the text back
    (every word followed by one space), for texts with quotes, tabs and
    non-ASCII characters too."""
    from parley.sources.fixtures import chat_tables
    from conftest import SF_SMALL
    m = chat_tables(spark, SF_SMALL).messages
    extra = spark.createDataFrame([(9_000_001, 1, 0, "assistant", 'say "hi"\tand\\ bye — ok', 0)], MSG)
    msgs = m.select(*extra.columns).unionByName(extra)
    got = {r.message_id: r.content for r in CH.assemble_chunks(CH.build_sse_lines(msgs)).collect()}
    want = {r.id: "".join(w + " " for w in r.content.split(" "))
            for r in msgs.filter(F.col("role") == "assistant").collect()}
    assert got == want


def test_title_matches_python_rule_on_random_text(spark):
    """The Column title rule equals the plain-Python rule (split on Unicode
    whitespace, 5 words, 50 characters) on 500 random strings."""
    import random
    rnd = random.Random(7)
    alphabet = list("abcdé xyz") + [" ", " ", "\t", "\n", " ", "　", "ß", "語"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(500)]

    def rule(t):
        w = t.split()
        base = " ".join(w[:5]) + "..." if len(w) > 5 else (" ".join(w) if w else t)
        return base[:50] + "..." if len(base) > 50 else base

    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
           .orderBy("i").select(T.title("t")).collect()]
    assert got == [rule(t) for t in texts]


def test_tokens_strip_duration_match_python(spark):
    import random
    rnd = random.Random(11)
    alphabet = list("ab é") + [" ", "\t", "\n", " ", "　", "\r", "語"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    ms = [rnd.randint(0, 200_000) for _ in range(300)]

    def dur(m):
        if m >= 60000:
            s = (m % 60000) // 1000
            return f"{m // 60000}m {s}s" if s > 0 else f"{m // 60000}m"
        return f"{m // 1000}s" if m >= 1000 else f"{m}ms"

    df = spark.createDataFrame([(i, t, m) for i, (t, m) in enumerate(zip(texts, ms))], "i int, t string, m bigint")
    rows = df.orderBy("i").select(T.token_count("t"), T.strip("t"), T.format_duration("m")).collect()
    assert [r[0] for r in rows] == [len(t.split()) for t in texts]
    assert [r[1] for r in rows] == [t.strip() for t in texts]
    assert [r[2] for r in rows] == [dur(m) for m in ms]


def test_long_conversations_keep_their_ids_apart(spark, scratch):
    """More than a thousand turns: no id meets one of the next conversation."""
    from parley.sources.fixtures import chat_tables
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t}") for c in (0, 1, 2) for t in range(1500)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(scratch + "/conversations.parquet")
    t = chat_tables(spark, scratch)
    assert t.messages.select("id").distinct().count() == len(rows)
    assert t.feedback.select("id").distinct().count() == t.feedback.count()


def test_positions_are_derived_where_there_are_none(spark):
    from conftest import SF_SMALL
    from parley.operators import feedback as FB
    from parley.operators import history as H
    from parley.sources.fixtures import chat_tables
    t = chat_tables(spark, SF_SMALL)
    bare = t.messages.drop("turn")
    assert sorted(FB.feedback_dataset(bare, t.feedback).collect()) == sorted(FB.feedback_dataset(t.messages, t.feedback).collect())
    assert sorted(H.regenerate_requests(bare).collect()) == sorted(H.regenerate_requests(t.messages).collect())


def test_finish_chunk_text_and_late_chunks(spark):
    from parley.operators import chunks as CH
    def line(text, reason="null"):
        return 'data: {"choices":[{"delta":{"content":"%s"},"finish_reason":%s}]}' % (text, reason)
    rows = [(1, 2, line("LAST", '"stop"')), (1, 0, line("a ")), (1, 1, line("b ")), (1, 3, line("after")), (1, 4, "data: [DONE]"),
            (2, 0, line("never finished")), (3, 0, 'data: {"usage":{}}'), (3, 1, "data: {bad"), (3, 2, "data: [DONE]")]
    df = spark.createDataFrame(rows, "message_id long, seq long, line string")
    assert sorted(tuple(r) for r in CH.assemble_chunks(df).collect()) == [(1, "a b LAST"), (3, "")]
    kinds = {(r.message_id, r.seq): r.kind for r in CH.parse_chunks(df).collect()}
    assert kinds[3, 0] == "ignored" and kinds[3, 1] == "malformed" and kinds[1, 2] == "finish"


def test_last_start_wins_and_completion_clears_the_error(spark):
    from parley.operators import tasks as TK
    ev = [(1, "running", 10, None, None), (1, "failed", 20, "boom", None), (1, "running", 30, None, None), (1, "completed", 40, None, "ok")]
    df = spark.createDataFrame(ev, "session_id long, status string, ts_s long, error_message string, output_data string")
    r = TK.session_state(df).first()
    assert (r.status, r.started_s, r.completed_s, r.error_message) == ("completed", 30, 40, None)
    kept = TK.status_rollup(df, "session_id").first()
    assert kept.started_s == 30 and kept.error_message == "boom"


def test_unique_keys_are_columns_not_joined_text(spark):
    from parley.operators import quality as Q
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None), (None, "x"), ("d", "d"), ("d", "d")], "k string, l string")
    assert [tuple(r) for r in Q.duplicate_keys(df, "t", ["k", "l"]).collect()] == [("t", "k,l", '["d","d"]', 2)]


def test_request_config_keeps_its_types(spark):
    import json
    from parley.operators import tasks as TK
    rows = [("6f1c-uuid", "trainer", "start_rlhf_training", '{"lr": 0.5, "opt": {"k": [1, 2]}, "user_id": "u-1"}'),
            ("7", "trainer", "start_rlhf_training", "not json")]
    df = spark.createDataFrame(rows, "id string, agent_type string, task_type string, input_data string")
    enc = TK.encode_requests(df)
    values = {r.key: json.loads(r.value) for r in enc.collect()}
    assert values["6f1c-uuid"]["config"] == {"lr": 0.5, "opt": {"k": [1, 2]}, "user_id": "u-1"} and values["7"]["config"] == {}
    dec = {r.task_id: r.config_user_id for r in TK.decode_requests(enc).collect()}
    assert dec == {"6f1c-uuid": "u-1", "7": None}
