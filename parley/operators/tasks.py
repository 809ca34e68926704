"""Agent task tables: dequeue, dispatch, state machine, monitoring, routing.

The reference runs these row by row in an asyncio loop; here each is one
columnar pass over the task table (per-type results are built with
``when``/``unionByName`` and serialised with ``to_json``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Task vocabularies and defaults of the reference.
PENDING_STATES = ("pending", "queued")
TERMINAL_STATES = ("completed", "failed")
DEFAULT_DAYS_OLD = 30
DEFAULT_BACKUP_PATH = "/tmp/feedback_backup.json"
MODEL_TYPE = "deepseek"
TOPIC_TRAINING = "training_requests"
TOPIC_EVALUATION = "evaluation_requests"

_JSON_OPTS = {"ignoreNullFields": "false"}


def json_field(col: str, path: str, cast: str = "string") -> Column:
    """A field of a JSON text column (missing or malformed → null)."""
    return F.get_json_object(F.col(col), f"$.{path}").try_cast(cast)


def json_number(x: Column, decimals: int = 6) -> Column:
    """Shortest plain decimal text of a rounded number (``0.000897``, ``0.11``,
    ``12``), the same text any JSON writer without exponent notation emits."""
    t = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{decimals}f", x), "0+$", ""), r"\.$", "")
    return F.when(x.isNull(), F.lit("null")).when(x == 0, F.lit("0")).otherwise(t)


def task_payload(tasks: DataFrame) -> DataFrame:
    """Fields of ``input_data`` with their defaults (days_old → 30)."""
    return tasks.select(
        "id", "task_type",
        json_field("input_data", "user_id").alias("user_id"),
        F.coalesce(json_field("input_data", "days_old", "bigint"), F.lit(DEFAULT_DAYS_OLD)).alias("days_old"))


def dequeue_tasks(tasks: DataFrame, n: int = 50) -> DataFrame:
    """Next ``n`` pending tasks: priority desc, created asc, id (a top-k)."""
    return (tasks.filter(F.col("status") == "pending")
                 .select("id", "agent_type", "task_type", "input_data", "priority", "created_s")
                 .orderBy(F.col("priority").desc_nulls_first(), F.col("created_s").asc_nulls_last(), "id")
                 .limit(n))


def start_tasks(tasks: DataFrame, dequeued: DataFrame, as_of: int) -> DataFrame:
    """Table rewrite: dequeued tasks become running with ``started_s = as_of``."""
    picked = dequeued.select(F.col("id"), F.lit(True).alias("_picked"))
    j = tasks.join(picked, "id", "left")
    p = F.coalesce(F.col("_picked"), F.lit(False))
    return j.select(*[
        F.when(p, F.lit("running")).otherwise(F.col("status")).alias("status") if c == "status"
        else F.when(p, F.lit(as_of).cast("bigint")).otherwise(F.col("started_s")).alias("started_s")
        if c == "started_s" else F.col(c) for c in tasks.columns])


def stuck_tasks(tasks: DataFrame, as_of: int, hours: int = 1) -> DataFrame:
    """Count of tasks running for more than ``hours`` hours at ``as_of``."""
    stuck = (F.col("status") == "running") & (F.col("started_s") < F.lit(as_of) - hours * 3600)
    return tasks.agg(F.count_if(stuck).cast("bigint").alias("stuck_tasks"))


def queue_depth(tasks: DataFrame, alarm: int = 100) -> DataFrame:
    """Waiting tasks per agent type and whether the queue is over ``alarm``."""
    return (tasks.filter(F.col("status").isin(*PENDING_STATES))
                 .groupBy("agent_type").agg(F.count(F.lit(1)).alias("queue_size"))
                 .withColumn("alarm", F.col("queue_size") > alarm))


def status_rollup(events: DataFrame, key: str, end_sets_error: bool = False) -> DataFrame:
    """Current state of each entity from its status event log.

    status = latest status; started = last 'running' (every start overwrites);
    completed = last terminal event; output/error taken from the latest
    completed/failed event; with ``end_sets_error`` the last terminal event sets
    the error, so a completion clears it.  One partial+final aggregation per key, so a hot entity costs one row per
    task before the shuffle.
    """
    ts = F.col("ts_s")
    running = F.col("status") == "running"
    term = F.col("status").isin(*TERMINAL_STATES)
    # Total order of events: time, then status and payloads (same-instant ties).
    order = F.struct(ts, F.col("status"), F.coalesce("output_data", F.lit("")),
                     F.coalesce("error_message", F.lit("")))
    sets_error = term if end_sets_error else F.col("status") == "failed"
    return events.groupBy(key).agg(
        F.max_by("status", order).alias("status"),
        F.max(F.when(running, ts)).alias("started_s"),
        F.max(F.when(term, ts)).alias("completed_s"),
        F.max_by(F.when(F.col("status") == "completed", F.col("output_data")),
                 F.when(F.col("status") == "completed", order)).alias("output_data"),
        F.max_by(F.when(F.col("status") == "failed", F.col("error_message")),
                 F.when(sets_error, order)).alias("error_message"),
    )


def task_state(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Table rewrite of agent tasks from their status event log (tasks without
    events keep their row)."""
    r = status_rollup(events, "task_id").withColumnRenamed("task_id", "id")
    j = tasks.select("id", "agent_type", "task_type", F.col("status").alias("_st0"),
                     F.col("started_s").alias("_sd0")).join(r, "id", "left")
    return j.select("id", "agent_type", "task_type",
                    F.coalesce("status", "_st0").alias("status"),
                    F.coalesce("started_s", "_sd0").alias("started_s"),
                    "completed_s", "output_data", "error_message")


def session_state(events: DataFrame) -> DataFrame:
    """Training session state (started only when running, completed only when
    done): the same roll-up over the session event log, where the end of a
    session writes its error, null on completion."""
    return status_rollup(events, "session_id", end_sets_error=True)


# ------------------------------------------------------------------ dispatch

def _archive_counts(conversations: DataFrame, as_of: int) -> Column:
    """Conversations a cleanup would archive, by ``days_old``: one array of
    (least day, counts), the count for day d at d - least.

    A conversation qualifies for every integer d with d·86400 < as_of − created,
    i.e. d ≤ ceil((as_of − created)/86400) − 1.  Conversations are reduced to a
    histogram over that bound and summed from the largest day down; each row
    then fills the days back to the one below.  The array has one entry for each
    day of the time span, whatever the number of rows.
    """
    maxd = (F.ceil((F.lit(as_of) - F.col("created_s")) / 86400.0) - 1).cast("bigint")
    hist = (conversations.filter(~F.col("is_archived") & F.col("created_s").isNotNull())
                         .groupBy(maxd.alias("maxd")).agg(F.count(F.lit(1)).alias("n")))
    down = Window.orderBy(F.desc("maxd"))
    sums = hist.select("maxd", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
                       F.coalesce(F.lead("maxd").over(down) + 1, F.col("maxd")).alias("least"))
    days = sums.select(F.explode(F.sequence("least", "maxd")).alias("day"), "n")
    return days.agg(F.array_sort(F.collect_list(F.struct("day", "n")))).scalar()


def dispatch_tasks(tasks: DataFrame, conversations: DataFrame, feedback: DataFrame,
                   messages: DataFrame, as_of: int, backup_days: int = 7) -> DataFrame:
    """Run every task's handler as a columnar expression and report
    (id, status, output_data, error_message).

    trainer: known and unknown types complete with {"status":"submitted"};
    evaluator: toxicity / hallucination result structs;
    db_manager: archive count for the task's days_old, feedback backup count;
    support: per-owner feedback summary (feedback_stats) as an array of structs.
    Unknown evaluator / db_manager / support types fail.
    """
    a, t = F.col("agent_type"), F.col("task_type")
    # One parse of the payload for every field any handler reads.
    fields = ("user_id", "days_old", "content", "content_id", "response", "context",
              "response_id", "backup_path")
    raw = tasks.select("id", "agent_type", "task_type",
                       F.json_tuple("input_data", *fields).alias(*[f"in_{f}" for f in fields]))
    p = raw.select(
        "id", "agent_type", "task_type", *[f"in_{f}" for f in fields[2:]],
        F.coalesce(F.col("in_days_old").try_cast("bigint"), F.lit(DEFAULT_DAYS_OLD).cast("bigint")).alias("days_old"),
        F.col("in_user_id").alias("payload_user_id"))

    # db_manager / cleanup: the count for the task's days_old is looked up.
    by_day = _archive_counts(conversations, as_of)
    least = F.get(by_day, F.lit(0))["day"]
    archived = F.coalesce(F.get(by_day, F.greatest(F.col("days_old") - least, F.lit(0)).try_cast("int"))["n"], F.lit(0)).cast("bigint")

    # support / analyze: per-owner summary, bounded (one entry per feedback type).
    from .feedback import feedback_stats
    stats = (feedback_stats(feedback, messages, conversations)
             .groupBy(F.col("user_id").cast("string").alias("payload_user_id"))
             .agg(F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("feedback_type", "avg_score", "feedback_count"))),
                  lambda x: F.concat(F.lit('{"type":"'), x["feedback_type"], F.lit('","avg_score":'),
                                     json_number(x["avg_score"]), F.lit(',"count":'),
                                     x["feedback_count"].cast("string"), F.lit("}"))), ",").alias("summary")))
    # Only those tasks meet the summaries; all others stay on the map side.
    wants = F.coalesce((a == "support") & (t == "analyze_user_feedback"), F.lit(False))
    p = p.filter(wants).join(stats, "payload_user_id", "left").unionByName(
        p.filter(~wants).withColumn("summary", F.lit(None).cast("string")))

    # db_manager / backup: one global count, attached as a scalar subquery.
    backup_n = (feedback.filter(F.col("created_s") >= F.lit(as_of) - backup_days * 86400)
                        .join(messages.select(F.col("id").alias("message_id")), "message_id")
                        .agg(F.count(F.lit(1))).scalar())

    content = F.coalesce(F.col("in_content"), F.lit(""))
    response = F.coalesce(F.col("in_response"), F.lit(""))
    context = F.coalesce(F.col("in_context"), F.lit(""))
    toxic = T.is_toxic(content)
    out = (
        F.when(a == "trainer", F.to_json(F.struct(F.lit("submitted").alias("status"))))
         .when((a == "evaluator") & (t == "toxicity_check"), F.to_json(F.struct(
             toxic.alias("is_toxic"),
             F.when(toxic, F.lit(0.95)).otherwise(F.lit(0.05)).alias("confidence"),
             F.col("in_content_id").alias("content_id")), _JSON_OPTS))
         .when((a == "evaluator") & (t == "hallucination_detection"), F.to_json(F.struct(
             T.is_hallucination(response, context).alias("has_hallucination"),
             F.lit(0.8).alias("confidence"),
             F.col("in_response_id").alias("response_id")), _JSON_OPTS))
         .when((a == "db_manager") & (t == "cleanup_old_conversations"), F.to_json(F.struct(
             archived.alias("archived_conversations"))))
         .when((a == "db_manager") & (t == "backup_feedback_data"), F.to_json(F.struct(
             F.coalesce(F.col("in_backup_path"), F.lit(DEFAULT_BACKUP_PATH)).alias("backup_path"),
             backup_n.alias("records_count"))))
         .when((a == "support") & (t == "analyze_user_feedback"), F.concat(
             F.lit('{"user_id":'), F.coalesce(F.when(F.col("payload_user_id").try_cast("bigint").isNotNull(), F.col("payload_user_id"))
                                              .when(F.col("payload_user_id").isNotNull(), F.concat(F.lit('"'), "payload_user_id", F.lit('"'))),
                                              F.lit("null")),
             F.lit(',"feedback_summary":['), F.coalesce(F.col("summary"), F.lit("")), F.lit("]}")))
    )
    failed = out.isNull()
    return p.select(
        "id", "agent_type", "task_type",
        F.when(failed, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        out.alias("output_data"),
        F.when(failed, F.concat(F.lit("unsupported task type: "), t)).alias("error_message"))


def encode_requests(tasks: DataFrame) -> DataFrame:
    """Trainer tasks → (topic, JSON value) records for the request topics."""
    t = F.col("task_type")
    trainer = tasks.filter((F.col("agent_type") == "trainer") & t.isin("start_rlhf_training", "evaluate_model"))
    # The config is passed on as the JSON text it is, types and nesting kept.
    cfg = F.when(F.try_parse_json("input_data").isNotNull(), F.col("input_data")).otherwise(F.lit("{}"))
    kind = F.when(F.get_json_object("input_data", "$.mode") == "supervised", "supervised_training").otherwise("rlhf_training")
    head = F.to_json(F.struct(F.col("id").alias("task_id"), kind.alias("type")))
    value = (F.when(t == "start_rlhf_training",
                    F.concat(F.left(head, F.char_length(head) - 1), F.lit(',"config":'), cfg, F.lit("}")))
              .otherwise(F.to_json(F.struct(
                 F.col("id").alias("task_id"), F.lit("model_evaluation").alias("type"),
                 F.get_json_object("input_data", "$.model_path").alias("model_path"),
                 F.get_json_object("input_data", "$.eval_dataset").alias("eval_dataset")), _JSON_OPTS)))
    return trainer.select(
        F.when(t == "start_rlhf_training", TOPIC_TRAINING).otherwise(TOPIC_EVALUATION).alias("topic"),
        F.col("id").cast("string").alias("key"), value.alias("value"))


REQUEST_SCHEMA = "task_id string, type string, model_path string, eval_dataset string"


def decode_requests(records: DataFrame) -> DataFrame:
    """(topic, value) JSON records → typed request columns; malformed → nulls.
    Ids are text, as any id type can be written so."""
    r = F.from_json(F.col("value"), REQUEST_SCHEMA)
    return records.select("topic", "value", r.alias("r")).select(
        "topic", "r.task_id", "r.type",
        F.get_json_object("value", "$.config.user_id").alias("config_user_id"),
        "r.model_path", "r.eval_dataset")


def route_requests(requests: DataFrame) -> DataFrame:
    """Route decoded requests by type; unknown types are kept with route 'unknown'."""
    ty = F.col("type")
    return requests.withColumn(
        "route", F.when(ty == "rlhf_training", "rlhf").when(ty == "supervised_training", "supervised")
                  .when(ty == "model_evaluation", "evaluation").otherwise("unknown"))


def live_gauges(samples: DataFrame, as_of: int, ttl_s: int = 300) -> DataFrame:
    """Last value per gauge key, if written within ``ttl_s`` before ``as_of``."""
    return (samples.filter((F.col("ts_s") > F.lit(as_of) - ttl_s) & (F.col("ts_s") <= as_of))
                   .groupBy("key").agg(F.max_by("value", F.struct("ts_s", "value")).alias("value"),
                                       F.max("ts_s").alias("ts_s")))


def request_params(options: DataFrame, default_temperature: float = 0.7,
                   default_max_tokens: int = 4096, generation_cap: int = 512) -> DataFrame:
    """Effective generation parameters: request option → configured default;
    max tokens parsed like JavaScript ``parseInt`` (0 / unparsable → 4096);
    generated tokens capped at 512; UI bounds checked."""
    raw = F.regexp_extract(F.col("max_tokens_raw"), r"^\s*([+-]?\d+)", 1)
    parsed = F.coalesce(F.nullif(raw.try_cast("bigint"), F.lit(0)), F.lit(default_max_tokens).cast("bigint"))
    temp = F.coalesce(F.col("temperature"), F.lit(default_temperature))
    return options.select(
        "id", temp.alias("temperature"), parsed.alias("max_tokens"),
        F.least(parsed, F.lit(generation_cap).cast("bigint")).alias("generation_tokens"),
        temp.between(0.0, 2.0).alias("temperature_ok"),
        parsed.between(1, 8192).alias("max_tokens_ok"))


def active_models(model_versions: DataFrame) -> DataFrame:
    """Active model versions with their JSON config fields."""
    cfg = F.from_json("config", "max_tokens bigint, temperature double, top_p double")
    return (model_versions.filter(F.col("is_active"))
                          .select("version_name", "model_type", cfg.alias("c"))
                          .select("version_name", "model_type", "c.max_tokens", "c.temperature", "c.top_p"))


def eval_results(evaluations: DataFrame) -> DataFrame:
    """Evaluation outcomes stored as model-version rows named ``eval_<task>``."""
    return evaluations.select(
        F.concat(F.lit("eval_"), F.col("task_id").cast("string")).alias("version_name"),
        F.lit(MODEL_TYPE).alias("model_type"),
        F.col("model_path"),
        F.to_json(F.col("metrics")).alias("performance_metrics"),
        F.lit(False).alias("is_active"))

