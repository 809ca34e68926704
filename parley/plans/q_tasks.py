"""Queries over the agent task table, request topics and model versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tasks as TK
from ..sources.fixtures import chat_tables
from .catalog import register
from .oracle_fixtures import with_fixtures as W
from .q_training import MEAN_REWARD_SQL, MODEL_CTES, mean_reward

AS_OF_TASKS = 120_000_000     # epoch seconds; task created_s = orderkey * 10
TASK_AS_OF = 360_000          # for conversation archive counts inside dispatch
STUCK_HOURS = 1
BACKUP_DAYS = 2


@register("task_payload", W("""
select id, task_type, json_extract_string(input_data, '$.user_id') as user_id,
       coalesce(try_cast(json_extract_string(input_data, '$.days_old') as bigint), 30) as days_old
from agent_tasks""", "agent_tasks"))
def q_task_payload(spark, sf_dir):
    return TK.task_payload(chat_tables(spark, sf_dir).agent_tasks)


@register("dequeue_tasks", W("""
select id, agent_type, task_type, input_data, priority, created_s from agent_tasks
where status = 'pending' order by priority desc nulls first, created_s asc nulls last, id limit 50""",
    "agent_tasks"))
def q_dequeue(spark, sf_dir):
    return TK.dequeue_tasks(chat_tables(spark, sf_dir).agent_tasks, 50)


@register("stuck_tasks", W(f"""
select count(*) filter (where status = 'running' and started_s < {AS_OF_TASKS} - {STUCK_HOURS} * 3600) as stuck_tasks
from agent_tasks""", "agent_tasks"))
def q_stuck(spark, sf_dir):
    return TK.stuck_tasks(chat_tables(spark, sf_dir).agent_tasks, AS_OF_TASKS, STUCK_HOURS)


@register("queue_depth", W("""
select agent_type, count(*) as queue_size, count(*) > 100 as alarm from agent_tasks
where status in ('pending', 'queued') group by agent_type""", "agent_tasks"))
def q_queue_depth(spark, sf_dir):
    return TK.queue_depth(chat_tables(spark, sf_dir).agent_tasks, 100)


_ROLLUP = """
select {key},
       arg_max(status, (ts_s, status, coalesce(output_data, ''), coalesce(error_message, ''))) as status,
       max(ts_s) filter (where status = 'running') as started_s,
       max(ts_s) filter (where status in ('completed', 'failed')) as completed_s,
       arg_max(output_data, (ts_s, status, coalesce(output_data, ''), coalesce(error_message, ''))) filter (where status = 'completed') as output_data,
       {error} as error_message
from {src} group by {key}"""
_LAST = "arg_max_null(error_message, (ts_s, status, coalesce(output_data, ''), coalesce(error_message, ''))) filter (where status {})"
_TASK_ERROR, _SESSION_ERROR = _LAST.format("= 'failed'"), _LAST.format("in ('completed', 'failed')")


@register("task_state", W(f"""
select t.id, t.agent_type, t.task_type, coalesce(r.status, t.status) as status,
       coalesce(r.started_s, t.started_s) as started_s, r.completed_s, r.output_data, r.error_message
from agent_tasks t left join ({_ROLLUP.format(key='task_id', src='task_events', error=_TASK_ERROR)}) r on r.task_id = t.id""",
    "agent_tasks", "task_events"))
def q_task_state(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return TK.task_state(t.agent_tasks, t.task_events)


_SESSION_EVENTS = """
session_events as (select session_id,
       case when epoch = 1 then 'running' when eval_loss > 0.15 then 'failed' else 'completed' end as status,
       created_s as ts_s,
       case when eval_loss > 0.15 then concat('eval_loss ', printf('%.2f', eval_loss)) end as error_message,
       concat('{"step": ', cast(step as varchar), '}') as output_data
from training_steps)"""


def _session_events(t):
    loss = F.col("eval_loss")
    return t.training_steps.select(
        "session_id",
        F.when(F.col("epoch") == 1, "running").when(loss > 0.15, "failed").otherwise("completed").alias("status"),
        F.col("created_s").alias("ts_s"),
        F.when(loss > 0.15, F.concat(F.lit("eval_loss "), F.format_string("%.2f", loss))).alias("error_message"),
        F.concat(F.lit('{"step": '), F.col("step").cast("string"), F.lit("}")).alias("output_data"))


@register("session_state", W(_ROLLUP.format(key="session_id", src="session_events", error=_SESSION_ERROR),
                             "training_steps", ctes=_SESSION_EVENTS))
def q_session_state(spark, sf_dir):
    return TK.session_state(_session_events(chat_tables(spark, sf_dir)))


def _dispatch_sql() -> str:
    ctes = f"""
p as (select id, agent_type, task_type, input_data,
             coalesce(try_cast(json_extract_string(input_data, '$.days_old') as bigint), 30) as days_old,
             try_cast(json_extract_string(input_data, '$.user_id') as bigint) as payload_user_id
      from agent_tasks),
arch as (select d.days_old, count(c.id) as archived
         from (select distinct days_old from p where agent_type = 'db_manager' and task_type = 'cleanup_old_conversations') d
         left join conversations_hdr c on not c.is_archived and c.created_s < {TASK_AS_OF} - d.days_old * 86400
         group by d.days_old),
st as (select c.user_id, f.feedback_type as type,
              coalesce(round(sum(f.score_centi)::double / nullif(count(f.score_centi)::double, 0) / 100.0, 6), 0.0) as avg_score,
              count(*) as count
       from feedback f join messages m on f.message_id = m.id join conversations_hdr c on m.conversation_id = c.id
       group by c.user_id, f.feedback_type),
summ as (select user_id,
                string_agg(concat('{{"type":"', type, '","avg_score":',
                                  case when avg_score = 0 then '0' else
                                  regexp_replace(regexp_replace(printf('%.6f', avg_score), '0+$', ''), '[.]$', '') end,
                                  ',"count":', cast(count as varchar), '}}'), ',' order by type, avg_score, count) as summary
         from st group by user_id),
bk as (select count(*) as n from feedback f join messages m on f.message_id = m.id
       where f.created_s >= {TASK_AS_OF} - {BACKUP_DAYS} * 86400),
o as (select p.id, p.agent_type, p.task_type,
        case when p.agent_type = 'trainer' then '{{"status":"submitted"}}'
             when p.agent_type = 'evaluator' and p.task_type = 'toxicity_check' then
               to_json({{'is_toxic': regexp_matches(lower(coalesce(json_extract_string(p.input_data, '$.content'), '')), 'hate|toxic|offensive'),
                        'confidence': case when regexp_matches(lower(coalesce(json_extract_string(p.input_data, '$.content'), '')), 'hate|toxic|offensive') then 0.95 else 0.05 end,
                        'content_id': json_extract_string(p.input_data, '$.content_id')}})::varchar
             when p.agent_type = 'evaluator' and p.task_type = 'hallucination_detection' then
               to_json({{'has_hallucination': length(coalesce(json_extract_string(p.input_data, '$.response'), '')) >
                                               2 * length(coalesce(json_extract_string(p.input_data, '$.context'), '')),
                        'confidence': 0.8, 'response_id': json_extract_string(p.input_data, '$.response_id')}})::varchar
             when p.agent_type = 'db_manager' and p.task_type = 'cleanup_old_conversations' then
               to_json({{'archived_conversations': coalesce(a.archived, 0)}})::varchar
             when p.agent_type = 'db_manager' and p.task_type = 'backup_feedback_data' then
               to_json({{'backup_path': coalesce(json_extract_string(p.input_data, '$.backup_path'), '/tmp/feedback_backup.json'),
                        'records_count': (select n from bk)}})::varchar
             when p.agent_type = 'support' and p.task_type = 'analyze_user_feedback' then
               concat('{{"user_id":', coalesce(cast(p.payload_user_id as varchar), 'null'),
                      ',"feedback_summary":[', coalesce(s.summary, ''), ']}}')
        end as output_data
      from p left join arch a on a.days_old = p.days_old
      left join summ s on s.user_id = p.payload_user_id)"""
    return W("""
select id, agent_type, task_type, case when output_data is null then 'failed' else 'completed' end as status,
       output_data, case when output_data is null then concat('unsupported task type: ', task_type) end as error_message
from o""", "agent_tasks", "conversations_hdr", "feedback", "messages", ctes=ctes)


@register("dispatch_tasks", _dispatch_sql())
def q_dispatch(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return TK.dispatch_tasks(t.agent_tasks, t.conversations, t.feedback, t.messages, TASK_AS_OF, BACKUP_DAYS)


_ENCODED = """
enc as (select case when task_type = 'start_rlhf_training' then 'training_requests' else 'evaluation_requests' end as topic,
               cast(id as varchar) as key,
               case when task_type = 'start_rlhf_training'
                    then concat('{"task_id":', id, ',"type":"', case when json_extract_string(input_data, '$.mode') = 'supervised'
                                then 'supervised_training' else 'rlhf_training' end, '","config":', input_data, '}')
                    else to_json({'task_id': id, 'type': 'model_evaluation',
                                  'model_path': json_extract_string(input_data, '$.model_path'),
                                  'eval_dataset': json_extract_string(input_data, '$.eval_dataset')})::varchar end as value,
               id, task_type, input_data
        from agent_tasks where agent_type = 'trainer' and task_type in ('start_rlhf_training', 'evaluate_model'))"""


@register("encode_requests", W("select topic, key, value from enc", "agent_tasks", ctes=_ENCODED))
def q_encode(spark, sf_dir):
    return TK.encode_requests(chat_tables(spark, sf_dir).agent_tasks)


@register("decode_requests", W("""
select topic, cast(id as varchar) as task_id, case when task_type <> 'start_rlhf_training' then 'model_evaluation'
            when json_extract_string(input_data, '$.mode') = 'supervised' then 'supervised_training' else 'rlhf_training' end as type,
       case when task_type = 'start_rlhf_training' then json_extract_string(input_data, '$.user_id') end as config_user_id,
       case when task_type <> 'start_rlhf_training' then json_extract_string(input_data, '$.model_path') end as model_path,
       case when task_type <> 'start_rlhf_training' then json_extract_string(input_data, '$.eval_dataset') end as eval_dataset
from enc""", "agent_tasks", ctes=_ENCODED))
def q_decode(spark, sf_dir):
    return TK.decode_requests(TK.encode_requests(chat_tables(spark, sf_dir).agent_tasks))


@register("route_requests", W("""
select topic, cast(id as varchar) as task_id, case when task_type <> 'start_rlhf_training' then 'model_evaluation'
            when json_extract_string(input_data, '$.mode') = 'supervised' then 'supervised_training' else 'rlhf_training' end as type,
       case when task_type = 'start_rlhf_training' then json_extract_string(input_data, '$.user_id') end as config_user_id,
       case when task_type <> 'start_rlhf_training' then json_extract_string(input_data, '$.model_path') end as model_path,
       case when task_type <> 'start_rlhf_training' then json_extract_string(input_data, '$.eval_dataset') end as eval_dataset,
       case when task_type <> 'start_rlhf_training' then 'evaluation'
            when json_extract_string(input_data, '$.mode') = 'supervised' then 'supervised' else 'rlhf' end as route
from enc""", "agent_tasks", ctes=_ENCODED))
def q_route(spark, sf_dir):
    return TK.route_requests(TK.decode_requests(TK.encode_requests(chat_tables(spark, sf_dir).agent_tasks)))


GAUGE_AS_OF = 1_704_931_200   # 2024-01-11 00:00:00 UTC, inside the events' month
GAUGE_TTL = 3600


@register("live_gauges", W(f"""
select key, arg_max(value, (ts_s, value)) as value, max(ts_s) as ts_s from (
  select concat('agent_queue_size:', event_type) as key, value, floor(epoch(ts))::bigint as ts_s from events)
where ts_s > {GAUGE_AS_OF} - {GAUGE_TTL} and ts_s <= {GAUGE_AS_OF} group by key"""))
def q_live_gauges(spark, sf_dir):
    e = chat_tables(spark, sf_dir).raw("events")
    samples = e.select(F.concat(F.lit("agent_queue_size:"), "event_type").alias("key"), "value",
                       F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"))
    return TK.live_gauges(samples, GAUGE_AS_OF, GAUGE_TTL)


_OPTIONS = """
opts as (select event_id as id,
       case when event_id % 5 = 0 then null else (event_id % 30) / 10.0 end as temperature,
       case event_id % 6 when 0 then null when 1 then 'abc' when 2 then concat(' ', cast(event_id % 9000 as varchar), 'tok')
            when 3 then '0' when 4 then concat('-', cast(event_id % 50 as varchar)) else cast(event_id % 10000 as varchar) end
         as max_tokens_raw
from events)"""


def _options(t):
    i = F.col("event_id")
    m6 = i % 6
    return t.raw("events").select(
        i.alias("id"),
        F.when(i % 5 == 0, F.lit(None).cast("double")).otherwise((i % 30) / 10.0).alias("temperature"),
        F.when(m6 == 0, F.lit(None).cast("string")).when(m6 == 1, "abc")
         .when(m6 == 2, F.concat(F.lit(" "), (i % 9000).cast("string"), F.lit("tok")))
         .when(m6 == 3, "0").when(m6 == 4, F.concat(F.lit("-"), (i % 50).cast("string")))
         .otherwise((i % 10000).cast("string")).alias("max_tokens_raw"))


@register("request_params", W("""
select id, coalesce(temperature, 0.7) as temperature, mt as max_tokens, least(mt, 512) as generation_tokens,
       coalesce(temperature, 0.7) between 0.0 and 2.0 as temperature_ok, mt between 1 and 8192 as max_tokens_ok
from (select id, temperature,
             coalesce(nullif(try_cast(regexp_extract(max_tokens_raw, '^\\s*([+-]?\\d+)', 1) as bigint), 0), 4096) as mt
      from opts)""", ctes=_OPTIONS))
def q_request_params(spark, sf_dir):
    return TK.request_params(_options(chat_tables(spark, sf_dir)))


@register("active_models", W("""
select version_name, model_type, try_cast(json_extract_string(config, '$.max_tokens') as bigint) as max_tokens,
       try_cast(json_extract_string(config, '$.temperature') as double) as temperature,
       try_cast(json_extract_string(config, '$.top_p') as double) as top_p
from model_versions where is_active""", "model_versions"))
def q_active_models(spark, sf_dir):
    return TK.active_models(chat_tables(spark, sf_dir).model_versions)


CACHE_AS_OF = 200_000


@register("cache_live", W(f"""
select concat('context:', cast(id as varchar)) as cache_key,
       to_json({{'id': id, 'user_id': user_id, 'updated_s': updated_s}})::varchar as payload,
       updated_s + 3600 * (1 + id % 48) as expires_s
from conversations_hdr where updated_s + 3600 * (1 + id % 48) > {CACHE_AS_OF}""", "conversations_hdr"))
def q_cache_live(spark, sf_dir):
    """Per-conversation context caches written at their last update with a
    1–48 h TTL; the live ones at ``CACHE_AS_OF``."""
    from ..sources import sinks
    c = chat_tables(spark, sf_dir).conversations
    entries = c.select(
        F.concat(F.lit("context:"), F.col("id").cast("string")).alias("cache_key"),
        F.to_json(F.struct("id", "user_id", "updated_s")).alias("payload"),
        (F.col("updated_s") + F.lit(3600) * (1 + F.col("id") % 48)).alias("expires_s"))
    return sinks.live_cache(entries, CACHE_AS_OF)


@register("eval_results", W(f"""
select concat('eval_', cast(t.id as varchar)) as version_name, 'deepseek' as model_type,
       json_extract_string(t.input_data, '$.model_path') as model_path,
       to_json({{'mean_reward': m.mean_reward, 'n_samples': m.n_samples}})::varchar as performance_metrics, false as is_active
from agent_tasks t, ({MEAN_REWARD_SQL}) m
where t.task_type = 'evaluate_model'""", "agent_tasks", "feedback", "messages", ctes=MODEL_CTES))
def q_eval_results(spark, sf_dir):
    """Evaluation tasks stored as ``eval_<task>`` model versions with the mean
    reward that the fitted reward model gives the evaluation set."""
    t = chat_tables(spark, sf_dir)
    ev = (t.agent_tasks.filter(F.col("task_type") == "evaluate_model")
           .select(F.col("id").alias("task_id"), F.get_json_object("input_data", "$.model_path").alias("model_path"))
           .crossJoin(F.broadcast(mean_reward(t)))    # one row
           .select("task_id", "model_path", F.struct("mean_reward", "n_samples").alias("metrics")))
    return TK.eval_results(ev)


@register("start_tasks", W(f"""
select t.id, t.agent_type, t.task_type,
       case when d.id is not null then 'running' else t.status end as status,
       t.input_data, t.priority, t.created_s,
       case when d.id is not null then {AS_OF_TASKS} else t.started_s end as started_s
from agent_tasks t left join (
  select id from agent_tasks where status = 'pending'
  order by priority desc nulls first, created_s asc nulls last, id limit 50) d on d.id = t.id""", "agent_tasks"))
def q_start_tasks(spark, sf_dir):
    """Dequeue then rewrite the task table: the picked tasks become running."""
    t = chat_tables(spark, sf_dir).agent_tasks
    return TK.start_tasks(t, TK.dequeue_tasks(t, 50), AS_OF_TASKS).select(
        "id", "agent_type", "task_type", "status", "input_data", "priority", "created_s", "started_s")
