"""Queries of the row builders, lookups and list operations: rows written with
the schema's defaults, cache entries, ids, one owner's conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embedded as E
from ..operators import history as H
from ..sources import sinks as S
from ..sources.fixtures import chat_tables
from .catalog import register
from .oracle_fixtures import with_fixtures as W

AS_OF = 400_000
CONVERSATION, OWNER = 7, 7


@register("new_conversations", W(f"""
select id, user_id, null::varchar as title, case when id % 2 = 0 then model_version else 'deepseek-v1.0' end as model_version,
       system_prompt, {AS_OF}::bigint as created_s, {AS_OF}::bigint as updated_s, false as is_archived
from conversations_hdr""", "conversations_hdr"))
def q_new_conversations(spark, sf_dir):
    c = chat_tables(spark, sf_dir).conversations
    return S.new_conversations(c.withColumn("model_version", F.when(F.col("id") % 2 == 0, F.col("model_version"))), AS_OF)


@register("new_users", W(f"""
select id, email, username, case when id % 3 = 0 then subscription_tier else 'free' end as subscription_tier,
       true as is_active, null::bigint as last_login_s, {AS_OF}::bigint as created_s from users""", "users"))
def q_new_users(spark, sf_dir):
    u = chat_tables(spark, sf_dir).users
    return S.new_users(u.withColumn("subscription_tier", F.when(F.col("id") % 3 == 0, F.col("subscription_tier"))), AS_OF)


@register("new_messages", W("""
select id, conversation_id, role, case when id % 9 = 4 then '  ' || chr(10) when id % 9 = 5 then null else content end as content
from messages where id % 9 not in (4, 5)""", "messages"))
def q_new_messages(spark, sf_dir):
    """Blank and missing texts are not sent."""
    i = F.col("id")
    m = chat_tables(spark, sf_dir).messages.select(
        "id", "conversation_id", "role", F.when(i % 9 == 4, F.lit("  \n")).when(i % 9 != 5, F.col("content")).alias("content"))
    return S.new_messages(m)


@register("rejected_feedback", W("""
select id, feedback_type, score_centi from (
  select id, case when id % 5 = 1 then 'meh' when id % 5 = 2 then null else feedback_type end as feedback_type,
         case when id % 3 = 1 then 150 else score_centi end as score_centi from feedback)
where feedback_type is null or feedback_type not in ('thumbs_up', 'thumbs_down', 'regenerate', 'report')
   or (score_centi is not null and score_centi not between -100 and 100)""", "feedback"))
def q_rejected_feedback(spark, sf_dir):
    """The rows that a checked append keeps out."""
    i = F.col("id")
    f = chat_tables(spark, sf_dir).feedback.select(
        "id", F.when(i % 5 == 1, "meh").when(i % 5 != 2, F.col("feedback_type")).alias("feedback_type"),
        F.when(i % 3 == 1, 150).otherwise(F.col("score_centi")).cast("bigint").alias("score_centi"))
    return S.split_checked(f, S.feedback_violation())[1]


@register("new_tasks", W(f"""
select id, agent_type, task_type, input_data, case when id % 2 = 0 then priority else 5 end as priority, 'pending' as status,
       {AS_OF}::bigint as created_s, null::bigint as started_s from agent_tasks""", "agent_tasks"))
def q_new_tasks(spark, sf_dir):
    t = chat_tables(spark, sf_dir).agent_tasks
    return S.new_tasks(t.withColumn("priority", F.when(F.col("id") % 2 == 0, F.col("priority"))), AS_OF)


@register("new_training_sessions", W(f"""
select id, case when id % 2 = 0 then 'v1' end as model_version_id, 'rlhf' as training_type, 'pending' as status,
       '{{"epochs":' || (id % 7) || '}}' as config, null::varchar as metrics, null::bigint as started_s, null::bigint as completed_s,
       {AS_OF}::bigint as created_s
from agent_tasks where task_type = 'start_rlhf_training'""", "agent_tasks"))
def q_new_sessions(spark, sf_dir):
    t = chat_tables(spark, sf_dir).agent_tasks.filter("task_type = 'start_rlhf_training'")
    return S.new_training_sessions(t.select(
        F.col("id").alias("task_id"), F.when(F.col("id") % 2 == 0, "v1").alias("model_version_id"), F.lit("rlhf").alias("training_type"),
        F.struct((F.col("id") % 7).alias("epochs")).alias("config")), AS_OF)


@register("run_manifest", W("""
select session_id as run_id, strftime(make_timestamp(max(created_s) * 1000000), '%Y%m%d_%H%M%S') as stamp,
       '{"config":{"steps":' || count(*) || '},"model_type":"reward"}' as manifest
from training_steps group by session_id""", "training_steps"))
def q_run_manifest(spark, sf_dir):
    runs = chat_tables(spark, sf_dir).training_steps.groupBy(F.col("session_id").alias("run_id")).agg(
        F.max("created_s").alias("ts_s"), F.struct(F.count(F.lit(1)).alias("steps")).alias("config"), F.lit("reward").alias("model_type"))
    return S.run_manifest(runs)


@register("cache_entries", W(f"""
select 'users' as cache_key, '{{"id":' || id || ',"username":"' || username || '"}}' as payload, {AS_OF + 3600}::bigint as expires_s
from users""", "users"))
def q_cache_entries(spark, sf_dir):
    return S.cache_entries(chat_tables(spark, sf_dir).users.select("id", "username"), "users", AS_OF)


@register("counter_keys", W("""
select id, 'rate_limit:' || user_id || ':' || endpoint as counter_key,
       regexp_replace(md5('["' || user_id || '","' || endpoint || '"]'),
                      '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as record_id
from requests""", "requests"))
def q_counter_keys(spark, sf_dir):
    r = chat_tables(spark, sf_dir).requests
    return r.select("id", T.composite_key("rate_limit", F.col("user_id").cast("string"), F.col("endpoint")).alias("counter_key"),
                    T.record_id(F.col("user_id"), F.col("endpoint")).alias("record_id"))


_DOC = """
select c.id as conversation_id, c.user_id, count(*) as n_messages,
       md5(string_agg(m.role || ':' || coalesce(m.content, ''), chr(10) order by m.created_s, m.id)) as messages_md5
from conversations_hdr c join messages m on m.conversation_id = c.id {where} group by c.id, c.user_id"""


def _digest(docs):
    lines = F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), F.coalesce(x["content"], F.lit(""))))
    return docs.select("conversation_id", "user_id", F.size("messages").cast("bigint").alias("n_messages"),
                       F.md5(F.array_join(lines, "\n")).alias("messages_md5"))


@register("conversation_nested", W(_DOC.format(where=""), "conversations_hdr", "messages"))
def q_conversation_nested(spark, sf_dir):
    """The API's shape, one row for each conversation; here with a digest of its message array."""
    t = chat_tables(spark, sf_dir)
    return _digest(H.conversation_documents(t.conversations, t.messages, nested=True))


@register("conversation_of_owner", W(_DOC.format(where=f"where c.id = {CONVERSATION} and c.user_id = {OWNER}"),
                                     "conversations_hdr", "messages"))
def q_conversation_of_owner(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return _digest(H.conversation_of_owner(t.conversations, t.messages, CONVERSATION, OWNER))


@register("kept_history", W("""
select m.conversation_id, m.turn, m.id, m.role, m.content from messages m
join (select conversation_id, turn from messages where id = (select max(id) from messages where role = 'assistant')) x
  on x.conversation_id = m.conversation_id and m.turn < x.turn""", "messages"))
def q_kept_history(spark, sf_dir):
    m = chat_tables(spark, sf_dir).messages
    newest = m.filter("role = 'assistant'").agg(F.max("id")).scalar()
    return H.kept_history(m.drop("turn"), newest)


@register("history_list", W("""
select user_id, md5(array_to_string(ids, ',')) as ids_md5, len(ids)::bigint as n from (
  select user_id, list(id order by first desc, k, id) as ids from (
    select user_id, id, max(first) as first, min(k) as k from (
      select user_id, id, 0 as first, -updated_s as k from conversations_hdr where not is_archived
      union all select user_id, id, 1, null from conversations_hdr where id % 10 = 0)
    group by user_id, id) group by user_id)""".replace("first desc, k, id", "first desc, case when first = 0 then k end, id"),
    "conversations_hdr"))
def q_history_list(spark, sf_dir):
    c = chat_tables(spark, sf_dir).conversations
    ids = H.prepend_history(c, c.filter(F.col("id") % 10 == 0).select("id", "user_id"))
    return ids.select("user_id", F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.size("ids").cast("bigint").alias("n"))


def _text_time(seconds):
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


@register("embedded_users", W("""
select id, email, username, case when id % 3 = 0 then subscription_tier else 'free' end as subscription_tier, is_active,
       case when id % 2 = 0 then id * 1000 end as last_login_s from users""", "users"))
def q_embedded_users(spark, sf_dir):
    i = F.col("id")
    u = chat_tables(spark, sf_dir).users
    return E.users(u.select("id", "email", "username", F.when(i % 3 == 0, F.col("subscription_tier")).alias("subscription_tier"),
                            F.col("is_active").cast("int").alias("is_active"),
                            F.when(i % 2 == 0, _text_time(i * 1000)).otherwise(F.lit("never")).alias("last_login")))


@register("embedded_conversations", W("""
select id, user_id, title, case when id % 2 = 0 then model_version else 'deepseek-chat' end as model_version, system_prompt,
       created_s, updated_s, is_archived from conversations_hdr""", "conversations_hdr"))
def q_embedded_conversations(spark, sf_dir):
    c = chat_tables(spark, sf_dir).conversations
    return E.conversations(c.select(
        "id", "user_id", "title", F.when(F.col("id") % 2 == 0, F.col("model_version")).alias("model_version"), "system_prompt",
        _text_time("created_s").alias("created_at"), _text_time("updated_s").alias("updated_at"),
        F.when(F.col("is_archived"), 1).alias("is_archived")))


@register("embedded_messages", W("""
select id, conversation_id, role, content, model_version, nullif(inference_time_ms, 0) as inference_time_ms, created_s
from messages""", "messages"))
def q_embedded_messages(spark, sf_dir):
    m = chat_tables(spark, sf_dir).messages
    return E.messages(m.withColumn("inference_time_ms", F.coalesce("inference_time_ms", F.lit(0)))
                       .withColumn("created_at", _text_time("created_s")))


@register("embedded_model_versions", W("""
select version_name, 'custom' as model_type, '{}' as config, is_active from model_versions""", "model_versions"))
def q_embedded_versions(spark, sf_dir):
    v = chat_tables(spark, sf_dir).model_versions
    return E.model_versions(v.select(F.split_part("version_name", F.lit("-"), F.lit(1)).alias("name"),
                                     F.split_part("version_name", F.lit("-"), F.lit(2)).alias("version"),
                                     F.when(F.col("is_active"), 1).otherwise(0).alias("is_active")))
