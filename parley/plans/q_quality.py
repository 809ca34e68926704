"""Queries of the data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.fixtures import chat_tables
from .catalog import register
from .oracle_fixtures import with_fixtures as W


# Every rule is broken by some rows, derived from the keys the same way in both engines.
_DIRTY = """
d_messages as (select id, case when conversation_id % 7 = 1 and turn = 0 then null else conversation_id end as conversation_id,
                      case when conversation_id % 11 = 2 and turn = 1 then 'tool' when conversation_id % 11 = 3 and turn = 1 then null else role end as role,
                      case when conversation_id % 13 = 4 then null else content end as content from messages),
d_feedback as (select id, case when id % 17 = 1 then null when id % 17 = 2 then -id - 1 else message_id end as message_id, user_id,
                      case when id % 5 = 1 then 'meh' when id % 5 = 2 then null else feedback_type end as feedback_type,
                      case when id % 3 = 1 then 150 else score_centi end as score_centi from feedback),
d_users as (select id, case when id % 7 = 1 then 'no at sign' when id % 7 = 2 then null when id % 7 = 3 then 'u3@example.com' else email end as email,
                   case when id % 9 = 1 then 'ab' when id % 9 = 2 then 'a|b' else username end as username,
                   case when id % 6 = 1 then null else concat('key', cast(id % 50 as varchar)) end as api_key from users),
d_conversations as (select id, case when id % 8 = 1 then null when id % 8 = 2 then 1000000000 + id else user_id end as user_id,
                           case when id % 10 = 3 then null else model_version end as model_version from conversations_hdr),
d_versions as (select version_name from model_versions union all select version_name from model_versions where version_name <> 'model-0'),
d_sessions as (select distinct session_id as id, concat('model-', cast(session_id % 5 as varchar)) as model_version from training_steps),
d_limits as (select min(id) as id, case when user_id % 4 = 1 then -user_id else user_id end as user_id, endpoint,
                    floor(epoch(ts) / 60)::bigint * 60 as window_start, count(*) as request_count
             from requests group by user_id, endpoint, floor(epoch(ts) / 60)::bigint * 60),
d_embeddings as (select message_id, case when message_id % 9 = 1 then null when message_id % 9 = 2 then embedding[1:10] else embedding end as embedding
                 from message_embeddings)"""
_DIRTY_NEEDS = ("messages", "feedback", "users", "conversations_hdr", "model_versions", "training_steps", "requests", "message_embeddings")


def DW(body):
    return W(body, *_DIRTY_NEEDS, ctes=_DIRTY)


def _limits(t):
    """The counter table behind the rate limits: one row for each user, endpoint and minute."""
    window = (F.floor(F.unix_micros("ts") / 60_000_000) * 60).cast("bigint")
    return (t.requests.groupBy("user_id", "endpoint", window.alias("window_start"))
            .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("request_count")))


class _Dirty:
    def __init__(self, spark, sf_dir):
        t = chat_tables(spark, sf_dir)
        i, c, turn = F.col("id"), F.col("conversation_id"), F.col("turn")
        null = F.lit(None)
        self.messages = t.messages.select(
            "id", F.when(~((c % 7 == 1) & (turn == 0)), c).alias("conversation_id"),
            F.when((c % 11 == 2) & (turn == 1), "tool").when(~((c % 11 == 3) & (turn == 1)), F.col("role")).alias("role"),
            F.when(c % 13 != 4, F.col("content")).alias("content"))
        self.feedback = t.feedback.select(
            "id", F.when(i % 17 == 1, null).when(i % 17 == 2, -i - 1).otherwise(F.col("message_id")).alias("message_id"), "user_id",
            F.when(i % 5 == 1, "meh").when(i % 5 == 2, null).otherwise(F.col("feedback_type")).alias("feedback_type"),
            F.when(i % 3 == 1, 150).otherwise(F.col("score_centi")).alias("score_centi"))
        self.users = t.users.select(
            "id", F.when(i % 7 == 1, "no at sign").when(i % 7 == 2, null).when(i % 7 == 3, "u3@example.com").otherwise(F.col("email")).alias("email"),
            F.when(i % 9 == 1, "ab").when(i % 9 == 2, "a|b").otherwise(F.col("username")).alias("username"),
            F.when(i % 6 != 1, F.concat(F.lit("key"), (i % 50).cast("string"))).alias("api_key"))
        self.conversations = t.conversations.select(
            "id", F.when(i % 8 == 1, null).when(i % 8 == 2, i + 1000000000).otherwise(F.col("user_id")).alias("user_id"),
            F.when(i % 10 != 3, F.col("model_version")).alias("model_version"))
        versions = t.model_versions.select("version_name")
        self.versions = versions.unionByName(versions.filter("version_name <> 'model-0'"))
        self.sessions = t.training_steps.select(F.col("session_id").alias("id")).distinct().withColumn(
            "model_version", F.concat(F.lit("model-"), (F.col("id") % 5).cast("string")))
        user = F.col("user_id")
        self.limits = _limits(t).withColumn("user_id", F.when(user % 4 == 1, -user).otherwise(user))
        m = F.col("message_id")
        self.embeddings = t.message_embeddings.select(
            "message_id", F.when(m % 9 == 1, null).when(m % 9 == 2, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"))


@register("check_enums", DW("""
select 'messages' as table_name, 'role_in_list' as rule, count(*) as n_checked,
       count(*) filter (where not coalesce(role in ('user', 'assistant', 'system'), false)) as n_violations
from d_messages
union all
select 'feedback', 'feedback_type_in_list', count(*),
       count(*) filter (where not coalesce(feedback_type in ('thumbs_up', 'thumbs_down', 'regenerate', 'report'), false))
from d_feedback
union all
select 'feedback', 'score_in_range', count(*),
       count(*) filter (where score_centi is not null and score_centi not between -100 and 100)
from d_feedback"""))
def q_check_enums(spark, sf_dir):
    d = _Dirty(spark, sf_dir)
    return Q.check_enums(d.messages, d.feedback)


@register("check_not_null", DW(" union all ".join(
    f"select '{t}' as table_name, '{c}_not_null' as rule, count(*) as n_checked, "
    f"count(*) filter (where {c} is null) as n_violations from d_{t}" for t, cs in Q.REQUIRED.items() for c in cs)))
def q_check_not_null(spark, sf_dir):
    d = _Dirty(spark, sf_dir)
    return reduce(DataFrame.unionByName, [Q.check_not_null(getattr(d, t), t, list(cs)) for t, cs in Q.REQUIRED.items()])


@register("check_users", DW("""
select id, coalesce(regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), false) as email_ok,
       coalesce(length(username) between 3 and 50, false) as username_ok
from d_users"""))
def q_check_users(spark, sf_dir):
    return Q.check_users(_Dirty(spark, sf_dir).users)


_UNIQUE = {"users": (("email",), ("username",), ("api_key",)), "versions": (("version_name",),),
           "limits": (("user_id", "endpoint", "window_start"),)}
_NAMES = {"users": "users", "versions": "model_versions", "limits": "rate_limits"}


@register("duplicate_keys", DW(" union all ".join(
    f"select '{_NAMES[t]}' as table_name, '{','.join(k)}' as key_columns, "
    f"to_json([{', '.join(f'cast({c} as varchar)' for c in k)}])::varchar as key_value, count(*) as n_rows from d_{t} "
    f"where {' and '.join(f'{c} is not null' for c in k)} group by {', '.join(k)} having count(*) > 1"
    for t, keys in _UNIQUE.items() for k in keys)))
def q_duplicate_keys(spark, sf_dir):
    d = _Dirty(spark, sf_dir)
    return reduce(DataFrame.unionByName, [Q.duplicate_keys(getattr(d, t), _NAMES[t], list(k)) for t, keys in _UNIQUE.items() for k in keys])


#: (child, its name, column, parent, parent's key, child's id): all declared foreign keys.
_FOREIGN = (("feedback", "feedback", "message_id", "messages", "id", "id"), ("feedback", "feedback", "user_id", "users", "id", "id"),
            ("conversations", "conversations", "user_id", "users", "id", "id"),
            ("messages", "messages", "conversation_id", "conversations", "id", "id"),
            ("embeddings", "message_embeddings", "message_id", "messages", "id", "message_id"),
            ("sessions", "training_sessions", "model_version", "versions", "version_name", "id"),
            ("limits", "rate_limits", "user_id", "users", "id", "id"))


@register("orphan_feedback", DW(" union all ".join(
    f"select '{name}.{fk}' as foreign_key, cast({cid} as varchar) as child_id, cast({fk} as varchar) as missing_key from d_{child} "
    f"where {fk} is not null and {fk} not in (select {pk} from d_{parent})" for child, name, fk, parent, pk, cid in _FOREIGN)))
def q_orphans(spark, sf_dir):
    d = _Dirty(spark, sf_dir)
    return reduce(DataFrame.unionByName, [Q.orphans(getattr(d, child), name, fk, getattr(d, parent), pk, cid)
                                          for child, name, fk, parent, pk, cid in _FOREIGN])


@register("cascade_delete", W("""
select table_name, n_before, n_kept, n_before - n_kept as n_deleted from (
  select 'users' as table_name, (select count(*) from users) as n_before,
         (select count(*) from users where id not in (select id from du)) as n_kept
  union all
  select 'conversations', (select count(*) from conversations_hdr),
         (select count(*) from conversations_hdr where id not in (select id from dc))
  union all
  select 'messages', (select count(*) from messages),
         (select count(*) from messages where id not in (select id from dm))
  union all
  select 'feedback', (select count(*) from feedback),
         (select count(*) from feedback where message_id not in (select id from dm)
                                          and user_id not in (select id from du))
  union all
  select 'message_embeddings', (select count(*) from message_embeddings),
         (select count(*) from message_embeddings where message_id not in (select id from dm))
  union all
  select 'rate_limits', (select count(*) from d_limits),
         (select count(*) from d_limits where user_id not in (select id from du)))""", *_DIRTY_NEEDS, ctes=_DIRTY + """,
du as (select id from users where not is_active),
dc as (select id from conversations_hdr where user_id in (select id from du)),
dm as (select id from messages where conversation_id in (select id from dc))"""))
def q_cascade(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    out = Q.cascade_delete(t.users, t.conversations, t.messages, t.feedback, t.message_embeddings,
                           _Dirty(spark, sf_dir).limits, t.users.filter(~F.col("is_active")))
    return out["counts"].select("table_name", "n_before", "n_kept", "n_deleted")


@register("check_dims", DW("""
select message_id, len(embedding)::bigint as dims, coalesce(len(embedding) = 64, false) as dims_ok from d_embeddings"""))
def q_check_dims(spark, sf_dir):
    return Q.check_dims(_Dirty(spark, sf_dir).embeddings, 64)
