"""Queries over chat history: scans, lookups, listings, documents, rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..sources.fixtures import chat_tables
from .catalog import register
from .oracle_fixtures import with_fixtures as W

AS_OF = 360_000
ARCHIVE_DAYS = 2
CONTEXT_N = 4

# DuckDB text of the title rule (first 5 words / 50 characters).
WS_RE = r"[\s\v\x{85}\pZ]+"


def title_sql(col: str) -> str:
    ws = f"list_filter(regexp_split_to_array({col}, '{WS_RE}'), lambda x: x <> '')"
    base = (f"(case when len({ws}) > 5 then array_to_string({ws}[1:5], ' ') || '...' "
            f"when len({ws}) > 0 then array_to_string({ws}, ' ') else {col} end)")
    return f"(case when length({base}) > 50 then substr({base}, 1, 50) || '...' else {base} end)"


_FIRST_USER = """
fu as (select conversation_id, content as first_message from messages where role = 'user'
       qualify row_number() over (partition by conversation_id order by created_s, id) = 1)"""


@register("scan_messages", W("""
select id as message_id, conversation_id, role, content as text, created_s from messages""", "messages"))
def q_scan_messages(spark, sf_dir):
    return H.scan_messages(chat_tables(spark, sf_dir).messages)


@register("active_users", W("""
select id, email, username, subscription_tier from users where is_active""", "users"))
def q_active_users(spark, sf_dir):
    return H.active_users(chat_tables(spark, sf_dir).users)


@register("user_history", W("""
select id, user_id, title, model_version, created_s, updated_s from conversations_hdr where not is_archived""",
    "conversations_hdr"))
def q_user_history(spark, sf_dir):
    return H.user_history(chat_tables(spark, sf_dir).conversations)


@register("conversation_documents", W("""
select c.id as conversation_id, c.user_id, c.title, c.updated_s as conversation_updated_s,
       m.id as message_id, m.role, m.content, m.created_s
from conversations_hdr c join messages m on m.conversation_id = c.id""", "conversations_hdr", "messages"))
def q_conversation_documents(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return H.conversation_documents(t.conversations, t.messages)


@register("conversation_context", W(f"""
select conversation_id, id, role, content, created_s, position from (
  select conversation_id, id, role, content, created_s,
         row_number() over (partition by conversation_id order by created_s asc nulls last, id) as position
  from messages) where position <= {CONTEXT_N}""", "messages"))
def q_conversation_context(spark, sf_dir):
    return H.conversation_context(chat_tables(spark, sf_dir).messages, CONTEXT_N)


@register("conversation_titles", W(f"""
select conversation_id, {title_sql('first_message')} as title from fu""", "messages", ctes=_FIRST_USER))
def q_conversation_titles(spark, sf_dir):
    return H.conversation_titles(chat_tables(spark, sf_dir).messages)


@register("apply_titles", W(f"""
select c.id, coalesce({title_sql('fu.first_message')}, c.title) as title, c.user_id, c.model_version,
       c.system_prompt, c.created_s,
       case when fu.first_message is not null then {AS_OF} else c.updated_s end as updated_s, c.is_archived
from conversations_hdr c left join fu on fu.conversation_id = c.id""", "messages", "conversations_hdr",
    ctes=_FIRST_USER))
def q_apply_titles(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return H.apply_titles(t.conversations, H.conversation_titles(t.messages), AS_OF)


@register("unanswered_conversations", W("""
select conversation_id, last_role, n_messages, has_answer from (
  select conversation_id, arg_max(role, created_s * 1000000000 + id) as last_role, count(*) as n_messages,
         bool_or(role = 'assistant') as has_answer
  from messages group by conversation_id) where last_role = 'user'""", "messages"))
def q_unanswered(spark, sf_dir):
    return H.unanswered_conversations(chat_tables(spark, sf_dir).messages)


@register("regenerate_requests", W("""
select a.id as message_id, a.conversation_id, u.content as prompt, a.turn as kept_messages
from messages a join messages u on u.conversation_id = a.conversation_id and u.turn = a.turn - 1
where a.role = 'assistant' and u.role = 'user'""", "messages"))
def q_regenerate(spark, sf_dir):
    return H.regenerate_requests(chat_tables(spark, sf_dir).messages)


@register("history_display", W(f"""
select c.id, coalesce(nullif({title_sql('fu.first_message')}, ''), 'New Conversation') as display_title,
       upper(substr(coalesce(nullif({title_sql('fu.first_message')}, ''), 'New Conversation'), 1, 1)) as initial,
       strftime(make_timestamp((case when fu.first_message is not null then {AS_OF} else c.updated_s end) * 1000000),
                '%Y-%m-%d') as updated_date
from conversations_hdr c left join fu on fu.conversation_id = c.id""", "messages", "conversations_hdr",
    ctes=_FIRST_USER))
def q_history_display(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return H.history_display(H.apply_titles(t.conversations, H.conversation_titles(t.messages), AS_OF))


_LOGINS = """
logins as (select user_id, floor(epoch(ts))::bigint as ts_s from events where event_type in ('signup', 'view'))"""


@register("last_login", W("""
select u.id, u.email, u.username, u.subscription_tier, u.is_active,
       coalesce(l.last_s, u.last_login_s) as last_login_s
from users u left join (select user_id, max(ts_s) as last_s from logins group by user_id) l on l.user_id = u.id""",
    "users", ctes=_LOGINS))
def q_last_login(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    logins = t.raw("events").filter(F.col("event_type").isin("signup", "view")).select(
        "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"))
    return H.last_login(t.users, logins)


_ARCHIVED = f"""
arch as (select id, user_id, title, model_version, system_prompt, created_s, updated_s,
                is_archived or created_s < {AS_OF} - {ARCHIVE_DAYS} * 86400 as is_archived,
                (created_s < {AS_OF} - {ARCHIVE_DAYS} * 86400) and not is_archived as archived_now
         from conversations_hdr)"""


@register("archive_conversations", W("select * from arch", "conversations_hdr", ctes=_ARCHIVED))
def q_archive(spark, sf_dir):
    return H.archive_conversations(chat_tables(spark, sf_dir).conversations, AS_OF, ARCHIVE_DAYS)


@register("archive_counts", W("""
select count(*) filter (where archived_now) as archived_conversations, count(*) as total_conversations
from arch""", "conversations_hdr", ctes=_ARCHIVED))
def q_archive_counts(spark, sf_dir):
    return H.archive_counts(H.archive_conversations(chat_tables(spark, sf_dir).conversations, AS_OF, ARCHIVE_DAYS))


@register("stale_conversations", W(f"""
select id, user_id, title, model_version, system_prompt, created_s, updated_s, is_archived
from conversations_hdr where created_s < {AS_OF} - {ARCHIVE_DAYS} * 86400 and not is_archived""",
    "conversations_hdr"))
def q_stale(spark, sf_dir):
    return H.stale_conversations(chat_tables(spark, sf_dir).conversations, AS_OF, ARCHIVE_DAYS)
