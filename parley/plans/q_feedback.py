"""Queries over feedback: statistics, reward data, evaluation and preference sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feedback as fb
from ..operators import preference as pr
from ..sources.fixtures import chat_tables
from .catalog import register
from .oracle_fixtures import with_fixtures as W

# Fixed query parameters shared by Spark and the oracle.
AS_OF = 360_000          # epoch seconds; the sf0.01 conversations span 0 .. ~360k s
BACKUP_DAYS = 2


def _avg(s: str, n: str) -> str:
    return f"round(({s})::double / nullif(({n})::double, 0) / 100.0, 6)"


@register("feedback_stats", W(f"""
select c.user_id, f.feedback_type,
       coalesce({_avg('sum(f.score_centi)', 'count(f.score_centi)')}, 0.0) as avg_score,
       count(*) as feedback_count
from feedback f join messages m on f.message_id = m.id
join conversations_hdr c on m.conversation_id = c.id
group by c.user_id, f.feedback_type""", "feedback", "messages", "conversations_hdr"))
def q_feedback_stats(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return fb.feedback_stats(t.feedback, t.messages, t.conversations)


_FEEDBACK_DATASET_SQL = W("""
select f.id as feedback_id, a.id as message_id, u.content as query, a.content as response,
       f.score_centi, f.score_centi / 100.0 as feedback_score, f.feedback_type, f.feedback_text,
       f.created_s as feedback_created_s
from feedback f
join messages a on a.id = f.message_id and a.role = 'assistant'
join messages u on u.conversation_id = a.conversation_id and u.turn = a.turn - 1 and u.role = 'user'
where f.score_centi is not null""", "feedback", "messages")


@register("feedback_dataset", _FEEDBACK_DATASET_SQL)
def q_feedback_dataset(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return fb.feedback_dataset(t.messages, t.feedback)


@register("sample_check", W("""
select count(*) as n_samples, count(*) >= 10 as enough from feedback f
join messages a on a.id = f.message_id and a.role = 'assistant'
join messages u on u.conversation_id = a.conversation_id and u.turn = a.turn - 1 and u.role = 'user'
where f.score_centi is not null""", "feedback", "messages"))
def q_sample_check(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return fb.sample_check(fb.feedback_dataset(t.messages, t.feedback), 10)


@register("recent_feedback", W(f"""
select id, message_id, user_id, feedback_type, score_centi, feedback_text, created_s from feedback
where created_s >= {AS_OF} - {BACKUP_DAYS} * 86400""", "feedback"))
def q_recent_feedback(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return fb.recent_feedback(t.feedback, AS_OF, BACKUP_DAYS)


@register("feedback_backup", W(f"""
select f.id, f.message_id, f.user_id, f.feedback_type, f.score_centi, f.feedback_text, f.created_s, m.content as message_content
from feedback f join messages m on f.message_id = m.id
where f.created_s >= {AS_OF} - {BACKUP_DAYS} * 86400""", "feedback", "messages"))
def q_feedback_backup(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return fb.feedback_backup(t.feedback, t.messages, AS_OF, BACKUP_DAYS).select(
        "id", "message_id", "user_id", "feedback_type", "score_centi", "feedback_text", "created_s", "message_content")


@register("score_feedback_types", W("""
select id, feedback_type, case feedback_type when 'thumbs_up' then 1.0 when 'thumbs_down' then -1.0 end::double as ui_score
from feedback""", "feedback"))
def q_score_feedback_types(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return fb.score_feedback_types(t.feedback)


@register("normalize_feedback", W("""
select id, message_id, user_id,
       case s when 1 then 'thumbs_up' when -1 then 'thumbs_down' when 0 then 'regenerate' else 'report' end as feedback_type,
       (s * 100)::bigint as score_centi, comment as feedback_text, created_s
from (select id, message_id, user_id,
             case when score_centi is null then null when score_centi > 33 then 1 when score_centi < -33 then -1 else 0 end as s,
             case when score_centi % 3 = 0 then concat('comment ', cast(id as varchar)) end as comment, created_s
      from feedback) f""", "feedback"))
def q_normalize_feedback(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    sc = F.col("score_centi")
    # SQLite-form rows (score −1/0/1 and a free comment) derived from the ratings.
    lite = t.feedback.select(
        "id", "message_id", "user_id",
        F.when(sc.isNull(), F.lit(None)).when(sc > 33, 1).when(sc < -33, -1).otherwise(0).cast("bigint").alias("score"),
        F.when(sc % 3 == 0, F.concat(F.lit("comment "), F.col("id").cast("string"))).alias("comment"),
        "created_s")
    return fb.normalize_feedback(lite)


# ---------------------------------------------------------------- preference

_PAIRS_LATER = """
rated as (select message_id, sum(score_centi) as sum_centi, count(*) as n_ratings
          from feedback where score_centi is not null group by message_id),
qa as (select u.id as query_id, u.content as query, a.content as response, r.sum_centi, r.n_ratings
       from messages u join messages a on a.conversation_id = u.conversation_id and a.created_s > u.created_s
       join rated r on r.message_id = a.id
       where u.role = 'user' and a.role = 'assistant')"""


@register("evaluation_dataset", W(f"""
select query_id, query, response, {_avg('s', 'n')} as avg_score
from (select query_id, query, response, sum(sum_centi) as s, sum(n_ratings) as n
      from qa group by query_id, query, response having sum(n_ratings) >= 2) g
order by s::double / n desc, query_id, response limit 100""", "feedback", "messages", ctes=_PAIRS_LATER))
def q_evaluation_dataset(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return pr.evaluation_dataset(t.messages, t.feedback, 2, 100).drop("sum_centi", "n_ratings")


_SCORES = _PAIRS_LATER + """,
scores as (select query, response, sum(sum_centi) as sum_centi, sum(n_ratings) as feedback_count
           from qa group by query, response having sum(n_ratings) >= 2)"""


@register("response_scores", W(f"""
select query, response, {_avg('sum_centi', 'feedback_count')} as avg_score,
       feedback_count::bigint as feedback_count, sum_centi::bigint as sum_centi
from scores""", "feedback", "messages", ctes=_SCORES))
def q_response_scores(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return pr.response_scores(t.messages, t.feedback, 2)


@register("preference_pairs", W("""
select a.query, a.response as response_a, b.response as response_b,
       case when a.sum_centi * b.feedback_count > b.sum_centi * a.feedback_count then 1 else 0 end as preference
from scores a join scores b on a.query = b.query and a.response <> b.response
where abs(a.sum_centi * b.feedback_count - b.sum_centi * a.feedback_count) > 20 * a.feedback_count * b.feedback_count""",
    "feedback", "messages", ctes=_SCORES))
def q_preference_pairs(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return pr.preference_pairs(pr.response_scores(t.messages, t.feedback, 2), 20, ordered=True)


_POOL = """
pool as (select distinct u.content as query, u.conversation_id
         from messages u
         where u.role = 'user' and u.conversation_id in (
               select m.conversation_id from feedback f join messages m on f.message_id = m.id))"""


@register("training_pool", W("select query, conversation_id from pool", "feedback", "messages", ctes=_POOL))
def q_training_pool(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return pr.training_pool(t.messages, t.feedback)


@register("training_batch", W("""
select query, conversation_id, md5(concat('42|', cast(conversation_id as varchar), '|', query)) as sample_key
from pool order by sample_key, conversation_id, query limit 8""", "feedback", "messages", ctes=_POOL))
def q_training_batch(spark, sf_dir):
    t = chat_tables(spark, sf_dir)
    return pr.training_batch(pr.training_pool(t.messages, t.feedback), 8, 42)


@register("training_sample", W("""
select query, conversation_id, md5(concat('42|', cast(conversation_id as varchar), '|', query)) as sample_key
from pool order by sample_key, conversation_id, query limit (select count(*) // 10 from pool)""", "feedback", "messages", ctes=_POOL))
def q_training_sample(spark, sf_dir):
    """A tenth of the pool."""
    t = chat_tables(spark, sf_dir)
    pool = pr.training_pool(t.messages, t.feedback)
    return pr.training_sample(pool, pool.count() // 10, 42)
