"""Queries of the per-row text functions, chunk streams and usage summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as CH
from ..operators import prompts as PR
from ..sources.fixtures import chat_tables
from .catalog import register
from .oracle_fixtures import with_fixtures as W

WS_RE = r"[\s\v\x{85}\pZ]+"
EDGE_WS = r"^[\s\v\x{85}\pZ]+|[\s\v\x{85}\pZ]+$"


def _ntok(col: str) -> str:
    return f"len(list_filter(regexp_split_to_array({col}, '{WS_RE}'), lambda x: x <> ''))"


@register("format_latency", W("""
select id, inference_time_ms,
       case when inference_time_ms >= 60000 then
              case when (inference_time_ms % 60000) // 1000 > 0
                   then concat(inference_time_ms // 60000, 'm ', (inference_time_ms % 60000) // 1000, 's')
                   else concat(inference_time_ms // 60000, 'm') end
            when inference_time_ms >= 1000 then concat(inference_time_ms // 1000, 's')
            else concat(inference_time_ms, 'ms') end as latency_text
from messages where inference_time_ms is not null""", "messages"))
def q_format_latency(spark, sf_dir):
    m = chat_tables(spark, sf_dir).messages.filter(F.col("inference_time_ms").isNotNull())
    return m.select("id", "inference_time_ms", T.format_duration("inference_time_ms").alias("latency_text"))


@register("render_prompts", W("""
select conversation_id, md5(p) as prompt_md5, length(p)::bigint as prompt_chars from (
  select conversation_id,
         string_agg(case role when 'system' then content || chr(10) || chr(10)
                              when 'user' then '### Instruction:' || chr(10) || content || chr(10) || chr(10)
                              when 'assistant' then '### Response:' || chr(10) || content || chr(10) || chr(10)
                              else '' end, '' order by created_s, id) || '### Response:' || chr(10) as p
  from messages group by conversation_id)""", "messages"))
def q_render_prompts(spark, sf_dir):
    p = PR.render_prompts(chat_tables(spark, sf_dir).messages)
    return p.select("conversation_id", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("bigint").alias("prompt_chars"))


@register("pair_text", W("""
select feedback_id, md5('Query: ' || query || chr(10) || 'Response: ' || response) as text_md5,
       length('Query: ' || query || chr(10) || 'Response: ' || response)::bigint as text_chars, score_centi
from fd""", "feedback", "messages", ctes="""
fd as (select f.id as feedback_id, u.content as query, a.content as response, f.score_centi
       from feedback f join messages a on a.id = f.message_id and a.role = 'assistant'
       join messages u on u.conversation_id = a.conversation_id and u.turn = a.turn - 1 and u.role = 'user'
       where f.score_centi is not null)"""))
def q_pair_text(spark, sf_dir):
    from ..operators.feedback import feedback_dataset
    t = chat_tables(spark, sf_dir)
    d = feedback_dataset(t.messages, t.feedback)
    txt = T.pair_text("query", "response")
    return d.select("feedback_id", F.md5(txt).alias("text_md5"), F.length(txt).cast("bigint").alias("text_chars"),
                    "score_centi")


@register("toxicity_check", W("""
select id, regexp_matches(lower(content), 'hate|toxic|offensive') as is_toxic,
       case when regexp_matches(lower(content), 'hate|toxic|offensive') then 0.95 else 0.05 end::double as confidence
from messages""", "messages"))
def q_toxicity(spark, sf_dir):
    return PR.toxicity_check(chat_tables(spark, sf_dir).messages)


@register("hallucination_check", W("""
select a.id as message_id, length(a.content) > 2 * length(u.content) as has_hallucination, 0.8::double as confidence
from messages a join messages u on u.conversation_id = a.conversation_id and u.turn = a.turn - 1
where a.role = 'assistant' and u.role = 'user'""", "messages"))
def q_hallucination(spark, sf_dir):
    return PR.hallucination_check(chat_tables(spark, sf_dir).messages)


@register("message_preview", W(f"""
select id, substr(regexp_replace(content, '{EDGE_WS}', '', 'g'), 1, 100) as preview from messages""", "messages"))
def q_preview(spark, sf_dir):
    return chat_tables(spark, sf_dir).messages.select("id", T.preview("content").alias("preview"))


@register("format_dates", W("""
select id, strftime(make_timestamp(created_s * 1000000), '%Y%m%d_%H%M%S') as stamp,
       strftime(make_timestamp(created_s * 1000000), '%Y-%m-%dT%H:%M:%S') as iso,
       created_s as epoch_s
from messages""", "messages"))
def q_format_dates(spark, sf_dir):
    m = chat_tables(spark, sf_dir).messages
    ts = F.timestamp_seconds("created_s")
    return m.select("id", F.date_format(ts, "yyyyMMdd_HHmmss").alias("stamp"),
                    F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
                    F.unix_seconds(ts).alias("epoch_s"))


def _code_answers(t):
    # Assistant answers of every third conversation carry their first line as a
    # fenced code block (language from the model); derived, not invented rows.
    m = t.messages.filter(F.col("role") == "assistant")
    first_line = F.substring_index("content", "\n", 1)
    fenced = F.when(F.col("conversation_id") % 3 == 0,
                    F.concat("content", F.lit("\n```"), F.regexp_replace("model_version", "-", "_"),
                             F.lit("\n"), first_line, F.lit("\n```\n")))
    return m.select("id", F.coalesce(fenced, F.col("content")).alias("content"))


@register("code_blocks", W("""
select id, (generate_subscripts(langs, 1) - 1)::bigint as block_index,
       nullif(unnest(langs), '') as language, regexp_replace(unnest(bodies), '\\n$', '') as code
from (select id, regexp_extract_all(content, '```(\\w*)\\n([\\s\\S]*?)```', 1) as langs,
             regexp_extract_all(content, '```(\\w*)\\n([\\s\\S]*?)```', 2) as bodies
      from (select id, case when conversation_id % 3 = 0
                            then content || chr(10) || '```' || replace(model_version, '-', '_') || chr(10)
                                 || split_part(content, chr(10), 1) || chr(10) || '```' || chr(10)
                            else content end as content
            from messages where role = 'assistant'))
where len(langs) > 0""", "messages"))
def q_code_blocks(spark, sf_dir):
    return PR.code_blocks(_code_answers(chat_tables(spark, sf_dir)))


@register("token_usage", W(f"""
select conversation_id, model_version,
       sum(case when role <> 'assistant' then {_ntok('content')} else 0 end)::bigint as prompt_tokens,
       sum(case when role = 'assistant' then {_ntok('content')} else 0 end)::bigint as completion_tokens,
       sum(length(content))::bigint as characters,
       (sum(case when role <> 'assistant' then {_ntok('content')} else 0 end)
        + sum(case when role = 'assistant' then {_ntok('content')} else 0 end))::bigint as total_tokens
from (select conversation_id, role, content, case when role = 'assistant' then model_version else
             min(model_version) filter (role = 'assistant') over (partition by conversation_id) end as model_version
      from messages) group by conversation_id, model_version""", "messages"))
def q_token_usage(spark, sf_dir):
    return CH.token_usage(chat_tables(spark, sf_dir).messages)


@register("latency_by_model", W("""
select model_version, count(*) as n, round(avg(inference_time_ms), 6) as mean_ms,
       round(quantile_cont(inference_time_ms::double, 0.95), 6) as p95_ms
from messages where inference_time_ms is not null group by model_version""", "messages"))
def q_latency(spark, sf_dir):
    return CH.latency_by_model(chat_tables(spark, sf_dir).messages)


@register("latency_sketch", W("""
select model_version, count(*) as n, true as within_bound
from messages where inference_time_ms is not null group by model_version""", "messages"))
def q_latency_sketch(spark, sf_dir):
    """p95 per model from sketches per model and hour, and whether its rank is within the stated bound."""
    m = chat_tables(spark, sf_dir).messages.filter(F.col("inference_time_ms").isNotNull())
    hourly = CH.latency_sketches(m.withColumn("hour", F.floor(F.col("created_s") / 3600)), ["model_version", "hour"])
    p95 = CH.merge_sketches(hourly, ["model_version"]).select("model_version", CH.sketch_quantile(0.95).alias("p95"))
    x = F.col("inference_time_ms")
    ranks = m.join(p95, "model_version").groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n"), F.avg((x < F.col("p95")).cast("int")).alias("below"), F.avg((x <= F.col("p95")).cast("int")).alias("upto"))
    near = (F.col("below") <= 0.95 + CH.RANK_ERROR) & (F.col("upto") >= 0.95 - CH.RANK_ERROR)
    return ranks.select("model_version", "n", near.alias("within_bound"))


def _chunks(t):
    return CH.build_sse_lines(t.messages, finished_when=F.col("message_id") % 5 != 0,
                              malformed_when=F.col("seq") % 11 == 5, empty_when=F.col("seq") % 13 == 6,
                              last_text_when=F.col("message_id") % 3 == 0)


_WORDS = """
w as (select id as message_id, unnest(string_split(content, ' ')) as word,
             (generate_subscripts(string_split(content, ' '), 1) - 1)::bigint as seq
      from messages where role = 'assistant')"""


@register("assemble_chunks", W("""
select message_id, coalesce(string_agg(word || ' ', '' order by seq) filter (seq % 11 <> 5 and seq % 13 <> 6), '')
       || case when message_id % 3 = 0 then 'THE END' else '' end as content
from w where message_id % 5 <> 0 group by message_id""", "messages", ctes=_WORDS))
def q_assemble(spark, sf_dir):
    return CH.assemble_chunks(_chunks(chat_tables(spark, sf_dir)))


@register("parse_chunks", W("""
select message_id, seq, case when seq % 11 = 5 then 'malformed' when seq % 13 = 6 then 'ignored' else 'content' end as kind,
       case when seq % 11 = 5 or seq % 13 = 6 then null else word || ' ' end as content, null::varchar as finish_reason
from w
union all
select message_id, max(seq) + 1, 'finish', case when message_id % 3 = 0 then 'THE END' end, 'stop' from w where message_id % 5 <> 0 group by message_id
union all
select message_id, max(seq) + 2, 'done', null, null from w where message_id % 5 <> 0 group by message_id""",
    "messages", ctes=_WORDS))
def q_parse(spark, sf_dir):
    return CH.parse_chunks(_chunks(chat_tables(spark, sf_dir)))


@register("chunk_stats", W("""
select message_id, count(*) as n_lines, count(*) filter (where seq % 11 = 5 and is_word) as n_malformed,
       bool_or(not is_word) as finished
from (select message_id, seq, true as is_word from w
      union all select message_id, max(seq) + 1, false from w where message_id % 5 <> 0 group by message_id
      union all select message_id, max(seq) + 2, false from w where message_id % 5 <> 0 group by message_id)
group by message_id""", "messages", ctes=_WORDS))
def q_chunk_stats(spark, sf_dir):
    """Lines, malformed lines (counted, not silently skipped) and finish per message."""
    return CH.chunk_stats(_chunks(chat_tables(spark, sf_dir)))
