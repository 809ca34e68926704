"""DuckDB text of the canonical fixture tables (same rules as
``parley.sources.fixtures``), composed as CTEs in front of each oracle query."""

from __future__ import annotations

FIXTURE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": ((), """
select conv_id*4294967296+turn as id, conv_id as conversation_id, turn, role, text as content,
       case when role='assistant' then concat('model-', cast(conv_id%3 as varchar)) else null end as model_version,
       case when role='assistant' then (conv_id*7919+turn*104729)%120000 else null end as inference_time_ms,
       conv_id*3600+turn*60 as created_s
from conversations"""),
    "conversations_hdr": ((), """
select conv_id as id, conv_id%20 as user_id, cast(null as varchar) as title,
       concat('model-', cast(conv_id%3 as varchar)) as model_version,
       max(case when role='system' then text else null end) as system_prompt,
       conv_id*3600 as created_s, conv_id*3600+max(turn)*60 as updated_s, conv_id%4=3 as is_archived
from conversations group by conv_id"""),
    "feedback": (("messages",), """
select m.id*4+m.k as id, m.id as message_id, (m.conversation_id*13+m.k)%50 as user_id,
       case (m.conversation_id+m.turn*3+m.k)%4 when 0 then 'thumbs_up' when 1 then 'thumbs_down'
            when 2 then 'regenerate' else 'report' end as feedback_type,
       case when (m.conversation_id*5+m.turn+m.k)%7=0 then null
            else (m.conversation_id*37+m.turn*53+m.k*29)%201-100 end as score_centi,
       case when (m.conversation_id+m.k)%3<>0 then concat('note ', cast(m.conversation_id as varchar)) end as feedback_text,
       m.created_s+30+m.k as created_s
from (select id, conversation_id, turn, created_s, unnest([0,1,2]) as k
      from messages where role='assistant') m
where m.k < (m.conversation_id+m.turn)%4"""),
    "users": ((), """
select c_custkey as id, concat('u', cast(c_custkey as varchar), '@example.com') as email, c_name as username,
       case when c_mktsegment='MACHINERY' then 'premium' else 'free' end as subscription_tier,
       c_custkey%7<>0 as is_active, cast(null as bigint) as last_login_s
from customer"""),
    "agent_tasks": ((), """
select o_orderkey as id,
       case o_orderkey%4 when 0 then 'trainer' when 1 then 'evaluator' when 2 then 'db_manager' else 'support' end as agent_type,
       case o_orderkey%9
            when 0 then 'start_rlhf_training' when 1 then 'evaluate_model' when 2 then 'toxicity_check'
            when 3 then 'hallucination_detection' when 4 then 'cleanup_old_conversations' when 5 then 'backup_feedback_data'
            when 6 then 'analyze_user_feedback' else 'unknown' end as task_type,
       case o_orderstatus when 'O' then 'pending' when 'P' then 'running' else 'completed' end as status,
       concat('{"user_id": ', cast(o_custkey as varchar), case when o_orderkey%3=0 then ', "days_old": 7' else '' end,
              case when o_orderkey%9=2 then concat(', "content_id": "c1", "content": "', case when o_orderkey%8<4 then 'a Toxic line' else 'a fine line' end, '"')
                   when o_orderkey%9=3 then concat(', "response_id": "r1", "context": "short", "response": "', case when o_orderkey%8<4 then 'an answer far longer' else 'brief' end, '"')
                   when o_orderkey%9=0 and o_orderkey%8<4 then ', "mode": "supervised", "lr": 0.5, "opt": {"k": [1, 2]}'
                   when o_orderkey%9=1 then concat(', "model_path": "models/', cast(o_orderkey as varchar), '"')
                   else '' end, '}') as input_data,
       cast(substr(o_orderpriority,1,1) as bigint) as priority,
       o_orderkey*10 as created_s,
       case when o_orderstatus='O' then null else o_orderkey*10+o_custkey%7200 end as started_s
from orders"""),
    "requests": ((), """
select event_id as id, user_id, case when event_type in ('click','view') then '/api/chat' else '/api/feedback' end as endpoint,
       case when event_type='error' then 500 else 200 end as status,
       cast(floor(value*100) as bigint) as latency_ms, cast(ts as timestamp) as ts
from events"""),
    "training_steps": ((), """
select l_suppkey as session_id, l_linenumber as epoch, l_orderkey as step,
       l_discount+l_tax as eval_loss, l_orderkey*60+l_linenumber as created_s
from lineitem"""),
    "message_embeddings": ((), """
select vec_id as message_id, embedding, label from embeddings"""),
    "task_events": ((), """
select l_orderkey as task_id,
       case when l_linenumber=1 then 'running' when l_returnflag='R' then 'failed'
            when l_linestatus='F' then 'completed' else 'running' end as status,
       l_orderkey*10+l_linenumber*60 as ts_s,
       case when l_returnflag='R' then concat('line ', cast(l_linenumber as varchar), ' returned') end as error_message,
       to_json({'quantity': l_quantity})::varchar as output_data
from lineitem"""),
    "model_versions": (("messages",), """
select model_version as version_name,
       case when model_version='model-0' then 'primary' else 'custom' end as model_type,
       concat('{"max_tokens": ', cast(count(*)*8 as varchar), ', "temperature": ', printf('%.1f', (max(inference_time_ms)%20)/10.0),
              case when model_version='model-2' then '' else ', "top_p": 0.9' end, '}') as config,
       model_version='model-0' as is_active
from messages where role='assistant' group by model_version"""),
}


def with_fixtures(body: str, *needs: str, ctes: str = "") -> str:
    """Prefix ``body`` with the fixture CTEs it needs (dependencies first),
    then any query-specific CTEs given in ``ctes`` (text after ``WITH``)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in FIXTURE_SQL[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} as ({FIXTURE_SQL[n][1]}\n)" for n in order]
    if ctes.strip():
        parts.append(ctes.strip())
    if not parts:
        return body.strip()
    return "with " + ",\n".join(parts) + "\n" + body.strip()
