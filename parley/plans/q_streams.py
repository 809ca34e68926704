"""Queries of the request-log operators (batch forms of the stream logic)."""

from __future__ import annotations

import uuid

from ..operators import requests as RQ
from ..session import checkpoint_path
from ..sources.fixtures import chat_tables
from ..streaming.runner import start_parquet
from ..streaming.windows import requests_per_window_stream
from .catalog import register
from .oracle_fixtures import with_fixtures as W

# Scaled parameters: the synthetic log holds about one request per user per
# day, so the production limits (60/min, 0.1 errors/s) would never trip.
RL_LIMIT, RL_TTL_S = 5, 86_400
ERR_THRESHOLD, ERR_HOLD_S = 0.005, 120
LAT_THRESHOLD_S, LAT_HOLD_S = 5.0, 300


_RL_CTES = f"""
ev as (
  select id, user_id, endpoint, epoch_us(ts) as t,
         row_number() over (partition by user_id, endpoint order by ts, id) as rn
  from requests),
st as (
  select user_id, endpoint, rn, id, t, 0::bigint as cnt_before, true as allowed, 1::bigint as cnt, t as last_t
  from ev where rn = 1
  union all
  select e.user_id, e.endpoint, e.rn, e.id, e.t, x.cb, x.cb < {RL_LIMIT},
         case when x.cb < {RL_LIMIT} then x.cb + 1 else x.cb end,
         case when x.cb < {RL_LIMIT} then e.t else s.last_t end
  from st s join ev e on e.user_id = s.user_id and e.endpoint = s.endpoint and e.rn = s.rn + 1,
       lateral (select case when e.t - s.last_t >= {RL_TTL_S}::bigint * 1000000 then 0 else s.cnt end as cb) x)"""


@register("rate_limit_decisions", "with recursive " + W(f"""
select user_id, endpoint, id, allowed, case when allowed then {RL_LIMIT} - cnt_before - 1 else 0 end as remaining
from st""", "requests", ctes=_RL_CTES)[len("with "):])
def q_rate_limit(spark, sf_dir):
    return RQ.rate_limit_decisions(chat_tables(spark, sf_dir).requests, RL_LIMIT, RL_TTL_S)


@register("requests_per_window", W("""
select (floor(epoch_us(ts) / 60000000) * 60)::bigint as window_start_s, user_id, endpoint, count(*) as request_count
from requests group by all""", "requests"))
def q_requests_per_window(spark, sf_dir):
    return RQ.requests_per_window(chat_tables(spark, sf_dir).requests)


@register("polled_requests", W("""
select window_start_s, user_id, endpoint, request_count from (
  select (floor(epoch_us(ts) / 60000000) * 60)::bigint as window_start_s, user_id, endpoint, count(*) as request_count
  from requests group by all)
where (window_start_s + 60) * 1000 <= (select epoch_ms(max(ts)) from requests) - 600000""", "requests"))
def q_polled_requests(spark, sf_dir):
    """The request log as files that a stream polls until none is left; windows
    that the watermark (10 minutes) has closed are in the sink."""
    name = f"parley-polled-{uuid.uuid4().hex}"
    log, out = checkpoint_path(spark, name + "-log"), checkpoint_path(spark, name + "-out")
    requests = chat_tables(spark, sf_dir).requests.select("user_id", "endpoint", "ts")
    requests.write.parquet(log)
    polled = requests_per_window_stream(spark.readStream.schema(requests.schema).parquet(log))
    start_parquet(polled, out, name, trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema(polled.schema).parquet(out)


_SLIDING = """
sl as (select endpoint, status, latency_ms, (floor(epoch_us(ts) / 60000000) * 60)::bigint - 60 * j as window_start_s
       from requests, (select unnest([0, 1, 2, 3, 4]) as j))"""


def _held_sql(src: str, hold_s: int) -> str:
    m = hold_s // 60
    return (f"(select count(*) from {src} f2 where f2.endpoint = f.endpoint and f2.window_start_s "
            f"between f.window_start_s - {m * 60} and f.window_start_s) = {m + 1}")


@register("alert_error_rate", W(f"""
select endpoint, window_end_s, errors, error_rate from fire f where {_held_sql('fire', ERR_HOLD_S)}""",
    "requests", ctes=_SLIDING + f""",
win as (select endpoint, window_start_s, window_start_s + 300 as window_end_s,
               count(*) filter (where status >= 500) as errors from sl group by endpoint, window_start_s),
fire as (select *, round(errors / 300.0, 6) as error_rate from win where errors > {ERR_THRESHOLD} * 300)"""))
def q_alert_error_rate(spark, sf_dir):
    return RQ.alert_error_rate(chat_tables(spark, sf_dir).requests, ERR_THRESHOLD, ERR_HOLD_S)


def _quantile_sql(q: float = 0.95) -> str:
    b = RQ.LATENCY_BUCKETS_MS
    rank = f"({q} * total)"
    parts = []
    for i, hi in enumerate(b):
        lo = float(b[i - 1]) if i else 0.0
        prev = f"le_{b[i - 1]}" if i else "0"
        parts.append(f"when le_{hi} >= {rank} then {lo} + {float(hi) - lo} * ({rank} - {prev}) / (le_{hi} - {prev})")
    return "(case " + " ".join(parts) + f" else {float(b[-1])} end)"


@register("alert_latency", W(f"""
select endpoint, window_end_s, total, p95_s from fire f where {_held_sql('fire', LAT_HOLD_S)}""",
    "requests", ctes=_SLIDING + """,
win as (select endpoint, window_start_s, window_start_s + 300 as window_end_s, count(*) as total, """
    + ", ".join(f"count(*) filter (where latency_ms <= {x}) as le_{x}" for x in RQ.LATENCY_BUCKETS_MS)
    + f""" from sl group by endpoint, window_start_s),
fire as (select endpoint, window_start_s, window_end_s, total, round({_quantile_sql()} / 1000.0, 6) as p95_s
         from win where round({_quantile_sql()} / 1000.0, 6) > {LAT_THRESHOLD_S})"""))
def q_alert_latency(spark, sf_dir):
    return RQ.alert_latency(chat_tables(spark, sf_dir).requests, LAT_THRESHOLD_S, LAT_HOLD_S)


@register("latency_p95_exact", W("""
select endpoint, window_start_s, count(*) as total,
       round(quantile_cont(latency_ms::double, 0.95) / 1000.0, 6) as p95_exact_s
from sl group by endpoint, window_start_s""", "requests", ctes=_SLIDING))
def q_latency_p95_exact(spark, sf_dir):
    return RQ.latency_windows_exact(chat_tables(spark, sf_dir).requests)
