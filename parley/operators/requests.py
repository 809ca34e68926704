"""Request-log operators (batch forms): rate-limit decisions, fixed-window
counters, error-rate and latency alerts with a hold duration.

Time is event time from the log; ``ts`` is a TIMESTAMP (cast NTZ input first).
Stream forms of the same logic live in ``parley.streaming``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import written

# Default histogram bucket bounds of a Prometheus client, in
# milliseconds (5 ms … 10 s); observations above the last bound fall in +Inf.
LATENCY_BUCKETS_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


# ------------------------------------------------------------ rate limiter

def rate_limit_fold(ts_us: np.ndarray, limit: int, ttl_us: int, state=None):
    """Idle-reset limiter over one key's requests in (ts, id) order.

    state = (count, last_accept_us).  The counter expires ``ttl`` after the
    last *accepted* request; an allowed request increments it and renews the
    expiry; a denied one changes nothing.  Returns (allowed, remaining, state).

    Jumps instead of stepping: a run of accepted rows ends at the limit or at
    an idle gap, and the denied rows after it end at a binary search for the
    expiry, so the loop runs once for each reset, not for each row.
    """
    n = len(ts_us)
    ts_us = np.asarray(ts_us, dtype=np.int64)
    allowed = np.zeros(n, dtype=bool)
    remaining = np.zeros(n, dtype=np.int64)
    count, last = state if state is not None else (0, None)
    gaps = np.flatnonzero(np.diff(ts_us) >= ttl_us) + 1
    i = 0
    while i < n:
        if last is not None and ts_us[i] - last >= ttl_us:
            count = 0
        if count >= limit:
            if last is None:   # a limit of zero denies everything
                break
            i = max(int(np.searchsorted(ts_us, last + ttl_us, side="left")), i + 1 if limit <= 0 else i)
            continue
        end = min(n, i + limit - count)
        g = int(np.searchsorted(gaps, i, side="right"))
        if g < len(gaps):
            end = min(end, int(gaps[g]))
        allowed[i:end] = True
        remaining[i:end] = limit - count - 1 - np.arange(end - i)
        count, last, i = count + end - i, int(ts_us[end - 1]), end
    return allowed, remaining, (count, last)


def _reset_chain(ts: np.ndarray, limit: int, ttl_us: int) -> tuple[np.ndarray, np.ndarray]:
    """For a reset of the counter at each row: the (count, last accepted) state
    after all rows of ``ts``.

    A reset at row i accepts a run of rows and leads to one next reset: the
    first idle gap in the run, or the first row after the run's last + ttl.
    That map is monotone; following it to its end for all rows at once takes
    log2 steps of index doubling."""
    n, i = len(ts), np.arange(len(ts))
    gaps = np.append(np.flatnonzero(np.diff(ts) >= ttl_us) + 1, n)
    gap = gaps[np.searchsorted(gaps, i, side="right").clip(max=len(gaps) - 1)]
    full = i + limit
    expiry = np.searchsorted(ts, ts[np.minimum(full, n) - 1] + ttl_us, side="left")
    after = np.where(gap < np.minimum(full, n), gap, np.where(full <= n, expiry, n))
    jump = np.where(after < n, after, i)
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return np.minimum(limit, n - jump), ts[np.minimum(jump + limit, n) - 1]


def _bucket_map(ts: np.ndarray, limit: int, ttl_us: int) -> dict:
    """What a bucket of one key's rows does to any state that may enter it: the
    states after its first rows, as far as an entering counter can last (one
    ttl and one run of accepted rows), and its size and last time."""
    n = len(ts)
    count, last = _reset_chain(ts, limit, ttl_us)
    reach = max(limit, int(np.searchsorted(ts, ts[min(limit, n) - 1] + ttl_us, side="left")))
    head = min(n, max(reach, int(np.searchsorted(ts, ts[0] + ttl_us, side="left"))) + 1)
    return {"n": n, "end_us": int(ts[-1]), "head": ts[:head].tolist(), "counts": count[:head].tolist(), "lasts": last[:head].tolist()}


#: Stands for "no accepted request yet" in arrays of last times.
NEVER = np.iinfo(np.int64).min


def _through_all(count: np.ndarray, last: np.ndarray, m: dict, limit: int, ttl_us: int) -> tuple[np.ndarray, np.ndarray]:
    """``_through`` for many states at once, as arrays."""
    head, counts, lasts = (np.asarray(m[c], dtype=np.int64) for c in ("head", "counts", "lasts"))
    n_head = len(head)
    count, last = np.array(count, dtype=np.int64), np.array(last, dtype=np.int64)
    never = last == NEVER
    fresh = never | (head[0] - np.where(never, head[0], last) >= ttl_us)
    room = ~fresh & (count < limit)
    more = np.where(room, limit - count, 0)
    gaps = np.flatnonzero(np.diff(head) >= ttl_us) + 1
    first_gap = int(gaps[0]) if len(gaps) else n_head
    at_gap = room & (first_gap < np.minimum(more, n_head))
    passes = room & ~at_gap & (m["n"] < more)
    fills = room & ~at_gap & ~passes
    full = np.where(fills, head[np.clip(more - 1, 0, n_head - 1)], last)
    # Full counters wait for their expiry; the others reset at row 0 or at the gap.
    wait = fills | (~fresh & ~room)
    reset = np.where(fresh, 0, np.where(at_gap, first_gap, np.where(wait, np.searchsorted(head, np.where(wait, full, 0) + ttl_us), n_head)))
    hit = reset < n_head
    j = np.minimum(reset, n_head - 1)
    out_count = np.where(hit, counts[j], np.where(passes, count + m["n"], np.where(fills, limit, count)))
    out_last = np.where(hit, lasts[j], np.where(passes, m["end_us"], np.where(fills, full, last)))
    return out_count, out_last


def _through(state: tuple[int, int | None], m: dict, limit: int, ttl_us: int) -> tuple[int, int | None]:
    """The state after a bucket, from the state before it and the bucket's map."""
    count, last = state
    head = np.asarray(m["head"], dtype=np.int64)

    def reset_at(j: int, else_state):
        return (int(m["counts"][j]), int(m["lasts"][j])) if j < len(head) else else_state

    if last is None or head[0] - last >= ttl_us:
        return reset_at(0, state)
    if count < limit:
        more = limit - count
        run = head[:min(more, len(head))]
        gaps = np.flatnonzero(np.diff(run) >= ttl_us) + 1
        if len(gaps):
            return reset_at(int(gaps[0]), state)
        if m["n"] < more:
            return count + m["n"], m["end_us"]
        last = int(head[more - 1])
    return reset_at(int(np.searchsorted(head, last + ttl_us, side="left")), (limit, last))


def _compose(a: dict, b: dict, limit: int, ttl_us: int) -> dict:
    """The map of the rows of ``a`` followed by those of ``b``.  Composition is
    associative, so maps can be put together in any grouping."""
    head = np.asarray(a["head"], dtype=np.int64)
    counts, lasts = _through_all(np.asarray(a["counts"]), np.asarray(a["lasts"]), b, limit, ttl_us)
    if len(head) == a["n"]:   # an entering counter may outlast all rows of a
        head, counts, lasts = (np.concatenate((x, np.asarray(b[c], dtype=np.int64)))
                               for x, c in ((head, "head"), (counts, "counts"), (lasts, "lasts")))
    n = a["n"] + b["n"]
    reach = max(limit, int(np.searchsorted(head, head[min(limit, len(head)) - 1] + ttl_us, side="left")))
    cut = min(len(head), max(reach, int(np.searchsorted(head, head[0] + ttl_us, side="left"))) + 1)
    return {"n": n, "end_us": b["end_us"], "head": head[:cut], "counts": counts[:cut], "lasts": lasts[:cut]}


def _runs(names: np.ndarray, bucket: np.ndarray):
    """(start, end) of the runs of equal (name, bucket) rows."""
    if len(bucket) == 0:
        return []
    starts = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (names[1:] != names[:-1]))))
    return zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)])


_MAP = "_k string, {} bigint, n bigint, end_us bigint, head array<bigint>, counts array<bigint>, lasts array<bigint>"
_ENTRY = "_k string, {} bigint, _count bigint, _last bigint"


def _compose_spans(limit: int, ttl_us: int):
    """Sorted maps of buckets → one map for each (key, span)."""
    def run(batches):
        key, held = None, None

        def made():
            return pd.DataFrame([{"_k": key[0], "_span": key[1], **{c: held[c] for c in ("n", "end_us")},
                                  **{c: np.asarray(held[c], dtype=np.int64).tolist() for c in ("head", "counts", "lasts")}}])

        for pdf in batches:
            for m in pdf.to_dict("records"):
                if (m["_k"], m["_span"]) != key:
                    if key is not None:
                        yield made()
                    key, held = (m["_k"], m["_span"]), m
                else:
                    held = _compose(held, m, limit, ttl_us)
        if key is not None:
            yield made()
    return run


def _enter(part: str, unit: list[str], limit: int, ttl_us: int):
    """Sorted maps of a unit → the state that enters each of them.  A unit starts
    from its own ``_count`` and ``_last`` if it has them, else from nothing."""
    def run(batches):
        key, state = None, (0, None)
        for pdf in batches:
            out = []
            for m in pdf.to_dict("records"):
                own = tuple(m[c] for c in unit)
                if own != key:
                    key, first = own, m.get("_last", NEVER)
                    state = (int(m.get("_count", 0)), None if first == NEVER else int(first))
                out.append((m["_k"], m[part], state[0], NEVER if state[1] is None else state[1]))
                state = _through(state, m, limit, ttl_us)
            yield pd.DataFrame(out, columns=["_k", part, "_count", "_last"])
    return run


def bucket_entries(maps: DataFrame, limit: int, ttl_us: int, span: int) -> DataFrame:
    """The state that enters each bucket of each key, by a scan over two levels.

    If a key has more than ``span`` buckets (looked for while the query is built),
    ``span`` buckets in a row are composed to one map; a key's spans are run
    through in order, and then the buckets of each span, from the state that
    enters it.  A key's buckets are spread over as many groups as it has spans,
    and its spans, ``span`` * ``bucket_ttls`` ttls each, are few whatever its rows.
    Else each key's buckets are run through at once."""
    if maps.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > span).isEmpty():
        return maps.repartition("_k").sortWithinPartitions("_k", "_bucket").mapInPandas(
            _enter("_bucket", ["_k"], limit, ttl_us), _ENTRY.format("_bucket"))
    shared = maps.withColumn("_span", F.floor(F.col("_bucket") / span)).repartition("_k", "_span")
    spans = (shared.sortWithinPartitions("_k", "_span", "_bucket")
             .mapInPandas(_compose_spans(limit, ttl_us), _MAP.format("_span")))
    entered = spans.repartition("_k").sortWithinPartitions("_k", "_span").mapInPandas(
        _enter("_span", ["_k"], limit, ttl_us), _ENTRY.format("_span"))
    return (shared.join(entered, ["_k", "_span"]).sortWithinPartitions("_k", "_span", "_bucket")
            .mapInPandas(_enter("_bucket", ["_k", "_span"], limit, ttl_us), _ENTRY.format("_bucket")))


def rate_limit_decisions(requests: DataFrame, limit: int = 60, ttl_s: int = 60,
                         keys: tuple[str, ...] = ("user_id", "endpoint"), bucket_ttls: int = 64,
                         span_buckets: int = 256) -> DataFrame:
    """Allow / deny every request as the idle-reset limiter would have.

    Each key's timeline is cut into buckets of ``bucket_ttls`` ttls; buckets,
    not keys, are the unit of work, so a key with a third of all requests is
    spread over as many tasks as it has buckets, with or without idle gaps.

    1. Every bucket publishes its map from entering to leaving state
       (``_bucket_map``): about 1 / ``bucket_ttls`` of its rows.
    2. The maps are composed in spans of ``span_buckets`` buckets, which gives
       each span and then each bucket the state it starts from (``bucket_entries``).
    3. All buckets decide their rows from there, in parallel.

    The maps are written once while the query is built.  Ids may have any type; a key
    column may be null.  Requests without a time get a null decision.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    ks, ttl_us = list(keys), ttl_s * 1_000_000
    kinds = {c: requests.schema[c].dataType.simpleString() for c in [*ks, "id"]}
    rows = requests.filter(F.col("ts").isNotNull()).select(
        *ks, "id", F.unix_micros("ts").alias("ts_us"), F.to_json(F.struct(*ks), {"ignoreNullFields": "false"}).alias("_k")).withColumn(
        "_bucket", F.floor(F.col("ts_us") / F.lit(ttl_us * bucket_ttls)))

    def publish(batches):
        # Rows come sorted by bucket; the last bucket of a batch may go on in the next.
        key, held = None, []

        def made():
            return {"_k": key[0], "_bucket": key[1]} | _bucket_map(np.concatenate(held), limit, ttl_us)

        for pdf in batches:
            out = []
            ts, bucket, names = pdf["ts_us"].to_numpy(), pdf["_bucket"].to_numpy(), pdf["_k"].to_numpy(dtype=object)
            for a, b in _runs(names, bucket):
                if (names[a], int(bucket[a])) != key:
                    if key is not None:
                        out.append(made())
                    key, held = (names[a], int(bucket[a])), []
                held.append(ts[a:b])
            if out:
                yield pd.DataFrame(out)
        if key is not None:
            yield pd.DataFrame([made()])

    maps = written(rows.select("_k", "_bucket", "ts_us").repartition("_k", "_bucket").sortWithinPartitions("_k", "_bucket", "ts_us")
                   .mapInPandas(publish, _MAP.format("_bucket")))
    entries = bucket_entries(maps, limit, ttl_us, span_buckets)

    def decide(batches):
        key, state = None, (0, None)
        for pdf in batches:
            allowed = np.zeros(len(pdf), dtype=bool)
            remaining = np.zeros(len(pdf), dtype=np.int64)
            ts, bucket, names = pdf["ts_us"].to_numpy(), pdf["_bucket"].to_numpy(), pdf["_k"].to_numpy(dtype=object)
            count, last = (pdf[c].to_numpy() for c in ("_count", "_last"))
            for a, b in _runs(names, bucket):
                if (names[a], bucket[a]) != key:
                    key = (names[a], bucket[a])
                    state = (int(count[a]), None if last[a] == NEVER else int(last[a]))
                allowed[a:b], remaining[a:b], state = rate_limit_fold(ts[a:b], limit, ttl_us, state)
            out = pdf[ks + ["id"]].copy()
            out["allowed"], out["remaining"] = allowed, remaining
            yield out

    known = (rows.join(entries, ["_k", "_bucket"]).repartition("_k", "_bucket")
             .sortWithinPartitions("_k", "_bucket", "ts_us", "id"))
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", allowed boolean, remaining bigint"
    decided = known.select(*ks, "id", "ts_us", "_k", "_bucket", "_count", "_last").mapInPandas(decide, schema)
    untimed = requests.filter(F.col("ts").isNull()).select(*ks, "id", F.lit(None).cast("boolean").alias("allowed"),
                                                           F.lit(None).cast("bigint").alias("remaining"))
    return decided.unionByName(untimed)


# ------------------------------------------------------------ windows

def epoch_s(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 1_000_000).cast("bigint")


def requests_per_window(requests: DataFrame, width: str = "1 minute",
                        keys: tuple[str, ...] = ("user_id", "endpoint")) -> DataFrame:
    """Fixed-window request counter per key (the rate_limits table)."""
    return (requests.groupBy(F.window("ts", width).alias("w"), *keys)
                    .agg(F.count(F.lit(1)).alias("request_count"))
                    .select(epoch_s(F.col("w.start")).alias("window_start_s"), *keys, "request_count"))


def held(windows: DataFrame, keys: list[str], start_col: str, step_s: int, hold_s: int,
         values: tuple[str, ...] = ()) -> DataFrame:
    """Gaps-and-islands "for: hold" on evaluation windows: a firing window at
    start s holds when the windows at s−step, …, s−hold also fire.

    Each firing window votes for itself and the next hold/step windows; a
    window holds when it collects hold/step + 1 votes.  Its own vote carries
    its ``values``.  One explode and one aggregation — no window function over
    a whole key, no self-join, one read of the source.
    """
    m = hold_s // step_s
    votes = windows.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(m))).alias("d"), start_col, *values)
    target = (F.col(start_col) + F.col("d") * step_s).alias(start_col)
    return (votes.select(*keys, target, *[F.when(F.col("d") == 0, F.col(v)).alias(v) for v in values])
                 .groupBy(*keys, start_col).agg(F.count(F.lit(1)).alias("_votes"), *[F.max(v).alias(v) for v in values])
                 .filter(F.col("_votes") == m + 1).drop("_votes"))


def _sliding(requests: DataFrame, keys: tuple[str, ...], width_s: int, step_s: int, aggs: dict[str, Column]) -> DataFrame:
    """Sliding windows of additive counts: rows are first summed for each step,
    then each step's one row is added to the windows that hold it.  A stream
    (whose watermark needs the window column) and widths that steps do not
    divide go through Spark's own sliding window instead."""
    if requests.isStreaming or width_s % step_s:
        w = F.window("ts", f"{width_s} seconds", f"{step_s} seconds").alias("w")
        at = [F.window_time("w").alias("window_time")] if requests.isStreaming else []   # carries the watermark on
        return (requests.groupBy(*keys, w).agg(*[a.alias(n) for n, a in aggs.items()])
                .select(*keys, epoch_s(F.col("w.start")).alias("window_start_s"), epoch_s(F.col("w.end")).alias("window_end_s"), *aggs, *at))
    step = (F.floor(epoch_s(F.col("ts")) / step_s) * step_s).cast("bigint")
    steps = (requests.filter(F.col("ts").isNotNull()).groupBy(*keys, step.alias("_step"))
             .agg(*[a.alias(n) for n, a in aggs.items()]))
    starts = F.sequence(F.col("_step") - width_s + step_s, F.col("_step"), F.lit(step_s).cast("bigint"))
    return (steps.select(*keys, F.explode(starts).alias("window_start_s"), *aggs)
            .groupBy(*keys, "window_start_s").agg(*[F.sum(n).alias(n) for n in aggs])
            .select(*keys, "window_start_s", (F.col("window_start_s") + width_s).alias("window_end_s"), *aggs))


def error_rate_windows(requests: DataFrame, keys: tuple[str, ...] = ("endpoint",),
                       width_s: int = 300, step_s: int = 60) -> DataFrame:
    """Sliding windows (width, step) with error count and errors per second."""
    w = _sliding(requests, keys, width_s, step_s, {
        "requests": F.count(F.lit(1)), "errors": F.count_if(F.col("status") >= 500).cast("bigint")})
    return w.withColumn("error_rate", F.round(F.col("errors") / float(width_s), 6))


def alert_error_rate(requests: DataFrame, threshold_per_s: float = 0.1, hold_s: int = 120,
                     keys: tuple[str, ...] = ("endpoint",), width_s: int = 300, step_s: int = 60) -> DataFrame:
    """Evaluations at which "error rate over width > threshold for hold" fires."""
    ks = list(keys)
    w = error_rate_windows(requests, keys, width_s, step_s)
    firing = w.filter(F.col("errors") > F.lit(threshold_per_s) * width_s)
    return held(firing, ks, "window_start_s", step_s, hold_s, ("window_end_s", "errors", "error_rate")).select(
        *ks, "window_end_s", "errors", "error_rate")


def resolved(alerts: DataFrame, keys: list[str], step_s: int) -> DataFrame:
    """(keys, window_end_s): the first evaluation after each run of alerts that is none."""
    after = alerts.select(*keys, (F.col("window_end_s") + step_s).alias("window_end_s"))
    return after.join(alerts.select(*keys, "window_end_s"), [*keys, "window_end_s"], "left_anti")


def histogram_quantile(q: float, cums: list[Column], total: Column, bounds=LATENCY_BUCKETS_MS) -> Column:
    """Linear interpolation inside the bucket holding rank q·total; a rank in
    the +Inf bucket returns the highest finite bound (in the bounds' unit)."""
    rank = F.lit(q) * total
    expr = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        lo = float(bounds[i - 1]) if i else 0.0
        prev = cums[i - 1] if i else F.lit(0)
        val = F.lit(lo) + F.lit(float(bounds[i]) - lo) * (rank - prev) / (cums[i] - prev)
        expr = F.when(cums[i] >= rank, val).otherwise(expr)
    return expr


def latency_windows(requests: DataFrame, keys: tuple[str, ...] = ("endpoint",), width_s: int = 300,
                    step_s: int = 60, q: float = 0.95, bounds=LATENCY_BUCKETS_MS) -> DataFrame:
    """Sliding windows with cumulative bucket counts and the interpolated quantile (seconds)."""
    aggs = {"total": F.count(F.lit(1))}
    aggs |= {f"le_{b}": F.count_if(F.col("latency_ms") <= b).cast("bigint") for b in bounds}
    g = _sliding(requests, keys, width_s, step_s, aggs)
    cums = [F.col(f"le_{b}") for b in bounds]
    at = ["window_time"] if "window_time" in g.columns else []
    return g.select(*keys, "window_start_s", "window_end_s", "total", *at,
                    F.round(histogram_quantile(q, cums, F.col("total"), bounds) / 1000.0, 6).alias("p95_s"))


def alert_latency(requests: DataFrame, threshold_s: float = 5.0, hold_s: int = 300,
                  keys: tuple[str, ...] = ("endpoint",), width_s: int = 300, step_s: int = 60) -> DataFrame:
    ks = list(keys)
    w = latency_windows(requests, keys, width_s, step_s)
    firing = w.filter(F.col("p95_s") > threshold_s)
    return held(firing, ks, "window_start_s", step_s, hold_s, ("window_end_s", "total", "p95_s")).select(
        *ks, "window_end_s", "total", "p95_s")


def latency_windows_exact(requests: DataFrame, keys: tuple[str, ...] = ("endpoint",), width_s: int = 300,
                          step_s: int = 60, q: float = 0.95) -> DataFrame:
    """Sliding windows with the exact interpolated quantile of the raw latencies
    (seconds), next to the histogram estimate of ``latency_windows``.  The exact
    aggregate keeps a count per distinct value in the window (integer ms,
    bounded by the request timeout), not every row."""
    # One row for each step and latency value, then the windows weigh values by their counts.
    w = _sliding(requests.filter(F.col("latency_ms").isNotNull()), (*keys, "latency_ms"), width_s, step_s, {"n": F.count(F.lit(1))})
    return (w.groupBy(*keys, "window_start_s")
             .agg(F.sum("n").alias("total"), F.percentile(F.col("latency_ms").cast("double"), F.lit(q), F.col("n")).alias("_p"))
             .select(*keys, "window_start_s", "total", F.round(F.col("_p") / 1000.0, 6).alias("p95_exact_s")))
