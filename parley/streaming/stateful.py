"""Stateful stream operators with ``transformWithStateInPandas``.

* ``IdleResetLimiter`` — per (user, endpoint) limiter state (count, last
  accepted time); the same fold as the batch form, carried across
  micro-batches.  Rows of one key inside a micro-batch are decided in
  (ts, id) order; a row arriving in a later batch is decided on arrival, as
  the reference's Redis counter would.
* ``ChunkAssembler`` — per message: the lines seen so far, until all lines up
  to the finish marker are there, in whatever order batches bring them; then
  one output row.  State of finished and of abandoned messages expires.
* ``GaugeStore`` — per gauge: its newest value, and a row when it expires.
* ``AlertHold`` — per key: the run of firing windows behind a held alert.

All but the assembler drop a key's state by event-time timers, the assembler by
processing-time ones, so state follows the live keys, not the history.  Without
a watermark (limiter) or a time limit (assembler) nothing can expire: replays of a
bounded log alone should run so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.chunks import parse_chunks
from ..operators.requests import rate_limit_fold

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store; set it unless the
    cluster already chose a provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    cur = spark.conf.get(key, None)
    if not cur or "HDFSBackedStateStoreProvider" in cur:
        spark.conf.set(key, ROCKSDB_PROVIDER)


class IdleResetLimiter(StatefulProcessor):
    """With ``expire`` (event-time mode) a timer at last-accept + ttl drops the
    key's state once the watermark passes it: an expired counter and no
    counter decide every later request identically, so cleanup is exact and
    state stays proportional to the keys active within one ttl."""

    def __init__(self, limit: int, ttl_s: int, key_cols: tuple[str, ...], expire: bool = False):
        self.limit, self.ttl_us, self.key_cols, self.expire = limit, ttl_s * 1_000_000, key_cols, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("limiter", "count bigint, last_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "id"], kind="stable")
        st = None
        if self.state.exists():
            c, last = self.state.get()
            st = (int(c), None if last is None else int(last))
        allowed, remaining, (count, last) = rate_limit_fold(pdf["ts_us"].to_numpy(), self.limit, self.ttl_us, st)
        if self.expire and last is not None and (st is None or st[1] != int(last)):
            if st is not None and st[1] is not None:
                self.handle.deleteTimer((st[1] + self.ttl_us) // 1000)
            self.handle.registerTimer((int(last) + self.ttl_us) // 1000)
        self.state.update((int(count), None if last is None else int(last)))
        out = pdf[list(self.key_cols) + ["id"]].copy()
        out["allowed"] = allowed
        out["remaining"] = remaining.astype(np.int64)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int, ttl_s: int,
                      keys: tuple[str, ...] = ("user_id", "endpoint"),
                      watermark: str | None = None) -> DataFrame:
    """Streaming decisions; ``requests`` is a streaming frame with ts, id and keys.

    With a ``watermark`` the query runs in event-time mode and expired keys'
    state is dropped by timers (rows behind the watermark are dropped by
    Spark, so choose it above the expected lateness)."""
    use_rocksdb(requests.sparkSession)
    ks = list(keys)
    key_types = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in ks)
    schema = f"{key_types}, id {requests.schema['id'].dataType.simpleString()}, allowed boolean, remaining bigint"
    src = requests if watermark is None else requests.withWatermark("ts", watermark)
    src = src.select(*ks, "id", "ts", F.unix_micros("ts").alias("ts_us"))
    return src.groupBy(*ks).transformWithStateInPandas(
        statefulProcessor=IdleResetLimiter(limit, ttl_s, keys, expire=watermark is not None),
        outputStructType=schema, outputMode="Append",
        timeMode="None" if watermark is None else "EventTime")


class ChunkAssembler(StatefulProcessor):
    """Keeps a message's lines until every line from 0 up to its first finish /
    done marker has come, then emits it once.  With ``abandon_after_ms`` a timer is
    armed at the first line: a message that has its end marker by then but misses lines is
    emitted as it stands, flagged; one without an end is dropped.  The same timer, armed
    again, clears the mark that a message is out."""

    def __init__(self, abandon_after_ms: int | None):
        self.abandon_after_ms = abandon_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "seq bigint, content string")
        self.end = handle.getValueState("end", "end_seq bigint")
        self.done = handle.getValueState("done", "flag boolean")

    def _out(self, key, lines: dict, end: int) -> pd.DataFrame:
        text = "".join(lines[q] or "" for q in sorted(lines) if q <= end)
        gaps = any(q not in lines for q in range(end + 1))
        return pd.DataFrame({"message_id": [key[0]], "content": [text], "has_gaps": [gaps]})

    def _held(self) -> dict:
        lines: dict = {}
        for q, c in (self.lines.get() if self.lines.exists() else ()):
            self._put(lines, int(q), c)
        return lines

    @staticmethod
    def _put(lines: dict, q: int, c) -> None:
        # Of lines sent twice the one with the greatest text counts, as in the batch form.
        if q not in lines or (c is not None and (lines[q] is None or c.encode() > lines[q].encode())):
            lines[q] = c

    def _finish(self, timerValues) -> None:
        self.lines.clear()
        self.end.clear()
        self.done.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return  # the message is out
        pdf = pd.concat(list(rows), ignore_index=True)
        if self.abandon_after_ms and not self.lines.exists() and not self.end.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.abandon_after_ms)
        ends = pdf.loc[pdf["kind"].isin(["finish", "done"]), "seq"]
        end = int(ends.min()) if len(ends) else None
        if self.end.exists():
            before = int(self.end.get()[0])
            end = before if end is None else min(end, before)
        text = pdf["content"].where(pdf["kind"].isin(["content", "finish"]), None)
        new = [(int(q), c if isinstance(c, str) else None) for q, c in zip(pdf["seq"], text)]
        lines = self._held()
        for q, c in new:
            self._put(lines, q, c)
        if end is None or any(q not in lines for q in range(end + 1)):
            self.lines.appendList(new)
            if end is not None:
                self.end.update((end,))
            return
        self._finish(timerValues)
        yield self._out(key, lines, end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.done.exists() or not self.end.exists():
            self.lines.clear()
            self.done.clear()
            return
        lines, end = self._held(), int(self.end.get()[0])
        self._finish(timerValues)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.abandon_after_ms)
        yield self._out(key, lines, end)

    def close(self) -> None:
        pass


def assemble_chunks_stream(chunks: DataFrame, abandon_after_ms: int | None = 600_000) -> DataFrame:
    """Streaming assembly of (message_id, seq, line) chunks into finished messages
    (message_id, content, has_gaps), those of ``assemble_chunks(flag_gaps=True)``.

    ``abandon_after_ms`` (by default the 10-minute request timeout) bounds how
    long a message is held: one with an end marker and missing lines is then
    emitted with ``has_gaps``, and all state goes.  It needs processing-time mode,
    which runs extra no-data batches, so ``availableNow`` replays of a bounded log
    pass None and hold messages with gaps back.
    """
    use_rocksdb(chunks.sparkSession)
    p = parse_chunks(chunks).select("message_id", "seq", "kind", "content")
    schema = f"message_id {chunks.schema['message_id'].dataType.simpleString()}, content string, has_gaps boolean"
    return p.groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=ChunkAssembler(abandon_after_ms), outputStructType=schema,
        outputMode="Append", timeMode="ProcessingTime" if abandon_after_ms else "None")


class GaugeStore(StatefulProcessor):
    """The newest (time, value) of a gauge, until ``ttl`` after its time."""

    def __init__(self, ttl_s: int):
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_ms bigint, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts_ms", "value"], kind="stable")
        ts, value = int(pdf["ts_ms"].iloc[-1]), float(pdf["value"].iloc[-1])
        if self.last.exists():
            before, old = self.last.get()
            if (ts, value) <= (int(before), float(old)):
                return
            self.handle.deleteTimer(int(before) + self.ttl_ms)
        self.last.update((ts, value))
        self.handle.registerTimer(ts + self.ttl_ms)
        yield pd.DataFrame({"key": [key[0]], "value": [value], "ts_s": [ts // 1000], "expires_s": [(ts + self.ttl_ms) // 1000], "live": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        ts, value = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "value": [float(value)], "ts_s": [int(ts) // 1000],
                            "expires_s": [(int(ts) + self.ttl_ms) // 1000], "live": [False]})

    def close(self) -> None:
        pass


def live_gauges_stream(samples: DataFrame, ttl_s: int = 300, watermark: str = "0 seconds") -> DataFrame:
    """Gauges that expire: samples (key, value, ts) → (key, value, ts_s, expires_s, live).

    A row with ``live`` for each newer value of a key, and one without when the
    watermark passes ``ttl_s`` after the last: whoever applies the rows in order
    holds the ``live_gauges`` of the watermark's time.  State is one value for
    each live key.  Samples without a time or value are left out; of samples at
    the same time the greatest value counts."""
    use_rocksdb(samples.sparkSession)
    src = (samples.filter("ts IS NOT NULL AND value IS NOT NULL").withWatermark("ts", watermark)
           .select("key", F.col("value").cast("double").alias("value"), "ts", F.unix_millis("ts").alias("ts_ms")))
    schema = f"key {samples.schema['key'].dataType.simpleString()}, value double, ts_s bigint, expires_s bigint, live boolean"
    return src.groupBy("key").transformWithStateInPandas(
        statefulProcessor=GaugeStore(ttl_s), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class AlertHold(StatefulProcessor):
    """Closed windows of a key, in time order → firing and resolved rows.

    State is the current run of firing windows (first and last start), and is
    there only while a run lasts.  A run ends with the next window that does not
    fire, or by a timer when the next window's end has passed and it held no rows."""

    def __init__(self, width_s: int, step_s: int, hold_s: int, keys: tuple[str, ...], values: tuple[str, ...]):
        self.width, self.step, self.hold, self.keys, self.values = width_s, step_s, hold_s, keys, values

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first bigint, last bigint")

    def _due(self, last: int) -> int:
        return (last + self.step + self.width) * 1000

    def _end(self, key, out: list) -> None:
        first, last = map(int, self.run.get())
        self.handle.deleteTimer(self._due(last))
        self.run.clear()
        if last - first >= self.hold:
            out.append((*key, last + self.step + self.width, "resolved", *[None] * len(self.values)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("window_start_s", kind="stable")
        out: list = []
        for start, fires, *values in pdf[["window_start_s", "fires", *self.values]].itertuples(index=False):
            start = int(start)
            if self.run.exists():
                first, last = map(int, self.run.get())
                if not fires or start > last + self.step:
                    self._end(key, out)
                else:
                    self.handle.deleteTimer(self._due(last))
            if fires:
                first = int(self.run.get()[0]) if self.run.exists() else start
                self.run.update((first, start))
                self.handle.registerTimer(self._due(start))
                if start - first >= self.hold:
                    out.append((*key, start + self.width, "firing", *values))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "window_end_s", "event", *self.values])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        if self.run.exists() and expiredTimerInfo.getExpiryTimeInMs() == self._due(int(self.run.get()[1])):
            self._end(key, out)
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "window_end_s", "event", *self.values])

    def close(self) -> None:
        pass


def hold_stream(windows: DataFrame, keys: tuple[str, ...], width_s: int, step_s: int, hold_s: int, values: tuple[str, ...]) -> DataFrame:
    """(keys, window_end_s, event, values) from closed windows (keys, window_start_s,
    window_time, fires, values): ``firing`` at each evaluation that holds, as
    ``requests.held`` finds them, and ``resolved`` at the first one after them."""
    use_rocksdb(windows.sparkSession)
    kinds = {c: windows.schema[c].dataType.simpleString() for c in (*keys, *values)}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "window_end_s bigint", "event string", *[f"{v} {kinds[v]}" for v in values]])
    return windows.select(*keys, "window_start_s", "window_time", "fires", *values).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=AlertHold(width_s, step_s, hold_s, tuple(keys), tuple(values)), outputStructType=schema,
        outputMode="Append", timeMode="EventTime")


class StuckTaskDetector(StatefulProcessor):
    """Event-time timer per task: armed at the first 'running' event for
    ``hours``; a terminal event before the deadline disarms it; if the
    watermark passes the deadline first, the task is reported stuck once.
    A task is decided once (state: started, deadline, closed).  The deadline's
    timer stays armed for decided tasks too and clears their state one timeout
    later, when no event of the run can come any more."""

    def __init__(self, hours: float):
        self.timeout_ms = int(hours * 3600 * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "started_ms bigint, deadline_ms bigint, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        # same instant: a start is applied before an end (start-and-finish is not stuck)
        pdf["_rank"] = (pdf["status"] != "running").astype("int8")
        pdf = pdf.sort_values(["ts_ms", "_rank"], kind="stable")
        st = self.run.get() if self.run.exists() else None
        for ts, status in zip(pdf["ts_ms"].tolist(), pdf["status"].tolist()):
            if st is not None and st[2]:
                break                                   # already decided
            if status == "running" and st is None:
                st = (int(ts), int(ts) + self.timeout_ms, False)
                self.handle.registerTimer(st[1])
            elif status in ("completed", "failed") and st is not None and int(ts) < st[1]:
                st = (st[0], st[1], True)
        if st is not None:
            self.run.update(st)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            started, deadline, closed = self.run.get()
            if expiredTimerInfo.getExpiryTimeInMs() > deadline:
                self.run.clear()
                return
            self.handle.registerTimer(int(deadline) + self.timeout_ms)
            if not closed:
                self.run.update((started, deadline, True))
                yield pd.DataFrame({"task_id": [key[0]], "started_s": [int(started) // 1000],
                                    "deadline_s": [int(deadline) // 1000]})

    def close(self) -> None:
        pass


def stuck_tasks_stream(events: DataFrame, hours: float = 1.0, watermark: str = "10 minutes") -> DataFrame:
    """Streaming stuck-task alerts from a (task_id, status, ts) event stream."""
    use_rocksdb(events.sparkSession)
    src = (events.withWatermark("ts", watermark)
                 .select("task_id", "status", "ts", F.unix_millis("ts").alias("ts_ms")))
    schema = f"task_id {events.schema['task_id'].dataType.simpleString()}, started_s bigint, deadline_s bigint"
    return src.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=StuckTaskDetector(hours), outputStructType=schema,
        outputMode="Append", timeMode="EventTime")


def stuck_tasks_batch(events: DataFrame, hours: float = 1.0, as_of_s: int | None = None) -> DataFrame:
    """Batch reference of the stream: first 'running' event per task, no
    terminal event before its deadline, deadline passed by ``as_of_s``."""
    ts_s = F.unix_seconds("ts")
    g = events.groupBy("task_id").agg(F.min(F.when(F.col("status") == "running", ts_s)).alias("started_s"))
    term = events.filter(F.col("status").isin("completed", "failed")).select("task_id", ts_s.alias("t_s"))
    deadline = F.col("started_s") + int(hours * 3600)
    s = g.filter(F.col("started_s").isNotNull()).withColumn("deadline_s", deadline)
    ended = s.join(term, "task_id").filter((F.col("t_s") >= F.col("started_s")) & (F.col("t_s") < F.col("deadline_s"))) \
             .select("task_id").distinct()
    out = s.join(ended, "task_id", "left_anti")
    if as_of_s is not None:
        out = out.filter(F.col("deadline_s") <= as_of_s)
    return out.select("task_id", "started_s", "deadline_s")
