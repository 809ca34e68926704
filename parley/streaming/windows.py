"""Event-time windowed aggregations on request streams (watermarked).

``requests`` streams carry ``ts`` as TIMESTAMP (cast TIMESTAMP_NTZ input
first: watermarks refuse NTZ).  Append mode emits a window once the watermark
has passed its end; rows older than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.requests import epoch_s, error_rate_windows, latency_windows
from .stateful import hold_stream


def requests_per_window_stream(requests: DataFrame, width: str = "1 minute", watermark: str = "10 minutes",
                               keys: tuple[str, ...] = ("user_id", "endpoint")) -> DataFrame:
    return (requests.withWatermark("ts", watermark)
                    .groupBy(F.window("ts", width).alias("w"), *keys)
                    .agg(F.count(F.lit(1)).alias("request_count"))
                    .select(epoch_s(F.col("w.start")).alias("window_start_s"), *keys, "request_count"))


def error_rate_stream(requests: DataFrame, keys: tuple[str, ...] = ("endpoint",), width_s: int = 300,
                      step_s: int = 60, watermark: str = "5 minutes") -> DataFrame:
    """Closed sliding windows with error counts; ``alert_error_rate_stream`` adds the hold."""
    return error_rate_windows(requests.withWatermark("ts", watermark), keys, width_s, step_s).drop("window_time")


def alert_error_rate_stream(requests: DataFrame, threshold_per_s: float = 0.1, hold_s: int = 120,
                            keys: tuple[str, ...] = ("endpoint",), width_s: int = 300, step_s: int = 60,
                            watermark: str = "5 minutes") -> DataFrame:
    """``requests.alert_error_rate`` as a running stream: a watermarked window
    aggregation and behind it the hold per key (two stateful operators).  Emits
    (keys, window_end_s, event, errors, error_rate), ``event`` firing or resolved."""
    w = error_rate_windows(requests.withWatermark("ts", watermark), keys, width_s, step_s)
    fires = F.col("errors") > F.lit(threshold_per_s) * width_s
    return hold_stream(w.withColumn("fires", fires), keys, width_s, step_s, hold_s, ("errors", "error_rate"))


def route_stream(decoded: DataFrame, sinks: dict, checkpoint: str, default: str):
    """Route decoded requests per type with ``foreachBatch``: each micro-batch
    is written once per route to that route's path, rows of any other route to
    ``default``, so none is lost; a replayed batch overwrites its own
    ``batch_id`` partition, so retries do not duplicate."""
    from ..operators.tasks import route_requests

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        r = route_requests(batch).persist()
        named = F.coalesce(F.col("route").isin(*sinks), F.lit(False))
        parts = [(F.col("route") == route, path) for route, path in sinks.items()] + [(~named, default)]
        for rows, path in parts:
            (r.filter(rows).withColumn("batch_id", F.lit(batch_id))
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("batch_id").parquet(path))
        r.unpersist()

    return decoded.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch).start()


def latency_stream(requests: DataFrame, keys: tuple[str, ...] = ("endpoint",), width_s: int = 300,
                   step_s: int = 60, watermark: str = "5 minutes") -> DataFrame:
    """Closed sliding windows with the histogram p95 (same expression as the
    batch ``latency_windows``); ``alert_latency_stream`` adds the hold."""
    return latency_windows(requests.withWatermark("ts", watermark), keys, width_s, step_s).drop("window_time")


def alert_latency_stream(requests: DataFrame, threshold_s: float = 5.0, hold_s: int = 300,
                         keys: tuple[str, ...] = ("endpoint",), width_s: int = 300, step_s: int = 60,
                         watermark: str = "5 minutes") -> DataFrame:
    """``requests.alert_latency`` as a running stream, with resolved rows."""
    w = latency_windows(requests.withWatermark("ts", watermark), keys, width_s, step_s)
    return hold_stream(w.withColumn("fires", F.col("p95_s") > threshold_s), keys, width_s, step_s, hold_s, ("total", "p95_s"))
