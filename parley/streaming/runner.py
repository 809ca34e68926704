"""Start stream queries with checkpoints in the cluster's shared folder.

The checkpoint location is ``<spark.checkpoint.dir>/<name>``: on a cluster
that setting names a shared file system, so a restarted driver or a lost
executor resumes from the last committed micro-batch (offsets, state store).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpoint_path


def start_parquet(df: DataFrame, path: str, name: str, trigger: dict | None = None,
                  output_mode: str = "append", partition_by: list[str] | None = None) -> StreamingQuery:
    """Run a streaming frame into a parquet table (exactly-once file sink).

    ``trigger``: e.g. {"processingTime": "5 seconds"} for the reference's
    polling loops, or {"availableNow": True} for a catch-up run.
    """
    w = (df.writeStream.format("parquet").option("path", path)
           .option("checkpointLocation", checkpoint_path(df.sparkSession, name))
           .outputMode(output_mode).queryName(name))
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def start_foreach_batch(df: DataFrame, fn, name: str, trigger: dict | None = None) -> StreamingQuery:
    """Run ``fn(batch_df, batch_id)`` per micro-batch; ``fn`` must be idempotent
    per batch id (a replay after failure calls it again with the same id)."""
    return (df.writeStream.option("checkpointLocation", checkpoint_path(df.sparkSession, name))
              .queryName(name).foreachBatch(fn).trigger(**(trigger or {"processingTime": "5 seconds"})).start())
