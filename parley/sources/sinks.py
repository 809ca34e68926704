"""Sinks and row builders: appends with schema defaults, JSON exports, dataset
caches with expiry, run manifests.

Tables are rewritten, never updated in place: a mutation is read → transform
→ write to a new path (or append).  Paths are whatever the cluster exposes
(object store or shared file system); nothing here uses machine-local temp
space.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of the reference schema for new rows.
DEFAULT_MODEL_VERSION = "deepseek-v1.0"
DEFAULT_SUBSCRIPTION = "free"
DEFAULT_TASK_PRIORITY = 5
DEFAULT_TASK_STATUS = "pending"
DEFAULT_CACHE_TTL_S = 3600


def append_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows (messages, feedback, tasks …) to a parquet table."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


MANIFEST = "batch_id string, folder string, published_us bigint"


def publish(df: DataFrame, table: str, batch_id: str = "current") -> None:
    """Write ``df`` as batch ``batch_id`` of a table of published batches.

    The rows go to a folder of their own, and then one row that names it goes to
    the table's manifest, in one file: readers see all of a batch or nothing.  A batch
    that is published again takes the place of its earlier version, so a run may be
    repeated; a run that dies before its manifest row leaves no trace for readers.
    ``drop_unpublished`` removes folders that no reader uses any more."""
    import time
    spark, table = df.sparkSession, table.rstrip("/")
    folder = f"batch-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{folder}")
    row = [(batch_id, folder, time.time_ns() // 1000)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").parquet(f"{table}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def published_folders(spark: SparkSession, table: str) -> dict[str, str]:
    """batch id → folder of its latest version (one small row for each batch)."""
    table = table.rstrip("/")
    if not _exists(spark, f"{table}/manifest/_SUCCESS"):
        return {}
    m = spark.read.schema(MANIFEST).parquet(f"{table}/manifest")
    latest = m.groupBy("batch_id").agg(F.max_by("folder", F.struct("published_us", "folder")).alias("folder")).collect()
    return {r["batch_id"]: f"{table}/{r['folder']}" for r in latest}


def read_published(spark: SparkSession, table: str, schema: str, batch_id: str | None = None) -> DataFrame:
    """The rows of all published batches, or of one; a table or batch that is not there has none."""
    folders = published_folders(spark, table)
    paths = list(folders.values()) if batch_id is None else [folders[batch_id]] if batch_id in folders else []
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def drop_unpublished(spark: SparkSession, table: str, older_than_s: int = 86400) -> int:
    """Delete folders of batches that the manifest does not name any more, if they have
    not changed for ``older_than_s``, so that readers and writers under way keep theirs."""
    import time
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(table.rstrip("/"))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    used = {f.rpartition("/")[2] for f in published_folders(spark, table).values()}
    gone = 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("batch-") and name not in used and status.getModificationTime() < (time.time() - older_than_s) * 1000:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def write_keyed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write a table in folders by key bucket, for ``rewrite_keyed``."""
    df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("_bucket").write.partitionBy("_bucket").parquet(path)


def rewrite_keyed(spark: SparkSession, path: str, changes: DataFrame, key: str, apply, buckets: int = 64) -> list[int]:
    """Rewrite only the buckets that hold keys of ``changes``.

    ``apply(rows, changes)`` gets the rows and the changes of those buckets and
    returns the rows as they shall be; the buckets' folders are replaced
    (dynamic partition overwrite) and all others keep their files.  Returns
    the buckets that were rewritten."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    routed = changes.withColumn("_bucket", bucket)
    touched = sorted(r["_bucket"] for r in routed.select("_bucket").distinct().collect())   # at most ``buckets`` numbers
    if not touched:
        return []
    table = spark.read.parquet(path)
    rows = table.filter(F.col("_bucket").isin(touched)).drop("_bucket")
    new = apply(rows, changes).withColumn("_bucket", bucket).select(table.columns)
    (new.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_bucket").parquet(path))
    return touched


def new_conversations(requests: DataFrame, as_of: int) -> DataFrame:
    """Conversation rows with the writer's defaults (title null, not archived)."""
    return requests.select(
        "id", "user_id", F.lit(None).cast("string").alias("title"),
        F.coalesce(F.col("model_version"), F.lit(DEFAULT_MODEL_VERSION)).alias("model_version"),
        F.col("system_prompt"), F.lit(as_of).cast("bigint").alias("created_s"),
        F.lit(as_of).cast("bigint").alias("updated_s"), F.lit(False).alias("is_archived"))


def new_users(registrations: DataFrame, as_of: int) -> DataFrame:
    """User rows with defaults: tier 'free', active, never logged in."""
    return registrations.select(
        "id", "email", "username",
        F.coalesce(F.col("subscription_tier"), F.lit(DEFAULT_SUBSCRIPTION)).alias("subscription_tier"),
        F.lit(True).alias("is_active"), F.lit(None).cast("bigint").alias("last_login_s"),
        F.lit(as_of).cast("bigint").alias("created_s"))


def new_tasks(requests: DataFrame, as_of: int) -> DataFrame:
    """Agent task rows: payload as JSON text, priority 5 and status pending by default."""
    payload = F.col("input_data") if dict(requests.dtypes).get("input_data") == "string" \
        else F.to_json("input_data")
    return requests.select(
        "id", "agent_type", "task_type", payload.alias("input_data"),
        F.coalesce(F.col("priority").cast("bigint"), F.lit(DEFAULT_TASK_PRIORITY).cast("bigint")).alias("priority"),
        F.lit(DEFAULT_TASK_STATUS).alias("status"),
        F.lit(as_of).cast("bigint").alias("created_s"), F.lit(None).cast("bigint").alias("started_s"))


def new_training_sessions(requests: DataFrame, as_of: int) -> DataFrame:
    """Training session rows; ``model_version_id`` is nullable (the reference
    inserts sessions without it)."""
    return requests.select(
        F.col("task_id").alias("id"), F.col("model_version_id").cast("string").alias("model_version_id"),
        F.col("training_type"), F.lit("pending").alias("status"), F.to_json("config").alias("config"),
        F.lit(None).cast("string").alias("metrics"), F.lit(None).cast("bigint").alias("started_s"),
        F.lit(None).cast("bigint").alias("completed_s"), F.lit(as_of).cast("bigint").alias("created_s"))


def run_manifest(runs: DataFrame) -> DataFrame:
    """Checkpoint / run manifest rows: (run, timestamp, JSON of config and model type)."""
    return runs.select(
        "run_id", F.date_format(F.timestamp_seconds("ts_s"), "yyyyMMdd_HHmmss").alias("stamp"),
        F.to_json(F.struct("config", "model_type")).alias("manifest"))


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON-lines export (feedback backups, topic files)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def cache_entries(df: DataFrame, key: str, as_of: int, ttl_s: int = DEFAULT_CACHE_TTL_S) -> DataFrame:
    """Rows of a cached dataset stamped with cache key and expiry."""
    return df.select(F.lit(key).alias("cache_key"), F.to_json(F.struct(*df.columns)).alias("payload"),
                     F.lit(as_of + ttl_s).cast("bigint").alias("expires_s"))


def write_cache(df: DataFrame, root: str, key: str, as_of: int, ttl_s: int = DEFAULT_CACHE_TTL_S) -> None:
    """Replace a key as a whole: a reader meets the old entries or the new ones."""
    publish(cache_entries(df, key, as_of, ttl_s), f"{root.rstrip('/')}/{key}")


def live_cache(entries: DataFrame, as_of: int) -> DataFrame:
    """Entries that have not expired at ``as_of`` (a miss is an empty frame)."""
    return entries.filter(F.col("expires_s") > as_of)


def read_cache(spark: SparkSession, root: str, key: str, as_of: int) -> DataFrame:
    e = read_published(spark, f"{root.rstrip('/')}/{key}", "cache_key string, payload string, expires_s bigint")
    return live_cache(e, as_of)


def feedback_violation():
    """Predicate of feedback rows with an unknown type or a score outside −1..1."""
    from ..operators.quality import FEEDBACK_TYPES, SCORE_RANGE_CENTI
    return (~F.coalesce(F.col("feedback_type").isin(*FEEDBACK_TYPES), F.lit(False))
            | F.coalesce(~F.col("score_centi").between(*SCORE_RANGE_CENTI), F.lit(False)))


def split_checked(df: DataFrame, violation) -> tuple[DataFrame, DataFrame]:
    """(rows that pass a data-quality predicate, rejected rows); a null verdict rejects."""
    ok = F.coalesce(~violation, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def append_checked(df: DataFrame, path: str, violation, batch_id: str | None = None) -> DataFrame:
    """Append the rows that pass and return the rejected ones, instead of
    failing the whole write.  With ``batch_id`` the rows are published as that
    batch, and a repeated append adds nothing."""
    passed, rejected = split_checked(df, violation)
    if batch_id is None:
        append_parquet(passed, path)
    else:
        publish(passed, path, batch_id)
    return rejected


def new_messages(messages: DataFrame) -> DataFrame:
    """Incoming chat messages minus blank ones (whitespace only / null)."""
    from ..functions.text import is_blank
    return messages.filter(~is_blank(F.col("content")))
