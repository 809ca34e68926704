"""Request topics: Kafka when the connector is on the class path, JSON files
with the same record shape otherwise.

A record is (topic, key, value) with ``value`` a JSON text; decoding is
``parley.operators.tasks.decode_requests``.  The Kafka connector jar is not
shipped in this container, so the Kafka path is untested here; the file path
is what the tests exercise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_SCHEMA = "topic string, key string, value string"


def read_topics(spark: SparkSession, topics: list[str], bootstrap: str | None = None,
                path: str | None = None, streaming: bool = True,
                max_files_per_trigger: int | None = None) -> DataFrame:
    if bootstrap:
        r = spark.readStream if streaming else spark.read
        df = (r.format("kafka").option("kafka.bootstrap.servers", bootstrap)
               .option("subscribe", ",".join(topics)).load())
        return df.select("topic", F.col("key").cast("string").alias("key"),
                         F.col("value").cast("string").alias("value"))
    if path is None:
        raise ValueError("either a Kafka bootstrap address or a topic folder is needed")
    if streaming:
        r = spark.readStream.schema(RECORD_SCHEMA)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        df = r.json(path)
    else:
        df = spark.read.schema(RECORD_SCHEMA).json(path)
    return df.filter(F.col("topic").isin(*topics))


def write_topics(records: DataFrame, bootstrap: str | None = None, path: str | None = None,
                 checkpoint: str | None = None):
    """Send (topic, key, value) records: Kafka routes by the ``topic`` column;
    the file form partitions by topic.  Streaming frames return the query."""
    if records.isStreaming:
        w = records.writeStream.option("checkpointLocation", checkpoint)
        if bootstrap:
            return w.format("kafka").option("kafka.bootstrap.servers", bootstrap).start()
        return w.format("json").partitionBy("topic").option("path", path).start()
    if bootstrap:
        records.write.format("kafka").option("kafka.bootstrap.servers", bootstrap).save()
        return None
    records.write.mode("append").partitionBy("topic").json(path)
    return None
