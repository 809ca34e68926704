"""Readers for the driver tables and the adapters the reference's stores map to.

The reference keeps its rows in PostgreSQL / SQLite, its streams in Kafka and
its caches in Redis.  Here every one of them is a DataFrame source:

* parquet tables (the driver's test data, or any table a cluster exposes),
* a JDBC reader with Spark's own partitioned-read arguments (no JDBC driver
  jar ships in this container, so it is untested here),
* Kafka / JSON-file request topics (``parley.sources.topics``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Table names of the driver's test data.
DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None,
              num_partitions: int = 25, properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC scan (the reference's pool of 25 connections becomes 25
    parallel range reads).  Needs the database's JDBC jar on the class path."""
    props = dict(properties or {})
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions,
                           properties=props)
