"""Helpers for keys that may hold a large share of all rows: numbering within a
group, and figures of a key joined to its rows, without a task that meets all
rows of one key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_path

#: Keys whose figures are broadcast.
HOT_KEYS = 1000


def numbered_in_group(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """``rows`` with their 0-based place within ``group`` in the order of ``order``.

    The rows are range partitioned by (group, order) and written once to the
    checkpoint folder (an action), which fixes the partitions; each task
    numbers its own range.  A group that reaches over several ranges starts in
    each of them after its rows in the earlier ones: one row for each range and
    group in it is all that a window sees.  ``group`` may be null; the columns of
    ``rows`` and ``order`` should be narrow.
    """
    spark = rows.sparkSession
    keys = [F.col(group).asc_nulls_first(), *order]
    path = checkpoint_path(spark, f"parley-numbered-{uuid.uuid4().hex}")
    (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
     .withColumn("_n", F.monotonically_increasing_id()).write.parquet(path))
    placed = spark.read.parquet(path).withColumn("_range", F.shiftright("_n", 33))
    own = placed.groupBy(group, "_range").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select(F.col(group).alias("_group"), F.col("_range").alias("_of_range"), "_first",
                     F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    same = placed[group].eqNullSafe(own["_group"]) & (placed["_range"] == own["_of_range"])
    return (placed.join(own, same).withColumn(name, (F.col("_n") - F.col("_first") + F.col("_before")).cast("bigint"))
            .drop("_n", "_range", "_group", "_of_range", "_first", "_before"))


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder (an action) and read back: its
    size is known, and what is built on it does not compute it again."""
    path = checkpoint_path(df.sparkSession, f"parley-written-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_figures(rows: DataFrame, figures: DataFrame, key: str, size: str = "n") -> DataFrame:
    """``rows`` left-joined with ``figures``, one row for each key; ``size`` is a
    measure of the key's weight.  The ``HOT_KEYS`` heaviest keys are broadcast; a key
    beyond them has at most 1 / ``HOT_KEYS`` of the weight, and joins by a shuffle or
    as Spark finds best.  A null key has no figures."""
    heavy = figures.orderBy(F.desc(size), key).limit(HOT_KEYS)
    light = figures.join(F.broadcast(heavy.select(key)), key, "left_anti")
    names = [c for c in figures.columns if c != key]
    tagged = rows.join(F.broadcast(heavy.withColumn("_hot", F.lit(True))), key, "left")
    met = tagged.filter("_hot").drop("_hot")
    rest = tagged.filter("_hot IS NULL").drop("_hot", *names).join(light, key, "left")
    return met.unionByName(rest)


def salt(column: Column | str, parts: Column) -> Column:
    """A part from 0 to ``parts`` - 1 for a row, by hash."""
    return F.pmod(F.xxhash64(column), parts)


def every_part(parts: Column) -> Column:
    """All parts from 0 to ``parts`` - 1, one row for each."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
