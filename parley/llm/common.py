"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes of text that become Python objects at once.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode (tests), where every task
    runs in this one process; a cluster without the setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="parley-llm-")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    cuts the lineage, survives lost executors and fixes generated row ids."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/parley-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices that end with the row whose text
    in ``column`` brings them to ``size`` bytes: the Python objects and results
    made of a slice stay small, however many rows Spark sends at once."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(ends):
            before = int(ends[lo - 1]) if lo else 0
            hi = min(int(np.searchsorted(ends, before + size)) + 1, len(ends))
            yield batch.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()  # Spark keeps the worker for later tasks


def empty_if_null(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def position_after_sort(df: DataFrame, keys: list, start: str) -> DataFrame:
    """``df`` with its 0-based rank in the order of ``keys`` as column ``start``.

    A range shuffle sorts the rows, each task numbers its own rows, and the
    row counts of the tasks (one number for each task) are summed up into
    offsets: no task sees more than its range of the order.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = save(ranged.withColumn("__n", F.monotonically_increasing_id()))
    part, row = F.shiftright("__n", 33), F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.withColumn("__part", part).withColumn("__row", row)
    counts = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__part"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    return (numbered.join(F.broadcast(offsets), "__part")
            .withColumn(start, F.col("__before") + F.col("__row"))
            .drop("__n", "__part", "__row", "__before"))


def running_total(df: DataFrame, keys: list, value: str, name: str, group: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row, in the order of ``keys``.

    With ``group``, the first key and never null, each of its values has a
    total of its own.  A task sums up its own range of the order; the sums of
    the tasks, one row for each task and group in it, become offsets.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = save(ranged.withColumn("__n", F.monotonically_increasing_id()))
    own = [group] if group else []
    numbered = numbered.withColumn("__part", F.shiftright("__n", 33))
    sums = numbered.groupBy("__part", *own).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", *own, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    local = Window.partitionBy("__part", *own).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    return (numbered.withColumn("__own", F.sum(value).over(local)).join(offsets, ["__part", *own])
            .withColumn(name, F.col("__before") + F.col("__own")).drop("__n", "__part", "__own", "__before"))


def first_of_group(df: DataFrame, group: list[str], order: list, n: int, rank: str, key: str, parts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their rank.  A group's
    rows are cut down in ``parts`` parts by hash of ``key`` first, so that a task of the
    last step meets at most ``parts`` * ``n`` rows of a group."""
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    cut = df.withColumn("__part", part)
    cut = cut.withColumn("__in_part", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))).filter(F.col("__in_part") <= n)
    return (cut.drop("__part", "__in_part").withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
            .filter(F.col(rank) <= n))
