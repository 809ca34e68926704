"""Operator 5: shards whose source mixture equals the corpus's.

Within each source the rows are ranked in a seeded shuffle (an MD5 of seed and
id); a row's fractional rank is (rank + 1/2) / rows of its source.  Sorting all
rows by fractional rank interleaves the sources in proportion, and cutting that
order into runs of equal length gives every shard the mixture, up to one row
for each source.  Shard sizes differ by one row at most (law ``rows``).

Both ranks come from range sorts with per-task offsets (``position_after_sort``),
so a source with a third of all rows is spread over tasks like any other.  Only
(id, source, size, checksum) rows are sorted, never the texts.

Defined results: a null text has no bytes (size 8, checksum 0); a null source
is a source of its own; null ids come last within equal hashes, and repeated
rows each get their own slot.  An empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import position_after_sort, save

SHARDS = 24
SEED = 20250
#: Bytes a stored text takes besides its own.
OVERHEAD = 8


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot, grown_shard."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = save(docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")).alias("__shuffle"),
        (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32")))
    within = position_after_sort(rows, ["__source", "__shuffle", "__id", "text_crc32"], "__rank")
    sources = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__rows"))
    first = within.groupBy("__source").agg(F.min("__rank").alias("__first"))
    scale = sources.join(first, sources["__source"].eqNullSafe(first["__source"])).select(
        sources["__source"].alias("__s"), "__rows", "__first")
    ranked = within.join(scale, within["__source"].eqNullSafe(scale["__s"]))
    fraction = (F.col("__rank") - F.col("__first") + 0.5) / F.col("__rows")
    mixed = save(ranked.select("__id", "size", "text_crc32", "__source", "__shuffle", fraction.alias("__fraction")))
    order = position_after_sort(mixed, ["__fraction", "__source", "__shuffle", "__id", "text_crc32"], "__place")
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("__total")))
    # Shard s holds the places from ceil(s * total / shards) on.
    shard = F.expr(f"__place * {shards} div __total")
    start = F.expr(f"(__place * {shards} div __total * __total + {shards - 1}) div {shards}")
    return order.crossJoin(total).select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"), (F.col("__place") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **kw) -> None:
    """The documents with their shard and slot, one folder for each shard, files in slot order."""
    placed = assign_shards(docs, id_col=id_col, **kw).select(F.col(id_col), "shard", "slot")
    (docs.join(placed, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


ORACLE = r"""
WITH crc_table AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
  FOR n IN range(256)] AS t),
bytes AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT row, doc_id, source, (length(h) // 2 + 8)::BIGINT AS size, md5('20250:' || doc_id::VARCHAR) AS shuffle,
  xor(4294967295, list_reduce([4294967295::BIGINT] || [('0x' || substr(h, k, 2))::BIGINT FOR k IN range(1, length(h), 2)],
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS text_crc32
  FROM bytes, crc_table),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shuffle, doc_id, text_crc32) - 1 + 0.5::DOUBLE)
  / count(*) OVER (PARTITION BY source) AS fraction FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, shuffle, doc_id, text_crc32) - 1 AS place,
  count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 24 // total)::INTEGER AS shard,
  (place - (place * 24 // total * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM placed
"""
