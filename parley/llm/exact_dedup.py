"""Operator 1: exact duplicates by a heavy-hitter split.

Texts are equal when they are identical after deleting ASCII white space; the
SHA-256 of what is left is the key.  One pass over the texts writes a narrow
table (id, digest, length).  The frequent-item summary of Misra and Gries
(``DataFrame.freqItems``: at most ``1 / support`` counters for each task)
names the digests that may hold more than ``support`` of the rows.  An exact
count verifies them and picks their winners, which are broadcast (at most
``1 / support`` rows): rows of those groups are settled on the map side and
never shuffled.  All other digests are shuffled as usual; none of their groups
exceeds ``support`` of the rows.

Defined results: a null text counts as empty, and all empty texts form one
group.  Of a group, the text with the most code points stays, then the
smallest id (null last), then any one of identical rows.  An empty table gives
an empty result.  Other columns pass through ``drop_duplicates`` untouched,
whatever their names (names that begin with ``__dedup`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, empty_if_null, save

#: Share of the rows from which a digest counts as heavy; bounds the broadcast to 1000 rows.
SUPPORT = 0.001


def digest(text_col: str) -> Column:
    return F.sha2(F.translate(empty_if_null(text_col), BLANKS, "").cast("binary"), 256)


def _order(id_col: str) -> list[Column]:
    return [F.col("__dedup_chars").desc(), F.col(id_col).asc_nulls_last()]


def heavy_winners(rows: DataFrame, id_col: str, support: float) -> DataFrame:
    """(digest, winner's length, id and row number, group size) of each digest
    that the summary names and the exact count confirms."""
    named = rows.freqItems(["__dedup_digest"], support).select(
        F.explode("__dedup_digest_freqItems").alias("__dedup_digest"))
    total = rows.agg(F.count(F.lit(1)).alias("__dedup_total"))
    best = F.min(F.struct(-F.col("__dedup_chars"), F.col(id_col).isNull(), F.col(id_col), F.col("__dedup_row")))
    counted = (rows.join(F.broadcast(named), "__dedup_digest", "left_semi")
               .groupBy("__dedup_digest").agg(F.count(F.lit(1)).alias("__dedup_size"), best.alias("b")))
    heavy = (counted.join(F.broadcast(total), F.col("__dedup_size") >= support * F.col("__dedup_total"))
             .filter("__dedup_size > 1"))
    return heavy.select("__dedup_digest", F.col("__dedup_size").alias("__dedup_heavy"),
                        F.col(f"b.{id_col}").alias("__dedup_keep"), F.col("b.__dedup_row").alias("__dedup_keep_row"))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return save(docs.select(
        F.col(id_col), digest(text_col).alias("__dedup_digest"),
        F.char_length(empty_if_null(text_col)).alias("__dedup_chars"),
        F.monotonically_increasing_id().alias("__dedup_row")))


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    support: float = SUPPORT) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256."""
    rows = _narrow(docs, id_col, text_col)
    heavy = save(heavy_winners(rows, id_col, support))
    marked = rows.join(F.broadcast(heavy), "__dedup_digest", "left")
    hot = marked.filter(F.col("__dedup_heavy").isNotNull()).select(
        id_col, F.col("__dedup_keep").alias("keep_id"), F.col("__dedup_heavy").alias("group_size"),
        (F.col("__dedup_row") == F.col("__dedup_keep_row")).alias("kept"),
        F.col("__dedup_digest").alias("text_sha256"))
    group = Window.partitionBy("__dedup_digest")
    ranked = group.orderBy(*_order(id_col), F.col("__dedup_row"))
    rest = marked.filter(F.col("__dedup_heavy").isNull()).select(
        id_col, F.first(id_col).over(ranked).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(ranked) == 1).alias("kept"),
        F.col("__dedup_digest").alias("text_sha256"))
    return hot.unionByName(rest)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    support: float = SUPPORT) -> DataFrame:
    """``docs`` without the rows that lose, all columns as they were.

    Losers of heavy groups fall out on the map side; what is left is shuffled
    by digest once, and a partial rank limit drops local losers before it.
    """
    rows = _narrow(docs, id_col, text_col)
    heavy = save(heavy_winners(rows, id_col, support)).drop("__dedup_keep_row")
    marked = (docs.withColumn("__dedup_digest", digest(text_col))
              .withColumn("__dedup_chars", F.char_length(empty_if_null(text_col)))
              .join(F.broadcast(heavy), "__dedup_digest", "left")
              .filter(F.col("__dedup_heavy").isNull() | F.col(id_col).eqNullSafe(F.col("__dedup_keep"))))
    ranked = Window.partitionBy("__dedup_digest").orderBy(*_order(id_col))
    return (marked.withColumn("__dedup_rank", F.row_number().over(ranked))
            .filter("__dedup_rank = 1").select(*[docs[c] for c in docs.columns]))


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by n desc, doc_id) = 1 as kept,
       text_sha256
from d
"""
