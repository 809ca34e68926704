"""Operator 12: mixing sources to target weights by weighted fair queueing.

Each source has a weight and, by it, a share of a budget of words; a share
stops at ``MOST`` times its source's size and what is left over is shared again
by weight.  A source's queue holds its documents in a seeded shuffle, then in
another shuffle a second and a third time, as far as its target reaches.  A
queued document's virtual finish time is the number of the source's words up to
its end divided by the source's target, so every source reaches its target at
time 1.  All queues are sorted by finish time into one order, which serves the
sources in proportion at every point, and that order is cut where it would
exceed the budget.  Documents are taken whole: a source misses its target by
less than its longest document.

Both running totals come from range sorts with per-task offsets
(``running_total``), so a source with a third of all rows spreads over tasks;
only (row, size) rows are sorted, never texts.  Targets are computed on one row
for each source.

Defined results: a null text has no words, a null source is a source of its own
and the last; documents without words are never queued and take 0; a source
without words has the target 0.  Rows with equal ids, repeated rows and null ids
are queued one by one, those of equal hash and id by size; which of two rows that agree
in source, id and size comes first does not change the result.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running_total, save

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 1212


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST, budget: int | None = None) -> DataFrame:
    """(source, source_size) -> also rank, budget and target.  The sources whose
    limit is small for their weight are the ones that reach it: in the order of
    limit / weight, a source is limited if its limit is within its share of what
    the sources before it leave."""
    everyone = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    total = F.sum("source_size").over(everyone) if budget is None else F.lit(budget).cast("long")
    ranked = (sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
              .withColumn("limit", most * F.col("source_size")).withColumn("budget", total))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    exact = "decimal(38,0)"
    left = F.col("budget").cast(exact) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    limited = F.col("limit").cast(exact) * F.sum("weight").over(onward) <= F.col("weight") * left
    marked = ranked.withColumn("limited", limited)
    spent = F.coalesce(F.sum(F.when(F.col("limited"), F.col("limit"))).over(everyone), F.lit(0))
    sharing = F.sum(F.when(~F.col("limited"), F.col("weight"))).over(everyone)
    share = (F.col("budget") - spent).cast("double") * F.col("weight") / sharing
    return marked.select("source", "source_size", "rank", "budget",
                         F.when(F.col("limited"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return save(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                            F.col(source_col).alias("source"), words.cast("long").alias("size")))


def fair_queue(sized: DataFrame, targets: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix: (row, id, size, epoch, finish, mix_end), one row for each taken copy;
    ``mix_end`` is the number of words of the mix up to the copy's end."""
    of_source = targets.withColumnRenamed("source", "__source")
    joined = sized.filter("size > 0").join(of_source, sized["source"].eqNullSafe(of_source["__source"]))
    last = F.least(F.lit(most - 1), F.floor(F.col("target") / F.col("source_size"))).cast("int")
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("id").cast("string")).cast("binary"))
    copies = (joined.select("row", "id", "size", "rank", "target", "budget", F.explode(F.sequence(F.lit(0), last)).alias("epoch"))
              .withColumn("shuffled", shuffled))
    queued = running_total(copies, ["rank", "epoch", "shuffled", "id", "size"], "size", "served", group="rank")
    # The copy in which a source reaches its target is the last one in its queue.
    queued = (queued.filter(F.col("served") - F.col("size") < F.col("target"))
              .withColumn("finish", F.col("served") / F.col("target")))
    order = running_total(queued, ["finish", "rank", "served"], "size", "mix_end")
    return order.filter("mix_end <= budget").select("row", "id", "size", "epoch", "finish", "mix_end")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, most: int = MOST, budget: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, targets, mix): the documents' sizes, the sources' targets and the mix in ``mix_end`` order."""
    sized = _sized(docs, id_col, text_col, source_col)
    targets = save(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, budget))
    return sized, targets, fair_queue(sized, targets, most, seed)


def taken_words(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row for each document: id, size, source_size, target, taken."""
    sized, targets, mix = mix_sources(docs, id_col=id_col, **kw)
    taken = mix.groupBy("row").agg(F.sum("size").alias("taken"))
    of_source = targets.withColumnRenamed("source", "__source")
    return (sized.join(of_source, sized["source"].eqNullSafe(of_source["__source"])).join(taken, "row", "left")
            .select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


ORACLE = r"""
WITH RECURSIVE sized AS (SELECT row_number() OVER () AS row, doc_id, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 3 * source_size AS most, sum(source_size) OVER () AS budget FROM sources),
-- Each step limits the sources whose share of the rest passes their limit.
steps AS (SELECT 0 AS step, list(rank) FILTER (most * 0 <> 0) AS limited FROM weighed
  UNION ALL SELECT step + 1, (SELECT list(w.rank ORDER BY w.rank) FROM weighed w WHERE list_contains(coalesce(s.limited, []), w.rank)
    OR w.most::HUGEINT * (SELECT sum(weight) FROM weighed x WHERE NOT list_contains(coalesce(s.limited, []), x.rank))
      <= w.weight * (w.budget - (SELECT coalesce(sum(most), 0) FROM weighed x WHERE list_contains(coalesce(s.limited, []), x.rank))))
  FROM steps s WHERE step < (SELECT count(*) FROM weighed)),
done AS (SELECT coalesce(limited, []) AS limited FROM steps ORDER BY step DESC LIMIT 1),
targets AS (SELECT w.*, CASE WHEN list_contains(limited, rank) THEN most::DOUBLE ELSE
    (budget - (SELECT coalesce(sum(most), 0) FROM weighed x WHERE list_contains(limited, x.rank)))::DOUBLE * weight
    / (SELECT sum(weight) FROM weighed x WHERE NOT list_contains(limited, x.rank)) END AS target FROM weighed w, done),
copies AS (SELECT s.row, s.doc_id, s.size, t.rank, t.target, t.budget, e.epoch,
    md5(concat_ws(':', '1212', e.epoch::VARCHAR, s.doc_id::VARCHAR)) AS shuffled
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1), (2)) e(epoch) WHERE s.size > 0),
queued AS (SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY epoch, shuffled, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS served FROM copies),
ordered AS (SELECT *, sum(size) OVER (ORDER BY served / target, rank, served ROWS UNBOUNDED PRECEDING) AS mix_end
  FROM queued WHERE served - size < target),
taken AS (SELECT row, sum(size) AS taken FROM ordered WHERE mix_end <= budget GROUP BY row)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON k.row = s.row
"""
