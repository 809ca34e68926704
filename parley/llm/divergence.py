"""Operator 11: how far the sources of a language differ in their words.

For each language the terms in at least ``LEAST_DOCS`` documents are kept.  A
group (language, source) gives a kept term with ``count`` occurrences the share
p = 1 + floor(10^9 * (count + 1) / (N + V)), N its occurrences of all V kept
terms; two shares p, q diverge by floor((p - q)^2 / q).

* ``pair_divergence``: the sum over all kept terms, for each ordered pair of
  sources.  The counts are a table with a column for each source.  The
  vocabulary is reordered by the terms' counts over the sources, so that equal
  counts stand together, and cut into blocks of that order; in a block each
  source's column is run-length encoded, the run boundaries of two columns are
  intersected, and the divergence of each common run is multiplied by its
  length.  A block is one group of one task, whatever the corpus's size.
* ``term_divergence``: the terms that a source uses more than its language.

Terms are counted inside the scan tasks, so only (language, source, term)
counts are shuffled.  All arithmetic is on integers; products that can pass 64
bits are decimals.

Defined results: null text, language and source are empty strings; a group
without terms still has its pairs; a language without kept terms has the value
0 for all pairs and no term rows; repeated rows count as documents of their
own.  Ties rank by the item's UTF-8 bytes.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_if_null, first_of_group, position_after_sort, save

LEAST_DOCS = 3
SCALE = 1000000000
TOP_TERMS = 200
#: Different count vectors (rows of the table) that one block holds.
BLOCK = 4096
#: Counters a scan task holds before it passes them on.
HELD = 500000
# Letters of ASCII, lower-cased, and every byte of a non-ASCII character.
TERM = re.compile(rb"[a-z\x80-\xff]+")
COUNTS = "lang string, source string, term binary, n long, d long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of a task's texts; a null
    term stands for the group itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out():
        for (lang, source), (n, d) in held.items():
            terms = [None, *n]
            for a in range(0, len(terms), 1 << 16):
                part = terms[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()),
                     pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())],
                    names=["lang", "source", "term", "n", "d"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, d = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            low = text.encode().lower()  # of bytes: A-Z only
            if len(low) > 1 << 24:
                seen = set()
                for m in TERM.finditer(low):  # no list of a very long text's terms
                    n[m.group()] += 1
                    seen.add(m.group())
                d.update(seen)
            else:
                terms = TERM.findall(low)
                n.update(terms)
                d.update(set(terms))
            size += len(n)
        if size > HELD:
            yield from out()
            size = 0
    yield from out()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(kept, groups): (lang, term, cells) with the counts of each kept term by
    source, and (lang, source, total, total_lang), the denominators N + V of every group
    and of its language."""
    rows = docs.select(empty_if_null(lang_col).alias("lang"), empty_if_null(source_col).alias("source"),
                       empty_if_null(text_col).alias("text"))
    cells = save(rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term")
                 .agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    kept = save(cells.filter("term IS NOT NULL").groupBy("lang", "term")
                .agg(F.sum("d").alias("d"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("cells"))
                .filter(F.col("d") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "cells"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    used = (kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("used")))
    groups = (cells.select("lang", "source").distinct().join(size, "lang", "left").join(used, ["lang", "source"], "left")
              .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("used", F.lit(0)).alias("used")))
    whole = Window.partitionBy("lang")  # one row for each source
    return kept, save(groups.select("lang", "source", (F.col("v") + F.col("used")).alias("total"),
                                    (F.col("v") + F.sum("used").over(whole)).alias("total_lang")))


def share(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (n + 1) / total), exact for counts of any size."""
    wide = n.astype(object) if n.size and int(n.max()) >= (1 << 63) // SCALE - 1 else n
    return (1 + SCALE * (wide + 1) // total).astype(np.int64)


def run_lengths(column: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values) of the runs of a column whose row i stands ``lengths[i]`` times."""
    new = np.flatnonzero(np.diff(column, prepend=column[:1] - 1))
    return (np.cumsum(lengths) - lengths)[new], column[new]


def diverge(a: tuple, b: tuple, end: int) -> tuple[int, int]:
    """Divergence of column a from b and of b from a, summed over positions up to ``end``."""
    starts = np.union1d(a[0], b[0])
    length = np.diff(starts, append=end)
    p = a[1][np.searchsorted(a[0], starts, "right") - 1]
    q = b[1][np.searchsorted(b[0], starts, "right") - 1]
    square = (p - q) ** 2
    return int((square // q * length).sum()), int((square // p * length).sum())


def _pairs_of_block(vectors: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over one block for each ordered pair of the language's sources."""
    names, totals = groups["source"].to_pylist(), groups["total"].to_pylist()
    length = vectors["m"].to_numpy()
    cells = vectors["cells"].combine_chunks()
    row = np.repeat(np.arange(len(length)), cells.value_lengths().to_numpy())
    number = {s: k for k, s in enumerate(names)}
    flat = cells.flatten()
    which = np.fromiter(map(number.__getitem__, flat.field("source").to_pylist()), np.int64, len(row))
    n = flat.field("n").to_numpy()
    order = np.argsort(which, kind="stable")
    cut = np.searchsorted(which[order], np.arange(len(names) + 1))
    runs = []
    for k, total in enumerate(totals):
        mine = order[cut[k]:cut[k + 1]]
        column = np.full(len(length), share(np.zeros(1, np.int64), total)[0])
        column[row[mine]] = share(n[mine], total)
        runs.append(run_lengths(column, length))
    end = int(length.sum())
    out = []
    for j in range(len(names)):
        for k in range(j):
            there, back = diverge(runs[j], runs[k], end)
            out += [(names[j], names[k], there), (names[k], names[j], back)]
    return pa.table({"lang": pa.array([vectors["lang"][0].as_py()] * len(out), pa.string()),
                     "source": pa.array([x[0] for x in out], pa.string()), "item": pa.array([x[1] for x in out], pa.string()),
                     "value": pa.array([x[2] for x in out], pa.int64())})


def _both(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()),
                         "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    return _pairs_of_block(left, right)


def pair_divergence(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of a language's sources."""
    vectors = kept.groupBy("lang", "cells").agg(F.count(F.lit(1)).alias("m"))
    # By the first cells; the hash of all keeps equal beginnings apart and the sort's samples short.
    placed = save(position_after_sort(vectors, [F.col("lang"), F.slice("cells", 1, 3), F.xxhash64("cells")], "__place")
                  .select("lang", "cells", "m", F.expr(f"__place div {block}").alias("__block")))
    columns = (placed.select("lang", F.col("__block").alias("__of_block")).distinct()
               .join(groups.select("lang", "source", "total"), "lang").withColumnRenamed("lang", "__of_lang"))
    sums = (placed.groupBy("lang", "__block").cogroup(columns.groupBy("__of_lang", "__of_block"))
            .applyInArrow(_both, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    every = (groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang")
             .filter("source <> item"))
    return (every.join(sums, ["lang", "source", "item"], "left")
            .withColumn("value", F.coalesce("value", F.lit(0)).cast("long")))


def _share(n: str, total: str):
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(38,0)) * ({n} + 1)) div {total}")


def term_divergence(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each term that a source uses more than its language."""
    used = kept.select("lang", "term", F.expr("aggregate(cells, 0L, (s, c) -> s + c.n)").alias("n_lang"), F.inline("cells"))
    shares = used.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("n_lang", "total_lang").alias("q"))
    return shares.filter("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit_sources(docs: DataFrame, top_terms: int = TOP_TERMS, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank): all ranked pairs, and each group's first terms."""
    kept, groups = count_terms(docs, **columns)
    group, order = ["lang", "source"], [F.desc("value"), F.col("item")]
    pairs = pair_divergence(kept, groups).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    terms = first_of_group(term_divergence(kept, groups), group, order, top_terms, "rank", "item")
    return (pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", "value", "rank"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
terms AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
cells AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, (SELECT coalesce(sum(n), 0) FROM cells c WHERE c.lang = g.lang AND c.source = g.source) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 200
"""
