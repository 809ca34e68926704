"""Vector operators over ``array<float>`` embeddings: mean pooling and exact
top-k similarity search.

Top-k is a distributed brute-force scan in blocks: queries and corpus rows are
packed into tiles of bounded size, every pair of tiles is scored with one matrix
product, and each pair keeps its local top-k for each query; a final per-query
top-k merges those.  Neither side is collected or held whole by a task, at any
size of either.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_path

# Rows of one tile; a task holds one tile of each side and their score matrix.
QUERY_TILE = 128
CORPUS_TILE = 2048


def mean_pool(df: DataFrame, group: str, col: str = "embedding") -> DataFrame:
    """Element-wise mean vector per group, via the JVM ``Summarizer`` aggregate
    (partial aggregation, memory per group = one vector)."""
    v = df.select(group, array_to_vector(F.col(col)).alias("_v"))
    return (v.groupBy(group).agg(Summarizer.mean(F.col("_v")).alias("_m"))
             .select(group, vector_to_array("_m").alias("mean_vector")))


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "dot":
        return x @ q.T
    if metric == "cosine":
        qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        xn = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return xn @ qn.T
    if metric == "l2":
        # Negative distance so that "larger is closer" for every metric.
        d2 = (x * x).sum(1)[:, None] - 2 * (x @ q.T) + (q * q).sum(1)[None, :]
        return -np.sqrt(np.maximum(d2, 0.0))
    raise ValueError(f"unknown metric {metric}")


def _one_score(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of one query, each summed in the same order wherever its row stands,
    so that equal vectors have equal scores."""
    if metric == "l2":
        return -np.sqrt(((x - q) ** 2).sum(1))
    dot = (x * q).sum(1)
    if metric == "dot":
        return dot
    norms = np.sqrt((x * x).sum(1)) * float(np.sqrt((q * q).sum()))
    return np.where(norms > 0, dot / np.where(norms > 0, norms, 1.0), 0.0)   # a zero vector is like nothing


def _tiles(rows: int):
    """Rows (id, vector) → tiles (dims, ids, matrix); null vectors and vectors that hold nulls are left out."""
    def run(it):
        held: dict[int, list] = {}

        def tile(n):
            own = held.pop(n)
            return pd.DataFrame({"dims": [n], "ids": [[i for i, _ in own]],
                                 "matrix": [np.asarray([v for _, v in own], dtype=np.float64).tobytes()]})

        for pdf in it:
            for i, v in zip(pdf["id"], pdf["v"]):
                if v is None or len(v) == 0:
                    continue
                v = np.asarray(v, dtype=np.float64)
                if np.isnan(v).any():
                    continue
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == rows:
                    yield tile(len(v))
        for n in list(held):
            yield tile(n)
    return run


def semantic_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, metric: str = "cosine",
                  query_id: str = "query_id", query_vec: str = "embedding",
                  corpus_id: str = "message_id", corpus_vec: str = "embedding",
                  query_tile: int = QUERY_TILE, corpus_tile: int = CORPUS_TILE) -> DataFrame:
    """Exact top-``k`` corpus rows per query by cosine / dot / (negative) L2,
    ties by id.

    Null vectors, vectors with null elements and corpus vectors of another
    length than the query's are not scored (``quality.check_dims`` reports
    them).  Within a pair of tiles a matrix product finds each query's
    candidates, with a margin for rounding; their scores are then summed again
    in a fixed order, and the cut takes (score desc, id asc)."""
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric}")
    qid_type = queries.schema[query_id].dataType.simpleString()
    cid_type = corpus.schema[corpus_id].dataType.simpleString()
    q = queries.select(F.col(query_id).alias("id"), F.col(query_vec).alias("v")).mapInPandas(
        _tiles(query_tile), f"dims int, ids array<{qid_type}>, matrix binary")
    c = corpus.select(F.col(corpus_id).alias("id"), F.col(corpus_vec).alias("v")).mapInPandas(
        _tiles(corpus_tile), f"dims int, ids array<{cid_type}>, matrix binary")
    # Blocks against blocks: the product is of tiles, not of rows.
    pairs = c.crossJoin(q.select(F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")))

    def score(it):
        for pdf in it:
            for row in pdf.itertuples(index=False):
                if row.dims != row.q_dims:
                    continue
                ids = list(row.ids)
                x = np.frombuffer(row.matrix, dtype=np.float64).reshape(-1, row.dims)
                qs = np.frombuffer(row.q_matrix, dtype=np.float64).reshape(-1, row.dims)
                rough = _scores(metric, qs, x)
                out = []
                for j, qid in enumerate(row.q_ids):
                    s = rough[:, j]
                    near = np.arange(len(s))
                    if len(s) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        near = np.flatnonzero(s >= least - 1e-6 * max(1.0, abs(float(least))))
                    exact = _one_score(metric, qs[j], x[near]).tolist()
                    best = sorted(zip(exact, (ids[i] for i in near.tolist())), key=lambda p: (-p[0], p[1]))[:k]
                    out += [(qid, cid, value) for value, cid in best]
                yield pd.DataFrame(out, columns=["qid", "cid", "score"])

    cand = pairs.mapInPandas(score, f"qid {qid_type}, cid {cid_type}, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("cid").asc())
    return (cand.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
                .select(F.col("qid").alias("query_id"), F.col("cid").alias(corpus_id), "rank", "score"))


def semantic_topk_lsh(queries: DataFrame, corpus: DataFrame, k: int = 5, threshold: float = 1.0,
                      bucket_length: float = 0.5, num_hash_tables: int = 4,
                      query_id: str = "query_id", query_vec: str = "embedding",
                      corpus_id: str = "message_id", corpus_vec: str = "embedding") -> DataFrame:
    """Approximate cosine top-k for query sets too large to broadcast.

    Vectors are L2-normalised (cosine order = Euclidean order on the unit
    sphere), bucketed with random projections, and joined on equal buckets
    (an equi-join: no pair outside a shared bucket is ever formed).  Pairs
    farther than ``threshold`` (Euclidean, unit vectors) are not considered.
    Opt-in and approximate: a true neighbour that shares no bucket can be
    missed; ``semantic_topk`` is the exact form.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer

    def unit(df, id_col, vec_col, out_id):
        v = df.select(F.col(id_col).alias(out_id), array_to_vector(F.col(vec_col)).alias("raw"))
        return Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(v).drop("raw")

    q = unit(queries, query_id, query_vec, "qid")
    c = unit(corpus, corpus_id, corpus_vec, "cid")
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", seed=7,
                                      bucketLength=bucket_length, numHashTables=num_hash_tables).fit(c)
    j = lsh.approxSimilarityJoin(q, c, threshold, distCol="dist").select(
        F.col("datasetA.qid").alias("qid"), F.col("datasetB.cid").alias("cid"),
        (1.0 - F.col("dist") * F.col("dist") / 2.0).alias("score"))     # cosine from unit distance
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("cid").asc())
    return (j.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
             .select(F.col("qid").alias("query_id"), F.col("cid").alias(corpus_id), "rank", "score"))


# ------------------------------------------------------------ exact top-k with pruning

#: Corpus rows (those with the least hashes) whose vectors the cells are laid around.
SEEDS = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _cell_tiles(seeds: dict[int, np.ndarray], rows: int, metric: str):
    """Rows sorted by (dims, cell) → tiles (dims, ids, matrix, centre, radius, n); the
    centre and radius are of unit vectors for cosine."""
    def run(it):
        held: list = []
        key = None

        def tile():
            x = np.asarray([v for _, v in held], dtype=np.float64)
            at = _unit(x) if metric == "cosine" else x
            centre = at.mean(axis=0)
            return pd.DataFrame({"dims": [key[0]], "ids": [[i for i, _ in held]], "matrix": [x.tobytes()], "centre": [centre.tobytes()],
                                 "radius": [float(np.sqrt(((at - centre) ** 2).sum(1)).max())], "n": [len(held)]})

        for pdf in it:
            for i, v, d, c in zip(pdf["id"], pdf["v"], pdf["dims"], pdf["cell"]):
                if key is not None and ((d, c) != key or len(held) == rows):
                    yield tile()
                    held = []
                key = (d, c)
                held.append((i, np.asarray(v, dtype=np.float64)))
        if held:
            yield tile()
    return run


def _bounds(metric: str, q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query and tile, a score that no row of the tile exceeds (triangle
    inequality), with room for rounding."""
    if metric == "l2":
        far = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * (q @ centre.T) + (centre * centre).sum(1)[None, :], 0.0))
        best = -np.maximum(far - radius[None, :], 0.0)
        scale = far + radius[None, :]
    else:
        at = _unit(q) if metric == "cosine" else q
        norm = np.linalg.norm(at, axis=1, keepdims=True)
        best = at @ centre.T + norm * radius[None, :]
        scale = norm * (np.linalg.norm(centre, axis=1) + radius)[None, :]
    return best + 1e-6 * np.maximum(1.0, scale)


def _best_of_tile(metric: str, k: int, q: np.ndarray, ids: list, x: np.ndarray):
    """(id, score) of the best k rows for each query, as ``semantic_topk`` scores them."""
    rough = _scores(metric, q, x)
    for j in range(len(q)):
        s, near = rough[:, j], np.arange(len(x))
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            near = np.flatnonzero(s >= least - 1e-6 * max(1.0, abs(float(least))))
        exact = _one_score(metric, q[j], x[near]).tolist()
        yield sorted(zip((ids[i] for i in near.tolist()), exact), key=lambda p: (-p[1], p[0]))[:k]


class _Pruned:
    """Tiles, queries and the (qid, tile) pairs that must be scored."""

    def __init__(self, tiles, asked, wanted, score):
        self.tiles, self.asked, self.wanted, self.score = tiles, asked, wanted, score


def prune_tiles(queries: DataFrame, corpus: DataFrame, k: int = 5, metric: str = "cosine",
                query_id: str = "query_id", query_vec: str = "embedding",
                corpus_id: str = "message_id", corpus_vec: str = "embedding",
                tile: int = CORPUS_TILE, seeds: int = SEEDS, query_tile: int = QUERY_TILE) -> _Pruned:
    """The tiles of the corpus and which of them each query has to read."""
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric}")
    spark = corpus.sparkSession
    qid_type = queries.schema[query_id].dataType.simpleString()
    cid_type = corpus.schema[corpus_id].dataType.simpleString()

    def usable(df, id_col, vec_col):
        return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(
            (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))).withColumn("dims", F.size("v"))

    q, rows = usable(queries, query_id, query_vec), usable(corpus, corpus_id, corpus_vec)
    by_dims: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(seeds).select("dims", "v").collect():
        by_dims.setdefault(r["dims"], []).append(r["v"])
    seed = {d: np.asarray(v, dtype=np.float64) for d, v in by_dims.items()}

    def assign(it):
        for pdf in it:
            cell = np.zeros(len(pdf), dtype=np.int32)
            dims = pdf["dims"].to_numpy()
            for d in np.unique(dims).tolist():
                if d in seed:
                    at = np.flatnonzero(dims == d)
                    x = np.asarray(pdf["v"].iloc[at].tolist(), dtype=np.float64)
                    centre = seed[d]
                    if metric == "cosine":
                        x, centre = _unit(x), _unit(centre)
                    cell[at] = ((centre * centre).sum(1)[None, :] - 2 * (x @ centre.T)).argmin(axis=1)
            yield pdf.assign(cell=cell)

    path = checkpoint_path(spark, f"parley-tiles-{uuid.uuid4().hex}")
    (rows.mapInPandas(assign, f"id {cid_type}, v array<double>, dims int, cell int")
     .repartitionByRange("dims", "cell", F.xxhash64("id")).sortWithinPartitions("dims", "cell")
     .mapInPandas(_cell_tiles(seed, tile, metric), f"dims int, ids array<{cid_type}>, matrix binary, centre binary, radius double, n long")
     .withColumn("tile", F.monotonically_increasing_id()).write.parquet(path))
    tiles = spark.read.parquet(path)

    def pack(size, fields, schema):
        """Rows of equal length → blocks of ``size`` rows, their fields as arrays."""
        def run(it):
            held: dict[int, list] = {}
            for pdf in it:
                for row in pdf[["dims", *fields]].itertuples(index=False):
                    mine = held.setdefault(row[0], [])
                    mine.append(row[1:])
                    if len(mine) == size:
                        held.pop(row[0])
                        yield pd.DataFrame({"dims": [row[0]], **{f: [list(c)] for f, c in zip(fields, zip(*mine))}})
            for d, mine in held.items():
                yield pd.DataFrame({"dims": [d], **{f: [list(c)] for f, c in zip(fields, zip(*mine))}})
        return run, schema

    centres = tiles.select("dims", "tile", "centre", "radius", "n").mapInPandas(*pack(
        1024, ["tile", "centre", "radius", "n"], "dims int, tile array<long>, centre array<binary>, radius array<double>, n array<long>"))

    def blocks_of(asked):
        fields, kinds = ["id", "v"], f"dims int, id array<{qid_type}>, v array<array<double>>"
        if "least" in asked.columns:
            fields, kinds = [*fields, "least"], kinds + ", least array<double>"
        packed = asked.select("dims", *fields).mapInPandas(*pack(query_tile, fields, kinds))
        return centres.join(packed.withColumnRenamed("dims", "q_dims"), F.col("dims") == F.col("q_dims"))

    def bounds(first: bool):
        def run(it):
            for pdf in it:
                for row in pdf.itertuples(index=False):
                    qs = np.asarray([list(v) for v in row.v], dtype=np.float64)
                    centre = np.asarray([np.frombuffer(c, dtype=np.float64) for c in row.centre])
                    n, ids = np.asarray(row.n), np.asarray(row.tile)
                    best = _bounds(metric, qs, centre, np.asarray(row.radius, dtype=np.float64))
                    out = []
                    for j, qid in enumerate(row.id):
                        if first:   # the best tiles, as many as hold k rows
                            order = np.argsort(-best[j], kind="stable")
                            chosen = order[:int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
                        else:
                            chosen = np.flatnonzero(best[j] >= row.least[j])
                        out += [(qid, int(ids[i]), float(best[j, i]), int(n[i])) for i in chosen.tolist()]
                    yield pd.DataFrame(out, columns=["qid", "tile", "bound", "n"])
        return run, f"qid {qid_type}, tile long, bound double, n long"

    def score(wanted):
        """(qid, cid, score): the best k of each wanted (query, tile)."""
        def run(it):
            for pdf in it:
                for row in pdf.itertuples(index=False):
                    x = np.frombuffer(row.matrix, dtype=np.float64).reshape(-1, row.dims)
                    qs = np.asarray([list(p["v"]) for p in row.asked], dtype=np.float64)
                    found = _best_of_tile(metric, k, qs, list(row.ids), x)
                    yield pd.DataFrame([(p["qid"], cid, s) for p, best in zip(row.asked, found) for cid, s in best],
                                       columns=["qid", "cid", "score"])
        asked = (wanted.join(q.select(F.col("id").alias("qid"), "v"), "qid")
                 .groupBy("tile", F.pmod(F.xxhash64("qid"), F.ceil(F.col("n_asked") / query_tile)).alias("part"))
                 .agg(F.collect_list(F.struct("qid", "v")).alias("asked")))
        return tiles.join(asked, "tile").select("dims", "ids", "matrix", "asked").mapInPandas(
            run, f"qid {qid_type}, cid {cid_type}, score double")

    def with_load(wanted):
        load = wanted.groupBy("tile").agg(F.count(F.lit(1)).alias("n_asked"))
        return wanted.join(load, "tile")

    best_first = Window.partitionBy("qid").orderBy(F.desc("bound"), "tile")
    before = F.coalesce(F.sum("n").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = blocks_of(q).mapInPandas(*bounds(True)).withColumn("before", before).filter(F.col("before") < k)
    first = score(with_load(seen.select("qid", "tile")))
    kth = (first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid")))
           .filter(F.col("place") <= k).groupBy("qid").agg(F.min("score").alias("least"), F.max("place").alias("have")))
    # Fewer than k rows in all: every tile counts.  A bound has room for rounding, so equal scores stay.
    asked = q.join(kth.select(F.col("qid").alias("id"), F.when(F.col("have") >= k, F.col("least")).alias("least")), "id", "left").select(
        "dims", "id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    wanted = blocks_of(asked).mapInPandas(*bounds(False)).select("qid", "tile")
    return _Pruned(tiles, q, wanted, lambda pairs: score(with_load(pairs)))


def semantic_topk_pruned(queries: DataFrame, corpus: DataFrame, k: int = 5, metric: str = "cosine",
                         corpus_id: str = "message_id", **kw) -> DataFrame:
    """The same rows as ``semantic_topk``, reading only tiles that can hold one of them.

    1. Corpus rows go to the cell of their nearest seed; the seeds are at most
       ``seeds`` corpus vectors (least hashes of ids), the only rows the driver sees.
       Rows are range partitioned by (cell, hash of id) and packed into tiles of at
       most ``tile`` rows, each with its centre and radius, and written once to the
       checkpoint folder.  A cell of any size is several tiles.
    2. Every query has a bound on its score in each tile, from blocks of tile centres
       against blocks of queries.  The tiles with the best bounds that hold k rows
       together are scored first and give a k-th score to beat.
    3. All tiles whose bound reaches it are scored, a tile's queries in blocks of
       ``query_tile``; the others are never read for that query.

    Null vectors and such of another length are left out as in ``semantic_topk``.
    The seeds and tiles are worked out while the query is built.
    """
    plan = prune_tiles(queries, corpus, k, metric, corpus_id=corpus_id, **kw)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("cid").asc())
    return (plan.score(plan.wanted).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
            .select(F.col("qid").alias("query_id"), F.col("cid").alias(corpus_id), "rank", "score"))
