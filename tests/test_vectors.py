"""Exact top-k against numpy brute force, for every metric and for one tile
and many tiles of either side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import vectors as V
from parley.sources.fixtures import chat_tables

from conftest import SF_SMALL


def _brute(q_ids, Q, c_ids, C, k, metric):
    if metric == "cosine":
        s = (C / np.linalg.norm(C, axis=1, keepdims=True)) @ (Q / np.linalg.norm(Q, axis=1, keepdims=True)).T
    elif metric == "dot":
        s = C @ Q.T
    else:
        s = -np.sqrt(((C[:, None, :] - Q[None, :, :]) ** 2).sum(-1))
    out = set()
    for j, q in enumerate(q_ids):
        order = sorted(range(len(c_ids)), key=lambda i: (-s[i, j], c_ids[i]))[:k]
        out |= {(q, c_ids[i], r + 1) for r, i in enumerate(order)}
    return out


@pytest.mark.parametrize("metric,tiles", [("cosine", {}), ("dot", {}), ("l2", {}), ("cosine", {"query_tile": 3, "corpus_tile": 17})])
def test_topk_matches_brute_force(spark, metric, tiles):
    emb = chat_tables(spark, SF_SMALL).message_embeddings
    queries = emb.filter(F.col("message_id") % 50 == 7).select(
        F.col("message_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.message_id, r.rank)
           for r in V.semantic_topk(queries, emb, 4, metric, **tiles).collect()}
    qp, cp = queries.toPandas(), emb.toPandas()
    Q = np.vstack(qp["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
    C = np.vstack(cp["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)))
    want = _brute(list(qp["query_id"]), Q, list(cp["message_id"]), C, 4, metric)
    assert got == want


@pytest.mark.parametrize("tiles", [{}, {"query_tile": 1, "corpus_tile": 9}])
def test_topk_ties_nulls_and_lengths(spark, tiles):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(200, 0, -1)] + [(900, None), (901, [1.0]), (902, [1.0, None, 0.5])]
    corpus = spark.createDataFrame(rows, "message_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(1, [1.0, 2.0, 0.5]), (2, None)], "query_id long, embedding array<double>")
    got = V.semantic_topk(queries, corpus, 5, **tiles).collect()
    assert [(r.query_id, r.message_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, i) for i in range(1, 6)]
    assert V.semantic_topk(queries.limit(0), corpus, 5).count() == 0


def test_mean_pool_matches_numpy(spark):
    emb = chat_tables(spark, SF_SMALL).message_embeddings
    got = {r.label: np.asarray(r.mean_vector) for r in V.mean_pool(emb, "label").collect()}
    p = emb.toPandas()
    for label, g in p.groupby("label"):
        want = np.vstack(g["embedding"].map(lambda v: np.asarray(v, dtype=np.float64))).mean(0)
        assert np.allclose(got[label], want, atol=1e-9)


def test_lsh_topk_is_close_to_exact(spark):
    emb = chat_tables(spark, SF_SMALL).message_embeddings
    queries = V.mean_pool(emb, "label").select(F.col("label").alias("query_id"),
                                               F.col("mean_vector").alias("embedding"))
    exact = {(r.query_id, r.message_id) for r in V.semantic_topk(queries, emb, 5).collect()}
    approx = V.semantic_topk_lsh(queries, emb, 5, threshold=2.0, bucket_length=2.0, num_hash_tables=8).collect()
    got = {(r.query_id, r.message_id) for r in approx}
    assert len(got & exact) / len(exact) >= 0.6
    assert all(-1.0 - 1e-9 <= r.score <= 1.0 + 1e-9 for r in approx)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("k, kw", [(4, {}), (1, {"tile": 5, "seeds": 9, "query_tile": 2}), (30, {"tile": 11, "seeds": 1}), (100000, {"tile": 64})])
def test_pruned_topk_equals_the_full_one(spark, metric, k, kw):
    """Ties (equal vectors under several ids), null, zero, short and broken vectors."""
    emb = chat_tables(spark, SF_SMALL).message_embeddings.select("message_id", "embedding")
    m = F.col("message_id")
    zero = F.transform("embedding", lambda x: x * F.lit(0).cast("float"))
    corpus = (emb.unionByName(emb.filter(m % 3 == 0).select((m + 1000000).alias("message_id"), "embedding"))
              .unionByName(emb.filter(m % 9 == 0).select((m + 2000000).alias("message_id"), zero.alias("embedding")))
              .unionByName(emb.filter(m % 9 == 1).select((m + 3000000).alias("message_id"), F.slice("embedding", 1, 7).alias("embedding")))
              .unionByName(emb.filter(m % 9 == 2).select((m + 4000000).alias("message_id"), F.lit(None).cast("array<float>").alias("embedding"))))
    queries = corpus.filter(m % 50 == 7).select(m.alias("query_id"), "embedding")

    def rows(df):
        return sorted((r.query_id, r.rank, r.message_id, round(r.score, 9)) for r in df.collect())
    assert rows(V.semantic_topk_pruned(queries, corpus, k, metric, **kw)) == rows(V.semantic_topk(queries, corpus, k, metric))


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_most_tiles_of_clustered_vectors_are_never_read(spark, metric):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 10
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.05
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "message_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, x[i * 37].tolist()) for i in range(60)], "query_id long, embedding array<double>")
    plan = V.prune_tiles(queries, corpus, 5, metric, tile=64, seeds=200)
    read, all_pairs = plan.wanted.count(), plan.tiles.count() * 60
    assert plan.tiles.count() >= 60 and read < all_pairs * 0.25

    def rows(df):
        return sorted((r.query_id, r.rank, r.message_id) for r in df.collect())
    assert rows(V.semantic_topk_pruned(queries, corpus, 5, metric, tile=64, seeds=200)) == rows(V.semantic_topk(queries, corpus, 5, metric))


def test_pruned_topk_of_empty_tables(spark):
    none = spark.createDataFrame([], "query_id long, message_id long, embedding array<double>")
    one = spark.createDataFrame([(1, 1, [1.0, 2.0])], "query_id long, message_id long, embedding array<double>")
    assert V.semantic_topk_pruned(one, none).count() == 0 == V.semantic_topk_pruned(none, one).count()
    assert [tuple(r)[:3] for r in V.semantic_topk_pruned(one, one).collect()] == [(1, 1, 1)]
