"""Queries over message embeddings: mean pooling and exact top-k search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from ..sources.fixtures import chat_tables
from .catalog import register
from .oracle_fixtures import with_fixtures as W

TOPK = 5

_CENTROIDS = """
pos as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from message_embeddings),
cent as (select label, list(m order by i) as c from (select label, i, avg(x) as m from pos group by label, i) group by label)"""


@register("mean_pool", W("""
select label, (i - 1)::bigint as dim_index, round(avg(x), 6) as mean_value from pos group by label, i""",
    "message_embeddings", ctes=_CENTROIDS))
def q_mean_pool(spark, sf_dir):
    m = V.mean_pool(chat_tables(spark, sf_dir).message_embeddings, "label")
    return m.select("label", F.posexplode("mean_vector").alias("dim_index", "mean_value")).select(
        "label", F.col("dim_index").cast("bigint"), F.round("mean_value", 6).alias("mean_value"))


# Every third vector also stands under a second id (a tie), some are null or short.
_CORPUS = _CENTROIDS + """,
corpus as (select message_id, embedding from message_embeddings
           union all select message_id + 1000000, embedding from message_embeddings where message_id % 3 = 0
           union all select message_id + 2000000, case when message_id % 2 = 0 then embedding[1:10] end from message_embeddings
                     where message_id % 50 = 0)"""


def _corpus(emb):
    m = F.col("message_id")
    short = F.when(m % 2 == 0, F.slice("embedding", 1, 10)).alias("embedding")
    return (emb.select("message_id", "embedding")
            .unionByName(emb.filter(m % 3 == 0).select((m + 1000000).alias("message_id"), "embedding"))
            .unionByName(emb.filter(m % 50 == 0).select((m + 2000000).alias("message_id"), short)))


_TOPK_SQL = W(f"""
select query_id, message_id, rank, round(score, 6) as score from (
  select c.label as query_id, e.message_id, s.score,
         row_number() over (partition by c.label order by s.score desc, e.message_id) as rank
  from cent c join corpus e on len(e.embedding) = len(c.c),
  lateral (select list_cosine_similarity(c.c, e.embedding::double[]) as score) s)
where rank <= {TOPK}""", "message_embeddings", ctes=_CORPUS)


@register("semantic_topk", _TOPK_SQL)
def q_semantic_topk(spark, sf_dir):
    emb = chat_tables(spark, sf_dir).message_embeddings
    queries = V.mean_pool(emb, "label").select(F.col("label").alias("query_id"),
                                               F.col("mean_vector").alias("embedding"))
    r = V.semantic_topk(queries, _corpus(emb), TOPK, "cosine")
    return r.select("query_id", "message_id", "rank", F.round("score", 6).alias("score"))


@register("semantic_topk_pruned", _TOPK_SQL)
def q_semantic_topk_pruned(spark, sf_dir):
    emb = chat_tables(spark, sf_dir).message_embeddings
    queries = V.mean_pool(emb, "label").select(F.col("label").alias("query_id"),
                                               F.col("mean_vector").alias("embedding"))
    r = V.semantic_topk_pruned(queries, _corpus(emb), TOPK, "cosine")
    return r.select("query_id", "message_id", "rank", F.round("score", 6).alias("score"))
