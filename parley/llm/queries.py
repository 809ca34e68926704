"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, collocations, decontaminate, divergence, exact_dedup, mixture, near_dedup, packing, quality, secrets,
               sharding, substring_dedup, url_filter)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return keep


@query("op1_exact_dedup", exact_dedup.ORACLE)
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.find_duplicates(table(spark, sf_dir, "documents"))


@query("op2_near_dedup", near_dedup.ORACLE)
def op2_near_dedup(spark, sf_dir):
    return near_dedup.find_near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query("op3_decontaminate", decontaminate.ORACLE)
def op3_decontaminate(spark, sf_dir):
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    marked = decontaminate.n_marked()
    return hits.select("doc_id", "n_words", marked.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       decontaminate.items_digest().alias("items_sha256"), (marked > 0).alias("contaminated"))


@query("op4_url_filter", url_filter.ORACLE)
def op4_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("alias_class")


@query("op5_sharding", sharding.ORACLE)
def op5_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query("op6_secrets", secrets.ORACLE)
def op6_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE],
                        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_chat_format", chat_format.ORACLE)
def op8_chat_format(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat_format.format_branches(chat_format.messages_by_turn(rows))
    turns, loss = chat_format.read_back(), chat_format.read_loss()
    said_all = F.concat_ws("", F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return made.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op9_substring_dedup")
def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.find_repeats(table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


@query("op11_source_divergence", divergence.ORACLE)
def op11_source_divergence(spark, sf_dir):
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


@query("op12_source_mix", mixture.ORACLE)
def op12_source_mix(spark, sf_dir):
    return mixture.taken_words(table(spark, sf_dir, "documents"))


@query("op13_collocations", collocations.ORACLE)
def op13_collocations(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))
