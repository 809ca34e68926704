"""Canonical chat tables derived from the driver tables by integer arithmetic.

The reference ships no data.  Its schema (users, conversations, messages,
feedback, agent tasks, ...) is filled here from the driver's tables with
rules that DuckDB can evaluate identically (``parley.plans.oracle_fixtures`` holds
the same rules as SQL), so every operator can be checked against an oracle.

Every derivation is a narrow projection (plus one aggregation for the
conversation header and one for the model table), so the fixtures scale
linearly with the driver tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


class ChatTables:
    """Lazily derived canonical tables for one driver data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def messages(self) -> DataFrame:
        c = self.raw("conversations")
        conv, turn = F.col("conv_id"), F.col("turn")
        is_asst = F.col("role") == "assistant"
        return c.select(
            (conv * (1 << 32) + turn).alias("id"),   # no two turns share an id
            conv.alias("conversation_id"),
            turn.alias("turn"),
            F.col("role"),
            F.col("text").alias("content"),
            F.when(is_asst, F.concat(F.lit("model-"), (conv % 3).cast("string"))).alias("model_version"),
            F.when(is_asst, (conv * 7919 + turn * 104729) % 120000).alias("inference_time_ms"),
            (conv * 3600 + turn * 60).alias("created_s"),
        )

    @cached_property
    def conversations(self) -> DataFrame:
        c = self.raw("conversations")
        conv = F.col("conv_id")
        return (
            c.groupBy("conv_id")
            .agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system_prompt"),
                 F.max("turn").alias("_max_turn"))
            .select(
                conv.alias("id"),
                (conv % 20).alias("user_id"),
                F.lit(None).cast("string").alias("title"),
                F.concat(F.lit("model-"), (conv % 3).cast("string")).alias("model_version"),
                F.col("system_prompt"),
                (conv * 3600).alias("created_s"),
                (conv * 3600 + F.col("_max_turn") * 60).alias("updated_s"),
                (conv % 4 == 3).alias("is_archived"),
            )
        )

    @cached_property
    def feedback(self) -> DataFrame:
        m = self.messages.filter(F.col("role") == "assistant")
        conv, turn = F.col("conversation_id"), F.col("turn")
        # Up to three ratings per assistant message: a constant fan-out done
        # with explode, not a join against a literal table.
        m = (m.select("id", "conversation_id", "turn", "created_s",
                      F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
             .filter(F.col("k") < (conv + turn) % 4))
        k = F.col("k").cast("bigint")
        ftype = (conv + turn * 3 + k) % 4
        return m.select(
            (F.col("id") * 4 + k).alias("id"),
            F.col("id").alias("message_id"),
            ((conv * 13 + k) % 50).alias("user_id"),
            F.when(ftype == 0, "thumbs_up").when(ftype == 1, "thumbs_down")
             .when(ftype == 2, "regenerate").otherwise("report").alias("feedback_type"),
            F.when((conv * 5 + turn + k) % 7 == 0, F.lit(None).cast("bigint"))
             .otherwise((conv * 37 + turn * 53 + k * 29) % 201 - 100).alias("score_centi"),
            F.when((conv + k) % 3 != 0, F.concat(F.lit("note "), conv.cast("string"))).alias("feedback_text"),
            (F.col("created_s") + 30 + k).alias("created_s"),
        )

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
            F.col("c_name").alias("username"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "premium").otherwise("free").alias("subscription_tier"),
            (F.col("c_custkey") % 7 != 0).alias("is_active"),
            F.lit(None).cast("bigint").alias("last_login_s"),
        )

    @cached_property
    def agent_tasks(self) -> DataFrame:
        o = self.raw("orders")
        key = F.col("o_orderkey")
        a = key % 4
        t = key % 9
        st = F.col("o_orderstatus")
        return o.select(
            key.alias("id"),
            F.when(a == 0, "trainer").when(a == 1, "evaluator").when(a == 2, "db_manager")
             .otherwise("support").alias("agent_type"),
            F.when(t == 0, "start_rlhf_training").when(t == 1, "evaluate_model")
             .when(t == 2, "toxicity_check").when(t == 3, "hallucination_detection")
             .when(t == 4, "cleanup_old_conversations").when(t == 5, "backup_feedback_data")
             .when(t == 6, "analyze_user_feedback").otherwise("unknown").alias("task_type"),
            F.when(st == "O", "pending").when(st == "P", "running").otherwise("completed").alias("status"),
            F.concat(F.lit('{"user_id": '), F.col("o_custkey").cast("string"),
                     F.when(key % 3 == 0, F.lit(', "days_old": 7')).otherwise(F.lit("")),
                     # what an evaluator judges: text with and without a flagged word, a long and a short answer
                     F.when(t == 2, F.concat(F.lit(', "content_id": "c1", "content": "'),
                                             F.when(key % 8 < 4, F.lit("a Toxic line")).otherwise(F.lit("a fine line")), F.lit('"')))
                      .when(t == 3, F.concat(F.lit(', "response_id": "r1", "context": "short", "response": "'),
                                             F.when(key % 8 < 4, F.lit("an answer far longer")).otherwise(F.lit("brief")), F.lit('"')))
                      .when((t == 0) & (key % 8 < 4), F.lit(', "mode": "supervised", "lr": 0.5, "opt": {"k": [1, 2]}'))
                      .when(t == 1, F.concat(F.lit(', "model_path": "models/'), key.cast("string"), F.lit('"')))
                      .otherwise(F.lit("")),
                     F.lit("}")).alias("input_data"),
            F.substring("o_orderpriority", 1, 1).cast("bigint").alias("priority"),
            (key * 10).alias("created_s"),
            F.when(st == "O", F.lit(None).cast("bigint"))
             .otherwise(key * 10 + F.col("o_custkey") % 7200).alias("started_s"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        e = self.raw("events")
        et = F.col("event_type")
        return e.select(
            F.col("event_id").alias("id"),
            F.col("user_id"),
            F.when(et.isin("click", "view"), "/api/chat").otherwise("/api/feedback").alias("endpoint"),
            F.when(et == "error", 500).otherwise(200).alias("status"),
            F.floor(F.col("value") * 100).cast("bigint").alias("latency_ms"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    @cached_property
    def training_steps(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(
            F.col("l_suppkey").alias("session_id"),
            F.col("l_linenumber").alias("epoch"),
            F.col("l_orderkey").alias("step"),
            (F.col("l_discount") + F.col("l_tax")).alias("eval_loss"),
            (F.col("l_orderkey") * 60 + F.col("l_linenumber")).alias("created_s"),
        )

    @cached_property
    def message_embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("message_id"), "embedding", "label")

    @cached_property
    def task_events(self) -> DataFrame:
        """Status change log of agent tasks, one event per order line."""
        li = self.raw("lineitem")
        ln = F.col("l_linenumber")
        return li.select(
            F.col("l_orderkey").alias("task_id"),
            F.when(ln == 1, "running")
             .when(F.col("l_returnflag") == "R", "failed")
             .when(F.col("l_linestatus") == "F", "completed")
             .otherwise("running").alias("status"),
            (F.col("l_orderkey") * 10 + ln * 60).alias("ts_s"),
            F.when(F.col("l_returnflag") == "R",
                   F.concat(F.lit("line "), ln.cast("string"), F.lit(" returned"))).alias("error_message"),
            F.to_json(F.struct(F.col("l_quantity").alias("quantity"))).alias("output_data"),
        )

    @cached_property
    def model_versions(self) -> DataFrame:
        """One version row per model seen in the messages, config as JSON text.

        Mirrors the seed row of the reference schema (max_tokens, temperature,
        top_p), with values derived from the model's own traffic; model-0 is
        the active one.
        """
        m = self.messages.filter(F.col("role") == "assistant")
        g = m.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"),
                                           F.max("inference_time_ms").alias("mx"))
        mv = F.col("model_version")
        return g.select(
            mv.alias("version_name"),
            F.when(mv == "model-0", "primary").otherwise("custom").alias("model_type"),
            F.concat(
                F.lit('{"max_tokens": '), (F.col("n") * 8).cast("string"),
                F.lit(', "temperature": '), F.format_string("%.1f", (F.col("mx") % 20) / 10.0),
                F.when(mv == "model-2", F.lit("")).otherwise(F.lit(', "top_p": 0.9')),
                F.lit("}")).alias("config"),
            (mv == "model-0").alias("is_active"),
        )


def chat_tables(spark: SparkSession, sf_dir: str) -> ChatTables:
    return ChatTables(spark, sf_dir)
