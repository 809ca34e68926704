"""Feedback analytics: statistics, the reward dataset, backups, normalisation.

Scores are carried as ``score_centi`` (score × 100, bigint) so sums and
thresholds are exact integers; averages are exposed as
``round(sum / count / 100, 6)`` doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .history import with_positions


def avg_score(sum_centi: Column, count: Column) -> Column:
    """Average score from an exact integer sum of centi-scores and a count;
    null when there are no scores (ANSI-safe division)."""
    return F.round(F.try_divide(sum_centi.cast("double"), count.cast("double")) / 100.0, 6)


def feedback_stats(feedback: DataFrame, messages: DataFrame, conversations: DataFrame,
                   user_id: int | None = None) -> DataFrame:
    """Average score and count of ratings per conversation owner and feedback type.

    feedback ⋈ messages ⋈ conversations, grouped by (owner, type).  The owner is
    the conversation's ``user_id`` (not the rater).  A null average is reported
    as 0.0, as the reference's summary does.  ``user_id`` restricts to one owner
    (the reference's per-task form); by default every owner is summarised.
    """
    conv = conversations.select(F.col("id").alias("conversation_id"), F.col("user_id"))
    if user_id is not None:
        conv = conv.filter(F.col("user_id") == user_id)
    msg = messages.select(F.col("id").alias("message_id"), "conversation_id")
    fb = feedback.select("message_id", "feedback_type", "score_centi")
    j = fb.join(msg, "message_id").join(conv, "conversation_id")
    return (j.groupBy("user_id", "feedback_type")
             .agg(F.sum("score_centi").alias("_s"), F.count("score_centi").alias("_n"),
                  F.count(F.lit(1)).alias("feedback_count"))
             .select("user_id", "feedback_type",
                     F.coalesce(avg_score(F.col("_s"), F.col("_n")), F.lit(0.0)).alias("avg_score"),
                     "feedback_count"))


def previous_message(messages: DataFrame) -> DataFrame:
    """Each message with the message right before it in its conversation.

    Messages get their position ``turn`` if they carry none; the predecessor is
    found by an equi-join on (conversation_id, turn - 1).  Hash partitioning on both
    columns spreads even a conversation holding a third of all rows evenly
    over the cluster, which a window partitioned by conversation would not.
    """
    messages = with_positions(messages)
    cur = messages.select("id", "conversation_id", "turn", "role", "content", "created_s")
    prev = messages.select(F.col("conversation_id"),
                           (F.col("turn") + 1).alias("turn"),
                           F.col("id").alias("prev_id"),
                           F.col("role").alias("prev_role"),
                           F.col("content").alias("prev_content"))
    return cur.join(prev, ["conversation_id", "turn"], "left")


def feedback_dataset(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Reward-model rows: (user query, rated assistant response, score).

    The reference joins the rated message with itself under contradictory role
    predicates (always empty).  Built here is its intent: a rated assistant
    message paired with the user message immediately before it; ratings with a
    null score are dropped.
    """
    messages = with_positions(messages)
    fb = (feedback.filter(F.col("score_centi").isNotNull())
                  .select(F.col("id").alias("feedback_id"), F.col("message_id").alias("id"),
                          "feedback_type", "feedback_text", "score_centi",
                          F.col("created_s").alias("feedback_created_s")))
    asst = messages.filter(F.col("role") == "assistant").select("id", "conversation_id", "turn", "content")
    rated = fb.join(asst, "id")
    users = messages.filter(F.col("role") == "user").select(
        "conversation_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("query"))
    return rated.join(users, ["conversation_id", "turn"]).select(
        "feedback_id", F.col("id").alias("message_id"), "query",
        F.col("content").alias("response"), "score_centi",
        (F.col("score_centi") / 100.0).alias("feedback_score"), "feedback_type", "feedback_text", "feedback_created_s")


def sample_check(dataset: DataFrame, min_count: int = 10) -> DataFrame:
    """Size of a dataset and whether it reaches the recommended minimum."""
    return dataset.agg(F.count(F.lit(1)).alias("n_samples")).select(
        "n_samples", (F.col("n_samples") >= min_count).alias("enough"))


def recent_feedback(feedback: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """Ratings created in the last ``days`` days before ``as_of`` (epoch s)."""
    return feedback.filter(F.col("created_s") >= F.lit(as_of) - days * 86400)


def feedback_backup(feedback: DataFrame, messages: DataFrame, as_of: int, days: int = 7) -> DataFrame:
    """All feedback columns plus the rated message's text, last ``days`` days.

    Write the result with ``parley.sources.sinks.write_json``; the record count
    is ``df.count()`` of what was written.
    """
    msg = messages.select(F.col("id").alias("message_id"), F.col("content").alias("message_content"))
    return recent_feedback(feedback, as_of, days).join(msg, "message_id")


def score_feedback_types(feedback: DataFrame) -> DataFrame:
    """UI feedback type → numeric score (thumbs up +1, thumbs down −1)."""
    return feedback.select("id", "feedback_type", T.feedback_type_score("feedback_type").alias("ui_score"))


def normalize_feedback(sqlite_feedback: DataFrame) -> DataFrame:
    """SQLite-form feedback (score −1/0/1, comment) → canonical columns.

    score 1 → thumbs_up, −1 → thumbs_down, 0 → regenerate; other scores are
    kept but typed 'report' so a DQ check can flag them.
    """
    s = F.col("score")
    return sqlite_feedback.select(
        "id", "message_id", "user_id",
        F.when(s == 1, "thumbs_up").when(s == -1, "thumbs_down").when(s == 0, "regenerate")
         .otherwise("report").alias("feedback_type"),
        (s.cast("bigint") * 100).alias("score_centi"),
        F.col("comment").alias("feedback_text"),
        "created_s")
