"""Chat history reads and rewrites: lookups, listings, documents, titles.

Ordering requirements of the reference (PostgreSQL) are made explicit: a DESC
sort puts nulls first, an ASC sort nulls last, and every order ends with the
row id so equal timestamps are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .skew import numbered_in_group


def scan_messages(messages: DataFrame) -> DataFrame:
    """Projection + rename of the message table (the reference's SELECT lists)."""
    return messages.select(F.col("id").alias("message_id"), "conversation_id", "role",
                           F.col("content").alias("text"), "created_s")


def active_users(users: DataFrame, user_id: int | None = None, email: str | None = None) -> DataFrame:
    """Key lookup of active users by id and/or email; both filters reach the scan."""
    cond = F.col("is_active")
    if user_id is not None:
        cond = cond & (F.col("id") == user_id)
    if email is not None:
        cond = cond & (F.col("email") == email)
    return users.filter(cond).select("id", "email", "username", "subscription_tier")


def with_positions(messages: DataFrame) -> DataFrame:
    """``messages`` with the 0-based position ``turn`` of each row in its
    conversation, by (created asc nulls last, id); unchanged if it has one.

    Only (id, conversation, time) rows are numbered, over range partitions, so a
    conversation may be of any size (``skew.numbered_in_group``, which writes them
    once while the query is built); texts join back by id, which is unique."""
    if "turn" in messages.columns:
        return messages
    place = numbered_in_group(messages.select("id", "conversation_id", "created_s"), "conversation_id",
                              [F.col("created_s").asc_nulls_last(), F.col("id").asc()], "turn")
    return messages.join(place.select("id", "turn"), "id")


def conversation_of_owner(conversations: DataFrame, messages: DataFrame, conversation_id, user_id) -> DataFrame:
    """One conversation with its messages, only if ``user_id`` owns it; both
    filters reach the scans, so only that conversation's rows are read."""
    own = conversations.filter((F.col("id") == conversation_id) & (F.col("user_id") == user_id))
    return conversation_documents(own, messages.filter(F.col("conversation_id") == conversation_id), nested=True)


def user_history(conversations: DataFrame, user_id: int | None = None, ordered: bool = False) -> DataFrame:
    """Non-archived conversations of one owner (or all owners).

    ``ordered`` sorts them newest first for display: a global sort on (user_id,
    updated desc nulls first, id), range partitioned, so that even an owner with
    a third of all rows is split over tasks.
    """
    c = conversations.filter(~F.col("is_archived"))
    if user_id is not None:
        c = c.filter(F.col("user_id") == user_id)
    c = c.select("id", "user_id", "title", "model_version", "created_s", "updated_s")
    return c if not ordered else (
            c.orderBy(F.col("user_id").asc(), F.col("updated_s").desc_nulls_first(), F.col("id").asc()))


def conversation_documents(conversations: DataFrame, messages: DataFrame,
                           nested: bool = False, ordered: bool = False) -> DataFrame:
    """Each conversation with its messages.

    Default (``nested=False``): one row per message carrying its conversation's
    columns, with ``ordered`` globally sorted by (conversation, created asc
    nulls last, id) — no conversation is ever gathered into one row, so no task
    holds a whole conversation.  ``nested=True`` returns the API shape, one row per
    conversation with ``messages: array<struct>`` (only for bounded conversations).
    """
    conv = conversations.select(F.col("id").alias("conversation_id"), "user_id", "title",
                                F.col("updated_s").alias("conversation_updated_s"))
    msg = messages.select("conversation_id", F.col("id").alias("message_id"), "role", "content", "created_s")
    j = conv.join(msg, "conversation_id")
    if not nested:
        return j if not ordered else j.orderBy("conversation_id", F.col("created_s").asc_nulls_last(), "message_id")
    return (j.groupBy("conversation_id", "user_id", "title", "conversation_updated_s")
             .agg(F.array_sort(F.collect_list(F.struct("created_s", "message_id", "role", "content")))
                  .alias("messages")))


def conversation_context(messages: DataFrame, n: int = 10, latest: bool = False) -> DataFrame:
    """First (or with ``latest`` last) ``n`` messages of every conversation.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the
    shuffle, so each task forwards at most ``n`` rows per conversation.
    """
    order = [F.col("created_s").desc_nulls_first(), F.col("id").desc()] if latest \
        else [F.col("created_s").asc_nulls_last(), F.col("id").asc()]
    w = Window.partitionBy("conversation_id").orderBy(*order)
    return (messages.select("conversation_id", "id", "role", "content", "created_s")
                    .withColumn("position", F.row_number().over(w).cast("bigint"))
                    .filter(F.col("position") <= n))


def first_user_message(messages: DataFrame) -> DataFrame:
    """Text of the earliest user message per conversation (partial aggregation)."""
    return (messages.filter(F.col("role") == "user")
                    .groupBy("conversation_id")
                    .agg(F.min_by("content", F.struct("created_s", "id")).alias("first_message")))


def conversation_titles(messages: DataFrame, max_words: int = 5, max_chars: int = 50) -> DataFrame:
    """Title of every conversation from its first user message."""
    return first_user_message(messages).select(
        "conversation_id", T.title("first_message", max_words, max_chars).alias("title"))


def apply_titles(conversations: DataFrame, titles: DataFrame, as_of: int) -> DataFrame:
    """Table rewrite: set ``title`` and ``updated_s = as_of`` where a new title exists."""
    t = titles.select(F.col("conversation_id").alias("id"), F.col("title").alias("_new_title"))
    j = conversations.join(t, "id", "left")
    has = F.col("_new_title").isNotNull()
    return j.select(
        *[F.when(has, F.col("_new_title")).otherwise(F.col("title")).alias("title") if c == "title"
          else F.when(has, F.lit(as_of).cast("bigint")).otherwise(F.col("updated_s")).alias("updated_s")
          if c == "updated_s" else F.col(c)
          for c in conversations.columns])


def last_message(messages: DataFrame) -> DataFrame:
    """Latest message per conversation with message counts (partial aggregation)."""
    return (messages.groupBy("conversation_id")
                    .agg(F.max_by("role", F.struct("created_s", "id")).alias("last_role"),
                         F.count(F.lit(1)).alias("n_messages"),
                         F.max(F.when(F.col("role") == "assistant", True).otherwise(False)).alias("has_answer")))


def unanswered_conversations(messages: DataFrame) -> DataFrame:
    """Conversations whose latest message is the user's (awaiting an answer);
    ``has_answer`` tells local (never answered) conversations apart."""
    return last_message(messages).filter(F.col("last_role") == "user")


def regenerate_requests(messages: DataFrame) -> DataFrame:
    """For every assistant message preceded by a user message: the prompt to
    resend and how many messages are kept (the history is cut before the
    answer).  Assistant messages at position 0 or after a non-user are skipped.
    ``kept_history`` gives the kept messages themselves.
    """
    messages = with_positions(messages)
    asst = messages.filter(F.col("role") == "assistant").select(
        F.col("id").alias("message_id"), "conversation_id", "turn")
    users = messages.filter(F.col("role") == "user").select(
        "conversation_id", (F.col("turn") + 1).alias("turn"), F.col("content").alias("prompt"))
    return asst.join(users, ["conversation_id", "turn"]).select(
        "message_id", "conversation_id", "prompt", F.col("turn").alias("kept_messages"))


def kept_history(messages: DataFrame, message_id) -> DataFrame:
    """The messages that stay when the answer ``message_id`` is regenerated."""
    messages = with_positions(messages)
    cut = messages.filter((F.col("id") == message_id) & (F.col("role") == "assistant")).select(
        "conversation_id", F.col("turn").alias("_cut"))
    return (messages.join(F.broadcast(cut), "conversation_id").filter(F.col("turn") < F.col("_cut"))   # one row, ids are unique
            .select("conversation_id", "turn", "id", "role", "content"))


def prepend_history(conversations: DataFrame, created: DataFrame) -> DataFrame:
    """Per owner the ids of the history list after ``created`` was put in front
    (any / append / slice on arrays): newest first, duplicates dropped."""
    newest = F.array_sort(F.collect_list(F.struct((-F.col("updated_s")).alias("k"), F.col("id"))))
    old = conversations.filter(~F.col("is_archived")).groupBy("user_id").agg(F.transform(newest, lambda x: x["id"]).alias("ids"))
    new = created.groupBy("user_id").agg(F.array_sort(F.collect_list("id")).alias("new_ids"))
    none = F.array().cast("array<bigint>")
    return old.join(new, "user_id", "full").select("user_id", F.array_distinct(
        F.concat(F.coalesce("new_ids", none), F.coalesce("ids", none))).alias("ids"))


def history_display(conversations: DataFrame) -> DataFrame:
    """Sidebar row: title with fallback and the last-update date."""
    return conversations.select(
        "id", T.display_title("title").alias("display_title"), T.initial(T.display_title("title")).alias("initial"),
        F.date_format(F.timestamp_seconds("updated_s"), "yyyy-MM-dd").alias("updated_date"))


def last_login(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Table rewrite: ``last_login_s`` = latest login event per user (kept if none)."""
    latest = logins.groupBy("user_id").agg(F.max("ts_s").alias("_last"))
    j = users.join(latest.withColumnRenamed("user_id", "id"), "id", "left")
    return j.select(*[F.coalesce(F.col("_last"), F.col("last_login_s")).alias("last_login_s")
                      if c == "last_login_s" else F.col(c) for c in users.columns])


def archive_conversations(conversations: DataFrame, as_of: int, days_old: int = 30) -> DataFrame:
    """Table rewrite: archive conversations created more than ``days_old`` days
    before ``as_of``.  ``archived_now`` flags rows this run changed."""
    old = F.col("created_s") < F.lit(as_of) - days_old * 86400
    newly = old & ~F.col("is_archived")
    cols = [F.col(c) for c in conversations.columns if c != "is_archived"]
    return conversations.select(*cols, (F.col("is_archived") | old).alias("is_archived"),
                                newly.alias("archived_now"))


def archive_counts(archived: DataFrame) -> DataFrame:
    """Affected-row count of an archive rewrite (the reference's rowcount)."""
    return archived.agg(F.count_if("archived_now").cast("bigint").alias("archived_conversations"),
                        F.count(F.lit(1)).alias("total_conversations"))


def stale_conversations(conversations: DataFrame, as_of: int, days_old: int = 30) -> DataFrame:
    return conversations.filter((F.col("created_s") < F.lit(as_of) - days_old * 86400)
                                & ~F.col("is_archived"))
