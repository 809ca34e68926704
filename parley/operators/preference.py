"""Evaluation sets, response scores, preference pairs, training pools and splits.

Semantics kept from the reference: a user message is paired with *every*
later assistant message of its conversation (not only the next one), so the
same user text may weigh an average several times.  ``pairing='next'`` offers
the narrower reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .feedback import avg_score
from .history import with_positions
from .skew import every_part, salt, with_figures, written

#: Rows of one key and side above which a theta join is cut into tiles.
TILE = 4096


def _rated_answers(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Assistant messages with the exact sum and count of their non-null scores.

    Ratings are pre-aggregated per message *before* the theta join, so the
    quadratic query/answer join carries one row per answer, not per rating.
    """
    fb = (feedback.filter(F.col("score_centi").isNotNull())
                  .groupBy("message_id")
                  .agg(F.sum("score_centi").alias("sum_centi"), F.count(F.lit(1)).alias("n_ratings")))
    asst = messages.filter(F.col("role") == "assistant").select(
        F.col("id").alias("message_id"), "conversation_id", *[c for c in ("turn",) if c in messages.columns],
        F.col("created_s").alias("answer_created_s"), F.col("content").alias("response"))
    return asst.join(fb, "message_id")


def query_answer_pairs(messages: DataFrame, feedback: DataFrame, pairing: str = "later", tile: int = TILE) -> DataFrame:
    """(user message, rated assistant message) pairs of the same conversation.

    ``later``: every assistant message created strictly after the user message.
    Conversations with more than ``tile`` messages of a kind (looked for while the
    query is built) are joined in tiles: both sides are cut into parts of about
    ``tile`` rows, and parts meet on (conversation, part, part), so one
    conversation's pairs spread over as many groups as it has tiles.  ``next``:
    only the assistant message at the following position.
    """
    if pairing == "next":
        messages = with_positions(messages)
        users = messages.filter(F.col("role") == "user").select(
            F.col("id").alias("query_id"), "conversation_id", F.col("turn").alias("query_turn"),
            F.col("created_s").alias("query_created_s"), F.col("content").alias("query"))
        ans = _rated_answers(messages, feedback)
        return users.join(ans, (users.conversation_id == ans.conversation_id)
                          & (ans.turn == users.query_turn + 1)).drop(ans.conversation_id)
    if pairing != "later":
        raise ValueError("pairing must be 'later' or 'next'")
    users = messages.filter(F.col("role") == "user").select(
        F.col("id").alias("query_id"), "conversation_id",
        F.col("created_s").alias("query_created_s"), F.col("content").alias("query"))
    ans = _rated_answers(messages.drop("turn"), feedback)
    of_role = messages.select("conversation_id", (F.col("role") == "user").alias("asks"), (F.col("role") == "assistant").alias("answers"))
    sizes = (of_role.groupBy("conversation_id").agg(F.count_if("asks").alias("asks"), F.count_if("answers").alias("answers"))
             .filter((F.col("asks") > tile) | (F.col("answers") > tile))
             .select("conversation_id", (F.col("asks") + F.col("answers")).alias("n"),
                     F.ceil(F.greatest("asks", F.lit(1)) / tile).alias("q_parts"), F.ceil(F.greatest("answers", F.lit(1)) / tile).alias("a_parts")))
    if sizes.isEmpty():
        return users.join(ans, (users.conversation_id == ans.conversation_id)
                          & (ans.answer_created_s > users.query_created_s)).drop(ans.conversation_id)
    sizes = written(sizes)

    def cut(rows, id_col, own, own_parts, other, other_parts):
        # Conversations of ordinary size have one part on either side.
        one = F.lit(1).cast("bigint")
        mine, theirs = F.coalesce(own_parts, one), F.coalesce(other_parts, one)
        return (with_figures(rows, sizes, "conversation_id").withColumn(own, salt(id_col, mine))
                .withColumn(other, every_part(theirs)).drop("n", "q_parts", "a_parts"))

    q = cut(users, "query_id", "q_part", F.col("q_parts"), "a_part", F.col("a_parts"))
    a = cut(ans, "message_id", "a_part", F.col("a_parts"), "q_part", F.col("q_parts"))
    return (q.join(a, ["conversation_id", "q_part", "a_part"]).filter("answer_created_s > query_created_s")
            .drop("q_part", "a_part"))


def evaluation_dataset(messages: DataFrame, feedback: DataFrame, min_count: int = 2,
                       limit: int = 100, pairing: str = "later") -> DataFrame:
    """Top ``limit`` (query, response) by average score, per user message.

    Groups by (user message id, query, response); keeps groups with at least
    ``min_count`` ratings; orders by average desc with (query id, response) as
    a total tie-break so the limit is deterministic (a top-k, planned as
    TakeOrderedAndProject: partial top-k per task, no global sort).
    """
    p = query_answer_pairs(messages, feedback, pairing)
    g = (p.groupBy("query_id", "query", "response")
          .agg(F.sum("sum_centi").alias("sum_centi"), F.sum("n_ratings").alias("n_ratings"))
          .filter(F.col("n_ratings") >= min_count))
    exact = F.col("sum_centi") / F.col("n_ratings")
    return (g.orderBy(exact.desc(), F.col("query_id").asc(), F.col("response").asc())
             .limit(limit)
             .select("query_id", "query", "response",
                     avg_score(F.col("sum_centi"), F.col("n_ratings")).alias("avg_score"), "sum_centi", "n_ratings"))


def response_scores(messages: DataFrame, feedback: DataFrame, min_count: int = 2,
                    pairing: str = "later") -> DataFrame:
    """Average score and rating count per (query text, response text), ≥ min_count."""
    p = query_answer_pairs(messages, feedback, pairing)
    return (p.groupBy("query", "response")
             .agg(F.sum("sum_centi").alias("sum_centi"), F.sum("n_ratings").alias("feedback_count"))
             .filter(F.col("feedback_count") >= min_count)
             .select("query", "response",
                     avg_score(F.col("sum_centi"), F.col("feedback_count")).alias("avg_score"),
                     "feedback_count", "sum_centi"))


def preference_pairs(scores: DataFrame, min_gap_centi: int = 20, ordered: bool = True, tile: int = TILE) -> DataFrame:
    """Pairs of responses to the same query whose average scores differ by
    more than ``min_gap_centi``/100; ``preference`` = 1 when a beats b.

    Exact integer test: |sa·cb − sb·ca| > gap·ca·cb (no float boundary error).
    ``ordered=True`` keeps both orders (a, b) and (b, a) as the reference does;
    ``ordered=False`` keeps one order (a.response < b.response).

    The scores are written once while the query is built.  A query with more than
    ``tile`` responses is joined in tiles: its responses are cut by score into cells as wide as the gap, and a cell into parts of
    about ``tile`` rows.  Two responses of one cell never differ by more than the gap,
    so a cell is not joined with itself; all other parts meet on
    (query, part, part).
    """
    # The join key is the 64-bit hash (cheap to shuffle and compare); the text
    # equality is kept as a residual so hash collisions cannot pair rows.
    keyed = written(scores.select(F.xxhash64("query").alias("qh"), "query", "response", "sum_centi", "feedback_count"))
    figures = ["query", "response", "sum_centi", "feedback_count"]
    left, right = ["query", "response_a", "sa", "ca"], ["query_b", "response_b", "sb", "cb"]

    def side(rows, names, *keys):
        return rows.select("qh", *keys, *[F.col(c).alias(n) for c, n in zip(figures, names)])

    sizes = keyed.groupBy("qh").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    if sizes.isEmpty():
        j = side(keyed, left).join(side(keyed, right), "qh")
    else:
        width = F.lit(max(min_gap_centi, 1)) * F.col("feedback_count")
        cell = F.expr("floor((sum_centi - pmod(sum_centi, _width)) / _width)").cast("bigint")
        sized = with_figures(keyed, written(sizes), "qh").withColumn("_width", width).withColumn("cell", cell).drop("_width")
        hot = sized.filter("n IS NOT NULL").drop("n")
        cells = written(hot.groupBy("qh", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"), F.count(F.lit(1)).alias("n"))
                        .withColumn("block", F.struct("qh", "cell")))
        # (query, cell, part) of the hot queries, and which of them meet.
        blocks = cells.select("qh", "cell", every_part(F.col("parts")).alias("part"))
        met = blocks.join(blocks.toDF("qh", "cell_b", "part_b"), "qh").filter("cell <> cell_b" if min_gap_centi > 0 else "true")
        parted = (with_figures(hot.withColumn("block", F.struct("qh", "cell")), cells.select("block", "parts", "n"), "block")
                  .withColumn("part", salt("response", F.col("parts"))))
        keys = ["qh", "cell", "part", "cell_b", "part_b"]
        a = side(parted, left, "cell", "part").join(met, ["qh", "cell", "part"])
        b = side(parted, right, F.col("cell").alias("cell_b"), F.col("part").alias("part_b")).join(met, ["qh", "cell_b", "part_b"])
        small = sized.filter("n IS NULL")
        j = (side(small, left).join(side(small, right), "qh").select(*left, *right)
             .unionByName(a.join(b, keys).select(*left, *right)))
    order = F.col("response_a") != F.col("response_b") if ordered else F.col("response_a") < F.col("response_b")
    lhs = F.col("sa") * F.col("cb")
    rhs = F.col("sb") * F.col("ca")
    return (j.filter((F.col("query") == F.col("query_b")) & order & (F.abs(lhs - rhs) > F.lit(min_gap_centi) * F.col("ca") * F.col("cb")))
             .select("query", "response_a", "response_b",
                     F.when(lhs > rhs, 1).otherwise(0).alias("preference")))


def training_pool(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """Distinct (user query text, conversation) for conversations with any rating.

    The correlated EXISTS of the reference is a left-semi join against the set
    of rated conversations (one small distinct per conversation).
    """
    rated_conv = (feedback.select("message_id")
                  .join(messages.select(F.col("id").alias("message_id"), "conversation_id"), "message_id")
                  .select("conversation_id").distinct())
    users = messages.filter(F.col("role") == "user").select(
        F.col("content").alias("query"), "conversation_id")
    return users.join(rated_conv, "conversation_id", "left_semi").distinct()


def training_batch(pool: DataFrame, n: int = 8, seed: int = 42) -> DataFrame:
    """A reproducible "random" batch of ``n`` rows: order by md5(seed‖key)."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col("conversation_id").cast("string"),
                         F.lit("|"), F.col("query")))
    return (pool.withColumn("sample_key", key)
                .orderBy("sample_key", "conversation_id", "query")
                .limit(n))


def training_sample(pool: DataFrame, n: int, seed: int = 42, digits: int = 4) -> DataFrame:
    """The first ``n`` rows in the order of ``training_batch``, for samples of any size.

    The rows are counted by the first ``digits`` hex digits of their sample key;
    the bin in which the n-th row falls is found from those counts, while the query is
    built.  All rows of the bins before it are taken by a filter, and only that one bin is cut in order."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col("conversation_id").cast("string"), F.lit("|"), F.col("query")))
    keyed = pool.withColumn("sample_key", key).withColumn("_bin", F.substr("sample_key", F.lit(1), F.lit(digits)))
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)   # 16 ** digits bins at most
    bins = keyed.groupBy("_bin").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_upto", F.sum("_rows").over(upto))
    edge = bins.filter(F.col("_upto") >= n).orderBy("_bin").select("_bin", (F.lit(n) - F.col("_upto") + F.col("_rows")).alias("need")).first()
    if edge is None:
        return keyed.drop("_bin")   # the pool holds fewer than n rows
    cut = keyed.filter(F.col("_bin") == edge["_bin"]).orderBy("sample_key", "conversation_id", "query").limit(max(int(edge["need"]), 0))
    return keyed.filter(F.col("_bin") < edge["_bin"]).unionByName(cut).drop("_bin")
