"""Data-quality checks run as jobs: enums, ranges, nulls, formats, keys, FKs,
cascades and the SQLite → canonical schema adapter.

Every check is one scan (per table) with all rules evaluated as aggregate
expressions, so a table is read once no matter how many rules apply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Enumerations and formats of the reference schema.
ROLES = ("user", "assistant", "system")
FEEDBACK_TYPES = ("thumbs_up", "thumbs_down", "regenerate", "report")
SCORE_RANGE_CENTI = (-100, 100)
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
USERNAME_LEN = (3, 50)
REQUIRED = {
    "users": ("id", "email", "username"),
    "conversations": ("id", "user_id", "model_version"),
    "messages": ("id", "conversation_id", "role", "content"),
    "feedback": ("id", "message_id", "user_id", "feedback_type"),
}


def _rules_summary(df: DataFrame, table: str, rules: dict) -> DataFrame:
    """One pass: for every rule (name → violation predicate) the number of
    rows checked and violating; melted to (table_name, rule, n_checked, n_violations)."""
    aggs = [F.count(F.lit(1)).alias("n_checked")]
    aggs += [F.count_if(pred).cast("bigint").alias(f"v_{i}") for i, pred in enumerate(rules.values())]
    names = list(rules)
    row = df.agg(*aggs).select("n_checked", *[F.col(f"v_{i}").alias(n) for i, n in enumerate(names)])
    # one aggregation, then the single result row is unpivoted to one row per rule
    return (row.unpivot(["n_checked"], names, "rule", "n_violations")
               .select(F.lit(table).alias("table_name"), "rule", "n_checked", "n_violations"))


def check_enums(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    """DQ1/DQ2: role and feedback type in their lists, score within −1..1."""
    lo, hi = SCORE_RANGE_CENTI
    m = _rules_summary(messages, "messages", {
        "role_in_list": ~F.coalesce(F.col("role").isin(*ROLES), F.lit(False))})
    f = _rules_summary(feedback, "feedback", {
        "feedback_type_in_list": ~F.coalesce(F.col("feedback_type").isin(*FEEDBACK_TYPES), F.lit(False)),
        "score_in_range": F.col("score_centi").isNotNull() & ~F.col("score_centi").between(lo, hi)})
    return m.unionByName(f)


def check_not_null(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """DQ3: null counts of the required columns, all in one aggregation."""
    return _rules_summary(df, table, {f"{c}_not_null": F.col(c).isNull() for c in columns})


def check_users(users: DataFrame) -> DataFrame:
    """DQ4: email format and username length per user."""
    lo, hi = USERNAME_LEN
    return users.select(
        "id",
        F.coalesce(F.col("email").rlike(EMAIL_PATTERN), F.lit(False)).alias("email_ok"),
        F.coalesce(F.length("username").between(lo, hi), F.lit(False)).alias("username_ok"))


def duplicate_keys(df: DataFrame, table: str, key_cols: list[str]) -> DataFrame:
    """A15/DQ5: key values occurring more than once (partial aggregation first).

    Groups by the columns themselves; rows with a null key column are never
    duplicates, as in SQL UNIQUE.  ``key_value`` is the JSON of the columns."""
    present = df.dropna(subset=key_cols).select(*[F.col(c).cast("string").alias(c) for c in key_cols])
    return (present.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n_rows"))
                   .filter(F.col("n_rows") > 1)
                   .select(F.lit(table).alias("table_name"), F.lit(",".join(key_cols)).alias("key_columns"),
                           F.to_json(F.array(*key_cols)).alias("key_value"), "n_rows"))


def orphans(child: DataFrame, child_table: str, fk: str, parent: DataFrame, parent_key: str,
            child_id: str = "id") -> DataFrame:
    """J9/DQ6: child rows whose foreign key has no parent (left-anti join)."""
    p = parent.select(F.col(parent_key).alias(fk))
    return (child.filter(F.col(fk).isNotNull())
                 .join(p, fk, "left_anti")
                 .select(F.lit(f"{child_table}.{fk}").alias("foreign_key"),
                         F.col(child_id).cast("string").alias("child_id"), F.col(fk).cast("string").alias("missing_key")))


def cascade_delete(users: DataFrame, conversations: DataFrame, messages: DataFrame,
                   feedback: DataFrame, embeddings: DataFrame, rate_limits: DataFrame,
                   deleted_users: DataFrame) -> dict:
    """J10: ON DELETE CASCADE along users → conversations → messages →
    (feedback, embeddings), users → feedback and users → rate limits.

    Every table is read once and gets a ``_gone`` flag by left joins with the
    keys deleted above it; survivors and counts both come from the flag.
    """
    gone = F.coalesce(F.col("_d"), F.lit(False))
    du = deleted_users.select(F.col("id").alias("user_id")).distinct().withColumn("_d", F.lit(True))

    def flagged(table, keys, on):
        return table.join(keys.withColumnRenamed(keys.columns[0], on), on, "left").withColumn("_gone", gone).drop("_d")

    def keys(table, name):
        return table.filter("_gone").select(F.col("id").alias(name), F.lit(True).alias("_d"))

    u = flagged(users, du, "id")
    c = flagged(conversations, du, "user_id")
    m = flagged(messages, keys(c, "conversation_id"), "conversation_id")
    dm = keys(m, "message_id")
    f = flagged(feedback, dm, "message_id").withColumnRenamed("_gone", "_by_message")
    f = flagged(f, du, "user_id").withColumn("_gone", F.col("_gone") | F.col("_by_message")).drop("_by_message")
    tables = {"users": u, "conversations": c, "messages": m, "feedback": f,
              "message_embeddings": flagged(embeddings, dm, "message_id"), "rate_limits": flagged(rate_limits, du, "user_id")}
    source = {"users": users, "conversations": conversations, "messages": messages, "feedback": feedback,
              "message_embeddings": embeddings, "rate_limits": rate_limits}
    counts = reduce(DataFrame.unionByName, [
        t.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(~F.col("_gone")).cast("bigint").alias("n_kept"))
         .select(F.lit(n).alias("table_name"), "n_before", "n_kept") for n, t in tables.items()])
    counts = counts.withColumn("n_deleted", F.col("n_before") - F.col("n_kept"))
    return {"kept": {n: t.filter(~F.col("_gone")).select(*source[n].columns) for n, t in tables.items()}, "counts": counts}


def check_dims(embeddings: DataFrame, dim: int, col: str = "embedding", id_col: str = "message_id") -> DataFrame:
    """DQ8: vectors whose dimension differs from ``dim`` (null vectors count)."""
    n = F.size(F.col(col))
    return embeddings.select(id_col, n.cast("bigint").alias("dims"),
                             F.coalesce(n == dim, F.lit(False)).alias("dims_ok"))
