"""Adapters from the embedded (SQLite) form of the tables to the canonical one.

The embedded form keeps times as text, flags as 0 / 1 integers and zero for
missing numbers; its model table has ``name`` and ``version`` columns.  Ratings
are adapted by ``feedback.normalize_feedback``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of the embedded schema.
DEFAULT_MODEL = "deepseek-chat"
DEFAULT_TIER = "free"


def _seconds(c: str) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` text → epoch seconds; anything else is null."""
    return F.unix_seconds(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss")))


def _flag(c: str, default: bool) -> Column:
    return F.coalesce(F.col(c) != 0, F.lit(default))


def users(df: DataFrame) -> DataFrame:
    return df.select("id", "email", "username", F.coalesce("subscription_tier", F.lit(DEFAULT_TIER)).alias("subscription_tier"),
                     _flag("is_active", True).alias("is_active"), _seconds("last_login").alias("last_login_s"))


def conversations(df: DataFrame) -> DataFrame:
    return df.select("id", "user_id", "title", F.coalesce("model_version", F.lit(DEFAULT_MODEL)).alias("model_version"),
                     "system_prompt", _seconds("created_at").alias("created_s"), _seconds("updated_at").alias("updated_s"),
                     _flag("is_archived", False).alias("is_archived"))


def messages(df: DataFrame) -> DataFrame:
    return df.select("id", "conversation_id", "role", "content", "model_version",
                     F.nullif(F.col("inference_time_ms"), F.lit(0)).alias("inference_time_ms"), _seconds("created_at").alias("created_s"))


def model_versions(df: DataFrame) -> DataFrame:
    """Name and version make the canonical version name; there is no configuration."""
    return df.select(F.concat_ws("-", "name", "version").alias("version_name"), F.lit("custom").alias("model_type"),
                     F.lit("{}").alias("config"), _flag("is_active", False).alias("is_active"))
