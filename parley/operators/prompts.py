"""Per-message text checks and per-conversation text products (prompts, code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .feedback import previous_message

# Fenced code block of chat markdown and its language tag.
CODE_FENCE = r"```(\w*)\n([\s\S]*?)```"


def render_prompts(messages: DataFrame) -> DataFrame:
    """The model prompt of every conversation: messages in time order, rendered
    by role (unknown roles skipped), ending with the response header.

    The prompt is the whole conversation by definition, so its pieces are
    gathered per conversation (the output row *is* that text).
    """
    pieces = messages.select("conversation_id", "created_s", "id",
                             T.prompt_piece("role", "content").alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("created_s", "id", "piece")))
    return pieces.groupBy("conversation_id").agg(
        F.concat(F.array_join(F.transform(ordered, lambda s: s["piece"]), ""),
                 F.lit(T.PROMPT_TAIL)).alias("prompt"))


def toxicity_check(df: DataFrame, col: str = "content", id_col: str = "id") -> DataFrame:
    tox = T.is_toxic(col)
    return df.select(id_col, tox.alias("is_toxic"),
                     F.when(tox, F.lit(T.TOXIC_CONFIDENCE)).otherwise(F.lit(T.CLEAN_CONFIDENCE)).alias("confidence"))


def hallucination_check(messages: DataFrame, ratio: int = 2) -> DataFrame:
    """Assistant answers longer than ``ratio`` × the user message before them."""
    p = previous_message(messages).filter((F.col("role") == "assistant") & (F.col("prev_role") == "user"))
    return p.select(F.col("id").alias("message_id"),
                    T.is_hallucination("content", "prev_content", ratio).alias("has_hallucination"),
                    F.lit(T.HALLUCINATION_CONFIDENCE).alias("confidence"))


def code_blocks(df: DataFrame, col: str = "content", id_col: str = "id") -> DataFrame:
    """Fenced code blocks: one row per block with its language and body
    (the final newline of the body removed)."""
    langs = F.regexp_extract_all(F.col(col), F.lit(CODE_FENCE), 1)
    bodies = F.regexp_extract_all(F.col(col), F.lit(CODE_FENCE), 2)
    z = df.select(id_col, F.posexplode(F.arrays_zip(langs.alias("language"), bodies.alias("body"))).alias("block_index", "b"))
    return z.select(id_col, F.col("block_index").cast("bigint").alias("block_index"),
                    F.nullif(F.col("b.language"), F.lit("")).alias("language"),
                    F.regexp_replace("b.body", r"\n$", "").alias("code"))
