"""Training-run tables: progress, per-epoch statistics, checkpoint retention,
best checkpoint, evaluation summaries, splits and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def progress_pct(epoch: Column, step: Column, n_epochs: Column, steps_per_epoch: Column) -> Column:
    """((epoch · S + step + 1) / (E · S)) · 100."""
    return (epoch * steps_per_epoch + step + 1) * 100.0 / (n_epochs * steps_per_epoch)


def training_progress(events: DataFrame) -> DataFrame:
    """Latest progress and metrics per session (last write wins), from a log of
    (session_id, epoch, step, n_epochs, steps_per_epoch, metrics, ts_s)."""
    # metrics join the order, so that rows of one instant resolve the same way everywhere
    order = F.struct("ts_s", "epoch", "step", "metrics")
    pct = progress_pct(F.col("epoch"), F.col("step"), F.col("n_epochs"), F.col("steps_per_epoch"))
    return (events.withColumn("progress", F.round(pct, 6))
                  .groupBy("session_id")
                  .agg(F.max_by("progress", order).alias("progress"),
                       F.max_by("metrics", order).alias("metrics"),
                       F.max("ts_s").alias("updated_s")))


def epoch_stats(steps: DataFrame, group: tuple[str, ...] = ("epoch",), metric: str = "eval_loss") -> DataFrame:
    """Per-epoch count / mean / min / max of a step metric."""
    x = F.col(metric)
    return steps.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_steps"), F.round(F.avg(x), 6).alias("mean_loss"),
        F.round(F.min(x), 6).alias("min_loss"), F.round(F.max(x), 6).alias("max_loss"))


def checkpoint_retention(checkpoints: DataFrame, keep: int = 5) -> DataFrame:
    """The newest ``keep`` checkpoints of every session (row_number ≤ keep is
    planned with a partial per-task limit before the shuffle)."""
    w = Window.partitionBy("session_id").orderBy(F.col("step").desc(), F.col("created_s").desc(),
                                                 F.col("eval_loss").asc())
    return (checkpoints.withColumn("rank", F.row_number().over(w).cast("bigint"))
                       .filter(F.col("rank") <= keep))


def best_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Checkpoint with the lowest eval loss per session (ties → lower step)."""
    key = F.struct("eval_loss", "step")
    return checkpoints.groupBy("session_id").agg(
        F.min_by("step", key).alias("best_step"), F.round(F.min("eval_loss"), 6).alias("best_eval_loss"))


def evaluate_summary(ranked: DataFrame, order: list, reward: str, n: int = 50) -> DataFrame:
    """Mean reward of the first ``n`` rows (0.0 when empty) and the sample count."""
    first = ranked.orderBy(*order).limit(n)
    return first.agg(F.coalesce(F.round(F.avg(reward), 6), F.lit(0.0)).alias("mean_reward"),
                     F.count(F.lit(1)).alias("n_samples"))


def split_bucket(key: Column, seed: int = 0) -> Column:
    """Stable 0..99 bucket of an integer key (multiplicative hash, no overflow)."""
    return ((F.pmod(key, F.lit(1000003)) * 2654435761 + seed) % 4294967296) % 100


def train_test_split(df: DataFrame, key: str, test_pct: int = 20, seed: int = 0) -> DataFrame:
    """Disjoint, reproducible split (the reference evaluates on rows it also
    trained on; here the test rows are excluded from training)."""
    return df.withColumn("is_test", split_bucket(F.col(key), seed) < test_pct)


def mse(df: DataFrame, prediction: str, label: str) -> DataFrame:
    d = F.col(prediction) - F.col(label)
    return df.agg(F.round(F.avg(d * d), 6).alias("mse"), F.count(F.lit(1)).alias("n"))
