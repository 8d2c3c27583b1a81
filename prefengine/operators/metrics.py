"""Training/evaluation metrics as aggregations (M1-M9).

The reference's cross-process gather before averaging is Spark's partial + final avg."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.functions.math import fixed_point_mean
from prefengine.functions.time import utc_instant
from prefengine.operators.order import assign_batches, running_sum


def pair_metrics(df: DataFrame, beta: float) -> DataFrame:
    """beta-scaled chosen / rejected rewards, margin and accuracy per pair (M1), score margin
    (M3) when scores are present, KL per side (M2)."""
    b = F.lit(float(beta))
    out = (df.withColumn("chosen_rewards", b * (F.col("chosen_logps") - F.col("ref_chosen_logps")))
             .withColumn("rejected_rewards", b * (F.col("rejected_logps") - F.col("ref_rejected_logps")))
             .withColumn("margins", F.col("chosen_rewards") - F.col("rejected_rewards"))
             .withColumn("accuracy", (F.col("chosen_rewards") > F.col("rejected_rewards")).cast("double"))
             .withColumn("kl", ((F.col("chosen_logps") - F.col("ref_chosen_logps"))
                                + (F.col("rejected_logps") - F.col("ref_rejected_logps"))) / F.lit(2.0)))
    if "chosen_score" in df.columns and "rejected_score" in df.columns:
        out = out.withColumn("score_margin", F.col("chosen_score") - F.col("rejected_score"))
    return out


def kl_estimate(df: DataFrame, by: list[str] | None = None, **more: Column) -> DataFrame:
    """Mean sequence KL estimate over both sides (M2), with further aggregates of the same groups."""
    kl = ((F.col("chosen_logps") - F.col("ref_chosen_logps"))
          + (F.col("rejected_logps") - F.col("ref_rejected_logps"))) / F.lit(2.0)
    return df.groupBy(*(by or [])).agg(F.avg(kl).alias("kl"), F.count(F.lit(1)).alias("n"),
                                        *[c.alias(name) for name, c in more.items()])


def interval_means(df: DataFrame, metrics: list[str], batch_size: int, accumulation: int, order_by,
                   by: list[str] | None = None, scale: int | None = None) -> DataFrame:
    """Mean of every metric per logging interval of batch_size * accumulation examples (M4).

    The interval comes from the skew-safe index (per ``by`` group); the last interval may
    be partial.  With ``scale`` the metrics are fixed-point and summed exactly."""
    per = batch_size * accumulation
    idx = assign_batches(df, per, order_by, name="interval", partition_by=by)
    mean = (lambda m: fixed_point_mean(m, scale)) if scale is not None else F.avg
    return (idx.groupBy(*(by or []), "interval")
            .agg(*[mean(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("examples"),
                 F.max("idx").alias("last_idx")))


def throughput(df: DataFrame, ts: str, group: list[str]) -> DataFrame:
    """Examples per second per group (M5): count / (max ts - min ts); NULL on zero span."""
    t = utc_instant(ts) if dict(df.dtypes)[ts] == "timestamp_ntz" else F.col(ts)
    span = (F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))).cast("double") / F.lit(1e6)
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("examples"), span.alias("seconds")) \
             .withColumn("examples_per_second", F.try_divide(F.col("examples").cast("double"), F.col("seconds")))


def running_accuracy(df: DataFrame, hit: str, order_by, by: list[str] | None = None) -> DataFrame:
    """Running mean of ``hit`` (0/1) as rows arrive in ``order_by`` order (M7)."""
    out = df.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_hit", F.col(hit).cast("double"))
    out = running_sum(out, ["_hit", "_one"], order_by, partition_by=by)
    return (out.withColumn("running_accuracy", F.col("_hit_cum") / F.col("_one_cum"))
               .withColumn("seen", F.col("_one_cum").cast("bigint"))
               .drop("_one", "_hit", "_hit_cum", "_one_cum"))


def cosine_lr(step: Column, lr: float, warmup: int, total: int, min_ratio: float = 0.1) -> Column:
    """Linear warm-up, then a half cosine down to min_ratio * lr (M8)."""
    s = step.cast("double")
    warm = s / F.lit(float(max(1, warmup)))
    progress = (s - F.lit(float(warmup))) / F.lit(float(max(1, total - warmup)))
    factor = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress))
    factor = factor * F.lit(1.0 - min_ratio) + F.lit(min_ratio)
    return F.lit(float(lr)) * F.when(s < F.lit(float(warmup)), warm).otherwise(F.greatest(F.lit(0.0), factor))


def with_lr(batches: DataFrame, n_rows: int, batch_size: int, accumulation: int, epochs: int, lr: float,
            warmup: int, batch_col: str = "batch_id", min_ratio: float = 0.1) -> DataFrame:
    """Learning rate of every batch (M8): the scheduler steps once per accumulation, so batch
    b trains at step floor(b / accumulation); total steps = n // (batch * accum) * epochs."""
    total = (n_rows // (batch_size * accumulation)) * epochs
    step = F.floor(F.col(batch_col) / F.lit(accumulation))
    return batches.withColumn("step", step.cast("bigint")).withColumn(
        "lr", cosine_lr(F.col("step"), lr, warmup, total, min_ratio))


def checkpoint_steps(batches: DataFrame, batch_size: int, eval_every: int,
                     batch_col: str = "batch_id") -> DataFrame:
    """Batches before which a checkpoint is written (M9): the example counter (batch *
    batch_size, tested before the batch is consumed) is a positive multiple of eval_every."""
    counter = F.col(batch_col) * F.lit(batch_size)
    return (batches.withColumn("example_counter", counter.cast("bigint"))
            .filter((F.col("example_counter") % F.lit(eval_every) == 0) & (F.col("example_counter") > 0)))
