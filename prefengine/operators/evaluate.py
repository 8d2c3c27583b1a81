"""Evaluation over checkpoints and sweeps (V1-V5) as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sweep_grid(spark, axes: dict[str, list[str]], steps: int | None = None) -> DataFrame:
    """Cartesian grid of sweep axes (string values) and, optionally, steps 0..``steps``.

    The steps are a distributed range; the axes are literal lists (a sweep has a few values each)
    exploded on every row of it: no join, and no task makes more than its part of the grid."""
    df = spark.range((steps if steps is not None else 0) + 1).select(F.col("id").alias("step"))
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(str(v)) for v in values])))
    return df.select(*axes, "step") if steps is not None else df.select(*axes)


def run_key(template: str, *cols: str) -> Column:
    """Run key from a printf-style template over axis columns."""
    return F.format_string(template, *[F.col(c) for c in cols])


def sweep_coverage(results: DataFrame, grid: DataFrame, key: list[str]) -> DataFrame:
    """Every grid cell with its number of result rows and a status (V1): missing (0),
    ok (1) or duplicate (> 1).  Results are pre-aggregated per key before the join."""
    counts = results.groupBy(*key).agg(F.count(F.lit(1)).alias("n_results"))
    out = grid.join(counts, key, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("bigint"))
    return out.withColumn("status", F.when(F.col("n_results") == 0, "missing")
                          .when(F.col("n_results") == 1, "ok").otherwise("duplicate"))


def win_rate(candidate: DataFrame, baseline: DataFrame, on: list[str], by: list[str],
             score: str = "score", rollup: bool = True) -> DataFrame:
    """Wins / ties / losses of candidate scores against the baseline's on the same prompt
    (V2); win_rate = (wins + ties / 2) / n.  With ``rollup`` the run totals and the grand
    total are added (rows with NULL grouping keys)."""
    b = baseline.select(*on, F.col(score).alias("_base"))
    j = candidate.join(b, on)
    win = (F.col(score) > F.col("_base")).cast("bigint")
    tie = (F.col(score) == F.col("_base")).cast("bigint")
    g = j.rollup(*by) if rollup else j.groupBy(*by)
    out = g.agg(F.sum(win).alias("wins"), F.sum(tie).alias("ties"),
                F.sum(F.lit(1) - win - tie).alias("losses"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("win_rate", (F.col("wins") + F.col("ties") / 2.0) / F.col("n"))


def kl_by_checkpoint(df: DataFrame, step: str, policy: str, reference: str) -> DataFrame:
    """Mean sequence KL estimate to the reference per checkpoint (V3)."""
    return df.groupBy(step).agg(F.avg(F.col(policy) - F.col(reference)).alias("kl"),
                                F.count(F.lit(1)).alias("n"))


def length_bias(df: DataFrame, step: str, length: str, reward: str) -> DataFrame:
    """Length vs reward per checkpoint (V4): Pearson correlation, mean reward, mean length."""
    return df.groupBy(step).agg(F.corr(F.col(length).cast("double"), F.col(reward)).alias("corr_len_reward"),
                                F.avg(reward).alias("mean_reward"), F.avg(length).alias("mean_length"))


def best_checkpoint(df: DataFrame, run: str, step: str, metric: str) -> DataFrame:
    """Checkpoint with the best metric per run (V5), earliest step on ties.  The input is one
    row per (run, checkpoint), so the per-run window is small."""
    w = Window.partitionBy(run).orderBy(F.desc(metric), F.asc(step))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def overoptimisation_onset(df: DataFrame, run: str, step: str, kl: str, reward: str) -> DataFrame:
    """Where the gold reward of a run turns down while the KL to the reference still grows (V5).

    The checkpoints of a run are ordered by KL; the split into two least-squares lines with the least squared
    error comes from prefix sums (at least two checkpoints a side, the earliest on ties).  If the first line
    rises and the second falls, the last checkpoint of the first is the onset; else (monotone, flat, fewer than four)
    it is null.  The peak is the highest reward, at the smallest KL on ties.  One row per run; the input is one row
    per (run, checkpoint), so a run's window is small."""
    whole = Window.partitionBy(run)
    ordered = whole.orderBy(kl, step)
    # centred, so that the sums of squares lose no digits
    x, y = F.col(kl) - F.avg(kl).over(whole), F.col(reward) - F.avg(reward).over(whole)
    c = df.select(run, step, kl, reward, x.alias("_x"), y.alias("_y")).withColumns({"_xx": F.col("_x") * F.col("_x"), "_xy": F.col("_x") * F.col("_y"), "_yy": F.col("_y") * F.col("_y")})
    terms = ("_x", "_y", "_xx", "_xy", "_yy")
    c = c.withColumns({"_k": F.row_number().over(ordered), "_n": F.count(F.lit(1)).over(whole),
                       **{f"{t}_l": F.sum(t).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) for t in terms}, **{f"{t}_t": F.sum(t).over(whole) for t in terms}})

    def line(n: Column, s: dict[str, Column]) -> tuple[Column, Column]:
        xx, xy, yy = s["_xx"] - s["_x"] * s["_x"] / n, s["_xy"] - s["_x"] * s["_y"] / n, s["_yy"] - s["_y"] * s["_y"] / n
        wide = xx > 1e-12
        return F.round(F.when(wide, xy / xx).otherwise(0.0), 9), F.when(wide, yy - xy * xy / xx).otherwise(yy)

    before, error_l = line(F.col("_k"), {t: F.col(f"{t}_l") for t in terms})
    after, error_r = line(F.col("_n") - F.col("_k"), {t: F.col(f"{t}_t") - F.col(f"{t}_l") for t in terms})
    inside = (F.col("_k") >= 2) & (F.col("_k") <= F.col("_n") - 2)
    c = c.withColumns({"_b": F.when(inside, before), "_a": F.when(inside, after), "_e": F.when(inside, F.round(error_l + error_r, 9))})
    found = (F.col("_s._b") > 0) & (F.col("_s._a") < 0)
    split = F.min_by(F.struct(F.col(step).alias("step"), F.col(kl).alias("kl"), "_b", "_a"), F.struct(F.coalesce("_e", F.lit(float("inf"))), "_k"))
    peak = F.max_by(F.struct(F.col(step).alias("step"), F.col(kl).alias("kl"), F.col(reward).alias("reward")), F.struct(reward, -F.col("_k")))
    out = c.groupBy(run).agg(F.count(F.lit(1)).alias("checkpoints"), peak.alias("_p"), split.alias("_s"))
    return out.select(run, "checkpoints", F.col("_p.step").alias("peak_step"), F.col("_p.kl").alias("peak_kl"), F.col("_p.reward").alias("peak_reward"),
                      *[F.when(found, F.col(f"_s.{c}")).alias(name) for c, name in (("step", "onset_step"), ("kl", "onset_kl"), ("_b", "slope_before"), ("_a", "slope_after"))])
