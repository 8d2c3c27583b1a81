"""A normalised log-linear policy over candidate sets: log pi(y | x) = theta . phi(y) - log Z(x), with Z(x)
the sum of exp(theta . phi) over the candidates of prompt x.

Sets may be of any size, so a set is never gathered: its softmax is one mergeable aggregate (partial
sums leave each map task), and samples are drawn by the Gumbel-max rule, a maximum per set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.functions.arrays import let
from prefengine.functions.text import md5_bits

#: Scores are summed as exp(score - BIN * bin) with bin = floor(score / BIN): no set's maximum has to be
#: known first, nothing overflows, and parts that are bins apart are rescaled when they meet.
BIN = 256.0


def dot(a, theta: Sequence[float]) -> Column:
    """theta . a of an array column."""
    lit = F.array(*[F.lit(float(t)) for t in theta])
    return F.aggregate(F.zip_with(a, lit, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def set_softmax(cands: DataFrame, key: list[str], theta: Sequence[float], phi: str = "phi", mean: bool = False) -> DataFrame:
    """(key, log_z[, mean_phi]) per candidate set: the log of the sum of exp(theta . phi) and, with
    ``mean``, the expectation of phi under the policy.

    Two aggregations, both with map-side sums: per (set, bin of scores), then the few bins of a set."""
    scored = cands.select(*key, F.col(phi).alias("_phi"), dot(F.col(phi), theta).alias("_s"))
    scored = scored.withColumn("_bin", F.floor(F.col("_s") / BIN))
    scored = scored.withColumn("_w", F.exp(F.col("_s") - F.col("_bin") * BIN))
    parts = [F.sum("_w").alias("z")]
    if mean:
        vector = array_to_vector(F.transform("_phi", lambda x: x.cast("double")))
        parts.append(Summarizer.mean(vector, F.col("_w")).alias("m"))
    bins = scored.groupBy(*key, "_bin").agg(*parts)
    if mean:
        bins = bins.withColumn("m", vector_to_array("m"))
    rows = bins.groupBy(*key).agg(F.max("_bin").alias("_top"), F.collect_list(F.struct("_bin", *[p for p in ("z", "m") if p == "z" or mean])).alias("_bins"))
    # weights relative to the highest bin; one three bins lower is below the last digit
    weighed = F.transform("_bins", lambda b: F.struct((b["z"] * F.exp((b["_bin"] - F.col("_top")) * BIN)).alias("z"), *([b["m"].alias("m")] if mean else [])))
    rows = rows.withColumn("_bins", weighed).withColumn("_z", F.aggregate("_bins", F.lit(0.0), lambda s, b: s + b["z"]))
    out = [*key, (F.col("_top") * BIN + F.log("_z")).alias("log_z")]
    if mean:
        zero = F.transform(F.get(F.col("_bins"), F.lit(0))["m"], lambda x: x * 0.0)
        out.append(F.aggregate("_bins", zero, lambda s, b: F.zip_with(s, b["m"], lambda x, y: x + y * (b["z"] / F.col("_z")))).alias("mean_phi"))
    return rows.select(*out)


def candidate_logps(cands: DataFrame, key: list[str], theta: Sequence[float], phi: str = "phi", out: str = "logp") -> DataFrame:
    """Every candidate with its log-probability in its set."""
    return (cands.join(set_softmax(cands, key, theta, phi).withColumnRenamed("log_z", "_log_z"), key)
            .withColumn(out, dot(F.col(phi), theta) - F.col("_log_z")).drop("_log_z"))


def pair_logps(pairs: DataFrame, cands: DataFrame, key: list[str], theta: Sequence[float], phi: str = "phi",
               chosen: str = "chosen_phi", rejected: str = "rejected_phi", prefix: str = "", mean: bool = False) -> DataFrame:
    """Pairs with <prefix>chosen_logps and <prefix>rejected_logps under the policy over the sets of ``cands`` and, with
    ``mean``, the set's expected features (mean_phi)."""
    out = pairs.join(set_softmax(cands, key, theta, phi, mean).withColumnRenamed("log_z", "_log_z"), key)
    sides = {f"{prefix}{side}_logps": dot(F.col(c), theta) - F.col("_log_z") for side, c in (("chosen", chosen), ("rejected", rejected))}
    return out.withColumns(sides).drop("_log_z")


def gumbel(seed: int, round_: int, sample: int, *cols: str) -> Column:
    """Gumbel noise from the md5 of (seed, round, sample, key): the same in every run and in SQL."""
    text = F.concat_ws(":", F.lit(f"{seed}:{round_}:{sample}"), *[F.col(c).cast("string") for c in cols])
    u = (md5_bits(text).cast("double") + 0.5) / float(1 << 32)
    return -F.log(-F.log(u))


def sample_sets(cands: DataFrame, key: list[str], cand: str, theta: Sequence[float], carry: list[str], n: int = 2,
                temperature: float = 0.9, seed: int = 0, round_: int = 0, phi: str = "phi") -> DataFrame:
    """``n`` independent samples of every set from the policy at a temperature (N2 with a policy): (key, and for
    each sample k the candidate and the ``carry`` columns with suffix _k).

    The largest of theta . phi / temperature + Gumbel noise is a draw from the softmax; ties go to the
    smaller candidate.  One aggregation with map-side maxima for all samples."""
    s = let(dot(F.col(phi), theta), lambda v: F.array(*[v / float(temperature) + gumbel(seed, round_, k, *key, cand) for k in range(n)]))
    values = F.struct(cand, *carry)
    noisy = cands.select(*key, values.alias("_v"), s.alias("_s"), (-F.col(cand)).alias("_o"))
    best = noisy.groupBy(*key).agg(*[F.max_by("_v", F.struct(F.get("_s", F.lit(k)), F.col("_o"))).alias(f"_{k}") for k in range(n)])
    return best.select(*key, *[F.col(f"_{k}.{c}").alias(f"{c}_{k}") for k in range(n) for c in [cand, *carry]])
