"""Pairwise objectives as DataFrame columns.

h = (pi_c - pi_r) - (rho_c - rho_r).  Every loss is a stable column expression (softplus
form), so h = +-1000 stays finite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.functions.math import softplus
from prefengine.session import require_columns

KINDS = ("dpo", "ipo", "is", "rpo", "length", "reward", "sft")


def logit_gap() -> Column:
    return ((F.col("chosen_logps") - F.col("rejected_logps"))
            - (F.col("ref_chosen_logps") - F.col("ref_rejected_logps")))


def objective(df: DataFrame, kind: str, beta: float = 0.1, eps: float = 0.25, eta: float = 0.005,
              alpha: float = 0.01, base: str = "ipo", logp: str = "logp") -> DataFrame:
    """Add h, weight and loss for one objective.

    dpo    softplus(-beta h)
    ipo    (h - 1/(2 beta))^2
    is     w * ipo (base="ipo", default) or w * dpo (base="sigmoid"), with
           w = exp(min(pi_c - d_c + pi_r - d_r, 2 eps)), d = data-model log-prob
    rpo    softplus(-beta h) - beta eta pi_c
    length softplus(-(beta h + alpha (len_c - len_r)))
    reward softplus(-(s_c - s_r))
    sft    -logp
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    b = F.lit(float(beta))
    one = F.lit(1.0)
    if kind == "reward":
        require_columns(df, "chosen_score", "rejected_score")
        h = F.col("chosen_score") - F.col("rejected_score")
        return df.withColumn("h", h).withColumn("weight", one).withColumn("loss", softplus(-F.col("h")))
    if kind == "sft":
        require_columns(df, logp)
        return df.withColumn("h", F.lit(None).cast("double")).withColumn("weight", one) \
                 .withColumn("loss", -F.col(logp))
    require_columns(df, "chosen_logps", "rejected_logps", "ref_chosen_logps", "ref_rejected_logps")
    out = df.withColumn("h", logit_gap())
    h = F.col("h")
    dpo = softplus(-b * h)
    ipo = F.pow(h - one / (F.lit(2.0) * b), F.lit(2.0))
    if kind == "dpo":
        return out.withColumn("weight", one).withColumn("loss", dpo)
    if kind == "ipo":
        return out.withColumn("weight", one).withColumn("loss", ipo)
    if kind == "rpo":
        return out.withColumn("weight", one).withColumn("loss", dpo - b * F.lit(float(eta)) * F.col("chosen_logps"))
    if kind == "length":
        require_columns(df, "chosen_length", "rejected_length")
        z = b * h + F.lit(float(alpha)) * (F.col("chosen_length") - F.col("rejected_length")).cast("double")
        return out.withColumn("weight", one).withColumn("loss", softplus(-z))
    # importance-weighted
    require_columns(df, "data_chosen_logps", "data_rejected_logps")
    ratio = (F.col("chosen_logps") - F.col("data_chosen_logps")
             + F.col("rejected_logps") - F.col("data_rejected_logps"))
    out = out.withColumn("weight", F.exp(F.least(ratio, F.lit(2.0 * eps))))
    if base not in ("ipo", "sigmoid"):
        raise ValueError("base must be 'ipo' or 'sigmoid'")
    return out.withColumn("loss", F.col("weight") * (ipo if base == "ipo" else dpo))
