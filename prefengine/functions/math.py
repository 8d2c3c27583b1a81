"""Numeric column functions: stable softplus / log-sigmoid and sequence log-probs from logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefengine.functions.arrays import IGNORE_INDEX, let


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softplus(z) -> Column:
    """ln(1 + e^z) without overflow: ln(1 + e^-|z|) + max(z, 0)."""
    x = _c(z)
    return F.log(F.lit(1.0) + F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def log_sum_exp(row) -> Column:
    """Stable log-sum-exp of an array<double> (the max is evaluated once per row)."""
    r = _c(row)
    return let(F.array_max(r), lambda m: m + F.log(
        F.aggregate(r, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))))


def _token_logps(logits, labels) -> Column:
    """Per-position log p(label_{i+1} | logits_i); 0 where the label is IGNORE_INDEX."""
    lg, lb = _c(logits), _c(labels)
    shifted = F.slice(lb, F.lit(2), F.greatest(F.size(lb) - F.lit(1), F.lit(0)))

    def one(lab, i):
        return F.when(lab == F.lit(IGNORE_INDEX), F.lit(0.0)).otherwise(
            let(F.element_at(lg, i + F.lit(1)),
                lambda r: F.element_at(r, lab + F.lit(1)) - log_sum_exp(r)))
    return F.transform(shifted, one)


def seq_logp(logits, labels, average: bool = False, temperature: float = 1.0) -> Column:
    """Sum (or mean per scored token) of label log-probs under ``logits`` (L1-L3).

    Mean divides by the scored-token count with try_divide: NULL when nothing is scored."""
    t = float(temperature)
    scaled = F.transform(_c(logits), lambda r: F.transform(
        r, lambda v: v.cast("double") if t == 1.0 else v.cast("double") / F.lit(t)))
    per = let(scaled, lambda lg: _token_logps(lg, labels))
    total = F.aggregate(per, F.lit(0.0), lambda acc, x: acc + x)
    if not average:
        return total
    lb = _c(labels)
    n = F.size(F.filter(lb, lambda x, i: (i > F.lit(0)) & (x != F.lit(IGNORE_INDEX))))
    return F.try_divide(total, n.cast("double"))


def fixed_point_mean(c, scale: int = 2) -> Column:
    """Mean of fixed-point values (e.g. two-decimal metrics) summed exactly as decimals.

    A double sum depends on the order partial sums meet, so the same rows can average to
    different last bits; a decimal sum does not, and the one division gives the same double
    everywhere."""
    x = F.col(c) if isinstance(c, str) else c
    return F.sum(x.cast(f"decimal(38,{scale})")).cast("double") / F.count(x).cast("double")
