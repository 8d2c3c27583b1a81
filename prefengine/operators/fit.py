"""Model fitting at scale (G1, G2): the reference's training loops re-aimed as Spark jobs.

G2 is one full-batch gradient of a pairwise objective for a log-linear policy
(log pi(y) = theta . phi(y) - log Z); the mean over all pairs is a vector summary (partial
aggregation, one vector per task).  Only the theta vector (dimension-sized) reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.functions.arrays import let
from prefengine.operators.objectives import KINDS
from prefengine.operators.policy import dot, pair_logps
from prefengine.session import materialize, require_columns

#: Objectives whose gradient needs the expected features of the prompt's candidate set.
NEEDS_MEAN = ("rpo", "sft")


def pair_gradient(df: DataFrame, theta: list[float], kind: str = "dpo", beta: float = 0.1, eps: float = 0.25,
                  eta: float = 0.005, alpha: float = 0.01, base: str = "ipo", chosen: str = "chosen_phi",
                  rejected: str = "rejected_phi", ref_chosen: str | None = None, ref_rejected: str | None = None,
                  data_chosen: str | None = None, data_rejected: str | None = None, mean: str = "mean_phi",
                  chosen_length: str = "chosen_length", rejected_length: str = "rejected_length",
                  logps: tuple[str, str] | None = None) -> Column:
    """Gradient of one pair's loss (``objectives.objective``) in theta, an array<double>.

    d log pi(y) / d theta = phi(y) - mean, with ``mean`` the expected features of the prompt's
    candidates; it cancels in h = (pi_c - pi_r) - (rho_c - rho_r), so only rpo and sft read it:

    dpo     g (phi_c - phi_r) with g = -beta sigmoid(-beta h)
    ipo     g = 2 (h - 1/(2 beta))
    is      w times ipo's (base="ipo") or dpo's g (base="sigmoid"),
            w = exp(min(pi_c - d_c + pi_r - d_r, 2 eps)) held constant
    length  g = -beta sigmoid(-(beta h + alpha (len_c - len_r)))
    reward  g = -sigmoid(-h), h = theta . (phi_c - phi_r)
    rpo     dpo's, and -beta eta (phi_c - mean)
    sft     -(phi_c - mean)

    ``logps`` names the policy's log-probs of both sides if the pairs carry them; without, theta . phi
    stands for them, which differs by log Z: h does not see that, the weight of ``is`` does."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if base not in ("ipo", "sigmoid"):
        raise ValueError("base must be 'ipo' or 'sigmoid'")
    pc, pr = (F.col(logps[0]), F.col(logps[1])) if logps else (dot(F.col(chosen), theta), dot(F.col(rejected), theta))
    ref = (F.col(ref_chosen) - F.col(ref_rejected)) if ref_chosen and kind != "reward" else F.lit(0.0)
    h, b, one = (pc - pr) - ref, F.lit(float(beta)), F.lit(1.0)
    dpo, ipo = -b / (one + F.exp(b * h)), F.lit(2.0) * (h - one / (F.lit(2.0) * b))
    if kind == "is":
        dc = F.col(data_chosen) if data_chosen else F.lit(0.0)
        dr = F.col(data_rejected) if data_rejected else F.lit(0.0)
        g = (ipo if base == "ipo" else dpo) * F.exp(F.least(pc - dc + pr - dr, F.lit(2.0 * eps)))
    elif kind == "length":
        require_columns(df, chosen_length, rejected_length)
        longer = (F.col(chosen_length) - F.col(rejected_length)).cast("double")
        g = -b / (one + F.exp(b * h + F.lit(float(alpha)) * longer))
    else:
        g = {"dpo": dpo, "rpo": dpo, "ipo": ipo, "reward": -one / (one + F.exp(h)), "sft": F.lit(0.0)}[kind]
    c, r = F.col(chosen), F.col(rejected)
    # coefficients are bound once per pair, not re-evaluated per dimension
    if kind not in NEEDS_MEAN:
        return let(g, lambda v: F.zip_with(c, r, lambda x, y: (x.cast("double") - y.cast("double")) * v))
    require_columns(df, mean)
    pull = F.lit(float(beta) * float(eta)) if kind == "rpo" else one
    toward = F.zip_with(c, F.col(mean), lambda x, m: (m - x.cast("double")) * pull)
    if kind == "sft":
        return toward
    return let(g, lambda v: F.zip_with(toward, F.zip_with(c, r, lambda x, y: (x.cast("double") - y.cast("double")) * v), lambda t, d: t + d))


def preference_gradient(df: DataFrame, theta: list[float], kind: str = "dpo", beta: float = 0.1, **options) -> DataFrame:
    """Mean gradient d loss / d theta over all pairs, one row per dimension (dim, grad); ``options`` as
    in ``pair_gradient``."""
    per_dim = pair_gradient(df, theta, kind, beta, **options)
    total = df.groupBy(F.lit("all")).agg(Summarizer.mean(array_to_vector(per_dim)).alias("m"))  # no pairs, no rows
    return total.select(F.posexplode(vector_to_array("m")).alias("dim", "grad"))


def fit_preference(df: DataFrame, dim: int, steps: int = 10, lr: float = 0.1, kind: str = "dpo",
                   beta: float = 0.1, cands: DataFrame | None = None, key: list[str] | None = None, **kw) -> list[float]:
    """A fixed number of full-batch gradient steps; theta travels as a literal array.

    With ``cands`` (the candidate sets, ``key`` their prompt's columns) the policy is normalised over
    them in every step; rpo and sft need that, and so does the weight of ``is`` to be the real ratio."""
    theta = [0.0] * dim
    pairs = materialize(df, "pairs")
    sets = materialize(cands.select(*key, "phi"), "candidates") if cands is not None else None
    for _ in range(steps):
        rows = pairs
        if sets is not None:
            rows, kw["logps"] = pair_logps(pairs, sets, key, theta, mean=kind in NEEDS_MEAN), ("chosen_logps", "rejected_logps")
        g = {r["dim"]: r["grad"] for r in preference_gradient(rows, theta, kind, beta, **kw).collect()}
        theta = [t - lr * g.get(i, 0.0) for i, t in enumerate(theta)]
    return theta


def fit_reward(df: DataFrame, chosen: str = "chosen_phi", rejected: str = "rejected_phi", reg: float = 0.0,
               max_iter: int = 50, tol: float = 1e-6):
    """Pairwise (Bradley-Terry) reward fit (G1): logistic regression without intercept on
    mirrored feature differences (phi_c - phi_r -> 1, phi_r - phi_c -> 0)."""
    d = F.zip_with(F.col(chosen), F.col(rejected), lambda a, b: a.cast("double") - b.cast("double"))
    pos = df.select(array_to_vector(d).alias("features"), F.lit(1.0).alias("label"))
    neg = df.select(array_to_vector(F.transform(d, lambda x: -x)).alias("features"), F.lit(0.0).alias("label"))
    lr = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=max_iter, tol=tol, standardization=False)
    return lr.fit(pos.unionByName(neg))


def fit_reward_newton(df: DataFrame, dim: int, reg: float = 0.01, steps: int = 8, chosen: str = "chosen_phi",
                      rejected: str = "rejected_phi") -> list[float]:
    """The same fit by a fixed number of Newton steps from zero (G1): deterministic weights.

    Minimises the mean of -log sigmoid(w . (phi_c - phi_r)) + reg / 2 |w|^2.  A step is one aggregate: the mean
    over pairs of the gradient and of the upper triangle of the Hessian's outer products, summed map-side into one vector
    per task; the driver solves a system of ``dim`` equations."""
    d = F.zip_with(F.col(chosen), F.col(rejected), lambda a, b: a.cast("double") - b.cast("double"))
    pairs = materialize(df.select(d.alias("_d")), "differences")
    upper, w = np.triu_indices(dim), np.zeros(dim)
    for _ in range(steps):
        miss = let(dot(F.col("_d"), w.tolist()), lambda h: F.lit(1.0) / (F.lit(1.0) + F.exp(h)))
        rows = pairs.select("_d", miss.alias("_q"))
        outer = F.flatten(F.transform("_d", lambda x, i: let(x * F.col("_q") * (F.lit(1.0) - F.col("_q")), lambda v: F.transform(
            F.slice("_d", i + 1, F.lit(dim)), lambda y: y * v))))
        both = F.concat(F.transform("_d", lambda x: -x * F.col("_q")), outer)
        mean = rows.groupBy(F.lit("all")).agg(Summarizer.mean(array_to_vector(both)).alias("m")).first()
        if mean is None:  # no pairs
            break
        values = mean["m"].toArray()
        hessian = np.zeros((dim, dim))
        hessian[upper] = values[dim:]
        hessian = hessian + np.triu(hessian, 1).T + reg * np.eye(dim)
        w = w - np.linalg.solve(hessian, values[:dim] + reg * w)
    return w.tolist()
