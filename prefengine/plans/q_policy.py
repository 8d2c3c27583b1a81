"""Queries for the normalised policy: gradients of every objective (G2) and online training with a changing
policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.operators import fit as G
from prefengine.operators import online as N
from prefengine.operators import pairs as P
from prefengine.operators import policy as Y
from prefengine.plans.registry import register, sql_md5_bits, sql_r, sql_softplus, table
from prefengine.session import materialize, shared_dir
from prefengine.sources import driver_tables as D

DIM, K = 64, 4
BETA, EPS, ETA, ALPHA = 0.1, 0.25, 0.05, 0.01
THETA = [0.6 * ((i % 7) - 3) for i in range(DIM)]
REF = [0.3 * ((i % 5) - 2) for i in range(DIM)]
DATA = [0.4 * ((i % 3) - 1) for i in range(DIM)]

_LIST = lambda theta: "([" + ", ".join(repr(t) for t in theta) + "]::DOUBLE[])"
_CAND = f"""cand AS (SELECT vec_id // {D.SET_SIZE} AS prompt_id, vec_id % {D.SET_SIZE} AS cand_idx, embedding::DOUBLE[] AS phi, label::DOUBLE AS score,
         len(list_filter(embedding, lambda x: x > 0)) AS length, embedding[1] >= -0.2 AS has_eos FROM embeddings)"""


def policy_pairs(cands: DataFrame) -> DataFrame:
    """The first K pairs of every candidate set, ordered by score, with features and lengths of both sides."""
    sets = cands.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("cand_idx", "score", "length", "phi"))).alias("cands"))
    two = P.candidate_pairs(sets, K, col="cands", first="a", second="b")
    flat = two.select("prompt_id", "pair_idx", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("cand_idx", "score", "length", "phi")])
    return P.label_pairs(flat, tie="second", unscored="raise", first="cand_idx_a", second="cand_idx_b", first_score="score_a", second_score="score_b",
                         carry={"phi": ("phi_a", "phi_b"), "length": ("length_a", "length_b")})


# -- G2: one full-batch gradient of each objective for the normalised policy (fixed theta, reference and data policies)
_H = "((pc - pr) - (rc - rr))"
_G_DPO = f"(-{BETA} / (1.0 + exp({BETA} * {_H})))"
_G_IPO = f"(2.0 * ({_H} - 1.0 / (2.0 * {BETA})))"
_W = f"exp(least(pc - dc + pr - dr, {2 * EPS}))"
#: Per kind: the factors of phi_c, phi_r and the expected features.
_FACTORS = {
    "is": (f"{_W} * {_G_IPO}", f"-{_W} * {_G_IPO}", "0.0"),
    "is_sigmoid": (f"{_W} * {_G_DPO}", f"-{_W} * {_G_DPO}", "0.0"),
    "rpo": (f"{_G_DPO} - {BETA * ETA!r}", f"-{_G_DPO}", f"{BETA * ETA!r}"),
    "length": (f"-{BETA} / (1.0 + exp({BETA} * {_H} + {ALPHA} * (lc - lr)))", f"{BETA} / (1.0 + exp({BETA} * {_H} + {ALPHA} * (lc - lr)))", "0.0"),
    "reward": ("-1.0 / (1.0 + exp(pc - pr))", "1.0 / (1.0 + exp(pc - pr))", "0.0"),
    "sft": ("-1.0", "0.0", "1.0"),
}


def _gradient_sql(kind: str) -> str:
    c, r, m = _FACTORS[kind]
    return f"""
WITH {_CAND},
sc AS (SELECT *, list_inner_product(phi, {_LIST(THETA)}) AS sp, list_inner_product(phi, {_LIST(REF)}) AS sr, list_inner_product(phi, {_LIST(DATA)}) AS sd FROM cand),
z AS (SELECT prompt_id, ln(sum(exp(sp))) AS zp, ln(sum(exp(sr))) AS zr, ln(sum(exp(sd))) AS zd FROM sc GROUP BY prompt_id),
lp AS (SELECT sc.*, sp - zp AS p, sr - zr AS r, sd - zd AS d FROM sc JOIN z USING (prompt_id)),
mean AS (SELECT prompt_id, i, sum(exp(p) * phi[i]) AS mu FROM lp, range(1, {DIM + 1}) t(i) GROUP BY ALL),
two AS (SELECT a.prompt_id, a.score > b.score AS first, a, b, row_number() OVER (PARTITION BY a.prompt_id ORDER BY a.cand_idx, b.cand_idx) AS k
        FROM lp a JOIN lp b ON a.prompt_id = b.prompt_id AND a.cand_idx < b.cand_idx),
lab AS (SELECT prompt_id, CASE WHEN first THEN a ELSE b END AS c, CASE WHEN first THEN b ELSE a END AS r FROM two WHERE k <= {K}),
pr AS (SELECT prompt_id, c.phi AS fc, r.phi AS fr, c.p AS pc, r.p AS pr, c.r AS rc, r.r AS rr, c.d AS dc, r.d AS dr, c.length AS lc, r.length AS lr FROM lab),
f AS (SELECT prompt_id, fc, fr, {c} AS a_c, {r} AS a_r, {m} AS a_m FROM pr)
SELECT (m.i - 1)::INT AS dim, {sql_r('avg(a_c * fc[m.i] + a_r * fr[m.i] + a_m * m.mu)', 8)} AS grad
FROM f JOIN mean m USING (prompt_id) GROUP BY m.i
"""


def _gradient_query(name: str):
    kind, base = ("is", "sigmoid") if name == "is_sigmoid" else (name, "ipo")

    def q(spark, sf):
        cands = materialize(D.policy_candidates(table(spark, sf, "embeddings")), "candidates")
        key = ["prompt_id"]
        pairs = Y.pair_logps(policy_pairs(cands), cands, key, THETA, mean=kind in G.NEEDS_MEAN)
        pairs = Y.pair_logps(pairs, cands, key, REF, prefix="ref_")
        if kind == "is":
            pairs = Y.pair_logps(pairs, cands, key, DATA, prefix="data_")
        data = {"data_chosen": "data_chosen_logps", "data_rejected": "data_rejected_logps"} if kind == "is" else {}
        grad = G.preference_gradient(pairs, THETA, kind, BETA, eps=EPS, eta=ETA, alpha=ALPHA, base=base, ref_chosen="ref_chosen_logps",
                                     ref_rejected="ref_rejected_logps", logps=("chosen_logps", "rejected_logps"), **data)
        return grad.select("dim", (F.round("grad", 8) + 0.0).alias("grad"))
    return q


for _kind in ("is", "is_sigmoid", "rpo", "length", "reward", "sft"):  # gradient_pass has dpo and ipo
    register(f"gradient_pass_{_kind}", _gradient_sql(_kind))(_gradient_query(_kind))


# -- N2 R4 R5 L6 J1/J2 G2 M1 M2 M4 M8 M9: one epoch of online training in three updates of two batches.  Each update samples
#    two candidates per prompt from the policy that the last one left
UPDATES, ACCUMULATION, SEED, TEMPERATURE, LR = 3, 2, 42, 0.9, 2.0
ONLINE_BETA = {"dpo": 0.05, "ipo": 0.03}


def _online_sql(kind: str) -> str:
    beta = ONLINE_BETA[kind]
    loss = sql_softplus(f"(-{beta} * h)") if kind == "dpo" else f"((h - 1.0 / (2.0 * {beta})) * (h - 1.0 / (2.0 * {beta})))"
    g = f"(-{beta} / (1.0 + exp({beta} * h)))" if kind == "dpo" else f"(2.0 * (h - 1.0 / (2.0 * {beta})))"
    ctes = [_CAND, f"""
pos AS (SELECT prompt_id, row_number() OVER (ORDER BY md5('{SEED}:0:' || prompt_id::VARCHAR), prompt_id) - 1 AS pos FROM (SELECT DISTINCT prompt_id FROM cand)),
size AS (SELECT count(*) AS n, greatest(1, (count(*) + {UPDATES * ACCUMULATION - 1}) // {UPDATES * ACCUMULATION}) AS b FROM pos),
dealt AS (SELECT prompt_id, pos // (b * {ACCUMULATION}) AS upd, (pos // b) % {ACCUMULATION} AS batch FROM pos, size),
ref AS (SELECT prompt_id, ln(sum(exp(list_inner_product(phi, {_LIST(REF)})))) AS zr FROM cand GROUP BY prompt_id),
base AS (SELECT c.*, d.upd, d.batch, list_inner_product(phi, {_LIST(REF)}) - zr AS rho FROM cand c JOIN dealt d USING (prompt_id) JOIN ref USING (prompt_id)),
th0 AS (SELECT {_LIST(REF)} AS th)"""]
    for u in range(UPDATES):
        noise = lambda k: f"(s / {TEMPERATURE} - ln(-ln(({sql_md5_bits(f'{chr(39)}{SEED}:{u}:{k}:{chr(39)} || prompt_id::VARCHAR || {chr(39)}:{chr(39)} || cand_idx::VARCHAR')} + 0.5) / 4294967296.0)))"
        ctes.append(f"""
s{u} AS (SELECT b.*, list_inner_product(phi, th) AS s FROM base b, th{u} WHERE upd = {u}),
z{u} AS (SELECT prompt_id, ln(sum(exp(s))) AS z FROM s{u} GROUP BY prompt_id),
n{u} AS (SELECT s{u}.*, s - z AS pi, CASE WHEN has_eos THEN score ELSE -1.0 END AS sc, {noise(0)} AS n0, {noise(1)} AS n1 FROM s{u} JOIN z{u} USING (prompt_id)),
a{u} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY n0 DESC, cand_idx) AS k FROM n{u}) WHERE k = 1),
b{u} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY n1 DESC, cand_idx) AS k FROM n{u}) WHERE k = 1),
p{u} AS (SELECT a.batch, CASE WHEN a.sc >= b.sc THEN a ELSE b END AS c, CASE WHEN a.sc >= b.sc THEN b ELSE a END AS r FROM a{u} a JOIN b{u} b USING (prompt_id)),
h{u} AS (SELECT *, (c.pi - r.pi) - (c.rho - r.rho) AS h FROM p{u}),
l{u} AS (SELECT {LR} * greatest(0.0, 0.5 * (1.0 + cos(pi() * {u} / greatest(1, n // (b * {ACCUMULATION})))) * 0.9 + 0.1) AS lr FROM size),
g{u} AS (SELECT i, avg(g) AS g FROM (SELECT batch, i, avg({g} * (c.phi[i] - r.phi[i])) AS g FROM h{u}, range(1, {DIM + 1}) t(i) GROUP BY batch, i) GROUP BY i),
th{u + 1} AS (SELECT list(th{u}.th[i] - lr * g ORDER BY i) AS th FROM g{u}, th{u}, l{u}),
m{u} AS (SELECT {u}::BIGINT AS update, count(*) AS examples, {sql_r('max(lr)')} AS lr, {sql_r(f'avg({loss})')} AS loss, {sql_r(f'avg({beta} * h)')} AS margins,
         {sql_r('avg(((c.pi - c.rho) + (r.pi - r.rho)) / 2.0)')} AS kl, {sql_r(f'avg(({beta} * (c.pi - c.rho) > {beta} * (r.pi - r.rho))::INT)')} AS accuracy,
         {sql_r('avg(c.sc - r.sc)')} AS score_margin, {sql_r('max((SELECT th[1] FROM th' + str(u + 1) + '))')} AS theta_first,
         {sql_r('max((SELECT list_sum(list_transform(th, lambda x: abs(x))) FROM th' + str(u + 1) + '))')} AS theta_size FROM h{u}, l{u})""")
    return "WITH " + ",".join(ctes) + "\n" + "\nUNION ALL ".join(f"SELECT * FROM m{u} WHERE examples > 0" for u in range(UPDATES))


def _online_query(kind: str):
    def q(spark, sf):
        cands = D.policy_candidates(table(spark, sf, "embeddings"))
        batch = max(1, -(-cands.select("prompt_id").distinct().count() // (UPDATES * ACCUMULATION)))
        run = N.Training(batch, ACCUMULATION, kind=kind, beta=ONLINE_BETA[kind], lr=LR, temperature=TEMPERATURE, seed=SEED)
        log = N.train_online(cands, "prompt_id", "cand_idx", REF, run, shared_dir(spark, "online"))
        size = F.aggregate("theta", F.lit(0.0), lambda s, x: s + F.abs(x))
        r = lambda c: (F.round(c, 6) + 0.0)
        return log.select("update", "examples", *[r(c).alias(c) for c in ("lr", "loss", "margins", "kl", "accuracy", "score_margin")],
                          r(F.get("theta", F.lit(0))).alias("theta_first"), r(size).alias("theta_size"))
    return q


register("online_training", _online_sql("dpo"))(_online_query("dpo"))
register("online_training_ipo", _online_sql("ipo"))(_online_query("ipo"))
