"""Candidate expansion, pair generation, scoring and labelling.

Pair generation stays in-row (array programs, no shuffle); scoring is an equi-join to a
score table or a batch scorer (operators.udf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.session import require_columns


def flatten_candidates(df: DataFrame, col: str = "completion", idx: str = "cand_idx") -> DataFrame:
    """One row per (prompt, completion) (E1): posexplode, order kept in ``idx``."""
    require_columns(df, col)
    others = [c for c in df.columns if c != col]
    return df.select(*others, F.posexplode(col).alias(idx, col)).withColumn(idx, F.col(idx).cast("bigint"))


def first_k_pair_indexes(n: Column, k: int) -> Column:
    """The first ``k`` index pairs (i < j) of an n-element list in lexicographic order.

    Only i < k and j <= i + k can fall among the first k pairs, so at most k*k candidates
    are built per row whatever n is; then the first k are kept."""
    last_i = F.least(n - F.lit(2), F.lit(k - 1))
    rows = F.transform(F.sequence(F.lit(0), last_i), lambda i: F.transform(
        F.sequence(i + F.lit(1), F.least(n - F.lit(1), i + F.lit(k))),
        lambda j: F.struct(i.alias("i"), j.alias("j"))))
    pairs = F.slice(F.flatten(rows), 1, k)
    # sequence(0, -1) counts down: guard lists shorter than two
    return F.when(n >= F.lit(2), pairs).otherwise(F.array().cast("array<struct<i:int,j:int>>"))


def candidate_pairs(df: DataFrame, k: int, col: str = "completion",
                    first: str = "chosen", second: str = "rejected") -> DataFrame:
    """First K 2-combinations of each candidate list, lexicographic in (i, j).

    Fewer than K available -> all of them (Q1).  A NULL list yields no pairs."""
    require_columns(df, col)
    others = [c for c in df.columns if c != col]
    n = F.coalesce(F.size(col), F.lit(0))
    ex = df.select(*others, F.col(col), F.posexplode(first_k_pair_indexes(n, k)).alias("pair_idx", "_p"))
    return ex.select(
        *others, F.col("pair_idx").cast("bigint").alias("pair_idx"),
        F.col("_p.i").cast("bigint").alias("i"), F.col("_p.j").cast("bigint").alias("j"),
        F.get(F.col(col), F.col("_p.i")).alias(first), F.get(F.col(col), F.col("_p.j")).alias(second))


def score_pairs(pairs: DataFrame, scores: DataFrame, keys: list[str], first_key: list[str],
                second_key: list[str], score: str = "score",
                first_score: str = "chosen_score", second_score: str = "rejected_score") -> DataFrame:
    """Attach a score to both sides (R1): two equi-joins to the score table.

    ``keys`` name the score table's key; ``first_key``/``second_key`` the matching pair
    columns.  The planner (AQE) picks broadcast or shuffle from the measured size."""
    s1 = scores.select(*[F.col(k).alias(a) for k, a in zip(keys, first_key)], F.col(score).alias(first_score))
    s2 = scores.select(*[F.col(k).alias(a) for k, a in zip(keys, second_key)], F.col(score).alias(second_score))
    return pairs.join(s1, first_key, "left").join(s2, second_key, "left")


def implicit_reward(aligned_logp, base_logp, beta: float) -> Column:
    """beta * (log p_aligned - log p_base) (R2)."""
    a = F.col(aligned_logp) if isinstance(aligned_logp, str) else aligned_logp
    b = F.col(base_logp) if isinstance(base_logp, str) else base_logp
    return F.lit(beta) * (a - b)


def label_pairs(df: DataFrame, tie: str = "second", first: str = "chosen", second: str = "rejected",
                first_score: str = "chosen_score", second_score: str = "rejected_score",
                carry: dict[str, tuple[str, str]] | None = None, unscored: str = "drop") -> DataFrame:
    """Order each pair by score (R3 offline, R5 online).

    tie="second": strict >, a tie makes the second response chosen (offline labelling);
    tie="first": >=, the first wins (online).  Scores follow their texts (Q2).  A pair with a
    NULL or NaN score cannot be ordered: it is left out, or with unscored="raise" (what the queries
    use) it is an error.  ``carry`` maps an output name
    to a (first, second) column pair that follows the choice the same way (e.g. ids)."""
    if tie not in ("first", "second"):
        raise ValueError("tie must be 'first' or 'second'")
    a, b = F.col(first_score), F.col(second_score)
    ok = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    if unscored == "raise":
        bad = F.raise_error(F.lit("label_pairs: a pair has no score on one side")).cast("boolean")
        ok = F.when(ok, F.lit(True)).otherwise(bad)
    keep_first = (a >= b) if tie == "first" else (a > b)
    others = [c for c in df.columns if c not in (first, second, first_score, second_score)
              and not any(c in pair for pair in (carry or {}).values())]
    extra = [F.when(keep_first, F.col(x)).otherwise(F.col(y)).alias(f"chosen_{name}")
             for name, (x, y) in (carry or {}).items()]
    extra += [F.when(keep_first, F.col(y)).otherwise(F.col(x)).alias(f"rejected_{name}")
              for name, (x, y) in (carry or {}).items()]
    return df.filter(ok).select(
        *others,
        F.when(keep_first, F.col(first)).otherwise(F.col(second)).alias("chosen"),
        F.when(keep_first, F.col(second)).otherwise(F.col(first)).alias("rejected"),
        F.greatest(a, b).alias("chosen_score"), F.least(a, b).alias("rejected_score"), *extra)


def penalise_unterminated(score, terminated, value: float = -1.0) -> Column:
    """Overwrite the score of a generation without EOS."""
    s = F.col(score) if isinstance(score, str) else score
    t = F.col(terminated) if isinstance(terminated, str) else terminated
    return F.when(t, s).otherwise(F.lit(float(value)))


def agreement(df: DataFrame, first_score: str = "chosen_score", second_score: str = "rejected_score",
              by: list[str] | None = None) -> DataFrame:
    """Share of pairs where the first response outscored the second (R6), of the pairs with both scores."""
    hit = (F.col(first_score) > F.col(second_score)).cast("double")
    aggs = [F.avg(hit).alias("accuracy"), F.count(hit).alias("n_pairs")]
    return df.groupBy(*(by or [])).agg(*aggs)


def pair_samples(df: DataFrame, key: list[str], rank: str, value_cols: list[str]) -> DataFrame:
    """Two samples per prompt (rloo_k == 2) side by side (N2): conditional aggregation over
    rank 0 / rank 1, a partial (map-side) aggregation."""
    aggs = []
    for c in value_cols:
        aggs.append(F.max(F.when(F.col(rank) == 0, F.col(c))).alias(f"{c}_0"))
        aggs.append(F.max(F.when(F.col(rank) == 1, F.col(c))).alias(f"{c}_1"))
    return (df.filter(F.col(rank).isin(0, 1)).groupBy(*key).agg(*aggs, F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == 2).drop("_n"))
