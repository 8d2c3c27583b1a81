"""Sequence log-probabilities.

L1-L3 are column functions over logits arrays (functions.math.seq_logp).  L7 is an
n-gram language model fitted by Spark: all models of a query are one count table (one column
per model), scored n-grams and their contexts meet the counts in one join each, and the keys that a
natural text repeats most are joined apart.  Large texts meet the counts by chunks (``ngram_scores``)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.functions.arrays import IGNORE_INDEX, let
from prefengine.functions.math import seq_logp  # noqa: F401  (re-exported: L1-L3)
from prefengine.operators.joins import HOT_SHARE, _hot_from, held_rows, join_counts  # noqa: F401
from prefengine.operators.ngram_counts import CONTEXT, NGRAM, TOKEN, count_ngrams, count_parts
from prefengine.operators.ngram_scores import chunk_sums
from prefengine.operators.tokens import token_list
from prefengine.session import materialize, materialize_buckets, plan_bytes, spread

# Fixed value: the start-of-sequence context filler.
START = "<s>"

#: Bytes of scored text (as its files hold it) per bucket of counts up to which a task can hold its n-grams.
HELD_BYTES = 4 << 20
#: Bytes of scored text (as its files hold it) up to which its n-grams are joined as rows.
ROW_BYTES = 8 << 20
#: Parts of the n-grams of such a text that are shuffled one after the other: each is one more reading of the text.
TURNS = 2


def _grams(df: DataFrame, col: str, n: int, keep: list[str] | None = None) -> DataFrame:
    """One row per token position: (keep..., ctx, tok); ctx = previous n-1 tokens (START-padded).

    Built with arrays_zip over shifted slices (no per-element lambda)."""
    if n < 1:
        raise ValueError("n must be >= 1")
    keep = keep or []
    t = spread(df.select(*keep, col)).select(*keep, token_list(col).alias("_t"))
    if n == 1:
        return t.select(*keep, F.explode("_t").alias("tok")).withColumn("ctx", F.lit(""))
    padded = F.concat(F.array_repeat(F.lit(START), n - 1), F.col("_t"))
    shifted = [F.slice(padded, j + 1, F.size("_t")).alias(f"c{j}") for j in range(n - 1)]
    z = t.select(*keep, F.explode(F.arrays_zip(*shifted, F.col("_t").alias("tok"))).alias("_g"))
    ctx = F.col("_g.c0") if n == 2 else F.concat_ws(" ", *[F.col(f"_g.c{j}") for j in range(n - 1)])
    return z.select(*keep, ctx.alias("ctx"), F.col("_g.tok").alias("tok"))


@dataclass(frozen=True)
class NgramModels:
    """Counts of several models of one order, side by side."""

    names: tuple[str, ...]
    ngrams: DataFrame           # ctx, tok (their xxhash64), c_<name>..., c_all
    contexts: DataFrame         # ctx, c_<name>..., c_all
    vocab_sizes: dict[str, int]
    n: int
    k: float
    parts: int                  # buckets of the counts
    hashed: DataFrame           # contexts by the xxhash64 of ctx

    @property
    def vocab_size(self) -> int:
        return self.vocab_sizes[self.names[0]]


def fit_ngrams(parts: list[tuple[DataFrame, dict[str, Column]]], col: str, n: int = 2, k: float = 1.0) -> NgramModels:
    """Add-k smoothed n-gram counts of several models.

    ``parts`` are corpora, each with the models it belongs to and the condition on its rows
    (``F.lit(True)`` for all), so nested subsets of one corpus cost one pass.  The n-grams, contexts and tokens of
    all models are counted together (``count_ngrams``: partial counts map-side, one shuffle) and written bucketed by
    n-gram, so a join on it doesn't shuffle the counts again."""
    if k <= 0:
        raise ValueError("k must be positive: an n-gram that was not counted has no log-prob without it")
    if n < 1:
        raise ValueError("n must be >= 1")
    names = tuple(dict.fromkeys(name for _, models in parts for name in models))
    tagged = None
    for df, models in parts:
        bits = F.lit(0).cast("bigint")
        for i, name in enumerate(names):
            bits = bits + F.when(models.get(name, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        one = spread(df.select(F.col(col).alias("text"), bits.alias("models")))
        one = one.select(F.lower("text").alias("text"), "models")
        tagged = one if tagged is None else tagged.unionByName(one)
    size = count_parts([df.select(col) for df, _ in parts])
    table = materialize_buckets(count_ngrams(tagged, names, n, START, size), "ngrams", "kind", ["ctx", "tok"], size)
    columns = [f"c_{name}" for name in names]
    ngrams = table.filter(F.col("kind") == NGRAM).select("ctx", "tok", *columns, "c_all")
    contexts = table.filter(F.col("kind") == CONTEXT).select(F.col("word").alias("ctx"), *columns, "c_all")
    v = (table.filter(F.col("kind") == TOKEN)
         .agg(*[F.coalesce(F.sum((F.col(c) > 0).cast("bigint")), F.lit(0)).alias(c) for c in columns]).first())
    hashed = table.filter(F.col("kind") == CONTEXT).select("ctx", *columns, "c_all")
    return NgramModels(names, ngrams, contexts, {name: int(v[f"c_{name}"]) for name in names}, n, float(k), size, hashed)


def fit_ngram(df: DataFrame, col: str, n: int = 2, k: float = 1.0) -> NgramModels:
    """A single model (named "logp"); see ``fit_ngrams``."""
    return fit_ngrams([(df, {"logp": F.lit(True)})], col, n, k)


def ngram_logps(df: DataFrame, key: list[str], col: str, models: NgramModels,
                with_length: str | None = None) -> DataFrame:
    """Log-probs of every row of ``df`` under all models (L7): sum over tokens of
    ln((c(ctx, tok) + k) / (c(ctx) + k V)), one column per model.

    The logarithm of the ratio is a difference, so the n-grams and their contexts meet their own table
    each, whatever the number of models, and only their sums per key are brought together: no row is shuffled
    from one table to the next, and frequent n-grams and contexts are not shuffled at all (``join_counts``).  Of more than ROW_BYTES of
    text an n-gram is shuffled once a chunk instead of once a place (``ngram_scores``).
    Rows without tokens score 0."""
    size = plan_bytes(df)
    few = size is not None and size <= models.parts * HELD_BYTES
    above, below = (_by_chunks if size is not None and size > ROW_BYTES else _joined)(df, key, col, models, few)
    scored = above.unionByName(below.withColumns({"_m": F.lit(0).cast("bigint")} | {name: -F.col(name) for name in models.names}))
    agg = [F.sum(name).alias(name) for name in models.names]
    if with_length:
        agg.append(F.sum("_m").alias(with_length))
    base = df.select(*key).join(scored.groupBy(*key).agg(*agg), key, "left")
    base = base.withColumns({name: F.coalesce(F.col(name), F.lit(0.0)) for name in models.names})
    if with_length:
        base = base.withColumn(with_length, F.coalesce(F.col(with_length), F.lit(0)).cast("bigint"))
    return base


def _joined(df: DataFrame, key: list[str], col: str, models: NgramModels, few: bool) -> tuple[DataFrame, DataFrame]:
    """(key..., _m, ln(c + add) of each model) per n-gram (_m: one place), and the same of its context."""
    grams = _grams(df, col, models.n, keep=key)
    one = F.lit(1).cast("bigint").alias("_m")

    def terms(adds: list[float]) -> list[Column]:
        return [F.log(F.coalesce(F.col(f"c_{name}"), F.lit(0)) + F.lit(add)).alias(name) for name, add in zip(models.names, adds)]
    hashed = grams.select(*key, *[F.xxhash64(c).alias(c) for c in ("ctx", "tok")])
    above = join_counts(hashed, models.ngrams, ["ctx", "tok"], few).select(*key, one, *terms(_adds(models)[0]))
    below = join_counts(grams.select(*key, "ctx"), models.contexts, ["ctx"], few).select(*key, one, *terms(_adds(models)[1]))
    return above, below


def _by_chunks(df: DataFrame, key: list[str], col: str, models: NgramModels, few: bool) -> tuple[DataFrame, DataFrame]:
    """``_joined``, summed per row and turn.  Each turn is written before the next begins: its shuffle is gone by then."""
    sums = []
    for counts, on, adds, turns in zip((models.ngrams, models.hashed), (["ctx", "tok"], ["ctx"]), _adds(models), (TURNS, 1)):
        hot = counts.filter(F.col("c_all") >= _hot_from(counts, held_rows(df.sparkSession) // len(on)))
        made = [materialize(chunk_sums(df, key, col, counts, on, hot, models.names, adds, models.n, START, few, (i, turns)), "sums") for i in range(turns)]
        sums.append(reduce(DataFrame.unionByName, made))
    return sums[0], sums[1]


def _adds(models: NgramModels) -> tuple[list[float], list[float]]:
    """What is added to the counts of n-grams and of contexts, by model."""
    return [models.k] * len(models.names), [models.k * models.vocab_sizes[name] for name in models.names]


def ngram_logp(df: DataFrame, key: list[str], col: str, model: NgramModels, out: str = "logp",
               with_length: str | None = None) -> DataFrame:
    """Single-model form of ``ngram_logps``: returns ``key`` + ``out`` (+ token count)."""
    return ngram_logps(df, key, col, model, with_length).withColumnRenamed(model.names[0], out)


def packed_logp(tokens: DataFrame, by: list[str], doc: str, value: str, out: str = "logp") -> DataFrame:
    """Per-document sums of per-token log-probs of a packed sequence (L4): ``tokens`` holds
    one row per packed position with its document index."""
    return tokens.groupBy(*by, doc).agg(F.sum(value).alias(out))


def pivot_sides(df: DataFrame, key: list[str], side: str, value: str,
                sides=("chosen", "rejected"), suffix: str = "_logps") -> DataFrame:
    """Long (key, side, value) -> one column per side (L5), by conditional aggregation."""
    return df.groupBy(*key).agg(*[F.max(F.when(F.col(side) == s, F.col(value))).alias(f"{s}{suffix}")
                                  for s in sides])


def attach_logps(pairs: DataFrame, key: list[str], policy=None, ref=None, data=None) -> DataFrame:
    """Bring policy / reference / data log-probs onto the pairs.

    Each is a table with ``key`` + chosen_logps, rejected_logps, or the names of two columns that
    the pairs already carry (no join then).  Precomputed columns already on ``pairs`` win
    (coalesce); the data log-prob falls back to the reference's."""
    out = pairs
    for name, t in (("", policy), ("ref_", ref), ("data_", data)):
        if t is None:
            continue
        found = {"chosen": f"_{name}c", "rejected": f"_{name}r"}
        if isinstance(t, DataFrame):
            out = out.join(t.select(*key, *[F.col(f"{side}_logps").alias(c) for side, c in found.items()]), key, "left")
        else:
            out = out.withColumns({c: F.col(own) for c, own in zip(found.values(), t)})
        for side, tmp in found.items():
            tgt = f"{name}{side}_logps"
            out = out.withColumn(tgt, F.coalesce(F.col(tgt), F.col(tmp)) if tgt in pairs.columns else F.col(tmp))
        out = out.drop(*found.values())
    for side in ("chosen", "rejected"):
        d, r = f"data_{side}_logps", f"ref_{side}_logps"
        if r in out.columns:
            out = out.withColumn(d, F.coalesce(F.col(d), F.col(r)) if d in out.columns else F.col(r))
    return out


def chunked_logps(chunks: DataFrame, key: list[str], average: bool = False, temperature: float = 1.0, pos: str = "pos",
                  first: str = "first_id", values: str = "values", label: str = "label", out: str = "logp") -> DataFrame:
    """``seq_logp`` for vocabularies too wide for one cell (L1-L3): (key, out).

    A row is a piece of one position's logits: ``values`` of the ids from ``first`` on, with the target
    ``label`` of the position (IGNORE_INDEX: not scored).  Each row leaves its maximum, its scaled sum and the
    label's logit if it holds it; the logits themselves are never moved.  The few partials of a position
    meet, then the positions of a sequence are summed.

    A sequence without scored positions has 0, or null as a mean; -inf logits weigh nothing, a label of
    -inf gives -inf, positions that are all -inf or hold +inf or NaN give NaN as in ``seq_logp``; a label that no row
    holds raises."""
    t = float(temperature)
    scored = F.col(label) != F.lit(IGNORE_INDEX)
    v = F.transform(values, lambda x: x.cast("double") if t == 1.0 else x.cast("double") / F.lit(t))
    low = F.lit(float("-inf"))

    def partial(x: Column) -> Column:
        return let(F.array_max(x), lambda m: F.struct(m.alias("m"), F.when(m == low, F.lit(0.0)).otherwise(
            F.aggregate(x, F.lit(0.0), lambda s, e: s + F.exp(e - m))).alias("z"), F.get(x, F.col(label) - F.col(first)).alias("g")))

    rows = chunks.select(*key, pos, F.when(scored, let(v, partial)).alias("_p"), scored.alias("_scored"))
    places = rows.groupBy(*key, pos).agg(F.max("_scored").alias("_scored"), F.collect_list(F.struct("_p.m", "_p.z")).alias("_parts"), F.max("_p.g").alias("_g"))
    top = F.array_max(F.transform("_parts", lambda p: p["m"]))
    lse = let(top, lambda m: F.when(m == low, F.lit(float("nan"))).otherwise(m + F.log(F.aggregate(
        "_parts", F.lit(0.0), lambda s, p: s + F.when(p["m"] == low, F.lit(0.0)).otherwise(p["z"] * F.exp(p["m"] - m))))))
    lp = F.when(F.col("_g").isNull(), F.raise_error(F.lit("chunked_logps: a label lies outside the vocabulary")).cast("double")).otherwise(F.col("_g") - lse)
    per = places.select(*key, F.when(F.col("_scored"), lp).alias("_lp"))
    total, n = F.coalesce(F.sum("_lp"), F.lit(0.0)), F.count("_lp")
    return per.groupBy(*key).agg((F.try_divide(total, n.cast("double")) if average else total).alias(out))
