"""Vocabulary fit, encode/decode, example building, padding, packing.

Tokenisation is a Spark job: whitespace split of the lower-cased text, a frequency-ranked
vocabulary fitted by groupBy, and encoding in the row by its frequent tokens, with an equi-join
for the rare ones only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefengine.functions import arrays as A
from prefengine.functions.text import truncation_mode
from prefengine.operators.joins import lookup_lists
from prefengine.operators.order import TOPN_ROWS, global_index
from prefengine.operators.udf import encode_with
from prefengine.session import materialize, require_columns, spread

# Special token ids and names (the vocabulary's first four entries).
PAD, BOS, EOS, UNK = 0, 1, 2, 3
SPECIALS = ["<pad>", "<bos>", "<eos>", "<unk>"]


def token_list(c) -> Column:
    """Lower-cased whitespace tokens, blanks removed."""
    x = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != F.lit(""))


@dataclass(frozen=True)
class Vocab:
    table: DataFrame          # token string, id int, cnt bigint
    size: int                 # rows in table (specials included)
    pad: int = PAD
    bos: int = BOS
    eos: int = EOS
    unk: int = UNK


def fit_vocab(df: DataFrame, col: str, max_size: int | None = None, id_offset: int = len(SPECIALS)) -> Vocab:
    """Frequency-ranked vocabulary (T0): ids after the specials by (count desc, token asc).

    Counting is a partial aggregation; ids come from the distributed global index.  With
    ``max_size`` only the most frequent tokens stay (a bounded top-k up to TOPN_ROWS)."""
    spark = df.sparkSession
    counts = (spread(df.select(col)).select(F.explode(token_list(col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))
    if max_size is not None and max_size <= TOPN_ROWS:
        counts = counts.orderBy(F.desc("cnt"), F.asc("token")).limit(max_size)
    ranked = (global_index(counts.withColumn("_neg", -F.col("cnt")), ["_neg", "token"], name="_r")
              .select("token", "cnt", (F.col("_r") + id_offset).cast("int").alias("id")))
    if max_size is not None:
        ranked = ranked.filter(F.col("id") < max_size + id_offset)
    specials = spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id int, cnt bigint")
    table = specials.unionByName(ranked.select("token", "id", "cnt"))
    kept = materialize(table, "vocabulary")
    return Vocab(kept, kept.count())


def encode_columns(df: DataFrame, key: list[str], cols: dict[str, str], vocab: Vocab) -> DataFrame:
    """Text columns -> token-id columns (T1), ``cols`` mapping input -> output name; unknown
    tokens map to UNK.

    The frequent tokens are found in the row, without a shuffle; only the rare ones of a vocabulary larger than
    a broadcast are exploded, meet it by a join and are gathered per ``key``, for all columns at once
    (``joins.lookup_lists``).  ``key`` is unique."""
    require_columns(df, *key, *cols)
    words = {c: f"_w_{c}" for c in cols}
    tokens = df.withColumns({w: token_list(c) for c, w in words.items()})
    return lookup_lists(tokens, key, {words[c]: out for c, out in cols.items()}, vocab.table, "token", "id", "cnt",
                        "id", vocab.unk).drop(*words.values())


def encode(df: DataFrame, key: list[str], col: str, vocab: Vocab | None = None, out: str | None = None,
           tokenizer: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Text -> token ids for one column (T1): with a fitted vocabulary (``encode_columns``), or with a
    ``tokenizer`` (U3), a function from a batch of texts to lists of ids."""
    if (vocab is None) == (tokenizer is None):
        raise ValueError("encode takes a vocabulary or a tokenizer")
    out = out or f"{col}_ids"
    return encode_with(df, tokenizer, col, out) if tokenizer else encode_columns(df, key, {col: out}, vocab)


def decode(df: DataFrame, key: list[str], ids: str, vocab: Vocab, out: str | None = None,
           skip_special: bool = True) -> DataFrame:
    """Token ids -> text joined by single spaces (T1); specials skipped."""
    out = out or f"{ids}_text"
    kept = df.withColumn("_ids", F.filter(ids, lambda x: x >= len(SPECIALS)) if skip_special else F.col(ids))
    text = lookup_lists(kept, key, {"_ids": "_t"}, vocab.table, "id", "token", "cnt", "id", SPECIALS[UNK])
    return text.withColumn(out, F.array_join("_t", " ")).drop("_ids", "_t")


def build_example(df: DataFrame, prompt_ids: str, completion_ids: str, prefix: str = "target",
                  max_length: int = 640, max_prompt_length: int = 512, mode=None,
                  bos: int = BOS, eos: int = EOS, prompt_text: str | None = None) -> DataFrame:
    """One side of a training example (T2-T5):
    clip specials, truncate (prompt first, per-row mode), append EOS, combine and mask.

    Output: prompt_input_ids, {prefix}_input_ids, {prefix}_combined_input_ids,
    {prefix}_combined_attention_mask, {prefix}_labels."""
    if mode is None:
        mode = truncation_mode(prompt_text) if prompt_text else F.lit("keep_start")
    p = A.clip_prompt(prompt_ids, eos)
    c = A.clip_completion(completion_ids, bos, eos)
    out = df.withColumn("_p", p).withColumn("_c", c)
    out = out.withColumn("_p2", A.truncate_prompt("_p", "_c", max_length, max_prompt_length, mode))
    out = out.withColumn("_c2", A.truncate_completion("_p2", "_c", max_length))
    out = (out.withColumn("prompt_input_ids", F.col("_p2"))
           .withColumn(f"{prefix}_input_ids", A.append_token("_c2", eos))
           .withColumn(f"{prefix}_combined_input_ids", A.combined_ids("prompt_input_ids", f"{prefix}_input_ids"))
           .withColumn(f"{prefix}_combined_attention_mask", A.ones_like(f"{prefix}_combined_input_ids"))
           .withColumn(f"{prefix}_labels", A.prompt_masked_labels("prompt_input_ids", f"{prefix}_input_ids")))
    return out.drop("_p", "_c", "_p2", "_c2")


def pad_batch(df: DataFrame, by: str, left: dict[str, int], right: dict[str, int]) -> DataFrame:
    """Pad every array to its batch maximum (T6): ``left`` columns (prompts) at the front,
    ``right`` columns at the back, each with its pad value.  A batch is bounded by the batch
    size, so the per-batch max is a small window."""
    out = df
    for cols, fn in ((left, A.pad_left), (right, A.pad_right)):
        for c, v in cols.items():
            m = F.max(F.size(c)).over(Window.partitionBy(by))
            out = out.withColumn(c, fn(c, m, v))
    return out


def pack_batch(df: DataFrame, by: str, order: str, ids: str, labels: str, max_length: int) -> DataFrame:
    """Pack a batch into one row (T8): each document cut to ``max_length``; ids and labels
    concatenated; mask = 1-based document index; positions restart per document."""
    g = (df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(
        F.col(order).alias("o"), F.slice(ids, 1, max_length).alias("ids"),
        F.slice(labels, 1, max_length).alias("lab")))).alias("_d")))
    return g.select(
        by,
        F.flatten(F.transform("_d", lambda d: d["ids"])).alias("input_ids"),
        F.flatten(F.transform("_d", lambda d: d["lab"])).alias("labels"),
        F.flatten(F.transform("_d", lambda d, i: F.array_repeat((i + 1).cast("int"), F.size(d["ids"])))).alias(
            "attention_mask"),
        F.flatten(F.transform("_d", lambda d: F.transform(d["ids"], lambda x, j: j.cast("int")))).alias(
            "position_ids"),
        F.transform("_d", lambda d: F.size(d["ids"])).alias("seq_len"))


def pack_pairs(df: DataFrame, by: str, order: str, max_length: int) -> DataFrame:
    """Pack a preference batch (T9): all chosen documents, then all rejected; the rejected
    document index is offset by the batch size; each mask is sized from its own side (Q5)."""
    parts = ["chosen", "rejected"]
    g = df.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col(order).alias("o"),
            *[F.slice(f"{s}_combined_input_ids", 1, max_length).alias(f"{s}_ids") for s in parts],
            *[F.slice(f"{s}_labels", 1, max_length).alias(f"{s}_lab") for s in parts]))).alias("_d"))
    n = F.size("_d")

    def side(s, offset):
        return (F.flatten(F.transform("_d", lambda d: d[f"{s}_ids"])),
                F.flatten(F.transform("_d", lambda d: d[f"{s}_lab"])),
                F.flatten(F.transform("_d", lambda d, i: F.array_repeat(
                    (i + 1 + offset).cast("int"), F.size(d[f"{s}_ids"])))),
                F.flatten(F.transform("_d", lambda d: F.transform(d[f"{s}_ids"], lambda x, j: j.cast("int")))),
                F.transform("_d", lambda d: F.size(d[f"{s}_ids"])))
    c, r = side("chosen", F.lit(0)), side("rejected", n)
    names = ["input_ids", "labels", "attention_mask", "position_ids", "seq_len"]
    return g.select(by, *[F.concat(a, b).alias(f"concatenated_{nm}") for a, b, nm in zip(c, r, names)])


def stack_sides(df: DataFrame, by: str, order: str, pad: int = PAD) -> DataFrame:
    """Chosen rows over rejected rows, padded to one common length per batch."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"),
                               F.col(f"{s}_combined_input_ids").alias("ids"),
                               F.col(f"{s}_labels").alias("labels"),
                               F.col(f"{s}_combined_attention_mask").alias("mask")) for s in ("chosen", "rejected")])
    ex = df.select(by, order, F.explode(sides).alias("_s")).select(by, order, "_s.*")
    return pad_batch(ex.withColumn("_len", F.size("ids")), by, {}, {"ids": pad, "labels": A.IGNORE_INDEX, "mask": 0}) \
        .drop("_len")


def side_lengths(df: DataFrame, sides=("chosen", "rejected")) -> DataFrame:
    """Scored-token count per side."""
    out = df
    for s in sides:
        out = out.withColumn(f"{s}_length", A.target_length(f"{s}_labels"))
    return out
