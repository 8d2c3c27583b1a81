"""Quality classifier: supervised subword embeddings.

Features of a text are its words, its pairs of neighbouring words and their shapes, and the 3- to 5-grams of the
UTF-8 characters' bytes of each word (with word boundaries), hashed into one table.  Every hash bucket has a learned vector,
a document is the average of its features' vectors, and a softmax layer gives the class
probabilities.  Vectors and layer are trained together by stochastic gradient descent in numpy over
a bounded sample of labelled rows; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.llm.common import fresh

DIM, BITS = 8, 18
BUCKETS = 1 << BITS
HELD_OUT_FOLD = 2
#: Characters of a text that are hashed at once, and the powers (and their inverses modulo 2^64) for their bytes.
PIECE = 1 << 16
BASE = 0x100000001B3
POWERS, INVERSES = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(4 * PIECE + 64, x, np.uint64), dtype=np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of BASE and of its inverse; more than the kept ones only for a word of megabytes."""
    if n <= len(POWERS):
        return POWERS[:n], INVERSES[:n]
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64), dtype=np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64)))


def spread_bits(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, repeats included, in pieces of a bounded size.

    All hashes are rolled over the bytes of the text at once: the n-grams of a word are the byte
    n-grams that hold a space at most at their ends; a word's hash is the sum of its bytes times
    powers that start anew with the word.  Neighbours give the hash of the pair and its shape: both lengths and
    whether first and last bytes agree.  A piece starts with the last word of the one before, whose own
    features are not counted again, so where pieces end makes no difference."""
    words = text.split() if text else []
    lo = 0
    while lo < len(words):
        size, hi, again = 0, lo, int(lo > 0)
        while hi < len(words) and size < PIECE:
            size, hi = size + len(words[hi]) + 1, hi + 1
        data = np.frombuffer(f" {' '.join(words[lo - again:hi])} ".encode("utf-8", "replace"), np.uint8)
        lo = hi
        space, b = data == 32, data.astype(np.uint64)
        edges = np.flatnonzero(space)
        kept = data[edges[again]:] if again else data
        own, full = kept == 32, kept.astype(np.uint64)
        grams = full[:-2] | full[1:-1] << np.uint64(8) | full[2:] << np.uint64(16)
        inner = ~own[1:-1]
        yield spread_bits(grams[inner])
        for n in (4, 5):
            if len(full) < n:
                break
            grams = grams[:-1] | full[n - 1:] << np.uint64(8 * (n - 1))
            inner = inner[:-1] & ~own[n - 2:-1]
            yield spread_bits(grams[inner])
        up, down = powers(len(b))
        hashes = np.add.reduceat(b * up, edges[:-1] + 1) * down[edges[:-1] + 1]
        yield spread_bits(hashes[again:] ^ hashes[again:] >> np.uint64(29))
        pairs = (hashes[:-1] ^ hashes[:-1] >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[1:]
        yield spread_bits(pairs ^ pairs >> np.uint64(29))
        lengths, first, last = np.minimum(np.diff(edges) - 1, 31).astype(np.uint64), data[edges[:-1] + 1], data[edges[1:] - 1]
        shapes = lengths[:-1] | lengths[1:] << np.uint64(5) | (first[:-1] == first[1:]).astype(np.uint64) << np.uint64(10) | (last[:-1] == last[1:]).astype(np.uint64) << np.uint64(11)
        yield spread_bits((shapes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text, ord) -> (label, ord, buckets, counts): the bag of hashed features of a text."""
    for batch in batches:
        bags = [np.unique(np.concatenate([np.zeros(0, np.int64), *buckets(t)]), return_counts=True) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("ord"), pa.array([x for x, _ in bags], pa.list_(pa.int32())),
                                          pa.array([n for _, n in bags], pa.list_(pa.float32()))], ["label", "ord", "buckets", "counts"])


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, layer and bias by SGD, one document at a time.  The step of each bucket's vector and
    of the layer falls with the squared gradients it has had, so rare features learn as well."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    if not bags:  # nothing learned: every answer is 0.5
        return vectors, np.zeros_like(layer), bias
    past, layer_past = np.full(BUCKETS, 1e-8, np.float32), 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            label, found, counts = bags[i]
            share = counts / counts.sum() if len(counts) else counts
            hidden = share @ vectors[found]
            logits = hidden @ layer + bias
            odds = np.exp(logits - logits.max())
            wrong = odds / odds.sum()
            wrong[label] -= 1
            back = layer @ wrong
            layer_past += float(wrong @ wrong)
            step = rate / layer_past ** 0.5
            layer -= step * np.outer(hidden, wrong)
            bias -= step * wrong
            past[found] += share * share * float(back @ back)
            vectors[found] -= (rate * share / np.sqrt(past[found]))[:, None] * back
    return vectors, layer, bias


def train(sample: DataFrame, epochs: int = 5, rate: float = 0.3, seed: int = 0, keep_vectors: bool = False) -> dict:
    """A model from ``sample`` (text, label 0/1, ord), which the caller has bounded.

    Features are counted where the rows are; the bags then meet in one task, which trains.  Layer and
    average are linear, so it takes each bucket's vector through the layer and returns what scoring
    needs: per bucket the difference of the two logits (weights), and the bias.  ``keep_vectors`` adds
    the vectors and the layer themselves.  Without rows the model answers 0.5."""
    bags = sample.select("label", "ord", "text").mapInArrow(count_features, "label int, ord long, buckets array<int>, counts array<float>")
    columns = ["weights", "bias", *["vectors", "layer"] * keep_vectors]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() if c in ("label", "ord") else [x.values.to_numpy() for x in b.column(c)]
                                                  for c in ("ord", "label", "buckets", "counts")))]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        vectors, layer, bias = fit([r[1:] for r in rows], epochs, rate, seed)
        made = {"weights": vectors @ (layer[:, 1] - layer[:, 0]), "bias": bias[1:] - bias[:1], "vectors": vectors, "layer": layer}
        yield pa.RecordBatch.from_pydict({c: [made[c].astype(np.float32).tobytes()] for c in columns})

    found = bags.repartition(1).mapInArrow(run, ", ".join(f"{c} binary" for c in columns)).collect()
    if not found:  # a plan without any partition
        return {"weights": np.zeros(BUCKETS, np.float32), "bias": np.zeros(1, np.float32)}
    model = {c: np.frombuffer(found[0][c], np.float32) for c in columns}
    return model | {c: model[c].reshape(-1, n) for c, n in (("vectors", DIM), ("layer", 2)) if c in model}


def score(docs: DataFrame, model: dict, text_col: str, out: str) -> DataFrame:
    """``docs`` with ``out``: the softmax probability of class 1 for the whole text, which with two
    classes is the logistic function of the difference of their logits."""
    bias = float(model["bias"][0])
    shared = docs.sparkSession.sparkContext.broadcast(model["weights"])

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value.astype(np.float64)
        for texts in parts:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                total, size = 0.0, 0
                for found in buckets(text):
                    total, size = total + w[found].sum(), size + len(found)
                logit = total / max(1, size) + bias
                out[i] = 1 / (1 + np.exp(-logit)) if logit >= 0 else np.exp(logit) / (1 + np.exp(logit))
            yield pd.Series(out)

    return docs.withColumn(out, probability(F.col(text_col)))


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the text 'null'."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % 4).cast("int")


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label, ord): at most ``rows`` labelled texts outside the held-out fold.

    Labels without an id or a value are left out; if an id has several labels the smallest holds.
    The bound works on the narrow label table (smallest hashes of the id first), so only the chosen
    texts travel; repeated documents of a chosen id are cut to one text."""
    mark = F.xxhash64(F.lit("sample"), F.col("__id"))
    known = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
             .filter(F.col("__id").isNotNull() & F.col("label").isin(0, 1)).groupBy("__id").agg(F.min("label").alias("label"))
             .filter(fold("__id") != HELD_OUT_FOLD).withColumn("ord", mark))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    present = texts.select("__id").distinct()
    chosen = known.join(present, "__id", "left_semi").orderBy("ord", "__id").limit(rows)
    found = texts.join(F.broadcast(chosen), "__id")  # bounded: at most ``rows`` narrow rows
    return found.groupBy("__id", "label", "ord").agg(F.min("text").alias("text")).select("text", "label", "ord")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             train_rows: int = 4000, epochs: int = 5, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (probability of label 1), predicted (1 if score >= threshold) and held_out.

    Learns from at most ``train_rows`` labelled rows whose crc32(id) mod 4 is not 2; ids, labels and
    other columns are never inputs of a score.  Columns of ``docs`` that clash with the three new ones
    are replaced.  Defined cases: null, empty and blank texts have no features and get the score of
    the bias alone; equal texts get equal scores; no labels at all give 0.5; an empty table stays
    empty; very long texts are scored whole."""
    model = train(training_sample(docs, labels, label_col, train_rows, id_col, text_col), epochs)
    name = fresh(docs, "__score")
    scored = score(docs, model, text_col, name)
    return (scored.drop("score", "predicted", "held_out")
            .withColumn("held_out", fold(id_col) == HELD_OUT_FOLD).withColumnRenamed(name, "score")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``; columns stay as they are.  ``options`` are those of
    ``classify``.

    Ties and repeated rows go or stay together, since equal texts have equal scores; null, empty and blank texts have the
    score of the bias; texts of any length are scored whole; a table without rows gives none."""
    id_col, label_col, rows = options.pop("id_col", "doc_id"), options.pop("label_col", "quality"), options.pop("train_rows", 4000)
    model = train(training_sample(docs, labels, label_col, rows, id_col, text_col), **options)
    name = fresh(docs, "__score")
    return score(docs, model, text_col, name).filter(F.col(name) >= threshold).drop(name)
