"""Toxicity: cumulative-link ordinal regression over sparse text features.

A document's severity is one of ordered grades.  One weight vector, shared by all thresholds, gives
a score s; the chance to be above grade k is logistic(s - threshold_k), with ordered thresholds.
The reported severity is the expected grade.  Features are the hashed words of a text and their
first four and five letters, so inflected and compounded forms of a telling stem are known as well.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.llm.common import fresh
from prefengine.llm.quality import training_sample

BUCKETS, GRADES = 1 << 18, 4
#: Words that a task remembers before it starts over.
REMEMBERED = 1 << 18
WORD = re.compile(r"\w+")
MODEL = "weights binary, thresholds binary"


def features(word: str) -> list[int]:
    """Buckets of a lower-case word: itself, its first four and its first five letters."""
    data = [word.encode("utf-8", "surrogatepass")] + [f"^{word[:n]}".encode("utf-8", "surrogatepass") for n in (4, 5) if len(word) > n]
    return [zlib.crc32(d) % BUCKETS for d in data]


def bag(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def weight(count: int, words: int) -> float:
    """Of a word that stands ``count`` times among ``words``: a part for standing there at all, so a few
    words count in a long text, and a part for its share."""
    return 0.25 + math.log1p(100 * count / words)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, ord, text) -> (label, ord, words, counts)."""
    for batch in batches:
        bags = [bag(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "ord": batch.column("ord"), "words": [list(b) for b in bags], "counts": [list(b.values()) for b in bags]})


def grades(labels: np.ndarray, bags: list[Counter]) -> np.ndarray:
    """Severity of each training text: 0 for clean ones; for toxic ones 1 to 3 by thirds of the share
    of their words that are telling (four times likelier, smoothed, in toxic than in clean texts)."""
    seen = [Counter(), Counter()]
    for label, words in zip(labels, bags):
        seen[label].update(words.keys())
    n = np.bincount(labels, minlength=2) + 1.0
    telling = {w for w, c in seen[1].items() if c > 1 and (c / n[1]) > 4 * (seen[0][w] + 0.5) / n[0]}
    share = np.array([sum(c for w, c in b.items() if w in telling) / max(1, sum(b.values())) for b in bags])
    bad = labels == 1
    cuts = np.quantile(share[bad], [1 / 3, 2 / 3]) if bad.any() else np.zeros(2)
    return np.where(bad, 1 + np.searchsorted(cuts, share, side="left"), 0)


def telling_odds(grade: np.ndarray, rows: list[np.ndarray], least: float = 6.0) -> np.ndarray:
    """Log odds of each bucket between graded and clean texts where a likelihood-ratio test tells them
    apart, else 0: the rest would only add noise to long texts.  The signed root is at least ``least``,
    or the test a quarter of what a word of all graded texts and no clean one reaches if that is less
    (few labelled texts); with one side only there is nothing to tell."""
    seen = [np.bincount(np.concatenate([r for g, r in zip(grade > 0, rows) if g == side] or [np.zeros(0, np.int64)]), minlength=BUCKETS).astype(float) for side in (False, True)]
    n = np.bincount((grade > 0).astype(int), minlength=2) + 1.0
    both = (seen[0] + seen[1]) / n.sum()
    odds = np.log((seen[1] + 0.5) / n[1]) - np.log((seen[0] + 0.5) / n[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        test = sum(2 * np.nan_to_num(k * np.log(k / (n[i] * both)), nan=0.0, posinf=0.0, neginf=0.0)
                   + 2 * np.nan_to_num((n[i] - k) * np.log((n[i] - k) / (n[i] * (1 - both))), nan=0.0, posinf=0.0, neginf=0.0) for i, k in enumerate(seen))
    share = np.bincount((grade > 0).astype(int), minlength=2) / max(1, len(grade))
    most = -2 * len(grade) * sum(p * math.log(p) for p in share if p)
    return np.where(test >= min(least * least, most / 4), odds, 0.0) if share.all() else np.zeros(BUCKETS)


def fit(grade: np.ndarray, bags: list[Counter], epochs: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by stochastic gradient on the likelihood of the grades, with step sizes
    per weight (falling with the gradients it has had).  Weights start at their log odds, so a
    telling word counts even where others already decide its training texts."""
    rows, cache = [], {}
    for b in bags:
        x, size = Counter(), sum(b.values())
        for w, c in b.items():
            for f in cache.get(w) or cache.setdefault(w, features(w)):
                x[f] += weight(c, size)
        rows.append((np.fromiter(x.keys(), np.int64, len(x)), np.fromiter(x.values(), np.float64, len(x))))
    start = telling_odds(grade, [r[0] for r in rows])
    rows = [(i[start[i] != 0], v[start[i] != 0]) for i, v in rows]
    w, past = start.copy(), np.full(BUCKETS, 1.0)
    scores = np.array([w[i] @ v for i, v in rows]) if rows else np.zeros(0)
    middle = [float(np.median(scores[grade == k])) if (grade == k).any() else 10.0 * k for k in range(GRADES)]
    limits = np.maximum.accumulate((np.array(middle[:-1]) + middle[1:]) / 2 + np.arange(GRADES - 1) * 1e-3)
    limits_past = np.ones(GRADES - 1)
    rng = np.random.default_rng(seed)
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            y, s = grade[i], float(w[at] @ x)
            upper = logistic(limits[y] - s) if y < GRADES - 1 else 1.0
            lower = logistic(limits[y - 1] - s) if y > 0 else 0.0
            slope = 1 - upper - lower  # of -log(upper - lower) in s
            g = slope * x + decay * (w[at] - start[at])
            past[at] += g * g
            w[at] -= rate * g / np.sqrt(past[at])
            chance = max(upper - lower, 1e-6)
            move = np.zeros(GRADES - 1)
            if y < GRADES - 1:
                move[y] -= upper * (1 - upper) / chance
            if y > 0:
                move[y - 1] += lower * (1 - lower) / chance
            move = np.clip(move, -1, 1)
            limits_past += move * move
            limits = limits - 20 * rate * move / np.sqrt(limits_past)
            limits = np.maximum.accumulate(limits + np.arange(GRADES - 1) * 1e-3)
    return w, limits


def train(sample: DataFrame, epochs: int = 6, rate: float = 0.1, decay: float = 1e-2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from the bounded ``sample`` (text, label, ord): words are counted where
    the rows are, the counts meet in one task that trains.  Without rows all severities are alike."""
    counted = sample.select("label", "ord", "text").mapInArrow(count_words, "label int, ord long, words array<string>, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, same = [], {}  # each word is kept once, however many texts hold it
        for batch in batches:
            for k in range(batch.num_rows):
                order, label, words, counts = (batch.column(c)[k].as_py() for c in ("ord", "label", "words", "counts"))
                rows.append((order, label, Counter({same.setdefault(w, w): n for w, n in sorted(zip(words, counts))})))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        labels, bags = np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]
        made = fit(grades(labels, bags), bags, epochs, rate, decay, seed) if rows else (np.zeros(BUCKETS), np.arange(1.0, GRADES))
        yield pa.RecordBatch.from_pydict({k: [v.tobytes()] for k, v in zip(("weights", "thresholds"), made)})

    found = counted.repartition(1).mapInArrow(run, MODEL).collect()
    if not found:
        return np.zeros(BUCKETS), np.arange(1.0, GRADES)
    return np.frombuffer(found[0]["weights"]), np.frombuffer(found[0]["thresholds"])


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             train_rows: int = 12_000, threshold: float = 0.5) -> DataFrame:
    """``docs`` with severity (expected grade, 0 to 3), grade (likeliest) and is_toxic (the chance to
    be above grade 0 is at least ``threshold``).

    Learns from at most ``train_rows`` labelled rows whose crc32(id) mod 4 is not 2; whole texts are
    scored.  Defined cases: null, empty and wordless texts score 0 and get the severity of the
    thresholds alone; equal texts get equal results; without labels the untrained thresholds hold;
    an empty table stays empty; columns of ``docs`` that clash with the three new ones are replaced."""
    w, limits = train(training_sample(docs, labels, label_col, train_rows, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast((w, limits))

    @F.pandas_udf("struct<severity: double, grade: int, is_toxic: boolean>")
    def graded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, limits = shared.value
        known: dict[str, float] = {}
        for texts in parts:
            scores = np.zeros(len(texts))
            for i, text in enumerate(texts):
                total, words = 0.0, bag(text)
                size = sum(words.values())
                for word, n in words.items():
                    v = known.get(word)
                    if v is None:
                        v = known[word] = float(sum(w[f] for f in features(word)))
                    if v:
                        total += v * weight(n, size)
                scores[i] = total
                if len(known) > REMEMBERED:
                    known = {}
            above = 1 / (1 + np.exp(np.clip(limits - scores[:, None], -500, 500)))
            each = -np.diff(np.concatenate([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))], axis=1), axis=1)
            yield pd.DataFrame({"severity": above.sum(1), "grade": each.argmax(1).astype("int32") if len(scores) else np.zeros(0, "int32"), "is_toxic": above[:, 0] >= threshold})

    name = fresh(docs, "__toxic")
    out = docs.withColumn(name, graded(F.col(text_col))).drop("severity", "grade", "is_toxic")
    return out.select(*[c for c in out.columns if c != name], f"{name}.*")
