"""Repeated substrings across a corpus, by suffix arrays of content-dealt shards.

Every string of ``length`` bytes has a key: the smallest hash of the 32-byte grams in it.  Equal
strings have equal keys wherever they stand, so all places that could repeat meet under one key.  The
starts of a text that share a key form a stretch; a stretch with its ``length - 1`` bytes behind is a
context.  Keys that occur once hold no repeats (unless the context has the key's gram twice); if
all contexts of a key are equal, all its starts repeat; only keys with different contexts go on, each
different context once.  Their contexts are dealt into shards by key, whose suffix arrays (induced sorting) and permuted common prefixes tell
the repeated starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.llm.common import fresh, shared_table
from prefengine.llm.sais import repeated

GRAM = 32
#: Starts of a stretch, bytes hashed at once, bytes of a shard.
STRETCH, PIECE, SHARD = 256, 1 << 20, 1 << 20
#: A key with more places than this is not sorted in one task: its starts are compared one by one.
HOT = 4096
ODD = np.uint64(0x9E3779B97F4A7C15)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sliding(x: np.ndarray, window: int, pick=np.minimum) -> np.ndarray:
    span = 1
    while span * 2 <= window:
        x, span = pick(x[:-span], x[span:]), span * 2
    return pick(x[:span - window], x[window - span:]) if span < window else x


def stretches(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, number of starts, key, whether its context holds the key's gram twice) of the
    stretches of a text, piece by piece.  Only with the gram twice can a stretch repeat within itself."""
    whole = np.frombuffer(data, np.uint8)
    np.seterr(over="ignore")  # hashes wrap
    for lo in range(0, len(whole) - length + 1, PIECE):
        b = whole[lo:lo + PIECE + length - 1]
        h, factor, span = (b.astype(np.uint64) + np.uint64(1)) * ODD, ODD, 1
        while span < GRAM:  # hashes of 2, 4, 8, 16, 32 bytes
            h = h[:-span] * factor + h[span:]
            h ^= h >> np.uint64(31)
            factor, span = factor * factor + np.uint64(2), span * 2
        window = length - GRAM + 1
        grams, h = h, sliding(h, window)
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        parts = -(-size // STRETCH)
        if (parts > 1).any():  # a periodic text: long stretches are cut
            inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, size = np.repeat(first, parts) + inside * STRETCH, np.minimum(np.repeat(size, parts) - inside * STRETCH, STRETCH)
        # places whose gram is the smallest of some window, and how many of each stretch's key its context holds
        edge = np.zeros(window - 1, h.dtype)
        least = np.flatnonzero(grams == sliding(np.concatenate([edge, h, edge]), window, np.maximum))
        at, end = np.searchsorted(least, first), np.searchsorted(least, first + size + window - 1)
        times, open_ = np.zeros(len(first), np.int64), np.arange(len(first))
        while len(open_):
            open_ = open_[(at[open_] < end[open_]) & (times[open_] < 2)]
            times[open_] += grams[least[at[open_]]] == h[first[open_]]
            at[open_] += 1
        yield lo + first, size, h[first], times > 1


def rows_of(batch: pa.RecordBatch, *columns: str, step: int = 256) -> Iterator[tuple]:
    """The rows of a batch, a few at a time as Python values: texts are not all copied at once."""
    for lo in range(0, batch.num_rows, step):
        part = batch.slice(lo, step)
        yield from zip(*(part.column(c).to_pylist() for c in columns))


def find_stretches(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_ = xxhash.xxh64_intdigest
        for batch in batches:
            for a, b, text in rows_of(batch, "t1", "t2", "text"):
                data = (text or "").encode("utf-8", "surrogatepass")
                for first, size, key, twice in stretches(data, length):
                    context = np.fromiter((hash_(data[lo:hi]) for lo, hi in zip(first.tolist(), (first + size + length - 1).tolist())), np.uint64, len(first))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), context.view(np.int64), np.full(len(first), a), np.full(len(first), b), first.astype(np.int64), size.astype(np.int64), twice)], ["key", "context", "t1", "t2", "first", "n", "twice"])

    return grouped(find)


def grouped(function, rows: int = 65_536):
    """Join the many small batches that ``function`` yields."""

    def run(batches):
        held, n = [], 0
        for b in function(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def cut_contexts(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text, wanted in rows_of(batch, "t1", "t2", "text", "wanted"):
                data = text.encode("utf-8", "surrogatepass")
                rows = [(w["key"], w["hot"], w["single"], a, b, w["first"], w["n"], data[w["first"]:w["first"] + w["n"] + length - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["key", "hot", "single", "t1", "t2", "first", "n", "bytes"])

    return grouped(cut, 8192)


def runs_of(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist())


def sort_shards(length: int):
    """Contexts ordered by key -> repeated runs of starts of those contexts that stand once."""

    def solve(shard: list[tuple]) -> Iterator[tuple]:
        # text bytes move up by one; 255 ends a context, 0 ends the shard
        parts, at = [], [0]
        for row in shard:
            parts.append(np.frombuffer(row[-1], np.uint8) + np.uint8(1))
            parts.append(np.array([255], np.uint8))
            at.append(at[-1] + len(row[-1]) + 1)
        found = repeated(np.concatenate([*parts, np.zeros(1, np.uint8)]), length)
        for (_, single, a, b, first, n, _), place in zip(shard, at):
            if single:
                for lo, hi in runs_of(found[place:place + n]):
                    yield a, b, first + lo, hi - lo

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size, last = [], 0, None

        def done() -> Iterator[pa.RecordBatch]:
            rows = list(solve(shard))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["t1", "t2", "first", "n"])

        for batch in batches:
            for row in rows_of(batch, "key", "single", "t1", "t2", "first", "n", "bytes"):
                if size >= SHARD and row[0] != last:  # a shard holds whole keys
                    yield from done()
                    shard, size = [], 0
                shard.append(row)
                size, last = size + len(row[-1]), row[0]
        if shard:
            yield from done()

    return sort


def hash_starts(length: int):
    """(key, string hash, place) of every start of a context."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, xxhash.xxh64_intdigest(data[k:k + length]) - (1 << 63), xxhash.xxh32_intdigest(data[k:k + length]), single, a, b, first + k)
                    for key, single, a, b, first, n, data in rows_of(batch, "key", "single", "t1", "t2", "first", "n", "bytes") for k in range(n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["key", "h1", "h2", "single", "t1", "t2", "first"])

    return each


PLACES = "t1 long, t2 long, first long, n long"


def repeated_places(texts: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """(t1, t2, first, n): runs of starts whose string of ``length`` bytes also starts elsewhere.

    ``texts`` (t1, t2, text) has all rows, ``distinct`` each text once."""
    found = texts.filter(F.octet_length("text") >= length).mapInArrow(find_stretches(length), "key long, context long, " + PLACES + ", twice boolean")
    found = shared_table(found, "stretches")
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("places"), F.min("context").alias("a"), F.max("context").alias("b"), F.max("twice").alias("any_twice"))
    shared = found.join(keys.filter("places > 1 or any_twice"), "key")
    sure = shared.filter("a = b and places > 1").select("t1", "t2", "first", "n")
    mixed = shared_table(shared.filter("a <> b or places = 1").select("key", "context", "t1", "t2", "first", "n", (F.col("places") > HOT).alias("hot")), "mixed-stretches")
    here = F.struct("t1", "t2", "first", "n")
    contexts = mixed.groupBy("key", "context", "hot").agg(F.count(F.lit(1)).alias("times"), F.min(here).alias("at"))
    often = contexts.filter("times > 1").select("key", "context")
    sure = sure.unionByName(mixed.join(often, ["key", "context"], "left_semi").select("t1", "t2", "first", "n"))

    wanted = contexts.select("at.t1", "at.t2", F.struct("at.first", "at.n", "key", "hot", (F.col("times") == 1).alias("single")).alias("w"))
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list("w").alias("wanted"))  # as many as the text has stretches
    pieces = distinct.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted").mapInArrow(cut_contexts(length), "key long, hot boolean, single boolean, t1 long, t2 long, first long, n long, bytes binary")
    pieces = shared_table(pieces, "contexts")
    sorted_ = pieces.filter("not hot").repartition("key").sortWithinPartitions("key").mapInArrow(sort_shards(length), PLACES)
    starts = pieces.filter("hot").mapInArrow(hash_starts(length), "key long, h1 long, h2 long, single boolean, t1 long, t2 long, first long")
    again = starts.groupBy("key", "h1", "h2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    hot = starts.filter("single").join(again, ["key", "h1", "h2"], "left_semi").select("t1", "t2", "first", F.lit(1).alias("n"))
    return sure.unionByName(sorted_).unionByName(hot).distinct()


def merge(wanted: list[dict] | None, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start in ``wanted``."""
    runs: list[list[int]] = []
    for lo, hi in sorted((w["first"], w["first"] + w["n"] + length - 1) for w in wanted or ()):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return [(lo, min(hi, size)) for lo, hi in runs]


def digest_texts(length: int):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, text, wanted in rows_of(batch, "t1", "t2", "text", "wanted"):
                data = text.encode("utf-8", "surrogatepass")
                runs = merge(wanted, len(data), length)
                ends = [0, *(x for run in runs for x in run), len(data)]
                kept = hashlib.sha256(b"".join(data[lo:hi] for lo, hi in zip(ends[::2], ends[1::2]))).hexdigest()
                rows.append((a, b, len(data), sum(hi - lo for lo, hi in runs), len(runs), kept))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)] if rows else [pa.array([], t) for t in (pa.int64(),) * 5 + (pa.string(),)], ["t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return digest


def clean_texts(length: int):
    """The texts without their repeated runs; a character of which a byte goes, goes whole."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, text, wanted in rows_of(batch, "t1", "t2", "text", "wanted"):
                data, runs = text.encode("utf-8", "surrogatepass"), []
                for lo, hi in merge(wanted, len(data), length):
                    while lo > 0 and data[lo] & 0xC0 == 0x80:
                        lo -= 1
                    while hi < len(data) and data[hi] & 0xC0 == 0x80:
                        hi += 1
                    runs.append((max(lo, runs[-1][1] if runs else 0), hi))
                ends = [0, *(x for run in runs for x in run), len(data)]
                rows.append((a, b, b"".join(data[lo:hi] for lo, hi in zip(ends[::2], ends[1::2])).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string())], ["t1", "t2", "kept"])

    return clean


def with_places(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """(t1, t2, text, wanted): every distinct text with its repeated starts.

    Texts are told apart by 128 bits of hash.  Copies collapse in each map task before they move; the
    two uses of the distinct texts share one exchange."""
    texts = docs.select(*text_keys(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    distinct = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    places = repeated_places(texts, distinct, length)
    places = places.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "n")).alias("wanted"))  # bounded by the text
    return distinct.join(places, ["t1", "t2"], "left")


def text_keys(text_col: str):
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def repeats_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """A row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else in the
    table, in the same text included.  Defined cases: null texts are empty; texts shorter than
    ``length`` stay whole; equal texts (repeated rows included) of at least ``length`` bytes go whole;
    ids may be null or repeat; very long and periodic texts are cut into pieces that lose no start; an
    empty table gives no rows; other columns are ignored."""
    made = with_places(docs, text_col, length).select("t1", "t2", "text", "wanted").mapInArrow(digest_texts(length), "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_keys(text_col))
    return rows.join(made, ["t1", "t2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the texts (whole characters go); all other
    columns stay.  Null texts stay null; n_chars, if there is such a column, is counted anew."""
    made = with_places(docs, text_col, length).select("t1", "t2", "text", "wanted").mapInArrow(clean_texts(length), "t1 long, t2 long, kept string")
    a, b, kept = (fresh(docs, x) for x in ("__t1", "__t2", "__kept"))
    keys = text_keys(text_col)
    void = fresh(docs, "__null")
    rows = docs.withColumns({a: keys[0], b: keys[1], void: F.col(text_col).isNull()}).drop(text_col)
    made = made.select(F.col("t1").alias(a), F.col("t2").alias(b), F.col("kept").alias(kept))
    out = rows.join(made, [a, b]).withColumn(text_col, F.when(~F.col(void), F.col(kept)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
