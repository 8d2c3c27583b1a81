"""SimHash near-duplicates with pivot distance tables.

Each text gets a 64-bit fingerprint of its word shingles.  Distinct fingerprints meet in blocks
(by the pigeonhole principle two that differ in at most ``bits`` of 64 agree in some choice of
bit groups).  In a block, the Hamming distances of every fingerprint to a set of reference
fingerprints are tabulated; by the triangle inequality two fingerprints within ``bits`` differ by at
most ``bits`` in every coordinate, so pairs with a larger difference in any are discarded and only
the survivors are verified.  A block sends back a spanning forest, never its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefengine.operators.joins import join_counts
from prefengine.llm.common import fresh, shared_table
from prefengine.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: References of the distance tables: fixed pseudo-random fingerprints.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(24)], np.uint64)
#: Members of a block that one task compares; larger blocks are split into pairs of parts.
BLOCK_ROWS = 8192


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit i is set if it is set in over half the hashes of the text's shingles; no words give 0."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):  # bounded for very long texts
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[lo:min(n, lo + 65_536)], stops[lo:lo + 65_536])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int) -> Column:
    """The 64 bits as a signed long."""
    @F.pandas_udf("long")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return made(text)


def block_masks(bits: int) -> list[int]:
    """Masks of bit groups: 64 bits cut into ``bits + 3`` groups, every choice of 3 of them.  At most
    ``bits`` groups hold a differing bit, so two fingerprints that link agree in at least 3 groups."""
    cuts = np.linspace(0, 64, bits + 4).astype(int).tolist()
    groups = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(groups, 3)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_pairs(prints: DataFrame, bits: int) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (column fp, distinct) that pairs within
    ``bits`` connect; at most one fewer than the members of a block.

    A block with more members than ``BLOCK_ROWS`` is dealt into parts and every pair of parts is
    compared on its own, so no task grows with the largest block."""
    masks = block_masks(bits)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("value")) for i, m in enumerate(masks)]))
    rows = prints.select("fp", keys.alias("k")).select("fp", F.xxhash64("k.no", "k.value").alias("block"))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    # Spark takes the rows for as few as the fingerprints that they were exploded from: no broadcast of them
    rows = rows.hint("merge").join(sizes, "block")
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("fp", F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("block"))
    dealt = rows.repartition("block").sortWithinPartitions("block", F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(int(PIVOTS[0]))))))
    return dealt.mapInArrow(linker(bits), "a long, b long").distinct()


def linker(bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_fp, held_block = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
            block = np.concatenate([held_block, batch.column("block").to_numpy()])
            cut = int(np.searchsorted(block != block[-1], False)) if len(block) == 0 or block[0] == block[-1] else int(np.flatnonzero(block != block[-1])[-1]) + 1
            yield from forest(fp[:cut], block[:cut], bits)
            held_fp, held_block = fp[cut:], block[cut:]
        yield from forest(held_fp, held_block, bits)

    return link


def forest(fp: np.ndarray, block: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the pairs within ``bits`` inside each block; rows come ordered by block and
    by the distance to the first reference."""
    if len(fp) < 2:
        return
    table = np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int16)
    label = np.arange(len(fp))
    at, lag = np.arange(len(fp) - 1), 1
    found: list[np.ndarray] = []
    while len(at):
        # beyond the first partner too far in the first coordinate, all later ones are too far as well
        at = at[at + lag < len(fp)]
        other = at + lag
        near = (block[at] == block[other]) & (table[other, 0] - table[at, 0] <= bits)
        at, other = at[near], other[near]
        a, b = at, other
        for k in range(1, table.shape[1]):
            close = np.abs(table[a, k] - table[b, k]) <= bits
            a, b = a[close], b[close]
        true = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        if true.any():
            found.append(np.stack([a[true], b[true]]))
        if sum(f.shape[1] for f in found) > 1 << 20:
            label, found = joined(label, np.concatenate(found, axis=1)), []
        lag += 1
    if found:
        label = joined(label, np.concatenate(found, axis=1))
    member = np.flatnonzero(label != np.arange(len(label)))
    if len(member):
        yield pa.RecordBatch.from_pydict({"a": fp[label[member]].view(np.int64), "b": fp[member].view(np.int64)})


def joined(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels (smallest place reachable) after adding pairs."""
    while True:
        a, b = label[pairs[0]], label[pairs[1]]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """A row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that
    links reach, itself included), text_hash (to tell rows of equal id apart), root (a fingerprint
    that stands for the component: unlike component_id, which can be null or repeat, it is its own).

    ``shingle`` words make a shingle, fingerprints link at ``bits`` or fewer differing bits.  Defined
    cases: null, empty and blank texts have the fingerprint zero and link like others; a text shorter
    than a shingle is one shingle; equal fingerprints are one node, so copies never form pairs; a
    null id never becomes a component's id unless all its ids are null; repeated rows share a
    component; an empty table gives no rows; other columns are ignored."""
    prints = shared_table(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                                      fingerprints(F.col(text_col), shingle).alias("fp")), "simhash")
    nodes = shared_table(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c_all")), "simhash-nodes")
    roots = components(near_pairs(nodes.select("fp"), bits)).withColumnRenamed("node", "fp")
    member = shared_table(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-members")
    # a component or a fingerprint with a large share of the rows meets its id apart from the others
    least = shared_table(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("c_all")), "simhash-least")
    final = shared_table(join_counts(member.select("fp", "root", F.col("c_all").alias("rows")), least, ["root"]).withColumnRenamed("rows", "c_all"), "simhash-final")
    shown = [F.lower(F.lpad(F.hex(c), 16, "0")).alias(name) for c, name in (("fp", "fingerprint"), ("root", "root"))]
    return join_counts(prints, final, ["fp"]).select("doc_id", shown[0], "component_id", "text_hash", shown[1])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (and among rows of
    that id the smallest text hash, then the smallest of the other columns); all columns stay as they are.

    Null, empty and blank texts are one group, null ids come last, repeated rows leave one, texts of any length are
    read whole, a table without rows gives none."""
    groups = near_duplicates(docs, id_col, text_col, shingle, bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_hash")).alias("first")
    mark, own_id, own_hash, row = (fresh(docs, name) for name in ("row_text_hash", "kept_id", "kept_hash", "kept_row"))
    # ids can be null or repeat, so components may share their smallest id, never their root
    keep = groups.groupBy("root").agg(first).select(F.col("first.doc_id").alias(own_id), F.col("first.text_hash").alias(own_hash))
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(mark) == F.col(own_hash))
    kept = marked.join(keep, same, "left_semi").groupBy(id_col, mark).agg(F.min(F.struct(*docs.columns)).alias(row))
    return kept.select(*[F.col(row)[c].alias(c) for c in docs.columns])
