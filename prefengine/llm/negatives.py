"""Hard-negative mining with coordinate pruning in length buckets.

Vectors become integers, so scores are exact.  Anchors come in blocks, the other rows in stripes, and
a task gets the cells (block, stripe): the anchors first, then the stripe's rows from the longest down,
so that it holds one block and one bucket of similar lengths at a time.  A bucket keeps, for each
coordinate, its rows sorted by that coordinate of the unit vector.

For an anchor that still looks for scores of at least t, a row of a bucket with greatest length l must
make an angle of at most acos(t / (anchor length * l)) with it.  That bounds each coordinate of the
row's unit vector; on the anchor's focus coordinates, its largest, the rows in the feasible range are
read off the sorted lists and intersected.  Only rows in all ranges are verified by the exact inner
product.  t rises as better rows are found, and a bucket too short for it is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefengine.llm.common import shared_table

#: Rows of a bucket, anchors of a block, most rows of a stripe, coordinates that prune.
BUCKET, BLOCK, STRIPE, FOCUS = 4096, 1024, 1 << 20, 4
#: Rounding of lengths and angles never prunes a row that belongs.
SLACK = 1e-9


class Bucket:
    """Rows of similar length with their sorted coordinate lists."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> None:
        self.uid, self.ids, self.labels, self.x = uid, ids, labels, x
        self.real, self.longest = x.astype(np.float64), float(lengths.max())
        unit = self.real / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.lists = np.ascontiguousarray(np.take_along_axis(unit, self.order, 0).T)
        self.order = np.ascontiguousarray(self.order.T)

    def candidates(self, unit: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Places of the rows that may score ``least`` or more with the anchor; None for all."""
        if not least > 0:
            return None
        if length * self.longest <= 0 or least > length * self.longest * (1 + SLACK):
            return np.zeros(0, np.int64)
        angle = np.arccos(min(1.0, least / (length * self.longest) * (1 - SLACK)))
        seen, ranges = None, 0
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            own = np.arccos(unit[f])
            low = np.searchsorted(self.lists[f], np.cos(min(np.pi, own + angle)) - SLACK, "left")
            high = np.searchsorted(self.lists[f], np.cos(max(0.0, own - angle)) + SLACK, "right")
            if high - low < len(self.uid):  # a range that holds every row says nothing
                seen = np.zeros(len(self.uid), np.uint8) if seen is None else seen
                seen[self.order[f, low:high]] += 1
                ranges += 1
        return None if seen is None else np.flatnonzero(seen == ranges)

    def scores(self, places: np.ndarray, x: np.ndarray, length: float) -> np.ndarray:
        """Exact inner products of the rows at ``places``; doubles hold all sums of less than 2^53."""
        if length * self.longest < float(1 << 52):
            return (self.real[places] @ x.astype(np.float64)).astype(np.int64)
        return self.x[places] @ x


class Best:
    """The best ``k`` rows so far: score downwards, then the smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, np.zeros((3, 0), np.int64)  # scores, ids, uids

    def add(self, scores: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # all that could be among the best, ties included
            some = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, uid = scores[some], ids[some], uid[some]
        rows = np.concatenate([self.rows, np.stack([scores, ids, uid])], axis=1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]

    def least(self) -> float:
        """The score that the next row must reach."""
        return float(self.rows[0, -1]) if self.rows.shape[1] == self.k else -np.inf


class Anchor:
    """One anchor's search in one stripe: positives, or the negatives of each of its positives."""

    def __init__(self, row: dict, x: np.ndarray, positives: int, negatives: int, low: int, high: int) -> None:
        self.uid, self.id, self.label, self.length, self.x = row["uid"], row["vec_id"], row["label"], row["length"], x
        self.unit = x / self.length if self.length > 0 else x * 0.0
        self.low, self.high = low, high
        self.wanted = row["wanted"]  # None: look for positives
        self.best = [Best(positives)] if self.wanted is None else [Best(negatives) for _ in self.wanted]

    def least(self) -> float:
        if self.wanted is None:
            return self.best[0].least()
        return min(max(w["score"] * self.low / 100, b.least()) for w, b in zip(self.wanted, self.best))

    def visit(self, bucket: Bucket) -> None:
        places = bucket.candidates(self.unit, self.length, self.least())
        same = bucket.labels == self.label if places is None else bucket.labels[places] == self.label
        side = same if self.wanted is None else ~same
        places = np.flatnonzero(side) if places is None else places[side]
        if not len(places):
            return
        scores, ids, uid = bucket.scores(places, self.x, self.length), bucket.ids[places], bucket.uid[places]
        if self.wanted is None:
            other = uid != self.uid
            self.best[0].add(scores[other], ids[other], uid[other])
            return
        for w, best in zip(self.wanted, self.best):
            # low * positive <= 100 * score <= high * positive, without leaving 64 bits
            fit = (scores >= -(-self.low * w["score"] // 100)) & (scores <= self.high * w["score"] // 100)
            if fit.any():
                best.add(scores[fit], ids[fit], uid[fit])

    def found(self) -> Iterator[tuple]:
        for k, best in enumerate(self.best):
            w = self.wanted[k] if self.wanted else {"uid": None, "vec_id": None, "score": None}
            for score, vec_id, uid in best.rows.T.tolist():
                yield self.uid, self.id, w["uid"], w["vec_id"], w["score"], uid, vec_id, score


FOUND = [("anchor", "long"), ("anchor_id", "long"), ("positive", "long"), ("positive_id", "long"), ("positive_score", "long"),
         ("uid", "long"), ("vec_id", "long"), ("score", "long")]
_TABLE = pa.schema([(name, pa.int64()) for name, _ in FOUND])


def searcher(positives: int, negatives: int, low: int, high: int):
    """Search the cells of a partition one after the other; rows come by cell, anchors first, longest first."""

    def emit(anchors: list[Anchor]) -> Iterator[pa.RecordBatch]:
        rows = [r for a in anchors for r in a.found()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_TABLE)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, anchors, held, n = None, [], [], 0

        def close() -> None:
            nonlocal held, n
            if held and anchors:
                bucket = Bucket(*(np.concatenate(c) for c in zip(*held)))
                for a in anchors:
                    a.visit(bucket)
            held, n = [], 0

        for batch in batches:
            block, stripe, kind = (batch.column(c).to_numpy() for c in ("block", "stripe", "kind"))
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else None
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(stripe) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if lo == hi:
                    continue
                if cell != (block[lo], stripe[lo]):
                    close()
                    yield from emit(anchors)
                    cell, anchors = (block[lo], stripe[lo]), []
                part = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    rows = part.select(["uid", "vec_id", "label", "length", "wanted"]).to_pylist()
                    anchors += [Anchor(row, v, positives, negatives, low, high) for row, v in zip(rows, x[lo:hi])]
                    continue
                columns = [*(part.column(c).to_numpy() for c in ("uid", "vec_id", "label")), x[lo:hi], part.column("length").to_numpy()]
                while len(columns[0]):
                    take = BUCKET - n
                    held.append([c[:take] for c in columns])
                    n += len(columns[0][:take])
                    columns = [c[take:] for c in columns]
                    if n == BUCKET:
                        close()
        close()
        yield from emit(anchors)

    return search


def integers(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, x, length) of the rows that take part."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= float(1 << 40))  # noqa: E731  infinite ones too
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                       & ~F.exists("v", lambda e: bad(e.cast("double"))))
    x = F.transform("v", lambda e: F.floor(F.lit(256.0) * e.cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), x.alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return rows.withColumn("length", F.sqrt(square)).filter(F.col("length") < float(1 << 31))


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose
    id is divisible by ``every`` and each of its ``positives`` best other rows of its label, the best
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Components become floor(256 c); where the id is divisible by 7 the label first becomes (label + 1) % 10.
    The best have the largest inner product, ties go to the smaller id.  Exact; all rows are searched.

    Defined cases: rows whose id, label or vector is null, or whose vector is empty, holds a null or a
    non-finite component or is not as long as most (the smaller of two), take no part, nor do those
    whose integer vector has a Euclidean length of 2^31 or more (scores stay within a long); zero
    vectors score 0; rows that share an id are rows of their own, each an anchor, a positive or a
    negative; an anchor alone in its label, or whose positive has a negative score, has no rows;
    no rows give no rows; other columns are ignored."""
    spark = vectors.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = integers(vectors, id_col, label_col, vector_col).withColumn("uid", F.monotonically_increasing_id())
    rows = shared_table(rows, "negatives-rows")  # ids of rows are fixed once written
    is_anchor = F.pmod("vec_id", F.lit(every)) == 0
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.sum(is_anchor.cast("long")).alias("anchors"))
    size = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not size or not size[0]["anchors"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dim, n, blocks = size[0]["dim"], size[0]["n"], -(-size[0]["anchors"] // BLOCK)
    stripes = max(-(-n // STRIPE), min(-(-4 * cores // blocks), -(-n // 256)))
    rows = rows.filter(F.size("x") == dim)
    anchors = shared_table(rows.filter(is_anchor).repartition(blocks).withColumn("block", F.spark_partition_id()), "negatives-anchors")
    data = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("uid"), F.lit(stripes)).cast("int").alias("stripe"),
                       F.lit(1).alias("kind"), "uid", "vec_id", "label", "length", "x")

    def search(asked: DataFrame) -> DataFrame:
        asked = asked.select("block", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("kind"), "uid", "vec_id", "label", "length", "x", "wanted")
        cells = data.unionByName(asked, allowMissingColumns=True).repartition(blocks * stripes, "block", "stripe")
        cells = cells.sortWithinPartitions("block", "stripe", "kind", F.desc("length"), "uid")
        return cells.mapInArrow(searcher(positives, negatives, low, high), ", ".join(f"{name} {kind}" for name, kind in FOUND))

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "uid")
    wanted = "array<struct<uid: long, vec_id: long, score: long>>"
    best = search(anchors.withColumn("wanted", F.lit(None).cast(wanted))).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives)
    best = best.groupBy(F.col("anchor").alias("uid")).agg(F.collect_list(F.struct("uid", "vec_id", "score")).alias("wanted"))
    found = search(anchors.join(best, "uid"))
    then = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(then)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
