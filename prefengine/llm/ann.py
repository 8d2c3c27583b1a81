"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, turned by their principal axes and a rotation learned so that
the signs lose little (fitted on a bounded sample), one bit per axis.  Codes are split into
substrings and each substring is indexed.  By the pigeonhole principle a code within a Hamming radius
of the query's agrees with it up to a small radius in some substring, so probing the substring
tables at these small radii retrieves every code within the radius.  What is retrieved is ranked by
the inner product of the original vectors.

Every row is encoded once, into a table in the shared folder.  Queries are dealt into blocks and rows
into stripes; a task gets the cells (block, stripe): the block's queries first, then the stripe's rows,
which it indexes chunk by chunk, and it returns only its best ``k`` per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefengine.llm.common import shared_table

#: Rows that the codes are fitted on, queries that the radius is chosen with.
FIT_ROWS, TUNE_QUERIES = 8192, 256
#: Queries of a block, most rows of a stripe, rows indexed at once.
BLOCK_QUERIES, STRIPE_ROWS, CHUNK_ROWS = 8192, 1 << 20, 8192
SUBSTRING_BITS = 8
POPCOUNT = np.array([bin(v).count("1") for v in range(1 << SUBSTRING_BITS)], np.uint8)


class Codes:
    """The learned code: ``encode`` gives one byte per substring; ``radius`` reaches the target recall on the sample."""

    def __init__(self, sample: np.ndarray, k: int, recall: float, rounds: int = 40, seed: int = 0) -> None:
        n, dim = sample.shape
        self.bits = dim
        self.parts = -(-dim // SUBSTRING_BITS)
        self.centre = sample.mean(0)
        turned = sample - self.centre
        _, axes = np.linalg.eigh(turned.T @ turned)
        turned = turned @ axes[:, ::-1]
        rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
        for _ in range(rounds):  # alternate: signs for the rotation, best rotation for the signs
            left, _, right = np.linalg.svd(np.where(turned @ rotation >= 0, 1.0, -1.0).T @ turned)
            rotation = (left @ right).T
        self.turn = axes[:, ::-1] @ rotation
        self.radius = self.choose(sample, k, recall)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        bits = (vectors - self.centre) @ self.turn >= 0
        return np.packbits(bits, axis=1)

    def choose(self, sample: np.ndarray, k: int, recall: float) -> int:
        """The least radius that holds the share ``recall`` of the sample's true neighbours."""
        codes, queries = self.encode(sample), np.arange(min(TUNE_QUERIES, len(sample)))
        near = sample[queries] @ sample.T
        near[queries, queries] = -np.inf
        best = np.argsort(-near, axis=1)[:, :min(k, max(1, len(sample) - 1))]
        far = POPCOUNT[codes[best] ^ codes[queries][:, None]].sum(2)
        return int(np.sort(far, axis=None)[max(0, int(np.ceil(recall * far.size)) - 1)])


def as_words(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words, for counting differing bits."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


class Tables:
    """Substring tables of one set of codes: per substring, the rows ordered by its value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.words = codes, as_words(codes)
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.edges = [np.searchsorted(codes[o, j], np.arange((1 << SUBSTRING_BITS) + 1)) for j, o in enumerate(self.order)]
        self.masks = [np.flatnonzero(POPCOUNT <= a) for a in range(SUBSTRING_BITS + 1)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most ``radius`` bits, in row order.

        radius = parts * a + b: a code that close differs in at most a bits in one of the first b + 1
        substrings or in at most a - 1 bits in one of the others."""
        parts = len(code)
        a, b = divmod(radius, parts)
        seen = np.zeros(len(self.codes), bool)
        for j in range(parts):
            small = a if j <= b else a - 1
            if small < 0:
                continue
            values = self.masks[min(small, SUBSTRING_BITS)] ^ int(code[j])
            start, size = self.edges[j][values], self.edges[j][values + 1] - self.edges[j][values]
            total = int(size.sum())
            if total:
                skip = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                seen[self.order[j][skip + np.arange(total)]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.words[rows] ^ as_words(code[None])).sum(1) <= radius]


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: score downwards, ties by id."""
    if len(ids) > 4 * k:  # all that could be among the best, ties included
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by
    ``every``, by largest inner product in double precision, ties to the smaller id.

    The codes are fitted on ``FIT_ROWS`` rows (smallest id hashes); every row is indexed.  A query with
    fewer than ``k`` rows within the radius is asked again with the radius that holds all rows, so what
    comes does not depend on how rows are dealt to tasks.  Defined cases: vectors that are null, empty,
    zero, hold null or non-finite components, or are not as long as most take no part, nor do rows
    without id; equal vectors tie; an id that repeats is one query (with its smallest vector), its rows
    are never its own neighbours but candidates of others; with too few rows all candidates come; no
    rows give no rows; other columns are ignored."""
    spark = vectors.sparkSession
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda e: e != 0))
    common = x.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = common[0]["dim"], common[0]["count"]
    x = x.filter(F.size("v") == dim)

    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()
    codes = Codes(np.array([r["v"] for r in sample], np.float64), k, recall)
    send = spark.sparkContext.broadcast(codes)  # the rotation: dimension-sized
    rows = shared_table(x.mapInArrow(encoder(send), f"vec_id long, v {x.schema['v'].dataType.simpleString()}, code binary"), "ann-index")
    asked = shared_table(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "code")).alias("q"))
                         .select("vec_id", "q.v", "q.code"), "ann-queries")

    def search(queries: DataFrame, number: int, radius: int) -> DataFrame:
        """(query_id, vec_id, score): the best ``k`` of every query in every stripe."""
        blocks = -(-number // BLOCK_QUERIES)
        # a cell for every core at least; more stripes than that only return more rows
        stripes = max(-(-n // STRIPE_ROWS), min(-(-spark.sparkContext.defaultParallelism // blocks), -(-n // 4096)))
        each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        dealt = queries.repartition(blocks).withColumn("block", F.spark_partition_id())
        dealt = dealt.select("block", each(stripes).alias("stripe"), F.lit(0).alias("kind"), "vec_id", "v", "code")
        data = rows.select(each(blocks).alias("block"), F.pmod(F.xxhash64("vec_id", "code"), F.lit(stripes)).cast("int").alias("stripe"),
                           F.lit(1).alias("kind"), "vec_id", "v", "code")
        cells = data.unionByName(dealt).repartition(4 * blocks * stripes, "block", "stripe").sortWithinPartitions("block", "stripe", "kind")
        return cells.mapInArrow(searcher(radius, k), "query_id long, vec_id long, score double")

    number = asked.count()
    if not number:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = shared_table(search(asked, number, codes.radius), "ann-found")
    # a stripe returns up to k rows of a query, so fewer in all are all that the radius holds
    full = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= k)
    short = shared_table(asked.join(full, "vec_id", "left_anti"), "ann-short")
    left = short.count()
    if left:
        again = search(short, left, 8 * codes.parts)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def encoder(send):
    """(vec_id, v) -> (vec_id, v, code)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = send.value.encode(matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([c.tobytes() for c in made], pa.binary())], ["vec_id", "v", "code"])

    return encode


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


class Cell:
    """One block of queries against one stripe of rows."""

    def __init__(self, radius: int, k: int) -> None:
        self.radius, self.k = radius, k
        self.queries: list[tuple] = []  # id, vector, code
        self.best: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: list[tuple] = []  # ids, vectors, codes of rows not yet indexed
        self.n = 0

    def add(self, kind: int, columns: tuple) -> None:
        if kind == 0:
            self.queries += zip(*columns)
            self.best += [(np.zeros(0, np.int64), np.zeros(0))] * len(columns[0])
            return
        while len(columns[0]):
            room = CHUNK_ROWS - self.n
            self.held.append(tuple(c[:room] for c in columns))
            self.n += len(self.held[-1][0])
            columns = tuple(c[room:] for c in columns)
            if self.n == CHUNK_ROWS:
                self.search()

    def search(self) -> None:
        """Index the held rows and probe them for every query."""
        if self.held and self.queries:
            ids, rows, codes = (np.concatenate(c) for c in zip(*self.held))
            tables = Tables(codes)
            for i, (query, vector, code) in enumerate(self.queries):
                near = tables.within(code, self.radius)
                near = near[ids[near] != query]
                scores = (rows[near] * vector).sum(1)
                ids_, scores_ = np.concatenate([self.best[i][0], ids[near]]), np.concatenate([self.best[i][1], scores])
                top = best_of(ids_, scores_, self.k)
                self.best[i] = (ids_[top], scores_[top])
        self.held, self.n = [], 0

    def found(self) -> Iterator[pa.RecordBatch]:
        self.search()
        for lo in range(0, len(self.best), 512):
            part = self.best[lo:lo + 512]
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(np.array([q[0] for q in self.queries[lo:lo + 512]], np.int64), [len(b[0]) for b in part]),
                                              "vec_id": np.concatenate([b[0] for b in part]), "score": np.concatenate([b[1] for b in part])})


def searcher(radius: int, k: int):
    """Search the cells of a partition one after the other; rows come by cell, queries first."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, cell = None, Cell(radius, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "stripe", "kind")], axis=1)
            columns = (batch.column("vec_id").to_numpy(), matrix(batch), np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if place != (keys[lo, 0], keys[lo, 1]):
                    yield from cell.found()
                    place, cell = (keys[lo, 0], keys[lo, 1]), Cell(radius, k)
                cell.add(int(keys[lo, 2]), tuple(c[lo:hi] for c in columns))
        yield from cell.found()

    return search
