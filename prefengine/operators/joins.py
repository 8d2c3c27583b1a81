"""Equi-joins whose hot keys don't become one task's work."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from prefengine.session import plan_bytes

#: A key that makes up at least this share of a count table is always joined apart (there are at most
#: as many such keys as the reciprocal).
HOT_SHARE = 1e-3


def join_counts(left: DataFrame, counts: DataFrame, on: list[str], few: bool = False) -> DataFrame:
    """Left join of ``left`` with a count table (``on`` unique, total in c_all).

    Keys with a share of HOT_SHARE or more ("the", the start of a text) would put that share of all
    rows into one task.  They are broadcast, with as many of the next frequent ones as a broadcast may hold
    (``held_rows``), which in natural text are most rows; only the other rows are shuffled to the table.  With ``few`` a task holds
    its share of them, and the table's rows pass by unsorted."""
    least = _hot_from(counts, held_rows(left.sparkSession) // len(on))
    hot = counts.filter(F.col("c_all") >= least).drop("c_all")
    found = [c for c in hot.columns if c not in on]
    tagged = left.join(F.broadcast(hot.select(*on, F.struct(*found).alias("_hot"))), on, "left")
    apart = tagged.filter(F.col("_hot").isNotNull()).select(*left.columns, "_hot.*")
    cold = counts.filter(F.col("c_all") < least).drop("c_all")
    rest = tagged.filter(F.col("_hot").isNull()).drop("_hot")
    rest = (rest.hint("shuffle_hash") if few else rest).join(cold, on, "left")
    return apart.unionByName(rest.select(*left.columns, *found))


def _hot_from(counts: DataFrame, rows: int) -> float:
    """The total from which a key is hot: those with HOT_SHARE of all, and more while they are at most ``rows``
    keys.  One row per distinct total is read, about the root of their sum at most."""
    sizes = counts.groupBy("c_all").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c_all")).collect()
    least = max(1, sum((r["c_all"] or 0) * r["n"] for r in sizes) * HOT_SHARE)
    for r in sizes:
        rows -= r["n"]
        if rows < 0 or not r["c_all"]:
            break
        least = min(least, r["c_all"])
    return least


def join_lookup(left: DataFrame, table: DataFrame, on: str, count: str) -> DataFrame:
    """Left join with a lookup table (``on`` unique, ``count`` its frequency): a table under Spark's broadcast
    threshold is broadcast, which keeps the partitioning of ``left``; a larger one is joined with its
    frequent keys apart."""
    limit = int(left.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = plan_bytes(table)
    if size is not None and size <= limit:
        return left.join(F.broadcast(table.drop(count)), on, "left")
    return join_counts(left, table.withColumnRenamed(count, "c_all"), [on])


#: Bytes that a row of a table held by every task may take: Spark's broadcast threshold holds that many rows.
ROW_BYTES = 40


def held_rows(spark) -> int:
    """Rows that a broadcast may hold (none where the session forbids broadcasts)."""
    return max(0, int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())) // ROW_BYTES


def lookup_lists(df: DataFrame, key: list[str], cols: dict[str, str], table: DataFrame, on: str, value: str, count: str,
                 rank: str, missing) -> DataFrame:
    """Array columns (``cols``: input -> output) with every element looked up in ``table`` (``on`` unique) and
    replaced by its ``value``, or ``missing``; order and length stay.  Rows with a null ``key`` get empty arrays.

    Tasks hold the rows with ``rank`` under ``held_rows``, the most frequent ones, and find them in the row: no
    element of these is shuffled.  The other elements, the rare ones, meet the rest of the table by ``join_lookup``,
    are gathered per ``key`` (unique in ``df``) and fill the gaps in their order."""
    spark = df.sparkSession
    limit = held_rows(spark)
    held = table.filter(F.col(rank) < limit).select(on, value).toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast(held)
    rest = table.filter(F.col(rank) >= limit).select(on, value, count)
    types = table.schema

    def inBroadcast(lists: pa.Array) -> pa.Array:  # the name that explain() shows
        return _find(lists, sent.value)
    look = F.arrow_udf(inBroadcast, StructType([
        StructField("found", ArrayType(types[value].dataType)), StructField("rare", ArrayType(types[on].dataType))]))
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    empty = F.array().cast(ArrayType(types[on].dataType))
    looked = df.withColumns({f"_l{i}": look(F.coalesce(F.when(whole, F.col(c)), empty)) for i, c in enumerate(cols)})
    if rest.isEmpty():
        return looked.select(*[c for c in df.columns if c not in cols.values()], *[
            F.transform(f"_l{i}.found", lambda x: F.coalesce(x, F.lit(missing))).alias(out) for i, out in enumerate(cols.values())])

    def tag(i: int):
        return lambda x, k: F.struct(F.lit(i).alias("_c"), k.alias("_k"), x.alias(on))
    tagged = F.concat(*[F.transform(f"_l{i}.rare", tag(i)) for i in range(len(cols))])
    ex = looked.select(*key, F.explode(tagged).alias("_t")).select(*key, "_t._c", "_t._k", f"_t.{on}")
    met = join_lookup(ex, rest, on, count).withColumn(value, F.coalesce(F.col(value), F.lit(missing)))
    gathered = met.repartition(*key).groupBy(*key).agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_c") == i, F.struct("_k", value)))), lambda x: x[value]).alias(f"_r{i}")
        for i in range(len(cols))])
    rows = looked.select(*[c for c in df.columns if c not in cols.values()], *[F.col(f"_l{i}.found").alias(f"_f{i}") for i in range(len(cols))])
    none = F.array().cast(ArrayType(types[value].dataType))
    fill = F.arrow_udf(_fill, ArrayType(types[value].dataType))
    joined = rows.join(gathered, key, "left")
    return joined.select(*[c for c in rows.columns if not c.startswith("_f") or c in df.columns], *[
        fill(f"_f{i}", F.coalesce(f"_r{i}", none)).alias(out) for i, out in enumerate(cols.values())])


def _lists(lengths: pa.Array, values: pa.Array) -> pa.Array:
    ends = pc.cumulative_sum(lengths.cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), values)


def _one(x) -> pa.Array:
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def _find(lists: pa.Array, held: pa.Table) -> pa.Array:
    """(found, rare) per list: the values of the elements that ``held`` has, null for others, and those others."""
    flat, lengths = lists.flatten(), lists.value_lengths()
    keys, values = (_one(c) for c in held.columns)
    found = values.take(pc.index_in(flat, value_set=keys.cast(flat.type)))
    gone = found.is_null()
    before = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(gone.cast(pa.int32()))])
    ends = pc.cumulative_sum(lengths.cast(pa.int32()))
    starts = pc.subtract(ends, lengths.cast(pa.int32()))
    n_rare = pc.subtract(before.take(ends), before.take(starts))
    return pa.StructArray.from_arrays([_lists(lengths, found), _lists(n_rare, flat.filter(gone))], ["found", "rare"])


def _fill(found: pa.Array, rare: pa.Array) -> pa.Array:
    """``found`` with its nulls replaced by the elements of ``rare``, in order."""
    lengths, flat = found.value_lengths(), found.flatten()
    gone = flat.is_null()
    before = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(gone.cast(pa.int32()))])
    ends = pc.cumulative_sum(lengths.cast(pa.int32()))
    missing = pc.subtract(before.take(ends), before.take(pc.subtract(ends, lengths.cast(pa.int32()))))
    if not missing.equals(rare.value_lengths().cast(pa.int32())):
        raise ValueError("lookup_lists: the key is not unique")
    return _lists(lengths, pc.replace_with_mask(flat, gone, rare.flatten()))
