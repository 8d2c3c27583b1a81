"""Ordering, indexing, batching and sharding.

No operator here plans an unpartitioned window (``Exchange SinglePartition``): the global
row index is a range-partitioned sort plus a prefix sum over per-partition counts.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefengine.session import checkpoint_root, plan_bytes

# A top-n (TakeOrderedAndProject) keeps n rows per task and merges them in one task: used only
# for n up to this bound; larger n go through the distributed global index.
TOPN_ROWS = 100_000
_LOCAL_BITS = 33  # monotonically_increasing_id = (partition << 33) + position in partition


def shuffle_key(seed: int, *key_cols) -> Column:
    """md5 over "seed:key..." — a seeded, reproducible order that the SQL oracle can repeat."""
    parts = [F.lit(str(seed))] + [F.col(k).cast("string") if isinstance(k, str) else k.cast("string")
                                  for k in key_cols]
    return F.md5(F.concat_ws(":", *parts))


# Target bytes per range partition when the partition count is derived from plan statistics.
RANGE_PARTITION_BYTES = 64 * 1024 * 1024


def range_partitions(df: DataFrame) -> int:
    """Partitions for a range exchange: the plan's estimated size / RANGE_PARTITION_BYTES, and at
    least one per core or shuffle partition, whichever is fewer (no job runs).  There is no upper
    bound: each partition is sorted in one task, so their size must not grow with the data."""
    spark = df.sparkSession
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = plan_bytes(df)
    return max(least, -(-(size or 0) // RANGE_PARTITION_BYTES))


def _cols(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def global_index(df: DataFrame, order_by, partition_by=None, name: str = "idx",
                 num_partitions: int | None = None, key=None) -> DataFrame:
    """0-based position of every row in ``order_by`` order, within ``partition_by`` groups.

    ``order_by`` must be a total order (end it with a unique key).  Frames with more than keys
    name their unique ``key``: then only key, order and group columns are sorted and
    checkpointed, and the positions are joined back to the rows.
    Plan: range-partition on
    (groups, keys) and sort inside partitions; tag rows with monotonically_increasing_id and
    checkpoint that into the shared checkpoint folder, so the count pass and the numbering pass
    read the same, fault-tolerant partitions; count rows per (partition, group); a prefix sum
    over that small table gives every (partition, group) its offset.  A hot group is spread
    over many range partitions instead of one task.
    """
    spark = df.sparkSession
    groups = _cols(partition_by)
    keys = groups + _cols(order_by)
    if key is not None:
        uk = _cols(key)
        narrow = df.select(*dict.fromkeys([*uk, *groups, *[c for c in _cols(order_by) if isinstance(c, str)]]))
        index = global_index(narrow, order_by, partition_by, name, num_partitions)
        return df.join(index.select(*uk, name), uk)
    n = num_partitions or range_partitions(df)
    checkpoint_root(spark)
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS).alias("_pid")
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    counts = (tagged.groupBy(pid, *groups)
              .agg(F.count(F.lit(1)).alias("_cnt"), F.min(local).alias("_first")))
    if groups:
        w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
                   .select("_pid", *groups, "_off", "_first"))
        right = offsets  # one row per (partition, group) present; adaptive execution knows its size
    else:
        # one row per partition: the prefix sum runs on the driver over n counts
        rows = sorted((r["_pid"], r["_cnt"], r["_first"]) for r in counts.collect())
        acc, data = 0, []
        for p, c, f in rows:
            data.append((p, acc, f))
            acc += c
        right = F.broadcast(spark.createDataFrame(data, "_pid bigint, _off bigint, _first bigint"))
    out = (tagged.withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS))
           .join(right, ["_pid", *groups])
           .withColumn(name, (F.col("_off") + local - F.col("_first")).cast("bigint"))
           .drop("_mid", "_pid", "_off", "_first"))
    return out


def shuffle(df: DataFrame, seed: int, key, name: str | None = None) -> DataFrame:
    """Seeded shuffle (B1): a global sort on md5(seed:key), key."""
    k = _cols(key)
    out = df.withColumn("_shuffle", shuffle_key(seed, *k)).orderBy("_shuffle", *k)
    return out if name is None else out.withColumnRenamed("_shuffle", name)


def shuffled_index(df: DataFrame, seed: int, key, name: str = "pos", partition_by=None) -> DataFrame:
    """Position of each row in the seeded shuffle order (B1 + B0); ``key`` is unique, and only it is
    shuffled and checkpointed."""
    k = _cols(key)
    uk = [*_cols(partition_by), *k]
    out = global_index(df.withColumn("_shuffle", shuffle_key(seed, *k)), ["_shuffle", *k],
                       partition_by=partition_by, name=name, key=None if set(df.columns) <= set(uk) else uk)
    return out.drop("_shuffle")


def sample_n(df: DataFrame, n: int, seed: int, key) -> DataFrame:
    """Shuffle, then take ``n`` (F3): a bounded top-n (TakeOrderedAndProject, no full sort)
    for n up to TOPN_ROWS, else the first n positions of the seeded order (global index)."""
    k = _cols(key)
    keyed = df.withColumn("_shuffle", shuffle_key(seed, *k))
    if n <= TOPN_ROWS:
        return keyed.orderBy("_shuffle", *k).limit(n).drop("_shuffle")
    return global_index(keyed, ["_shuffle", *k], name="_pos").filter(F.col("_pos") < n).drop("_shuffle", "_pos")


def assign_batches(df: DataFrame, size: int, order_by, name: str = "batch_id",
                   partition_by=None, index_name: str = "idx", key=None) -> DataFrame:
    """Fixed-size batches in ``order_by`` order (B2): floor(idx / size).  ``key`` as in
    ``global_index``: name it when the rows carry more than keys."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    out = global_index(df, order_by, partition_by=partition_by, name=index_name, key=key)
    return out.withColumn(name, F.floor(F.col(index_name) / F.lit(size)).cast("bigint"))


def shard_of(n: int, *key_cols) -> Column:
    """Shard number: md5 bits of the key modulo n."""
    s = F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols])
    return F.pmod(F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def assign_shards(df: DataFrame, n: int, key, name: str = "shard", repartition: bool = True) -> DataFrame:
    """Split rows over ``n`` workers (B3); optionally each shard is exactly one partition (the shard
    number is the partition number; hashing it would put two shards together and leave one empty)."""
    out = df.withColumn(name, shard_of(n, *_cols(key)))
    return out.repartitionById(n, F.col(name).cast("int")) if repartition else out


def repeat_rows(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    """Each row ``n`` times (B4), in-row explode: no shuffle."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else \
        df.withColumn(name, F.lit(None).cast("int")).limit(0)


def expand_epochs(df: DataFrame, epochs: int, seed: int, key, name: str = "epoch",
                  pos_name: str = "pos") -> DataFrame:
    """Multi-epoch pass reshuffled per epoch (B5): position inside each epoch."""
    k = _cols(key)
    ex = repeat_rows(df, epochs, name)
    ex = ex.withColumn("_shuffle", shuffle_key(seed, F.col(name), *k))
    return global_index(ex, ["_shuffle", *k], partition_by=[name], name=pos_name).drop("_shuffle")


def head_fraction(df: DataFrame, pct: float, order_by, index_name: str = "idx", key=None) -> DataFrame:
    """First ``pct`` percent of rows in order (S5): idx < floor(n * pct / 100), with n taken from the
    index itself.  ``key`` as in ``global_index``."""
    uk = _cols(key)
    narrow = df.select(*dict.fromkeys([*uk, *[c for c in _cols(order_by) if isinstance(c, str)]])) if uk else df
    index = global_index(narrow, order_by, name=index_name)
    keep = int((index.agg(F.max(index_name) + 1).first()[0] or 0) * pct // 100)
    index = index.filter(F.col(index_name) < F.lit(keep))
    return df.join(index.select(*uk, index_name), uk) if uk else index


def drop_tail(df: DataFrame, n: int, order_by, unique_key, index_name: str | None = None) -> DataFrame:
    """Hold out the last ``n`` rows in order (F2).

    For n up to TOPN_ROWS the tail is a top-n in reverse order (no full sort) removed with a
    broadcast anti-join on the unique key; a larger n falls back to the global index."""
    keys = _cols(order_by)
    uk = _cols(unique_key)
    if n <= 0:
        return df
    if n <= TOPN_ROWS and index_name is None:
        rev = [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in keys]
        tail = df.orderBy(*rev).limit(n).select(*uk)
        return df.join(F.broadcast(tail), uk, "left_anti")
    total = df.count()
    name = index_name or "_idx"
    out = global_index(df, keys, name=name).filter(F.col(name) < F.lit(total - n))
    return out if index_name else out.drop(name)


def mix(sources: dict[str, DataFrame], seed: int, key, name: str = "pos") -> DataFrame:
    """Concatenate sources, keeping duplicates, then a seeded shuffle (O1).

    Each row carries its ``source``; its shuffled position is ``name``.  Only (source, key) is shuffled
    and checkpointed; rows get the positions of their key back by a join.  Keys may repeat: equal
    keys are numbered on both sides."""
    frames = [df.withColumn("source", F.lit(src)) for src, df in sources.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    keys = ["source", *_cols(key)]
    index = shuffled_index(union.select(*keys), seed, keys, name=name)
    index = index.withColumn("_dup", F.row_number().over(Window.partitionBy(*keys).orderBy(name)))
    rows = union.withColumn("_dup", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    return rows.join(index, [*keys, "_dup"]).drop("_dup")


def running_sum(df: DataFrame, values: list[str], order_by, partition_by=None,
                suffix: str = "_cum", num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` in ``order_by`` order within ``partition_by`` groups.

    One full shuffle: range partitions, sorted and checkpointed as for the global index; every
    (partition, group) is run up where it lies (a window would shuffle the sorted rows again) and
    a prefix sum over their totals gives the offsets.  A group as large as a third of the data
    still spreads over many tasks.  NULL values add nothing and show the sum so far."""
    spark = df.sparkSession
    groups = _cols(partition_by)
    keys = groups + _cols(order_by)
    n = num_partitions or range_partitions(df)
    checkpoint_root(spark)
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.shiftright(F.monotonically_increasing_id(), _LOCAL_BITS))
              .checkpoint(eager=True))
    types = dict(tagged.dtypes)
    kind = {v: "bigint" if types[v] in ("tinyint", "smallint", "int", "bigint") else "double" for v in values}
    totals = tagged.groupBy("_pid", *groups).agg(*[F.sum(F.col(v).cast(kind[v])).alias(f"_t_{v}") for v in values])
    if groups:
        w = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offs = totals.select("_pid", *groups, *[F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)).alias(f"_o_{v}")
                                                for v in values])
    else:  # one row per partition: run up on the driver
        acc, data = {v: 0 if kind[v] == "bigint" else 0.0 for v in values}, []
        for r in sorted(totals.collect(), key=lambda r: r["_pid"]):
            data.append((r["_pid"], *[acc[v] for v in values]))
            acc = {v: acc[v] + (r[f"_t_{v}"] or 0) for v in values}
        offs = spark.createDataFrame(data, ", ".join(["_pid bigint"] + [f"_o_{v} {kind[v]}" for v in values]))
        offs = F.broadcast(offs)  # one row per range partition
    schema = ", ".join([f"`{c}` {t}" for c, t in tagged.dtypes] + [f"`_s_{v}` {kind[v]}" for v in values])
    run = tagged.mapInPandas(_run_up(groups, {v: kind[v] for v in values}), schema)
    same = F.lit(True)
    for g in ["_pid", *groups]:
        same = same & run[g].eqNullSafe(offs[g])
    out = run.join(offs, same)
    return out.select(*[run[c] for c in df.columns],
                      *[(run[f"_s_{v}"] + offs[f"_o_{v}"]).alias(f"{v}{suffix}") for v in values])


def _run_up(groups: list[str], kinds: dict[str, str]):
    """Running sums per group over the sorted batches of one partition; the last group carries on."""
    def run(batches):
        last, carry = None, {}
        for pdf in batches:
            if not len(pdf):
                continue
            code = pdf.groupby(groups, sort=False, dropna=False).ngroup() if groups else pdf["_pid"] * 0
            ends = tuple(None if pd.isna(x) else x for x in pdf[groups].iloc[-1]) if groups else ()
            first = tuple(None if pd.isna(x) else x for x in pdf[groups].iloc[0]) if groups else ()
            for v, kind in kinds.items():
                x = pdf[v].fillna(0).astype("int64" if kind == "bigint" else "float64")
                s = x.groupby(code).cumsum()
                if last == first:
                    s = s.where(code != code.iloc[0], s + carry[v])
                pdf[f"_s_{v}"] = s
            last, carry = ends, {v: pdf[f"_s_{v}"].iloc[-1] for v in kinds}
            yield pdf
    return run
