"""Helpers shared by the corpus operators: tables in the shared folder, running sums without a
hot task, word and name helpers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefengine.session import shared_dir

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder that the cluster shares (``spark.checkpoint.dir``) and read
    it back: cuts the lineage, survives lost executors and is not computed again by later jobs."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it carries."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = f"_{name}"
    return name


def running_sums(df: DataFrame, group: Sequence[str], bucket: str, order: Iterable[Column],
                 sums: dict[str, Column]) -> DataFrame:
    """Add, for each ``out: value`` of ``sums``, the sum of ``value`` over the rows of the same group
    that come before the row in the order (bucket, ``order``).

    A group is never sorted in one task: each (group, bucket) is summed on its own, the bucket
    totals are run up per group, and rows are only ordered inside their bucket.  Callers choose
    buckets so that each holds a bounded number of rows.  Group and bucket columns are not null."""
    order = list(order)
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(f"__t_{o}") for o, v in sums.items()])
    totals = totals.select(*keys, *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__b_{o}") for o in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(totals, keys)
    return joined.select(*df.columns, *[(F.col(f"__b_{o}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(o)
                                        for o, v in sums.items()])
