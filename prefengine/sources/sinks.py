"""Sinks (K1-K3): parallel JSON Lines part files and partitioned metric tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Candidate sets / labelled pairs as JSON Lines part files, one per task (K1)."""
    df.write.mode(mode).json(path)


def write_json_arrays(df: DataFrame, path: str, chunk: str, files: int) -> None:
    """Files that each hold one JSON array of the rows with the same ``chunk`` (an int from 0 to ``files`` - 1), indented as the
    reference's writer does it (what ``read_json_array`` cuts).  A task writes a file object by object: it never
    holds an array."""
    rows = df.select(F.col(chunk).cast("int").alias("_chunk"), F.to_json(F.struct(*[c for c in df.columns if c != chunk]), {"pretty": "true"}).alias("value"))

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                # each object is held back until it is known whether another follows
                yield _lines(["["] if last is None else [last + ","], [t + "," for t in texts[:-1]])
                last = texts[-1]
        if last is not None:
            yield _lines([last, "]"])

    dealt = rows.repartitionById(files, "_chunk").select("value")
    dealt.mapInArrow(frame, "value string").write.text(path)


def _lines(*parts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"value": pa.array([x for part in parts for x in part], pa.string())})


def write_metrics(df: DataFrame, path: str, partition_by: str = "run", batch: str | None = None) -> None:
    """Add metric rows to a parquet table partitioned by run (K3).

    With ``batch`` (a name for this set of rows, e.g. the step of the job) the rows go to a partition
    of their own, and writing the same batch again replaces it; without, every call appends."""
    if batch is None:
        df.write.mode("append").partitionBy(partition_by).parquet(path)
    else:
        (df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition_by, "batch").parquet(path))
