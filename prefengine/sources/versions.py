"""A small result table in versions: each micro-batch writes its own version and publishes it last.

A version is a folder ``epoch=<id>``; readers take the newest id that has a marker under ``_published``, so a
job that ends between deleting and writing leaves the version before to be read, and doing the same micro-batch
again replaces only its own version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """``schema`` is a DDL string; ``keep`` versions stay (readers of the last but one are not disturbed)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 3) -> None:
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, max(2, keep)
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def epochs(self) -> list[int]:
        """Published versions, oldest first."""
        folder = self._hadoop(f"{self.path}/_published")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder))

    def newest(self, before: int | None = None) -> int | None:
        """The newest published version (older than ``before``)."""
        known = [e for e in self.epochs() if before is None or e < before]
        return known[-1] if known else None

    def read(self, before: int | None = None) -> DataFrame:
        """The newest published version; no rows if there is none."""
        epoch = self.newest(before)
        if epoch is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/epoch={epoch}")

    def write(self, rows: DataFrame, epoch: int) -> None:
        """Write version ``epoch`` and publish it; a version of that id is replaced.  Later ones mean
        that the table belongs to another stream."""
        if any(e > epoch for e in self.epochs()):
            raise ValueError(f"{self.path} has versions after {epoch}: it belongs to another checkpoint")
        marker = self._hadoop(f"{self.path}/_published/{epoch}")
        self._fs.delete(marker, False)
        rows.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        self._fs.create(marker, True).close()
        for old in self.epochs()[:-self.keep]:
            self._fs.delete(self._hadoop(f"{self.path}/_published/{old}"), False)
            self._fs.delete(self._hadoop(f"{self.path}/epoch={old}"), True)
