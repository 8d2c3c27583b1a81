"""Session helper, shared-folder resolution and driver-side schema checks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "prefengine",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, pass the cluster's own builder settings instead.

    The UI stays off; AQE (coalescing + skew join) is on; the session zone is UTC so
    timestamps agree with the SQL oracle.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests, laptop runs) may name none: it gets a private folder.  On a
    cluster a folder of one machine would be read by the others, so that is an error."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base:
        return base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="prefengine-ckpt-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


_folders: list[str] = []
_tables: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (stream outputs, state, written tables);
    ``release`` deletes it."""
    root = checkpoint_root(spark)
    _folders.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return _folders[-1]


def release(spark: SparkSession) -> int:
    """Delete every folder that ``shared_dir`` gave out, with the tables on them, and drop cached tables.  For callers that are
    done with all results of the queries so far (bench, notebooks): results read from these folders
    can't be computed again afterwards.  Returns the number of folders."""
    spark.catalog.clearCache()
    for table in _tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    _tables.clear()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in _folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    n = len(_folders)
    _folders.clear()
    return n


def require_columns(df: DataFrame, *cols: str) -> None:
    """Driver-side check (schema only, no scan); raises ValueError naming what is missing."""
    have = set(df.columns)
    missing = [c for c in cols if c not in have]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {sorted(have)}")


def spread(df: DataFrame) -> DataFrame:
    """Deal ``df`` (a scan) over all cores if its files make fewer partitions than there are cores:
    a small file with one row group would otherwise be processed by one task.  The number of
    partitions comes from the plan's size estimate and the scan's split size; no job runs."""
    spark = df.sparkSession
    size = plan_bytes(df)
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    cores = spark.sparkContext.defaultParallelism
    return df if size is None or size >= cores * split else df.repartition(cores)


#: Size estimates from here on stand for "unknown" (frames made of RDDs or checkpoints).
_UNKNOWN_BYTES = 1 << 60


def plan_bytes(df: DataFrame) -> int | None:
    """Size estimate of ``df`` (no job runs); None if there is none.

    The optimized plan's own estimate, or the sum of the tables it reads if that is less: without
    column statistics Spark takes a join for the product of its sides.  A checkpoint keeps the estimate
    of the plan it was made from, that product; its files count instead."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [_leaf_bytes(df.sparkSession, leaves.apply(i)) for i in range(leaves.size())]
    known = [n for n in sizes if n < _UNKNOWN_BYTES]
    own = int(str(plan.stats().sizeInBytes()))
    return min(own, sum(known)) if known else (own if own < _UNKNOWN_BYTES else None)


def _leaf_bytes(spark: SparkSession, leaf) -> int:
    if leaf.getClass().getSimpleName() == "LogicalRDD":
        file = leaf.rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return int(str(leaf.stats().sizeInBytes()))


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings (their dots as double underscores) for the time of one write."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: A written table needs no shuffle file of the write any more; Spark would keep them until the driver collects its garbage.
_FREED = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


def materialize(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` (a table read several times: fitted models, vocabularies, per-candidate scores)
    once to the shared folder and read it back.

    Lost executors cost nothing, joins see a plain scan with its real size (so adaptive execution
    can broadcast or split it), and ``release`` deletes it."""
    path = shared_dir(df.sparkSession, name)
    with _set(df.sparkSession, **_FREED):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files that a task of ``materialize_buckets`` keeps open before it sorts its rows.
FOLDERS = 16


def materialize_buckets(df: DataFrame, name: str, folders: str, by: list[str], buckets: int) -> DataFrame:
    """``materialize`` for a table that is joined on ``by``: written in as many ``buckets`` (``df`` is hash-partitioned
    that way), so the join doesn't shuffle it again, with a folder per value of ``folders``."""
    path = shared_dir(df.sparkSession, name)
    _tables.append(path.rsplit("/", 1)[1].replace("-", "_"))
    spark = df.sparkSession
    with _set(spark, spark__sql__maxConcurrentOutputFileWriters=str(FOLDERS), **_FREED):  # a task writes one bucket in few folders: nothing to sort
        df.write.option("path", path).option("compression", "zstd").partitionBy(folders).bucketBy(buckets, *by).saveAsTable(_tables[-1], format="parquet")
    return spark.table(_tables[-1])
