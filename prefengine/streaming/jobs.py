"""Structured Streaming jobs (ST1-ST3, online pairs, metrics by count).

Every job reads a file source, writes an append/complete sink with a checkpoint folder in
the shared checkpoint location, and can run to completion with ``trigger(availableNow=True)``;
a rerun from the same checkpoint processes only new files (exactly-once file sink)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefengine.functions.math import fixed_point_mean
from prefengine.functions.time import utc_instant, utc_wall
from prefengine.operators.order import global_index
from prefengine.operators.pairs import candidate_pairs, label_pairs, score_pairs
from prefengine.session import materialize
from prefengine.sources.versions import VersionedTable


def label_stream(candidates: DataFrame, scores: DataFrame, k: int = 4) -> DataFrame:
    """Continuous labelling (ST1): candidate-set stream -> first K pairs (stateless, in-row)
    -> stream-static joins to the score table -> order by score (offline tie rule)."""
    pairs = candidate_pairs(candidates.select("conv_id", "turns"), k, col="turns",
                            first="first_turn", second="second_turn")
    scored = score_pairs(pairs, scores, ["conv_id", "turn"], ["conv_id", "first_turn"], ["conv_id", "second_turn"])
    lab = label_pairs(scored, tie="second", unscored="raise", first="first_turn", second="second_turn")
    return lab.select("conv_id", "pair_idx", F.col("chosen").alias("chosen_turn"),
                      F.col("rejected").alias("rejected_turn"), "chosen_score", "rejected_score")


def accuracy_stream(pairs: DataFrame, run: str = "run") -> DataFrame:
    """Running accuracy and count per run (ST2): a stateful streaming aggregation."""
    hit = (F.col("chosen_score") > F.col("rejected_score")).cast("double")
    return pairs.groupBy(run).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n_pairs"))


def metric_stream(events: DataFrame, window: str = "1 day", delay: str = "1 hour", ts: str = "ts",
                  key: str = "event_id", by: str = "event_type", scale: int | None = 2) -> DataFrame:
    """Metric means per tumbling window with a late-data bound and id dedup (ST3).

    A timestamp_ntz column is read as UTC wall time (``functions.time.utc_instant``) before
    the watermark, so windows do not depend on the session time zone; window bounds are
    returned as UTC wall times."""
    if dict(events.dtypes)[ts] == "timestamp_ntz":
        events = events.withColumn(ts, utc_instant(ts))
    e = events.withWatermark(ts, delay)
    e = e.dropDuplicatesWithinWatermark([key])
    return (e.groupBy(F.window(ts, window).alias("w"), by)
            .agg((fixed_point_mean("value", scale) if scale is not None else F.avg("value")).alias("mean_value"),
                 F.count(F.lit(1)).alias("n"))
            .select(utc_wall("w.start").alias("window_start"), utc_wall("w.end").alias("window_end"), by,
                    "mean_value", "n"))


def _start(writer, spark: SparkSession, state_partitions: int | None) -> StreamingQuery:
    """Start a query; ``state_partitions`` fixes the number of state-store partitions (taken
    from spark.sql.shuffle.partitions at the first start and kept in the checkpoint)."""
    if state_partitions is None:
        return writer.start()
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, old)


def run_append(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
               state_partitions: int | None = None) -> StreamingQuery:
    """Append sink (file formats are exactly-once with the checkpoint); runs what is available."""
    w = (df.writeStream.format(fmt).outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    q = _start(w, df.sparkSession, state_partitions)
    q.awaitTermination()
    return q


def online_pair_stream(samples: DataFrame, key: list[str], rank: str, carry: list[str], ts: str = "ts", wait: str = "1 hour",
                       unpaired: bool = False) -> DataFrame:
    """Two samples of a prompt side by side as soon as both are there (N2 as a stream).

    The state holds a prompt's sample 0 until its sample 1 arrives, or the other way round; the pair is emitted
    once.  A sample that comes again inside the wait is dropped, one that waited longer than ``wait`` (event
    time) expires, and one older than the watermark is not taken.  Both steps are built-in stateful
    operators, keyed by prompt.  With ``unpaired`` only the expired samples come, with what they miss null."""
    sides = []
    for k in (0, 1):
        # the predicate reads the event time, so it stays above the watermark: the clock of both sides is that of all samples
        own = (F.col(rank) + F.unix_micros(ts) * 0) == k
        one = samples.withWatermark(ts, wait).filter(own).dropDuplicatesWithinWatermark([*key, rank])
        sides.append(one.select(*[F.col(c).alias(f"{c}_{k}") for c in [*key, *carry, ts]]))
    first, second = sides
    same = F.lit(True)
    for c in key:
        same = same & (F.col(f"{c}_0") == F.col(f"{c}_1"))
    near = F.expr(f"{ts}_1 >= {ts}_0 - INTERVAL {wait} AND {ts}_1 <= {ts}_0 + INTERVAL {wait}")
    two = first.join(second, same & near, "full_outer" if unpaired else "inner")
    found = two.select(*[F.coalesce(f"{c}_0", f"{c}_1").alias(c) for c in key], *[f"{c}_{k}" for c in carry for k in (0, 1)], f"{ts}_0", f"{ts}_1")
    return found.filter(F.col(f"{ts}_0").isNull() | F.col(f"{ts}_1").isNull()) if unpaired else found


def online_label_stream(samples: DataFrame, key: list[str], rank: str = "cand_idx", sample: str = "turn", score: str = "score",
                        ts: str = "ts", wait: str = "1 hour") -> DataFrame:
    """Online labelling (N2, R5): pairs of samples ordered by score, the first wins a tie."""
    two = online_pair_stream(samples, key, rank, [sample, score], ts, wait)
    lab = label_pairs(two, tie="first", unscored="raise", first=f"{sample}_0", second=f"{sample}_1", first_score=f"{score}_0", second_score=f"{score}_1")
    return lab.select(*key, "chosen", "rejected", "chosen_score", "rejected_score")


def run_update(df: DataFrame, table: VersionedTable, key: list[str], checkpoint: str, state_partitions: int | None = None) -> StreamingQuery:
    """Update-mode aggregation into a versioned table: a micro-batch brings the keys that changed, the next
    version is the last one with them replaced.  Doing a micro-batch again gives the same version."""
    def write(batch: DataFrame, epoch: int) -> None:
        changed = materialize(batch, "changed")
        table.write(table.read(before=epoch).join(changed.select(*key), key, "left_anti").unionByName(changed), epoch)

    w = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = _start(w, df.sparkSession, state_partitions)
    q.awaitTermination()
    return q


#: Parts that the rows of one run are dealt into where they meet the run's counter.
SALTS = 16


class IntervalMeans:
    """Logging by count (M4 as a stream): per run a row counter and the sums of the open interval.

    A mean record comes out when ``batch_size`` x ``accumulation`` rows of a run have been seen, whatever
    micro-batches they came in; then sums start anew.  Rows count in order of arrival, inside a micro-batch by
    ``order_by``.  The counters are a versioned table and the records of a micro-batch a folder of their own, so a
    micro-batch done again changes nothing.  Rows are numbered by range partitions and summed before they meet, so
    a run with most of the rows is no single task's."""

    def __init__(self, spark: SparkSession, path: str, run: str, order_by: list[str], metrics: list[str], batch_size: int,
                 accumulation: int, scale: int = 2, run_type: str = "long") -> None:
        self.spark, self.run, self.order_by, self.metrics = spark, run, order_by, metrics
        self.per, self.scale, self.path = batch_size * accumulation, scale, path.rstrip("/")
        number = f"decimal(38,{scale})"
        self.fields = ", ".join(f"{m} {number}, n_{m} long" for m in metrics)
        self.state = VersionedTable(spark, f"{self.path}/state", f"{run} {run_type}, seen long, examples long, {self.fields}")
        self.schema = f"{run} {run_type}, interval long, examples long, {self.fields}"

    def _sums(self, rows: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for m in self.metrics for c in (m, f"n_{m}")]
        return rows.groupBy(self.run, "interval").agg(F.sum("examples").cast("long").alias("examples"), *sums)

    def take(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch: the body of ``foreachBatch``."""
        before = materialize(self.state.read(before=epoch), "counters")
        rows = global_index(batch.select(self.run, *self.order_by, *self.metrics), self.order_by, partition_by=[self.run], name="_i")
        salted = before.select(F.col(self.run).alias("_run"), "seen").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_at", F.pmod(F.xxhash64("_i"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, (F.col(self.run).eqNullSafe(F.col("_run"))) & (F.col("_at") == F.col("_salt")), "left")
        interval = F.floor((F.coalesce("seen", F.lit(0)) + F.col("_i")) / self.per)
        values = [c for m in self.metrics for c in (F.coalesce(F.col(m), F.lit(0)).cast(f"decimal(38,{self.scale})").alias(m), F.col(m).isNotNull().cast("long").alias(f"n_{m}"))]
        fresh = self._sums(rows.select(self.run, interval.alias("interval"), F.lit(1).alias("examples"), *values))
        held = before.filter("examples > 0").withColumn("interval", F.floor(F.col("seen") / self.per)).select(fresh.columns)
        sums = materialize(self._sums(fresh.unionByName(held)), "intervals")
        sums.filter(F.col("examples") == self.per).write.mode("overwrite").parquet(f"{self.path}/records/epoch={epoch}")
        is_open = F.col("examples") < self.per
        after = sums.groupBy(self.run).agg(F.max(F.col("interval") * self.per + F.col("examples")).alias("seen"),
                                           *[F.coalesce(F.sum(F.when(is_open, F.col(c))), F.lit(0)).cast(kind).alias(c)
                                             for c, kind in [tuple(f.split()) for f in ["examples long", *self.fields.split(", ")]]])
        idle = before.join(after.select(F.col(self.run).alias("_run")), F.col(self.run).eqNullSafe(F.col("_run")), "left_anti")
        self.state.write(after.unionByName(idle), epoch)

    def run_stream(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take what is available."""
        q = rows.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    def _means(self, sums: DataFrame) -> DataFrame:
        mean = [F.try_divide(F.col(m).cast("double"), F.col(f"n_{m}").cast("double")).alias(m) for m in self.metrics]
        return sums.select(self.run, "interval", "examples", *mean)

    def records(self, open_intervals: bool = False) -> DataFrame:
        """The records of all published micro-batches; with ``open_intervals`` also what the open ones hold so far."""
        newest = self.state.newest()
        if newest is None:
            return self._means(self.spark.createDataFrame([], self.schema))
        schema = f"{self.schema}, epoch long"
        sums = self.spark.read.schema(schema).parquet(f"{self.path}/records").filter(F.col("epoch") <= newest).drop("epoch")
        if open_intervals:
            held = self.state.read().filter("examples > 0").withColumn("interval", F.floor(F.col("seen") / self.per))
            sums = sums.unionByName(held.select(sums.columns))
        return self._means(sums)


def file_stream(spark: SparkSession, path: str, fmt: str, schema, glob: str | None = None) -> DataFrame:
    """File source over a folder; ``glob`` keeps only matching file names."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)
