"""Streaming queries (ST1-ST3, K1, K2) run with availableNow, plus the batch twin of ST3."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefengine.session import shared_dir
from prefengine.sources import driver_tables as D
from prefengine.sources.sinks import write_jsonl
from prefengine.sources.versions import VersionedTable
from prefengine.streaming import jobs as S
from prefengine.functions.math import fixed_point_mean
from prefengine.functions.time import utc_instant, utc_wall
from prefengine.plans import q_pairs  # noqa: F401 - registers label_offline, whose SQL the stream jobs share
from prefengine.plans import q_train  # registers interval_means, whose SQL the stream job shares
from prefengine.plans.registry import ORACLE, register, sql_fixed_mean, sql_r, table


def _state_partitions(spark) -> int:
    """State-store partitions: the cluster's parallelism, not a fixed 200."""
    return spark.sparkContext.defaultParallelism


CANDIDATE_SCHEMA = "conv_id bigint, prompt string, turns array<bigint>, completion array<string>"
WINDOW, DELAY = "1 day", "1 hour"


def _candidate_files(spark, sf, k=4) -> str:
    """Candidate sets written as JSON Lines part files (K1): the stream's input folder."""
    conv = table(spark, sf, "conversations")
    sets = D.candidate_sets(conv, max_candidates=k + 1).select("conv_id", "prompt", "turns", "completion")
    path = shared_dir(spark, "candidates")
    write_jsonl(sets, path)
    return path


def _labelled_stream_output(spark, sf) -> str:
    src = _candidate_files(spark, sf)
    stream = S.file_stream(spark, src, "json", CANDIDATE_SCHEMA)
    out, ck = shared_dir(spark, "labels"), shared_dir(spark, "labels-ckpt")
    S.run_append(S.label_stream(stream, D.turn_scores(table(spark, sf, "conversations"))), out, ck, fmt="json")
    return out


LABEL_SCHEMA = ("conv_id bigint, pair_idx bigint, chosen_turn bigint, rejected_turn bigint, "
                "chosen_score double, rejected_score double")


# -- ST1 K1 K2: candidate-set files -> stream of labelled pairs (JSON Lines, append, checkpointed)
@register("stream_label", ORACLE["label_offline"])  # the same labels as the batch job
def stream_label(spark, sf):
    return spark.read.schema(LABEL_SCHEMA).json(_labelled_stream_output(spark, sf))


# -- ST2: running accuracy / counts per run over the labelled-pair stream (run = conv_id % 5)
@register("stream_accuracy", f"""
WITH lab AS ({ORACLE["label_offline"]})
SELECT conv_id % 5 AS run, {sql_r('avg(CASE WHEN chosen_score > rejected_score THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n_pairs
FROM lab GROUP BY conv_id % 5
""")
def stream_accuracy(spark, sf):
    labelled = _labelled_stream_output(spark, sf)
    pairs = S.file_stream(spark, labelled, "json", LABEL_SCHEMA).withColumn("run", F.col("conv_id") % 5)
    result = VersionedTable(spark, shared_dir(spark, "accuracy"), "run bigint, accuracy double, n_pairs bigint")
    S.run_update(S.accuracy_stream(pairs), result, ["run"], shared_dir(spark, "accuracy-ckpt"), state_partitions=_state_partitions(spark))
    return result.read().withColumn("accuracy", F.round("accuracy", 6))


_WINDOWS_SQL = f"""
WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, value FROM events),
lim AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(window_start + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, {sql_fixed_mean('value')} AS mean_value, count(*) AS n
FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT wm FROM lim)
GROUP BY window_start, event_type
"""
_TIME = "yyyy-MM-dd HH:mm:ss"


# -- ST3: metric means per 1-day window, 1-hour watermark, id dedup (closed windows are emitted)
@register("stream_metrics", _WINDOWS_SQL)
def stream_metrics(spark, sf):
    path = f"{sf.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = S.file_stream(spark, sf, "parquet", schema, glob="events.parquet")
    out, ck = shared_dir(spark, "metrics"), shared_dir(spark, "metrics-ckpt")
    S.run_append(S.metric_stream(events, WINDOW, DELAY), out, ck, state_partitions=_state_partitions(spark))
    return spark.read.parquet(out).select(F.date_format("window_start", _TIME).alias("window_start"),
                                          F.date_format("window_end", _TIME).alias("window_end"),
                                          "event_type", "mean_value", "n")


# -- ST3 batch twin: the same windows in batch, closed ones only (end <= max ts - delay)
@register("metric_windows", _WINDOWS_SQL)
def metric_windows(spark, sf):
    ev = table(spark, sf, "events").withColumn("ts", utc_instant("ts"))
    wm = ev.agg(F.max("ts") - F.expr(f"INTERVAL {DELAY}")).scalar()
    g = (ev.groupBy(F.window("ts", WINDOW).alias("w"), "event_type")
         .agg(fixed_point_mean("value").alias("mean_value"), F.count(F.lit(1)).alias("n"))
         .filter(F.col("w.end") <= wm))
    return g.select(F.date_format(utc_wall("w.start"), _TIME).alias("window_start"),
                    F.date_format(utc_wall("w.end"), _TIME).alias("window_end"),
                    "event_type", "mean_value", "n")


# -- N2 R5 as a stream: the samples of a prompt arrive one after the other; the state pairs them
SAMPLE_SCHEMA = "conv_id bigint, cand_idx bigint, turn bigint, score double, ts timestamp"


@register("stream_online_pairs", ORACLE["label_online"])  # the same pairs as the batch job
def stream_online_pairs(spark, sf):
    """First all first samples arrive, then all second ones; both rounds are one stream with one checkpoint."""
    cands = D.first_candidates(table(spark, sf, "conversations"), 2).withColumn("score", D.text_score("completion"))
    cands = cands.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("cand_idx") * 60)).select("conv_id", "cand_idx", "turn", "score", "ts")
    src, out, ck = (shared_dir(spark, f"online-{x}") for x in ("samples", "pairs", "ckpt"))
    for k in (0, 1):
        cands.filter(F.col("cand_idx") == k).write.mode("append").parquet(src)
        stream = S.file_stream(spark, src, "parquet", SAMPLE_SCHEMA)
        S.run_append(S.online_label_stream(stream, ["conv_id"]), out, ck, state_partitions=_state_partitions(spark))
    pairs = spark.read.schema("conv_id bigint, chosen bigint, rejected bigint, chosen_score double, rejected_score double").parquet(out)
    return pairs.withColumnsRenamed({"chosen": "chosen_turn", "rejected": "rejected_turn"})


# -- M4 as a stream: the metric log arrives in three parts that cut through the intervals
ARRIVALS = 3
LOG_SCHEMA = "run bigint, idx bigint, value double, click double, purchase double"


@register("stream_interval_means", ORACLE["interval_means"])  # the same records as the batch job, the open intervals included
def stream_interval_means(spark, sf):
    log = D.metric_log(table(spark, sf, "events")).withColumns({c: F.when(F.col("metric") == c, F.col("value")) for c in ("click", "purchase")})
    log = log.select("run", "idx", "value", "click", "purchase")
    low, high = log.agg(F.min("idx"), F.max("idx")).first()
    src, ck = shared_dir(spark, "log"), shared_dir(spark, "log-ckpt")
    means = S.IntervalMeans(spark, shared_dir(spark, "intervals"), "run", ["idx"], ["value", "click", "purchase"], q_train.BATCH, q_train.ACCUM)
    for k in range(ARRIVALS if low is not None else 0):
        edges = [low + (high + 1 - low) * j // ARRIVALS for j in (k, k + 1)]
        log.filter((F.col("idx") >= edges[0]) & (F.col("idx") < edges[1])).write.mode("append").parquet(src)
        means.run_stream(S.file_stream(spark, src, "parquet", LOG_SCHEMA), ck)
    return means.records(open_intervals=True)
