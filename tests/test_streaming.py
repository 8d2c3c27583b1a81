"""ST1-ST3: stream = batch, rerun from checkpoint adds nothing, dedup and late data."""

import os
import tempfile

from pyspark.sql import functions as F

from prefengine.operators.pairs import candidate_pairs, label_pairs, score_pairs
from prefengine.session import shared_dir
from prefengine.sources import driver_tables as D
from prefengine.sources.sinks import write_jsonl
from prefengine.sources.versions import VersionedTable
from prefengine.streaming import jobs as S
from tests.conftest import SF_SMOKE

CAND_SCHEMA = "conv_id bigint, prompt string, turns array<bigint>, completion array<string>"
LABEL_COLS = ["conv_id", "pair_idx", "chosen_turn", "rejected_turn", "chosen_score", "rejected_score"]


def test_label_stream_equals_batch_and_rerun_adds_nothing(spark):
    conv = spark.read.parquet(f"{SF_SMOKE}/conversations.parquet")
    sets = D.candidate_sets(conv, max_candidates=5).select("conv_id", "prompt", "turns", "completion")
    src = shared_dir(spark, "t-cands")
    write_jsonl(sets, src)
    scores = D.turn_scores(conv)
    out, ck = shared_dir(spark, "t-labels"), shared_dir(spark, "t-labels-ckpt")
    stream = S.file_stream(spark, src, "json", CAND_SCHEMA)
    S.run_append(S.label_stream(stream, scores), out, ck, fmt="json")
    got = sorted(tuple(r) for r in spark.read.json(out).select(*LABEL_COLS).collect())
    pairs = candidate_pairs(sets.select("conv_id", "turns"), 4, col="turns", first="first_turn", second="second_turn")
    batch = label_pairs(score_pairs(pairs, scores, ["conv_id", "turn"], ["conv_id", "first_turn"],
                                    ["conv_id", "second_turn"]), first="first_turn", second="second_turn")
    want = sorted(tuple(r) for r in batch.select("conv_id", "pair_idx", F.col("chosen").alias("chosen_turn"),
                                                 F.col("rejected").alias("rejected_turn"), "chosen_score",
                                                 "rejected_score").collect())
    assert got == want and len(got) > 0
    # rerun from the same checkpoint: no new input, no new output
    stream2 = S.file_stream(spark, src, "json", CAND_SCHEMA)
    S.run_append(S.label_stream(stream2, scores), out, ck, fmt="json")
    assert spark.read.json(out).count() == len(got)


def test_metric_stream_dedup_and_late(spark):
    d = tempfile.mkdtemp(prefix="prefengine-ev-")
    rows = [(1, "2024-01-01 10:00:00", "a", 1.0), (1, "2024-01-01 10:00:00", "a", 1.0),  # duplicate id
            (2, "2024-01-01 12:00:00", "a", 3.0), (3, "2024-01-03 00:00:00", "a", 5.0)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, event_type string, value double") \
        .withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(os.path.join(d, "b1"))
    late = spark.createDataFrame([(4, "2024-01-01 09:00:00", "a", 100.0)],
                                 "event_id bigint, ts string, event_type string, value double") \
        .withColumn("ts", F.to_timestamp("ts"))
    schema = df.schema
    out, ck = shared_dir(spark, "t-metrics"), shared_dir(spark, "t-metrics-ckpt")
    S.run_append(S.metric_stream(S.file_stream(spark, d + "/*", "parquet", schema), "1 day", "1 hour"), out, ck)
    late.write.parquet(os.path.join(d, "b2"))   # arrives after the watermark passed day 1
    S.run_append(S.metric_stream(S.file_stream(spark, d + "/*", "parquet", schema), "1 day", "1 hour"), out, ck)
    res = spark.read.parquet(out).collect()
    day1 = [r for r in res if str(r["window_start"]).startswith("2024-01-01")]
    assert len(day1) == 1 and day1[0]["n"] == 2 and day1[0]["mean_value"] == 2.0


def test_accuracy_stream(spark):
    d = tempfile.mkdtemp(prefix="prefengine-acc-")
    spark.createDataFrame([(0, 2.0, 1.0), (0, 1.0, 2.0), (1, 3.0, 0.0)],
                          "run int, chosen_score double, rejected_score double").write.parquet(d + "/p")
    schema = "run int, chosen_score double, rejected_score double"
    out = VersionedTable(spark, shared_dir(spark, "t-acc"), "run int, accuracy double, n_pairs bigint")
    S.run_update(S.accuracy_stream(S.file_stream(spark, d + "/p", "parquet", schema)), out, ["run"], shared_dir(spark, "t-acc-ckpt"))
    got = {r["run"]: (r["accuracy"], r["n_pairs"]) for r in out.read().collect()}
    assert got == {0: (0.5, 2), 1: (1.0, 1)}


def test_metric_stream_equals_batch_twin_on_events(spark):
    """Closed 1-day windows of the events stream equal the batch twin restricted to windows
    that end before the watermark."""
    import __spark_entry__ as E
    qs = E.queries()
    stream = sorted(tuple(r) for r in qs["stream_metrics"](spark, SF_SMOKE).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), F.date_format("window_end", "yyyy-MM-dd HH:mm:ss"),
        "event_type", "mean_value", "n").collect())
    batch = sorted(tuple(r) for r in qs["metric_windows"](spark, SF_SMOKE).select(
        "window_start", "window_end", "event_type", "mean_value", "n").collect())
    assert stream == batch and len(batch) > 0


def test_results_do_not_depend_on_session_zone(spark):
    """timestamp_ntz event times are read as UTC wall time: windows and throughput are the same
    in a session whose zone is not UTC."""
    import __spark_entry__ as E
    qs = E.queries()

    def run():
        w = sorted(tuple(r) for r in qs["metric_windows"](spark, SF_SMOKE).collect())
        t = sorted(tuple(r) for r in qs["throughput"](spark, SF_SMOKE).collect())
        return w, t
    utc = run()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        other = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc == other
