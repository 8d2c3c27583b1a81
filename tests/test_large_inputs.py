"""Array files cut into pieces (S2), JSON Lines with bad lines (S1), logits in chunks (L1-L3), onset (V5), Newton fit (G1)."""

import json
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefengine.functions.math import seq_logp
from prefengine.operators import evaluate as V
from prefengine.operators import fit as G
from prefengine.operators import logprob as L
from prefengine.plans.q_logprob import logit_chunks
from prefengine.sources import readers as R
from prefengine.sources.sinks import write_json_arrays

ITEM = "prompt string, n int, tags array<string>"


def write_array(path, items):
    """As the reference's writer frames it."""
    with open(path, "w") as f:
        f.write("[\n" + ",\n".join(json.dumps(x, indent=2) for x in items) + "\n]")


@pytest.fixture
def splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, old)


def test_one_array_file_is_read_by_many_tasks(spark, splits):
    d = tempfile.mkdtemp(prefix="prefengine-array-")
    items = [{"prompt": 'a\n},\n{\n"b" ]\n', "n": 1, "tags": ["x", "]", "}"]}, {}, {"n": 2, "tags": []}, {"prompt": "é\U0001f600 { [", "n": None, "other": {"n": 3}}, {}, {}]
    items += [{"prompt": f"p{i}" * (i % 7), "n": i, "tags": [str(i)] * (i % 3)} for i in range(60)] + [{"n": 99, "tags": ["]"]}]
    write_array(f"{d}/one.json", items)
    want = sorted((x.get("prompt") or "", -1 if x.get("n") is None else x["n"], x.get("tags") or []) for x in items)
    for size in [*range(40, 64), 97, 512, 1 << 20]:
        splits(size)
        df = R.read_json_array(spark, f"{d}/one.json", ITEM)
        got = sorted((r["prompt"] or "", -1 if r["n"] is None else r["n"], r["tags"] or []) for r in df.collect())
        assert got == want, size
        assert size > 1000 or df.rdd.getNumPartitions() > 1


def test_other_array_files(spark):
    d = tempfile.mkdtemp(prefix="prefengine-array-")
    for name, text, n in (("compact", '[{"n": 1}, {"n": 2, "tags": ["]"]}]', 2), ("four", json.dumps([{"n": 1}, {"n": 2}], indent=4), 2), ("none", "[\n\n]", 0),
                          ("blank", "[]", 0), ("one", '[\n{\n  "n": 5\n}\n]\n', 1), ("lists", '[\n{\n  "tags": [\n    "a"\n  ]\n},\n{\n  "tags": [\n    "b"\n  ]\n}\n]', 2), ("empty", "", 0)):
        with open(f"{d}/{name}.json", "w") as f:
            f.write(text)
        assert R.read_json_array(spark, f"{d}/{name}.json", ITEM).count() == n, name
    for name, text in (("torn", '[\n{\n  "n": 1\n},\n{\n  "n": '), ("typed", '[\n{\n  "n": "x"\n}\n]')):
        with open(f"{d}/{name}.json", "w") as f:
            f.write(text)
        with pytest.raises(Exception):
            R.read_json_array(spark, f"{d}/{name}.json", ITEM).collect()


def test_arrays_written_by_tasks_are_arrays(spark):
    d = tempfile.mkdtemp(prefix="prefengine-array-")
    df = spark.range(500).select(F.col("id").cast("int").alias("n"), F.lit('t"\n}').alias("prompt"), (F.col("id") % 3).alias("f"))
    write_json_arrays(df, f"{d}/a", "f", 5)
    texts = [open(f"{d}/a/{f}").read() for f in os.listdir(f"{d}/a") if f.startswith("part") and os.path.getsize(f"{d}/a/{f}")]
    assert len(texts) == 3 and sorted(x["n"] for t in texts for x in json.loads(t)) == list(range(500))
    assert R.read_json_array(spark, f"{d}/a", ITEM).agg(F.sum("n")).first()[0] == 124750


def test_quarantine(spark):
    d = tempfile.mkdtemp(prefix="prefengine-lines-")
    good = [{"prompt": f"p{i}", "n": i, "tags": ["a"]} for i in range(20)] + [{"prompt": None}, {}, {"n": 7, "extra": 1}]
    bad = {'{"prompt": "p", "n": 1': "truncated", "{": "truncated", "plain": "syntax", '{"n": 1}}': "syntax", "[1, 2]": "not an object", "3": "not an object",
           '{"n": "x"}': "wrong type: n", '{"n": [1], "tags": 5}': "wrong type: n, tags", '{"n": 12345678901}': "wrong type: n"}
    with open(f"{d}/x.jsonl", "w") as f:
        f.write("\n".join([json.dumps(x) for x in good[:10]] + list(bad) + ["", "   "] + [json.dumps(x) for x in good[10:]]) + "\n")
    rows, lines = R.read_jsonl_quarantine(spark, f"{d}/x.jsonl", ITEM, max_bad=0.5)
    got = sorted((r["prompt"] or "", r["n"] if r["n"] is not None else -1, r["tags"] or []) for r in rows.collect())
    assert got == sorted((x.get("prompt") or "", x.get("n", -1), x.get("tags") or []) for x in good)
    assert rows.columns == ["prompt", "n", "tags"]
    found = {r["line"]: r["reason"] for r in lines.collect()}
    assert found == bad and all(r["file"].endswith("x.jsonl") for r in lines.collect())
    with pytest.raises(R.QuarantineExceeded):
        R.read_jsonl_quarantine(spark, f"{d}/x.jsonl", ITEM)
    with open(f"{d}/none.jsonl", "w"):
        pass
    assert [t.count() for t in R.read_jsonl_quarantine(spark, f"{d}/none.jsonl", ITEM)] == [0, 0]


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == pytest.approx(b, rel=1e-12) or (math.isnan(a) and math.isnan(b))))


def test_chunked_logps_equal_whole_rows(spark):
    rng = np.random.default_rng(4)
    inf = float("inf")
    rows = []
    for i in range(12):
        labels = [-100 if rng.random() < 0.3 else int(rng.integers(0, 8)) for _ in range(6)]
        rows.append((i, [[float(x) for x in rng.normal(size=8) * rng.choice([1, 400])] for _ in range(6)], labels))
    rows.append((20, [[0.0] * 8] * 3, [1, -100, -100]))                       # nothing scored
    rows.append((21, [[-inf, 1.0, 2.0, -inf, -inf, -inf, -inf, 0.5]] * 2, [0, 2]))
    rows.append((22, [[-inf, 1.0, 2.0, -inf, -inf, -inf, -inf, 0.5]] * 2, [0, 0]))  # the label itself is -inf
    rows.append((23, [[inf] + [0.0] * 7] * 2, [0, 1]))
    rows.append((24, [[float("nan")] + [0.0] * 7] * 2, [0, 1]))
    df = spark.createDataFrame(rows, "vec_id int, logits array<array<double>>, labels array<int>")
    for options in ({}, {"average": True}, {"temperature": 0.7}, {"temperature": 0.7, "average": True}):
        want = {r["vec_id"]: r["s"] for r in df.select("vec_id", seq_logp("logits", "labels", **options).alias("s")).collect()}
        for width in (1, 3, 8):
            got = {r["vec_id"]: r["logp"] for r in L.chunked_logps(logit_chunks(df, width), ["vec_id"], **options).collect()}
            assert got.keys() == want.keys() and all(same(got[i], want[i]) for i in want), (width, options)
    beyond = spark.createDataFrame([(1, [[0.0] * 4] * 2, [0, 9])], df.schema)
    with pytest.raises(Exception, match="outside the vocabulary"):
        L.chunked_logps(logit_chunks(beyond, 2), ["vec_id"]).collect()
    plan = L.chunked_logps(logit_chunks(df, 3), ["vec_id"])._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange"):].splitlines()[1]
    assert "values" not in exchange  # partials move, logits don't


def brute_onset(points):
    pts = sorted(points, key=lambda p: (p[1], p[0]))
    x, y = np.array([p[1] for p in pts]), np.array([p[2] for p in pts])
    best = None
    for k in range(2, len(pts) - 1):
        sse, slopes = 0.0, []
        for part in (slice(0, k), slice(k, None)):
            xx, yy = x[part], y[part]
            fit = np.polyfit(xx, yy, 1) if np.ptp(xx) > 0 else np.array([0.0, yy.mean()])
            slopes.append(fit[0])
            sse += ((yy - np.polyval(fit, xx)) ** 2).sum()
        if best is None or sse < best[0] - 1e-9:
            best = (sse, k, slopes)
    if best is None or not (best[2][0] > 1e-9 and best[2][1] < -1e-9):
        return None
    return pts[best[1] - 1][0], pts[best[1] - 1][1]


def test_onset(spark):
    rng = np.random.default_rng(6)
    runs = {"turns": [(i, float(i), 0.1 * min(i, 12 - i)) for i in range(12)], "rises": [(i, float(i), 0.1 * i) for i in range(8)],
            "falls": [(i, float(i), -0.1 * i) for i in range(8)], "few": [(0, 0.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 0.0)], "flat": [(i, float(i), 0.5) for i in range(6)],
            "same_kl": [(i, 1.0, float(i % 3)) for i in range(6)], "valley": [(i, float(i), abs(i - 4) * 0.1) for i in range(9)]}
    for r in range(8):
        turn = rng.integers(3, 12)
        runs[f"noisy{r}"] = [(i, float(rng.random() * 0.5 + i), float(0.08 * min(i, 2 * turn - i) + rng.normal() * 0.02)) for i in range(16)]
    df = spark.createDataFrame([(k, *p) for k, pts in runs.items() for p in pts], "run string, step int, kl double, reward double").repartition(4)
    got = {r["run"]: r for r in V.overoptimisation_onset(df, "run", "step", "kl", "reward").collect()}
    assert got.keys() == runs.keys()
    for k, pts in runs.items():
        want = brute_onset(pts)
        assert (got[k]["onset_step"], got[k]["onset_kl"]) == (want or (None, None)), k
        assert got[k]["peak_reward"] == max(p[2] for p in pts) and got[k]["checkpoints"] == len(pts)
    assert got["turns"]["onset_step"] in (5, 6) and got["turns"]["peak_step"] == 6 and got["turns"]["slope_after"] == pytest.approx(-0.1)
    assert all(got[k]["onset_step"] is None for k in ("rises", "falls", "few", "flat", "same_kl", "valley"))


def test_newton_is_the_optimum(spark):
    rng = np.random.default_rng(8)
    w = np.array([1.0, -2.0, 0.5, 0.0])
    rows = []
    for _ in range(300):
        a, b = rng.normal(size=4), rng.normal(size=4)
        rows.append((a.tolist(), b.tolist()) if (a - b) @ w + rng.normal() > 0 else (b.tolist(), a.tolist()))
    df = spark.createDataFrame(rows, "chosen_phi array<double>, rejected_phi array<double>")
    got = np.array(G.fit_reward_newton(df, 4, reg=0.05))
    d = np.array([np.array(c) - np.array(r) for c, r in rows])
    gradient = -(d / (1 + np.exp(d @ got))[:, None]).mean(0) + 0.05 * got
    assert np.abs(gradient).max() < 1e-10
    assert G.fit_reward(df, reg=0.05, max_iter=300, tol=1e-12).coefficients.toArray() == pytest.approx(got.tolist(), abs=1e-5)
    assert G.fit_reward_newton(df.limit(0), 4) == [0.0] * 4
