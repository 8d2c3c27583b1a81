import numpy as np
import pytest

from prefengine.llm import ann
from tests.conftest import SF_SMOKE


def exact(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(1)
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_embeddings(spark):
    df = spark.read.parquet(f"{SF_SMOKE}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    want = exact(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64), 20, 20)
    got = found(ann.nearest(df))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    for q in want:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        scores = dict(exact_all := want[q])
        assert all(abs(scores[i] - s) < 1e-12 for i, s in got[q] if i in scores) and exact_all


def test_full_radius_is_exact_with_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 12)).astype(float)
    x[50:120] = x[0]  # a very common vector
    x[(x == 0).all(1)] = 1
    rows = [(int(i), [float(v) for v in r], 1) for i, r in enumerate(x)]
    want = exact(np.arange(300), x, 20, 20)
    odd = [(320, None, 1), (340, [0.0] * 12, 1), (360, [float("nan")] * 12, 1), (380, [float("inf")] * 12, 1), (400, [None] + [1.0] * 11, 1), (420, [1.0], 1), (440, [], 1), (None, [9.0] * 12, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int").repartition(5)
    assert found(ann.nearest(df, recall=1.0)).keys() == want.keys()
    got = found(ann.nearest(df.filter("vec_id < 15"), recall=1.0))
    assert list(got) == [0] and len(got[0]) == 14  # all candidates, if fewer
    tables = ann.Tables(codes := rng.integers(0, 256, (400, 3)).astype(np.uint8))
    for radius in (0, 1, 2, 5, 9, 24):
        near = ann.POPCOUNT[codes ^ codes[7]].sum(1) <= radius
        assert list(tables.within(codes[7], radius)) == list(np.flatnonzero(near))
    ids, scores = np.array([5, 3, 9, 1, 7]), np.array([1.0, 2.0, 1.0, 2.0, 0.0])
    assert list(ids[ann.best_of(ids, scores, 3)]) == [1, 3, 5]


def test_blocks_and_empty(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = found(ann.nearest(df, every=2, k=5))
    # neither blocks, stripes, chunks nor how the rows are dealt change what comes
    for name, value in (("BLOCK_QUERIES", 30), ("STRIPE_ROWS", 17), ("CHUNK_ROWS", 9)):
        monkeypatch.setattr(ann, name, value)
        assert found(ann.nearest(df.repartition(3), every=2, k=5)) == one
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.filter("vec_id = 1")).count() == 0
    assert ann.nearest(df.filter("vec_id = 0")).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest(twice).collect()] == [(1, pytest.approx(1.0))]


def test_queries_with_too_few_rows_in_the_radius(spark, monkeypatch):
    """They are asked again with all rows: the k best come, exactly; queries with enough rows stay as they are."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 16))
    x[60:85] = x[60]  # 25 rows of one code
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact(np.arange(120), x, 20, 20)
    monkeypatch.setattr(ann.Codes, "choose", lambda self, sample, k, recall: 0)
    got = found(ann.nearest(df))
    assert got.keys() == want.keys()
    for q in want:
        if q not in (60, 80):
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert [i for i, _ in got[60]] == list(range(61, 81)) and all(abs(s - x[60] @ x[60]) < 1e-9 for _, s in got[60])
