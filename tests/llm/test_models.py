import random
import zlib

import numpy as np
import pytest

from prefengine.llm import quality, toxicity


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(1 + len(w) // 20):
                w[rng.randrange(len(w))] = rng.choice(["nasty", "nastier", "vilest", "vile"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


EXTRA = [(900, None), (901, ""), (902, " \t\n"), (903, "word " * 100_000), (None, "no id at all"), (3, "twice"), (3, "twice")]


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = corpus()
    table = spark.createDataFrame([*((*x, 1) for x in labels), (None, 1, 1, 1), (5000, None, None, 1), (7000, 0, 1, 1)], "doc_id long, quality int, toxic int, text int")
    return rows, {i: (q, t) for i, q, t in labels}, table


def test_quality_held_out(docs, labelled):
    rows, truth, labels = labelled
    df = docs(rows + EXTRA)
    out = quality.classify(df, labels).collect()
    assert len(out) == len(rows) + len(EXTRA)
    test = [r for r in out if r.doc_id in truth and held_out(r.doc_id) and r.text != "twice"]
    assert all(r.held_out == held_out("null" if r.doc_id is None else r.doc_id) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in test]) > 0.95
    blank = {r.score for r in out if r.doc_id in (900, 901, 902)}
    assert len(blank) == 1
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in out)


def test_quality_reads_no_held_out_label(docs, spark, labelled):
    rows, truth, _ = labelled
    flipped = [(i, 1 - q if held_out(i) else q) for i, (q, _) in truth.items()]
    plain = [(i, q) for i, (q, _) in truth.items()]
    a, b = (quality.classify(docs(rows), spark.createDataFrame(x, "doc_id long, quality int")).select("doc_id", "score").collect() for x in (plain, flipped))
    assert sorted(a) == sorted(b)


def test_without_labels_or_rows(docs, spark, labelled):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs(EXTRA), none).collect()} == {0.5}
    assert quality.classify(docs([]), labelled[2]).count() == 0
    assert toxicity.severity(docs(EXTRA), none).count() == len(EXTRA) and toxicity.severity(docs([]), labelled[2]).count() == 0


def test_features():
    flat = lambda t: np.concatenate([np.zeros(0, np.int64), *quality.buckets(t)])
    assert len(flat(None)) == len(flat("  ")) == 0
    one, two = flat("alpha beta gamma"), flat("  alpha\tbeta \n gamma ")
    assert sorted(one) == sorted(two) and ((0 <= one) & (one < quality.BUCKETS)).all()
    assert len(flat("beta")) == (4 + 3 + 2) + 1  # 3-, 4- and 5-grams of " beta ", the word
    assert set(flat("alpha")) - set(flat("beta gamma"))
    # neighbours of one shape share a feature, whatever the words
    assert set(flat("gone gone")) & set(flat("kilt kilt")) and not set(flat("gone gone")) & set(flat("kilt most"))
    long = "x" * 3_000_000 + " y"
    assert len(flat(long)) > 8_000_000


def test_features_do_not_depend_on_pieces(monkeypatch):
    flat = lambda t: sorted(np.concatenate([np.zeros(0, np.int64), *quality.buckets(t)]).tolist())
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    whole = [flat(t) for t in texts]
    for piece in (1, 7, 50):
        monkeypatch.setattr(quality, "PIECE", piece)
        monkeypatch.setattr(quality, "POWERS", quality.POWERS[:9])
        assert [flat(t) for t in texts] == whole


def test_toxicity_held_out(docs, labelled):
    rows, truth, labels = labelled
    df = docs(rows + EXTRA)
    out = toxicity.severity(df, labels).collect()
    assert len(out) == len(rows) + len(EXTRA) and all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in out)
    test = [r for r in out if r.doc_id in truth and held_out(r.doc_id) and r.text != "twice"]
    assert np.mean([r.is_toxic == bool(truth[r.doc_id][1]) for r in test]) > 0.95
    bad, good = ([r.severity for r in test if truth[r.doc_id][1] == t] for t in (1, 0))
    assert np.mean(bad) > 10 * np.mean(good)
    assert len({r.severity for r in out if r.doc_id in (900, 901, 902)}) == 1


def test_ordinal_fit_orders_grades():
    from collections import Counter

    rng = random.Random(0)
    bags, grade = [], []
    for i in range(600):
        g = i % 4 if i % 8 < 4 else 0
        bags.append(Counter([f"w{rng.randrange(200)}" for _ in range(60)] + ["bad"] * 2 * g))
        grade.append(g)
    grade = np.array(grade)
    w, limits = toxicity.fit(grade, bags, 6, 0.1, 1e-2, 0)
    assert (np.diff(limits) > 0).all()
    score = lambda b: sum(toxicity.weight(c, sum(b.values())) * sum(w[f] for f in toxicity.features(x)) for x, c in b.items())
    expected = [np.mean([(1 / (1 + np.exp(limits - score(b)))).sum() for b, y in zip(bags, grade) if y == g]) for g in range(4)]
    assert expected == sorted(expected) and expected[0] < 0.5 < 2 < expected[3]


def test_few_labels_still_grade_words():
    """Too few labelled texts for the full test: words are told apart all the same."""
    from collections import Counter

    rng = random.Random(1)
    some = lambda: Counter([f"w{rng.randrange(100)}" for _ in range(30)])
    grade = np.array([1] * 8 + [0] * 16)
    bags = [some() + Counter({"qqzz": 2 * int(g)}) for g in grade]
    w, limits = toxicity.fit(grade, bags, 6, 0.1, 1e-2, 0)
    score = lambda b: sum(toxicity.weight(c, sum(b.values())) * sum(w[f] for f in toxicity.features(x)) for x, c in b.items())
    new = [some() for _ in range(50)]
    assert np.mean([score(b) < limits[0] for b in new]) > 0.95 and np.mean([score(b + Counter({"qqzz": 2})) >= limits[0] for b in new]) > 0.95
    assert not toxicity.fit(np.zeros(24, int), bags, 1, 0.1, 1e-2, 0)[0].any()
