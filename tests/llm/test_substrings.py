import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from prefengine.llm import sais, substrings


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def fixture():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 8))) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            parts += [s[rng.randrange(20):len(s) - rng.randrange(20)], text(rng.randrange(20))]
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "short"), (103, "a" * 900), (104, "word " * 150), (105, "xyz" * 64 + "q"), (7, rows[7][1]), (None, rows[8][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_against_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = fixture()
    got = substrings.repeats_digest(docs(rows).repartition(4), length=100)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute(rows, 100)


def test_pieces_of_a_long_text(docs, monkeypatch):
    """A text hashed in several pieces loses no start (checked on the stretches, in this process)."""
    monkeypatch.setattr(substrings, "PIECE", 300)
    data = " ".join(str(i * 7919 % 1000) for i in range(2000)).encode()
    found = list(substrings.stretches(data, 200))
    starts = np.concatenate([np.arange(a, a + n) for first, size, *_ in found for a, n in zip(first, size)])
    assert (starts == np.arange(len(data) - 199)).all()


def test_clean_texts(docs):
    shared = "é" * 150 + " tail"
    rows = [(1, "start of one. " + shared + " end"), (2, "other " + shared + "!"), (3, None), (4, "clean")]
    df = docs(rows)
    out = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert out[4].text == "clean" and out[3].text is None and out[4].score == -1.0
    assert out[1].text == "start of one. end" and out[2].text == "other!" and out[1].n_chars == len(out[1].text)
    assert substrings.remove_repeats(df).columns == df.columns
    assert substrings.repeats_digest(docs([])).count() == 0 and substrings.remove_repeats(docs([])).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = np.append(rng.integers(1, 1 + rng.integers(1, 4), rng.integers(1, 50)), 0).astype(np.uint8)
        t = np.concatenate([t[:-1]] * 3 + [t[-1:]]) if trial % 3 == 0 else t
        b, length = t.tobytes(), int(rng.integers(1, 9))
        assert list(sais.suffix_array(t)) == sorted(range(len(b)), key=lambda i: b[i:])
        seen = Counter(b[i:i + length] for i in range(len(b) - length + 1))
        assert list(sais.repeated(t, length)) == [i + length <= len(b) and seen[b[i:i + length]] > 1 for i in range(len(b))]
