import random

import numpy as np
import xxhash

from prefengine.llm import graph, simhash


def slow_print(text, k=4):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprint():
    for t in (None, "", " \n", "One", "a B c", "a b c d e F g É", "x " * 200_000, "Ärger ÄRGER"):
        assert simhash.fingerprint(t, 4) == slow_print(t)


def test_documents(spark, docs):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(50)) for _ in range(60)) for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.randrange(1, 8)):
            w = b.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "new"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "  "), (None, "a lonely text"), (3, rows[0][1]), (3, rows[0][1])]
    got = simhash.near_duplicates(docs(rows)).collect()
    prints = [slow_print(t) for _, t in rows]
    comp = slow_components(prints, 4)
    least = {}
    for (i, _), c in zip(rows, comp):
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    want = sorted(((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, comp)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want
    kept = simhash.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns and kept.count() == len(set(comp))
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components_that_share_their_smallest_id(spark, docs):
    """Null ids and an id that repeats with another text: one document of each component stays."""
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in ("red", "green", "blue", "grey", "pink")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[3]), (8, texts[4])]
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])], key=str)


def test_dense_blocks_split(spark, monkeypatch):
    """Many fingerprints in one block: parts of blocks are compared pairwise, no link is lost."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(0)
    prints = {0}
    while len(prints) < 300:
        p = sorted(prints)[rng.integers(len(prints))]
        for b in rng.integers(0, 64, 3):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints | {int(x) for x in rng.integers(0, 1 << 63, 200)})
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.near_pairs(df, 4)).collect()}
    comp = slow_components(prints, 4)
    mine = {}
    for p, c in zip(prints, comp):
        mine.setdefault(c, set()).add(got.get(simhash.signed(p), simhash.signed(p)))
    assert all(len(v) == 1 for v in mine.values()) and len({next(iter(v)) for v in mine.values()}) == len(mine)


def test_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 251


def test_one_row_of_rows_that_share_id_and_text(spark, docs):
    from pyspark.sql import functions as F

    df = docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "quite another text of six"), (3, None), (4, "")])
    df = df.withColumns({"__id": F.lit(1), "kept_id": F.lit("x"), "kept_hash": F.lit(0), "root": F.monotonically_increasing_id()}).cache()
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {1, 3, None} and kept.count() == 3
    assert rows[1].root == min(r.root for r in df.collect() if r.doc_id == 1)  # the smallest of the others
