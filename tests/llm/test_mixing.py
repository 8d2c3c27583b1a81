import re
from collections import defaultdict

import pytest

from prefengine.llm import mixing


def digest(df, **options):
    return [r.asDict() for r in mixing.mix_digest(df, **options).collect()]


def water_level(sizes, weights):
    """Targets by resharing the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, {s for s in names if sizes[s]}
    left = float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return {s: target.get(s, 0.0) for s in names}


def test_targets_and_taken(docs):
    rows = [(i, "w " * (i % 40 + 1), f"s{i % 3}") for i in range(300)]
    rows += [(1000, "tiny one", "a"), (1001, "x y z", None), (1002, None, "b"), (1003, " \n\t", "s1"), (5, "again and again", "s2"), (None, "no id", "s2"), (5, "again and again", "s2")]
    out = digest(docs(rows))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken = water_level(sizes, (1, 2, 3)), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, 0.002 * sizes[s])
    assert sorted(map(str, out)) == sorted(map(str, digest(docs(rows[::-1]))))


def test_schedule_spreads_sources(spark, docs):
    df = docs([(i, "w " * 50, f"s{i % 4}") for i in range(400)])
    totals = spark.createDataFrame([(f"s{i}", 5000, 100) for i in range(4)], "source string, source_size long, n_docs long")
    targets = mixing.source_targets(totals, weights=(1, 3), block_words=10, min_blocks=1)
    slots = sorted((r.slot, r.source_idx, r["rank"]) for r in mixing.slot_schedule(targets).collect())
    counts = {r.source_idx: r.slots for r in targets.collect()}
    seen = defaultdict(int)
    for k, (_, source, rank) in enumerate(slots, 1):
        assert rank == seen[source]
        seen[source] += 1
        for s, n in counts.items():  # every prefix of the mix holds the sources in their shares
            assert abs(seen[s] - n * k / len(slots)) <= 8
    assert dict(seen) == counts
    mix, members = mixing.mix_sources(df, weights=(1, 3), block_words=10, min_blocks=1)
    assert members.count() == 400 and mix.filter("n_words <= 0 or first_word < 0 or first_word + n_words > size").count() == 0


def test_empty(docs):
    assert digest(docs([])) == []
    assert [r["taken"] for r in digest(docs([(1, None), (2, "")]))] == [0, 0]


def test_slots_are_made_by_many_tasks(spark):
    targets = spark.createDataFrame([(0, 900_000, 0, 700, 7), (1, 100_000, 900_000, 300, 3)], "source_idx int, slots long, first_slot long, n_blocks long, source string")
    made = mixing.slot_schedule(targets)
    assert made.count() == 1_000_000 and made.groupBy("source_idx").count().orderBy("source_idx").collect()[0]["count"] == 900_000
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # 16 chunks of 2^16 slots: a given number of tasks, which is not coalesced


