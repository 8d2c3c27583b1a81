import random

import pytest
from pyspark.sql import functions as F

from prefengine.llm import decontam

ITEMS = [(1, "Anna Berg buys 12 apples for 3 dollars each and Tom takes 4 of them home. How many apples does Anna keep for herself?"),
         (2, "The quick brown fox jumps over the lazy dog while seven small birds sing in the old tree behind the house."),
         (3, "two words"), (4, None), (1, "Anna Berg buys 12 apples for 3 dollars each and Tom takes 4 of them home. How many apples does Anna keep for herself?")]
RNG = random.Random(1)
NOISE = lambda n: " ".join(RNG.choice(["lorem", "ipsum", "dolor", "sit", "amet", "7", "Paris", "kg"]) for _ in range(n))
EXCHANGED = "there Maria Holt buys 25 apples for 9 dollars each and Jim takes 6 of them home. How many apples does Maria keep for herself?"
MIXED_UP = "there Maria Holt buys 25 apples for 9 dollars each and Jim takes 6 of them home. How many apples does Jim keep for herself?"
DOCS = [(1, f"{NOISE(40)} {ITEMS[0][1]} {NOISE(40)}"), (2, f"{NOISE(9000)} {ITEMS[1][1]} {NOISE(10)}"), (3, f"{NOISE(30)} {EXCHANGED} {NOISE(3)}"),
        (4, f"{NOISE(30)} {MIXED_UP} {NOISE(3)}"), (5, NOISE(3000)), (6, None), (7, ""), (8, "two words"), (9, ITEMS[1][1].lower().replace(" fox", "\n fox,")),
        (10, "The quick brown fox jumps over the lazy dog and goes home."), (None, ITEMS[1][1]), (1, f"{ITEMS[0][1]} again"), (12, ITEMS[1][1]), (12, ITEMS[1][1])]


@pytest.mark.parametrize("broadcast", [decontam.BROADCAST_WINDOWS, 0])
def test_leaks(spark, docs, broadcast):
    bench = spark.createDataFrame([(*i, "x", 0.5) for i in ITEMS], "item_id long, text string, template string, coverage double")
    df = docs(DOCS)
    out = decontam.find_leaks(df, bench, broadcast_windows=broadcast).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in out) == sorted([("1", 1), ("1", 1), ("2", 2), ("3", 1), ("9", 2), ("None", 2), ("12", 2)])
    assert {r.doc_id: r.exchanged for r in out}[3] >= 4 and {r.doc_id: r.exchanged for r in out}[12] == 0
    kept = decontam.drop_leaked(df, bench, broadcast_windows=broadcast)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8, 10]


def test_windows(spark, docs):
    df = docs([(1, NOISE(500)), (2, "one two three four"), (3, None)]).select("doc_id", decontam.tokens(F.col("text")).alias("tokens"))
    out = decontam.windows(df, ["doc_id"]).collect()
    n = {r.doc_id: len(r.tokens) for r in df.collect()}
    assert n[2] == 4 and n[3] == 0 and sorted({r.pos for r in out}) == list(range(n[1] - 4)) and len(out) < 2.1 * n[1]


def test_kinds(spark, docs):
    text = "In 2019 Anna paid 5 kg. Tom saw kg of USA, 3.5% and $7 for Zoë\nJim, Eve left 12km of iPhone"
    got = docs([(1, text)]).select(decontam.tokens(F.col("text")).alias("t")).first().t
    kinds = {decontam.NAME: "p", decontam.NUMBER: "n", decontam.UNIT: "u"}
    assert [(w.lstrip("".join(kinds)), kinds.get(w[0], "w")) for w in got] == [
        ("in", "w"), ("2019", "n"), ("anna", "p"), ("paid", "w"), ("5", "n"), ("kg", "u"), ("tom", "w"), ("saw", "w"), ("kg", "w"), ("of", "w"), ("usa", "w"),
        ("3", "n"), ("5", "n"), ("percent", "u"), ("and", "w"), ("usd", "u"), ("7", "n"), ("for", "w"), ("zoë", "p"), ("jim", "w"), ("eve", "p"), ("left", "w"),
        ("12", "n"), ("km", "u"), ("of", "w"), ("iphone", "w")]


def test_empty_and_native(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.find_leaks(docs(DOCS), none).count() == 0 and decontam.find_leaks(docs([]), bench).count() == 0
    assert decontam.drop_leaked(docs(DOCS), none).count() == len(DOCS)
    plan = decontam.find_leaks(docs(DOCS), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_openers_units_and_whole_numbers(spark, docs):
    """Names that open a sentence, spelled units and numbers with separators can be exchanged; conflicting openers take nothing away."""
    story = "Anna has 3 apples. Tom has 5 apples. Tom gives Anna 2 apples. How many apples does Anna have now?"
    road = "A car that burns 2.5 liters goes 5 kilometers in the morning and costs 1,200 dollars when it is sold next year."
    plain = ("The first of all the houses by the old harbour was painted in a bright yellow colour that nobody liked at all. "
             "The second one stood further up the hill among tall trees and had been left without any roof since the great storm of the winter. The end came.")
    list_ = "write down the numbers 1,2,3 and then the numbers 4,5,6 in the order in which they were given"
    bench = spark.createDataFrame([(1, story), (2, road), (3, plain), (4, list_)], "item_id long, text string")
    rows = [(1, story.replace("Anna", "Eva").replace("Tom", "Jim")), (2, "Read this.\n" + road.replace("2.5 liters", "7 milliliters").replace("5 kilometers", "8 miles").replace("1,200", "95")),
            (3, plain.replace("The second", "My second").replace("The end", "Our end")), (4, story.replace("Anna", "Eva", 1).replace("Tom", "Eva")),
            (5, list_.replace(",", ", ")), (6, road.replace("1,200", "1200").replace("2.5", "2,5"))]
    got = {(r.doc_id, r.item_id): r.coverage for r in decontam.find_leaks(docs(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (5, 4), (6, 2)} and got[1, 1] == got[2, 2] == got[6, 2] == 1


def test_items_that_share_an_id(spark, docs):
    """Texts under one id (merged benchmarks, null ids) are items of their own."""
    long, short = ITEMS[1][1], "Nine old boats lie on the grey beach and wait for the tide"
    for i in (5, None):
        bench = spark.createDataFrame([(i, long), (i, short), (i, short)], "item_id long, text string")
        out = decontam.find_leaks(docs([(1, f"{NOISE(20)} {short} {NOISE(20)}"), (2, f"{long} {short}"), (3, long)]), bench).collect()
        assert sorted((r.doc_id, r.item_id, r.coverage) for r in out) == [(1, i, 1.0), (2, i, 1.0), (2, i, 1.0), (3, i, 1.0)]


def test_other_letter_case_number_words_and_insertions(spark, docs):
    items = [(1, ITEMS[0][1]), (2, ITEMS[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    first, second = items[0][1], items[1][1]
    rows = [(10, first.lower()), (11, first.upper()), (12, first.title()), (13, first.swapcase()), (20, second.lower()), (21, second.upper()), (22, second.title()),
            (30, first.replace("12", "twelve").replace("4 of", "four of")), (31, second.replace("seven", "7")),
            (40, second.replace("fox jumps", "fox then quickly jumps").replace("sing in", "sing loudly in")), (50, " ".join(second.split()[:10])), (51, first.lower()[:60])]
    got = {r.doc_id: (r.item_id, r.coverage) for r in decontam.find_leaks(docs([(i, f"{NOISE(20)} . {t} . {NOISE(20)}") for i, t in rows]), bench).collect()}
    assert {i: item for i, (item, _) in got.items()} == {i: 1 if i // 10 in (1, 3) and i != 31 else 2 for i, _ in rows if i < 50}
    assert all(got[i][1] == 1.0 for i in (10, 11, 20, 21, 22, 30, 31)) and got[12][1] > 0.9 and got[40][1] > 0.8


def brute(doc, item):
    """All choices, alignments and values of two readings (lists of marked tokens) in plain Python; the best coverage."""
    from itertools import product

    def meanings(w):
        bare = w.lstrip(decontam.NAME + decontam.NUMBER + decontam.UNIT + decontam.EITHER)
        if w in decontam.SPELLED or w.startswith(decontam.NUMBER):
            return [(bare, "number", False)]
        if w.startswith(decontam.UNIT):
            return [(bare, "unit", False)]
        if w.startswith(decontam.NAME):
            return [(bare, "name", False)]
        return [(bare, "", False), (bare, "name", True)] if w.startswith(decontam.EITHER) else [(bare, "", False)]

    def windows(tokens):
        out = []
        for p in range(len(tokens) - decontam.WINDOW + 1):
            own = tokens[p:p + decontam.WINDOW]
            ways = [list(c) for c in product(*map(meanings, own))]
            if any(w.startswith(decontam.NAME) for w in own):
                ways.append([(b, "" if k == "name" else k, False) for b, k, _ in ways[0]])
            out += [(p, way, any(o for _, _, o in way)) for way in ways]
        return out

    ways = {}
    for ip, iw, io in windows(item):
        for dp, dw, do in windows(doc):
            if all(a[1] == b[1] and (a[1] or a[0] == b[0]) for a, b in zip(iw, dw)):
                pairs = {((a[1], a[0]), (b[1], b[0])) for a, b in zip(iw, dw) if a[1]}
                for plain in (False, True):
                    if not plain or not (io or do):
                        places, values = ways.setdefault((dp - ip, plain), (set(), set()))
                        places.add(ip)
                        values.update(pairs)
    one_to_one = lambda values: len({a for a, _ in values}) == len(values) == len({b for _, b in values})
    covered, held, shifts, found = set(), set(), [], set()
    for _, shift, _, places, values in sorted(((len(p), shift, plain, p, v) for (shift, plain), (p, v) in ways.items()), key=lambda w: w[:3], reverse=True):
        if places and one_to_one(values):
            found |= places
            if one_to_one(held | values) and (not shifts or any(abs(s - shift) <= decontam.GAP for s in shifts)):
                held, shifts = held | values, [*shifts, shift]
                covered |= {p + k for p in places for k in range(decontam.WINDOW)}
    n = len(item) - decontam.WINDOW + 1
    return max(len(found) / n, len(covered) / len(item)) if n > 0 else 0.0


def test_equals_all_alignments(spark, docs):
    rng = random.Random(11)
    words = ["Anna", "Tom", "the", "old", "Paris", "7", "12", "three", "kg", "buys", "apples.", "Then", "and", "sells", "Red"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 16))) for _ in range(12)]
    rows = []
    for i in range(60):
        t = rng.choice(texts).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.3:
            t.insert(rng.randrange(len(t)), rng.choice(words))
        t = " ".join(t)
        rows.append((i, rng.choice([t, t.lower(), t.upper(), t.replace("Anna", "Eva").replace("12", "9")])))
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontam.find_leaks(docs(rows), bench).collect()}
    read = lambda df, key: {r[key]: r.tokens for r in decontam.readings(df, F.col("text"), {key: F.col(key)}).collect()}
    d, b = read(docs(rows), "doc_id"), read(bench, "item_id")
    want = {(i, j): c for i in d for j in b if (c := brute(d[i], b[j])) >= decontam.SHARE}
    assert want and got == pytest.approx(want)


def test_columns_that_clash(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = docs(DOCS).withColumns({"__id": F.lit(1), "leaked_id": F.lit("x"), "leaked_hash": F.lit(0), "text_hash": F.lit(2)})
    kept = decontam.drop_leaked(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7, 8, 10]
