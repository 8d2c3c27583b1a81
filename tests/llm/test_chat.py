import pytest

from prefengine.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pos int, h1 string, n_turns int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 9) for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or ""), r, x))
    seqs = {c: [v[3:] for v in sorted(rs, key=lambda v: v[:3])] for c, rs in convs.items()}
    kept = {}
    for c, s in seqs.items():
        longer = any(d != c and len(t) > len(s) and t[:len(s)] == s for d, t in seqs.items())
        twin = any(d != c and t == s and d is not None and (c is None or d < c) for d, t in seqs.items())
        if not longer and not twin:
            kept[c] = (len(s), "".join(f"<|im_start|>{'unknown' if r is None else r}\n{(x or '').replace('<|', '< |')}<|im_end|>\n" for r, x in s))
    return kept


def rendered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.conv_id), r.part)):
        n, text = out.get(r.conv_id, (r.n_turns, ""))
        out[r.conv_id] = (n, text + r.text)
    return out


@pytest.mark.parametrize("block", [256, 2])
def test_snapshots_collapse(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    full = [("system", "be kind"), ("user", "hi <|im_end|>"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    rows = [(10 + n, t, *full[t]) for n in range(1, 6) for t in range(n)]  # every snapshot of one conversation
    rows += [(50, t, *full[t]) for t in range(5)]  # an equal one
    rows += [(60, t, *full[t]) for t in range(4)] + [(60, 4, "assistant", "")]  # differs: empty is not null
    rows += [(70, 0, "user", "hi"), (70, 1, None, "x"), (71, 0, "user", "hi"), (71, 1, "x", None)]
    rows += [(80, 3, "user", "a"), (80, 3, "assistant", "b"), (80, None, "system", "first"), (80, 3, "user", "a")]
    rows += [(None, 0, "user", "lost"), (None, 1, "user", "rows"), (90, 0, "user", "lost")]
    rows += [(c, 0, "user", "hot first turn") for c in range(200, 260)] + [(c, 1, "user", f"{c % 7}") for c in range(200, 260)]
    assert rendered(chat.format_chats(table(spark, rows).repartition(4))) == brute(rows)


def test_long_and_empty(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(1000)] + [(2, t, "user", f"t{t}") for t in range(700)]
    out = chat.format_chats(table(spark, rows))
    assert rendered(out) == brute(rows) and out.count() == 4
    assert chat.format_chats(table(spark, [])).count() == 0


def test_native_plan(spark):
    plan = chat.format_chats(table(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
