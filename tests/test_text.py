"""String column functions on hand-made rows (FIXTURES §4)."""

from pyspark.sql import functions as F

from prefengine.functions import text as T
from prefengine.operators import text as X


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_strip_marker(spark):
    m = T.END_OF_TEXT
    got = one(spark, T.strip_marker("s"), [(f"a{m}b{m}",), (f"{m}x",), ("plain",)], "s string")
    assert got == ["ab", "x", "plain"]


def test_instruction_prompt(spark):
    got = one(spark, T.instruction_prompt("i", "x"), [("do", "this"), ("do", ""), ("do", None)], "i string, x string")
    assert got == ["do\nthis", "do", "do"]


def test_pick_by_preference(spark):
    df = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("a", "b", 0), ("a", "b", None)],
                               "o1 string, o2 string, p int")
    c, r = T.pick_by_preference("o1", "o2", "p")
    assert [tuple(x) for x in df.select(c, r).collect()] == [("a", "b"), ("b", "a"), ("b", "b"), ("b", "b")]


def test_message_content(spark):
    df = spark.createDataFrame([([],), ([("hi", "user")],), ([("hi", "user"), ("yo", "assistant")],)],
                               "m array<struct<content:string,role:string>>")
    got = [tuple(r) for r in df.select(T.message_content("m", 0), T.message_content("m", 1)).collect()]
    assert got == [(None, None), ("hi", None), ("hi", "yo")]


def test_markers(spark):
    m = T.SUMMARY_MARKER
    rows = [("no marker here",), (f"x {m} one",), (f"a {m} b {m} c",), ("",)]
    df = spark.createDataFrame(rows, "s string")
    got = [tuple(r) for r in df.select(T.from_last_marker("s"), T.before_last_marker("s")).collect()]
    assert got == [("no marker here", "no marker here"), (f"{m} one", "x "), (f"{m} c", f"a {m} b "), ("", "")]


def test_rstrip_all(spark):
    df = spark.createDataFrame([(["a\n", "b\t ", "   ", "c"],)], "c array<string>")
    assert df.select(T.rstrip_all("c")).first()[0] == ["a", "b", "", "c"]


def test_render_dialogue_last_context_turn_is_human(spark):
    rows = [(["q1"], " a "), (["q1", "a1"], "x"), (["q1", "a1", "q2"], "\ty\n")]
    df = spark.createDataFrame(rows, "ctx array<string>, r string")
    out = X.render_dialogue(df.withColumn("r2", F.col("r")), "ctx", "r", "r2").collect()
    assert out[0]["prompt"] == "\n\nHuman: q1\n\nAssistant:"
    assert out[1]["prompt"] == "\n\nAssistant: q1\n\nHuman: a1\n\nAssistant:"
    assert out[2]["prompt"] == "\n\nHuman: q1\n\nAssistant: a1\n\nHuman: q2\n\nAssistant:"
    assert [r["chosen"] for r in out] == [" a", " x", " y"]


def test_truncation_mode(spark):
    got = one(spark, T.truncation_mode("p"), [("\n\nHuman: hi",), ("plain",)], "p string")
    assert got == ["keep_end", "keep_start"]


def test_drop_identical(spark):
    df = spark.createDataFrame([("p", "a", "a"), ("p", "a", "a "), ("p", "a", "b")], "prompt string, chosen string, rejected string")
    assert X.drop_identical(df).count() == 2


def test_render_chat(spark):
    df = spark.createDataFrame([([("hi", "user")],)], "m array<struct<content:string,role:string>>")
    assert df.select(X.render_chat("m")).first()[0] == "<|user|>\nhi\n<|assistant|>\n"


def test_with_exemplars(spark):
    ex = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "item_id int, text string")
    df = spark.createDataFrame([("q",)], "prompt string")
    assert X.with_exemplars(df, ex, 2, "text", "item_id").first()["prompt"] == "a\n\nb\n\nq"
