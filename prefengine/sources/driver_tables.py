"""Reference input shapes derived from the driver tables (FIXTURES.md §3).

Every derivation is a DataFrame job over the given tables, so its work grows with them.
Joins are equi-joins on keys; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefengine.functions.text import END_OF_TEXT, SUMMARY_MARKER, md5_bits
from prefengine.operators.order import global_index


def sft_examples(conv: DataFrame) -> DataFrame:
    """User turn -> the next turn when it is an assistant turn: (conv_id, turn, prompt, completion).

    Turns are contiguous per conversation, so "next" is the equi-join on turn + 1; the join key
    (conv_id, turn) spreads a long conversation over many tasks, unlike a window on conv_id."""
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return u.join(a, ["conv_id", "turn"])


#: Parts that the turns of one conversation are dealt into where they meet a per-conversation value.
SALTS = 16


def candidate_prompts(conv: DataFrame) -> DataFrame:
    """Per conversation: the last user turn before the first assistant turn, and the number of
    assistant turns (conv_id, prompt, prompt_turn, n_candidates).

    Aggregations are partial (map-side).  Turn numbers, not texts, meet the first assistant turn, in
    ``SALTS`` parts per conversation, so a long conversation is not one task's; the text of the one
    turn found comes by its key."""
    first = (conv.filter(F.col("role") == "assistant").groupBy("conv_id")
             .agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_candidates")))
    salted = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    turns = users.select("conv_id", "turn", F.pmod("turn", F.lit(SALTS)).cast("int").alias("_salt"))
    last = (turns.join(salted, ["conv_id", "_salt"]).filter(F.col("turn") < F.col("first_turn"))
            .groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max("n_candidates").alias("n_candidates")))
    return (users.join(last, ["conv_id", "turn"])
            .select("conv_id", F.col("text").alias("prompt"), F.col("turn").alias("prompt_turn"), "n_candidates"))


def candidates_long(conv: DataFrame) -> DataFrame:
    """One row per assistant turn: (conv_id, turn, cand_idx, completion); cand_idx is the
    0-based rank by turn inside the conversation, from the skew-safe grouped index (a long
    conversation is spread over range partitions, not sorted in one task)."""
    a = conv.filter(F.col("role") == "assistant")
    idx = global_index(a.select("conv_id", "turn"), ["turn"], partition_by=["conv_id"], name="cand_idx")
    return idx.join(a.select("conv_id", "turn", F.col("text").alias("completion")), ["conv_id", "turn"])


def first_candidates(conv: DataFrame, k: int) -> DataFrame:
    """The first ``k`` assistant turns of every conversation: (conv_id, turn, cand_idx, completion).

    ``row_number() <= k`` is planned as a group limit on both sides of the shuffle, so each
    task ships at most k rows of a conversation, however long it is."""
    a = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("completion"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (a.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
            .withColumn("cand_idx", (F.col("_r") - 1).cast("bigint")).drop("_r"))


#: Candidates of one prompt that meet it in one part.
PART = 1024


def prompted_candidates(conv: DataFrame) -> DataFrame:
    """One row per (prompt, candidate): (conv_id, prompt, cand_idx, completion).  A prompt is there once per
    ``PART`` of its candidates, so a conversation with most of the rows meets it in many parts and all others in one."""
    prompts = candidate_prompts(conv).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n_candidates") / PART))))
    cands = candidates_long(conv).withColumn("_part", F.floor(F.col("cand_idx") / PART))
    return cands.join(prompts, ["conv_id", "_part"]).select("conv_id", "prompt", "cand_idx", "completion")


def candidate_sets(conv: DataFrame, max_candidates: int | None = None) -> DataFrame:
    """Candidate-set rows (conv_id, prompt, n_candidates, completion array<string>, turns array<bigint>).

    With ``max_candidates`` only the first that many candidates (by turn) are gathered: the
    ``row_number() <= k`` filter is planned as a per-partition group limit before the
    shuffle, so every task ships at most k rows of a conversation.  E2 with K pairs needs
    only the first K + 1 candidates, which makes that cap exact."""
    a = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    if max_candidates is not None:
        w = Window.partitionBy("conv_id").orderBy("turn")
        a = a.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_candidates).drop("_r")
    sets = (a.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_c"))
            .select("conv_id",
                    F.transform("_c", lambda x: x["text"]).alias("completion"),
                    F.transform("_c", lambda x: x["turn"]).alias("turns")))
    return candidate_prompts(conv).join(sets, "conv_id")


def chat_messages(conv: DataFrame, max_messages: int | None = None) -> DataFrame:
    """Ordered messages per conversation: (conv_id, messages array<struct<content, role>>).

    Readers of ``messages[i]`` for i < k pass ``max_messages=k``: the ``row_number() <= k``
    filter is planned as a group limit before the shuffle, so a long conversation ships at most
    k rows per task instead of all of its turns."""
    rows = conv.select("conv_id", "turn", "role", "text")
    if max_messages is not None:
        w = Window.partitionBy("conv_id").orderBy("turn")
        rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_messages).drop("_r")
    return (rows.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
            .select("conv_id", F.transform("_m", lambda m: F.struct(
                m["text"].alias("content"), m["role"].alias("role"))).alias("messages")))


def dialogue_turns(conv: DataFrame) -> DataFrame:
    """(conv_id, context array<string>, chosen_response, rejected_response): the non-system
    turns before the last assistant turn; chosen = last assistant text, rejected = first.

    Turns meet the last assistant turn in ``SALTS`` parts of their conversation; what is one row per conversation by
    its shape, the context, is gathered after that."""
    asst = (conv.filter(F.col("role") == "assistant").groupBy("conv_id")
            .agg(F.max("turn").alias("last_turn"),
                 F.max_by("text", "turn").alias("chosen_response"),
                 F.min_by("text", "turn").alias("rejected_response")))
    last = asst.select("conv_id", "last_turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    turns = conv.filter(F.col("role") != "system").withColumn("_salt", F.pmod("turn", F.lit(SALTS)).cast("int"))
    ctx = (turns.join(last, ["conv_id", "_salt"]).filter(F.col("turn") < F.col("last_turn"))
           .groupBy("conv_id")
           .agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_c")))
    return (ctx.select("conv_id", F.transform("_c", lambda x: x["text"]).alias("context"))
            .join(asst.select("conv_id", "chosen_response", "rejected_response"), "conv_id"))


def doc_key(doc_id_col="doc_id"):
    return F.md5(F.col(doc_id_col).cast("string"))


def doc_pairs(docs: DataFrame, labels: DataFrame, by=("lang",)) -> DataFrame:
    """Preference pairs: every quality-1 document with a quality-0 document of its ``by`` group (md5
    rank n meets rank n modulo the number of bad ones) -> (pair_key..., prompt, chosen_id,
    rejected_id, chosen, rejected).  Groups without a bad document make no pair.

    The rank runs on a narrow (id, group, key) frame with the skew-safe global index; the
    texts join back on doc_id afterwards."""
    by = list(by)
    lab = labels.select("doc_id", "quality")
    narrow = docs.select("doc_id", *by).join(lab, "doc_id").withColumn("_k", doc_key())
    ranked = global_index(narrow, ["_k", "doc_id"], partition_by=[*by, "quality"], name="rank")
    n_bad = narrow.filter(F.col("quality") == 0).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    good = (ranked.filter(F.col("quality") == 1).join(n_bad, by)
            .select(*by, (F.col("rank") % F.col("_n")).alias("rank"), F.col("doc_id").alias("chosen_id")))
    bad = ranked.filter(F.col("quality") == 0).select(*by, "rank", F.col("doc_id").alias("rejected_id"))
    pairs = good.join(bad, [*by, "rank"])
    texts = docs.select("doc_id", "text")
    return (pairs
            .join(texts.withColumnRenamed("doc_id", "chosen_id").withColumnRenamed("text", "chosen"), "chosen_id")
            .join(texts.withColumnRenamed("doc_id", "rejected_id").withColumnRenamed("text", "rejected"),
                  "rejected_id")
            .withColumn("prompt", F.col(by[0])))


def instruction_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Instruction-preference shape from document pairs: instruction = lang, input = source
    (empty when the chosen doc_id % 3 = 0), output_1/2 = the pair with the side of the good
    document chosen by an md5 bit, preference = the side holding the good document."""
    p = doc_pairs(docs, labels).join(docs.select(F.col("doc_id").alias("chosen_id"), "source"), "chosen_id")
    flip = (md5_bits(F.col("chosen_id")) % 2) == 1
    return p.select(
        "chosen_id", "rejected_id",
        F.col("lang").alias("instruction"),
        F.when(F.col("chosen_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("input"),
        F.when(flip, F.col("rejected")).otherwise(F.col("chosen")).alias("output_1"),
        F.when(flip, F.col("chosen")).otherwise(F.col("rejected")).alias("output_2"),
        F.when(flip, F.lit(2)).otherwise(F.lit(1)).alias("preference"))


def marker_docs(docs: DataFrame) -> DataFrame:
    """Few-shot-style texts: 'SUBREDDIT a ' + text + ' SUBREDDIT b'; plain for doc_id % 5 = 0;
    completions ending in the end-of-text marker for even doc_id."""
    m = SUMMARY_MARKER
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, F.col("text"))
         .otherwise(F.concat(F.lit(m + " a "), F.col("text"), F.lit(" " + m + " b"))).alias("marked"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("text"), F.lit(END_OF_TEXT)))
         .otherwise(F.col("text")).alias("eot_text"))


def text_score(text_col="text"):
    """Deterministic stand-in scorer: (length % 13) / 4 + (md5 bits % 4) / 2 — quarter steps,
    so ties occur."""
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    return ((F.length(t) % 13).cast("double") / 4.0
            + (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % 4).cast("double") / 2.0)


def turn_scores(conv: DataFrame) -> DataFrame:
    """Score table keyed by (conv_id, turn)."""
    return conv.filter(F.col("role") == "assistant").select("conv_id", "turn", text_score("text").alias("score"))


def metric_log(events: DataFrame, runs: int = 5) -> DataFrame:
    """Metric log: run = user_id % runs, metric = event_type, index = event_id."""
    return events.select(
        (F.col("user_id") % runs).alias("run"), F.col("event_type").alias("metric"),
        F.col("event_id").alias("idx"), "value", "ts", "event_id")


#: Vectors that make one candidate set.
SET_SIZE = 8


def policy_candidates(embeddings: DataFrame) -> DataFrame:
    """Candidate sets with features (prompt_id, cand_idx, phi, score, length, has_eos): ``SET_SIZE`` vectors with
    neighbouring ids answer one prompt; the label is the judge's score, the positive components are the
    scored tokens, and a first component of -0.2 or more ends with EOS."""
    phi = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.floor(F.col("vec_id") / SET_SIZE).alias("prompt_id"), F.pmod("vec_id", F.lit(SET_SIZE)).alias("cand_idx"),
                             phi.alias("phi"), F.col("label").cast("double").alias("score"))
    return rows.withColumn("length", F.size(F.filter("phi", lambda x: x > 0))).withColumn("has_eos", F.get("phi", F.lit(0)) >= -0.2)
