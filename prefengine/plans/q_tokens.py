"""Queries for vocabulary, encoding and token-array operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.functions import arrays as A
from prefengine.functions.text import truncation_mode
from prefengine.operators import order as O
from prefengine.operators import tokens as K
from prefengine.plans.q_text import _DIALOGUE_SQL, _dialogue
from prefengine.plans.registry import register, sql_tokens, table
from prefengine.sources import driver_tables as D

VOCAB_CAP = 500     # vocab_capped only: every other query uses all tokens
MAX_LEN = 640
MAX_PROMPT = 512
PACK_LEN = MAX_LEN
GEN_BUDGET = 1024
BATCH = 8
PAIR_BATCH = 4
SEED = 42


def _s(c) -> F.Column:
    """Array column -> space-joined string (results compare as text)."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, " ")


# ------------------------------------------------------------------ Spark side
def _vocab(spark, sf, *sources, size=None):
    texts = [table(spark, sf, t).select("text") for t in sources or ("conversations", "documents")]
    return K.fit_vocab(reduce(DataFrame.unionByName, texts), "text", max_size=size)


KEY = ["source", "conv_id", "turn"]


def _rows(spark, sf) -> DataFrame:
    """SFT rows (keep_start prompts), rendered dialogues (keep_end prompts) and whole documents cut in
    the middle (prompt and completion far over their budgets for the long ones)."""
    conv = table(spark, sf, "conversations")
    sft = D.sft_examples(conv).select(F.lit("sft").alias("source"), "conv_id", "turn", "prompt", "completion")
    dlg = _dialogue(spark, sf).select(F.lit("dialogue").alias("source"), "conv_id",
                                      F.lit(-1).cast("bigint").alias("turn"), "prompt",
                                      F.col("chosen").alias("completion"))
    half = F.floor(F.length("text") / 2).cast("int")
    docs = table(spark, sf, "documents").select(
        F.lit("document").alias("source"), F.col("doc_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"),
        F.substring("text", F.lit(1), half).alias("prompt"),
        F.substring("text", half + 1, F.length("text")).alias("completion"))
    return sft.unionByName(dlg).unionByName(docs)


def _examples(spark, sf) -> DataFrame:
    """``_rows`` encoded, with an EOS on some prompts and BOS/EOS around some completions so clipping
    has work."""
    enc = K.encode_columns(_rows(spark, sf), KEY, {"prompt": "p_ids", "completion": "c_ids"}, _vocab(spark, sf))
    eos, bos = K.EOS, K.BOS
    enc = enc.withColumn("p_raw", F.when(F.col("conv_id") % 2 == 0, F.array_append("p_ids", F.lit(eos)))
                         .otherwise(F.col("p_ids")))
    enc = enc.withColumn("c_raw", F.when(F.col("conv_id") % 3 == 0, F.concat(
        F.array(F.lit(bos)), F.col("c_ids"), F.array(F.lit(eos)))).otherwise(F.col("c_ids")))
    return K.build_example(enc, "p_raw", "c_raw", prefix="target", max_length=MAX_LEN,
                           max_prompt_length=MAX_PROMPT, mode=truncation_mode("prompt"))


# ------------------------------------------------------------------ SQL side
def _sql_vocab(name: str, texts: str, cap: int | None = None) -> str:
    return f"""
{name} AS (SELECT '<pad>' AS token, 0 AS id UNION ALL SELECT '<bos>', 1 UNION ALL SELECT '<eos>', 2
          UNION ALL SELECT '<unk>', 3 UNION ALL
          SELECT token, id FROM (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) + 3 AS id
                                 FROM (SELECT tok AS token, count(*) AS cnt
                                       FROM (SELECT unnest({sql_tokens('text')}) AS tok FROM ({texts}))
                                       GROUP BY tok))
          WHERE {f'id <= {cap + 3}' if cap else 'true'})"""


_VOCAB_SQL = _sql_vocab("vocab", "SELECT text FROM conversations UNION ALL SELECT text FROM documents")


def _sql_encode(name: str, rows: str, key: list[str], text: str, vocab: str = "vocab") -> str:
    ks = ", ".join(key)
    return f"""
{name}_t AS (SELECT {ks}, {sql_tokens(text)} AS t FROM {rows}),
{name}_x AS (SELECT {ks}, pos, t[pos] AS token FROM (SELECT {ks}, t, unnest(range(1, len(t) + 1)) AS pos FROM {name}_t)),
{name}_l AS (SELECT {ks}, list(coalesce(v.id, 3) ORDER BY pos) AS ids FROM {name}_x LEFT JOIN {vocab} v USING (token) GROUP BY ALL),
{name} AS (SELECT {', '.join('r.' + k for k in key)}, coalesce(l.ids, []::BIGINT[]) AS ids
           FROM {name}_t r LEFT JOIN {name}_l l USING ({ks}))"""


_ROWS_SQL = f"""
{_DIALOGUE_SQL},
rows AS (SELECT 'sft' AS source, u.conv_id, u.turn, u.text AS prompt, a.text AS completion
         FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
         WHERE u.role = 'user' AND a.role = 'assistant'
         UNION ALL SELECT 'dialogue', conv_id, -1, prompt, chosen FROM dlg
         UNION ALL SELECT 'document', doc_id, -1, left(text, length(text) // 2),
                          substr(text, length(text) // 2 + 1) FROM documents),
{_VOCAB_SQL},
{_sql_encode('pe', 'rows', ['source', 'conv_id', 'turn'], 'prompt')},
{_sql_encode('ce', 'rows', ['source', 'conv_id', 'turn'], 'completion')},
raw AS (SELECT r.source, r.conv_id, r.turn,
               CASE WHEN contains(r.prompt, chr(10) || chr(10) || 'Human:') THEN 'keep_end' ELSE 'keep_start' END AS mode,
               CASE WHEN r.conv_id % 2 = 0 THEN list_append(pe.ids, 2) ELSE pe.ids END AS p0,
               CASE WHEN r.conv_id % 3 = 0 THEN list_append(list_prepend(1, ce.ids), 2) ELSE ce.ids END AS c0
        FROM rows r JOIN pe USING (source, conv_id, turn) JOIN ce USING (source, conv_id, turn)),
clip1 AS (SELECT *, CASE WHEN len(p0) > 0 AND p0[-1] = 2 THEN list_slice(p0, 1, len(p0) - 1) ELSE p0 END AS p1,
                    CASE WHEN len(c0) > 0 AND c0[1] = 1 THEN list_slice(c0, 2, len(c0)) ELSE c0 END AS cb
          FROM raw),
clip2 AS (SELECT *, CASE WHEN len(cb) > 0 AND cb[-1] = 2 THEN list_slice(cb, 1, len(cb) - 1) ELSE cb END AS c1 FROM clip1),
tr1 AS (SELECT *, CASE WHEN len(p1) + len(c1) > {MAX_LEN} AND len(p1) > {MAX_PROMPT}
                       THEN (CASE WHEN mode = 'keep_start' THEN list_slice(p1, 1, {MAX_PROMPT})
                                  ELSE list_slice(p1, len(p1) - {MAX_PROMPT} + 1, len(p1)) END)
                       ELSE p1 END AS p2 FROM clip2),
tr2 AS (SELECT *, CASE WHEN len(p2) + len(c1) > {MAX_LEN}
                       THEN list_slice(c1, 1, CASE WHEN {MAX_LEN} - len(p2) >= 0 THEN {MAX_LEN} - len(p2)
                                                   ELSE greatest(len(c1) + {MAX_LEN} - len(p2), 0) END)
                       ELSE c1 END AS c2 FROM tr1),
ex AS (SELECT source, conv_id, turn, p2 AS prompt_ids, list_append(c2, 2) AS gen,
              list_concat(p2, list_append(c2, 2)) AS combined,
              list_concat(list_resize([]::BIGINT[], len(p2), -100), list_append(c2, 2)) AS labels
       FROM tr2)"""


# -- T0: frequency-ranked vocabulary, specials first; all tokens, and the most frequent ones
@register("vocab", f"WITH {_VOCAB_SQL} SELECT token, id::INT AS id FROM vocab")
def vocab(spark, sf):
    return _vocab(spark, sf).table.select("token", "id")


@register("vocab_capped", f"""
WITH {_sql_vocab('vocab', 'SELECT text FROM conversations', VOCAB_CAP)} SELECT token, id::INT AS id FROM vocab
""")
def vocab_capped(spark, sf):
    return _vocab(spark, sf, "conversations", size=VOCAB_CAP).table.select("token", "id")


# -- T1: encode whole documents and turns, and decode them (specials skipped): with all tokens in the
#    vocabulary decode(encode(x)) is the lower-cased text with single blanks
_TEXTS_SQL = """
texts AS (SELECT 'turn' AS source, conv_id, turn, text FROM conversations
          UNION ALL SELECT 'document', doc_id, -1, text FROM documents)"""


def _texts(spark, sf) -> DataFrame:
    conv = table(spark, sf, "conversations").select(F.lit("turn").alias("source"), "conv_id", "turn", "text")
    docs = table(spark, sf, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("conv_id"),
                                                F.lit(-1).cast("bigint").alias("turn"), "text")
    return conv.unionByName(docs)


@register("encode", f"""
WITH {_VOCAB_SQL}, {_TEXTS_SQL},
{_sql_encode('e', 'texts', ['source', 'conv_id', 'turn'], 'text')}
SELECT source, conv_id, turn, array_to_string(ids, ' ') AS ids FROM e
""")
def encode(spark, sf):
    return K.encode(_texts(spark, sf), KEY, "text", _vocab(spark, sf), out="ids").select(*KEY, _s("ids").alias("ids"))


@register("decode", f"""
WITH {_TEXTS_SQL}
SELECT source, conv_id, turn, array_to_string({sql_tokens('text')}, ' ') AS text FROM texts
""")
def decode(spark, sf):
    v = _vocab(spark, sf)
    enc = K.encode(_texts(spark, sf), KEY, "text", v, out="ids").drop("text")
    return K.decode(enc, KEY, "ids", v, out="text").select(*KEY, "text")


# -- T2 T3 T4 T14: clip specials, truncate (prompt first, per-row mode), append EOS
@register("clip_truncate", f"""
WITH {_ROWS_SQL}
SELECT source, conv_id, turn, array_to_string(prompt_ids, ' ') AS prompt_ids, array_to_string(gen, ' ') AS target_ids
FROM ex
""")
def clip_truncate(spark, sf):
    e = _examples(spark, sf)
    return e.select("source", "conv_id", "turn", _s("prompt_input_ids").alias("prompt_ids"),
                    _s("target_input_ids").alias("target_ids"))


# -- T5 T13: combined sequence, prompt-masked labels, scored-token count
@register("combine_mask", f"""
WITH {_ROWS_SQL}
SELECT source, conv_id, turn, array_to_string(combined, ' ') AS combined, array_to_string(labels, ' ') AS labels,
       len(combined)::BIGINT AS mask_ones,
       len(list_filter(labels, lambda x, i: i > 1 AND x <> -100))::BIGINT AS target_length
FROM ex
""")
def combine_mask(spark, sf):
    e = _examples(spark, sf)
    return e.select("source", "conv_id", "turn", _s("target_combined_input_ids").alias("combined"),
                    _s("target_labels").alias("labels"),
                    F.aggregate("target_combined_attention_mask", F.lit(0).cast("bigint"),
                                lambda a, x: a + x).alias("mask_ones"),
                    A.target_length("target_labels").cast("bigint").alias("target_length"))


def _batched(spark, sf, size=BATCH):
    """Examples with their batch: only the keys are shuffled and checkpointed."""
    keys = _rows(spark, sf).select(*KEY).withColumn("_k", O.shuffle_key(SEED, *KEY))
    batches = O.assign_batches(keys, size, ["_k", *KEY]).drop("_k")
    return _examples(spark, sf).join(batches, KEY)


_BATCH_SQL = f"""
b AS (SELECT *, (row_number() OVER (ORDER BY md5('{SEED}:' || source || ':' || conv_id::VARCHAR || ':' || turn::VARCHAR),
                                    source, conv_id, turn) - 1) AS idx FROM ex),
bb AS (SELECT *, idx // {BATCH} AS batch_id, idx % {BATCH} AS ord FROM b)"""


# -- T6 T7: pad to the batch maximum (prompts on the left), position ids from the mask
@register("pad_batch", f"""
WITH {_ROWS_SQL}, {_BATCH_SQL},
mx AS (SELECT *, max(len(prompt_ids)) OVER (PARTITION BY batch_id) AS mp,
              max(len(combined)) OVER (PARTITION BY batch_id) AS mc FROM bb),
pd AS (SELECT *, list_concat(list_resize([]::BIGINT[], mp - len(prompt_ids), 0), prompt_ids) AS pp,
              list_concat(combined, list_resize([]::BIGINT[], mc - len(combined), 0)) AS cp,
              list_concat(labels, list_resize([]::BIGINT[], mc - len(labels), -100)) AS lp,
              list_concat(list_resize([]::BIGINT[], len(combined), 1), list_resize([]::BIGINT[], mc - len(combined), 0)) AS mk
       FROM mx)
SELECT source, conv_id, turn, batch_id::BIGINT AS batch_id, array_to_string(pp, ' ') AS prompt_ids,
       array_to_string(cp, ' ') AS combined, array_to_string(lp, ' ') AS labels, array_to_string(mk, ' ') AS mask,
       array_to_string(list_transform(mk, lambda x, i: CASE WHEN x = 0 THEN 0 ELSE i - list_position(mk, 1) END), ' ') AS positions
FROM pd
""")
def pad_batch(spark, sf):
    b = _batched(spark, sf)
    p = K.pad_batch(b, "batch_id", left={"prompt_input_ids": K.PAD},
                    right={"target_combined_input_ids": K.PAD, "target_labels": A.IGNORE_INDEX,
                           "target_combined_attention_mask": 0})
    return p.select("source", "conv_id", "turn", "batch_id", _s("prompt_input_ids").alias("prompt_ids"),
                    _s("target_combined_input_ids").alias("combined"), _s("target_labels").alias("labels"),
                    _s("target_combined_attention_mask").alias("mask"),
                    _s(A.position_ids("target_combined_attention_mask")).alias("positions"))


# -- T8: pack a batch into one row (documents cut, mask = 1-based doc index, positions restart)
@register("pack_batch", f"""
WITH {_ROWS_SQL}, {_BATCH_SQL},
cut AS (SELECT batch_id, ord, list_slice(combined, 1, {PACK_LEN}) AS ids, list_slice(labels, 1, {PACK_LEN}) AS lab FROM bb)
SELECT batch_id::BIGINT AS batch_id,
       array_to_string(flatten(list(ids ORDER BY ord)), ' ') AS input_ids,
       array_to_string(flatten(list(lab ORDER BY ord)), ' ') AS labels,
       array_to_string(flatten(list(list_resize([]::BIGINT[], len(ids), ord + 1) ORDER BY ord)), ' ') AS attention_mask,
       array_to_string(flatten(list(list_transform(ids, lambda x, i: i - 1) ORDER BY ord)), ' ') AS position_ids,
       array_to_string(list(len(ids) ORDER BY ord), ' ') AS seq_len
FROM cut GROUP BY batch_id
""")
def pack_batch(spark, sf):
    b = _batched(spark, sf).withColumn("ord", F.col("idx") % BATCH)
    p = K.pack_batch(b, "batch_id", "ord", "target_combined_input_ids", "target_labels", PACK_LEN)
    return p.select("batch_id", *[_s(c).alias(c) for c in
                                  ("input_ids", "labels", "attention_mask", "position_ids", "seq_len")])


# ---- preference pairs as token examples (both sides), for T9 T10
def _pair_examples(spark, sf) -> DataFrame:
    d = _dialogue(spark, sf)
    v = _vocab(spark, sf)
    key = ["conv_id"]
    e = K.encode_columns(d, key, {"prompt": "p_ids", "chosen": "c_ids", "rejected": "r_ids"}, v)
    mode = truncation_mode("prompt")
    e = K.build_example(e, "p_ids", "c_ids", "chosen", MAX_LEN, MAX_PROMPT, mode) \
        .withColumnRenamed("prompt_input_ids", "chosen_prompt_ids")
    e = K.build_example(e, "p_ids", "r_ids", "rejected", MAX_LEN, MAX_PROMPT, mode)
    keys = d.select("conv_id").withColumn("_k", O.shuffle_key(SEED, "conv_id"))
    batches = O.assign_batches(keys, PAIR_BATCH, ["_k", "conv_id"]).withColumn("ord", F.col("idx") % PAIR_BATCH)
    return e.join(batches.drop("_k"), "conv_id")


_PAIR_ROWS_SQL = f"""
{_DIALOGUE_SQL},
{_VOCAB_SQL},
{_sql_encode('pe', 'dlg', ['conv_id'], 'prompt')},
{_sql_encode('ce', 'dlg', ['conv_id'], 'chosen')},
{_sql_encode('re', 'dlg', ['conv_id'], 'rejected')},
sides AS (SELECT d.conv_id, s.side,
                 CASE WHEN contains(d.prompt, chr(10) || chr(10) || 'Human:') THEN 'keep_end' ELSE 'keep_start' END AS mode,
                 pe.ids AS p1, CASE WHEN s.side = 'chosen' THEN ce.ids ELSE re.ids END AS c1
          FROM dlg d JOIN pe USING (conv_id) JOIN ce USING (conv_id) JOIN re USING (conv_id),
               (SELECT 'chosen' AS side UNION ALL SELECT 'rejected') s),
tr1 AS (SELECT *, CASE WHEN len(p1) + len(c1) > {MAX_LEN} AND len(p1) > {MAX_PROMPT}
                       THEN (CASE WHEN mode = 'keep_start' THEN list_slice(p1, 1, {MAX_PROMPT})
                                  ELSE list_slice(p1, len(p1) - {MAX_PROMPT} + 1, len(p1)) END)
                       ELSE p1 END AS p2 FROM sides),
tr2 AS (SELECT *, CASE WHEN len(p2) + len(c1) > {MAX_LEN} THEN list_slice(c1, 1, greatest({MAX_LEN} - len(p2), 0))
                       ELSE c1 END AS c2 FROM tr1),
px AS (SELECT conv_id, side, list_concat(p2, list_append(c2, 2)) AS combined,
              list_concat(list_resize([]::BIGINT[], len(p2), -100), list_append(c2, 2)) AS labels FROM tr2),
pb AS (SELECT conv_id, idx // {PAIR_BATCH} AS batch_id, idx % {PAIR_BATCH} AS ord, n_in_batch
       FROM (SELECT conv_id, idx, count(*) OVER (PARTITION BY idx // {PAIR_BATCH}) AS n_in_batch
             FROM (SELECT conv_id, row_number() OVER (ORDER BY md5('{SEED}:' || conv_id::VARCHAR), conv_id) - 1 AS idx FROM dlg))),
pp AS (SELECT pb.*, px.side, px.combined, px.labels FROM pb JOIN px USING (conv_id))"""


# -- T9: pack a preference batch: chosen docs then rejected docs, rejected index offset by batch size
@register("pack_pairs", f"""
WITH {_PAIR_ROWS_SQL},
cut AS (SELECT batch_id, ord, side, n_in_batch, list_slice(combined, 1, {PACK_LEN}) AS ids,
               list_slice(labels, 1, {PACK_LEN}) AS lab FROM pp)
SELECT batch_id::BIGINT AS batch_id,
       array_to_string(flatten(list(ids ORDER BY side, ord)), ' ') AS concatenated_input_ids,
       array_to_string(flatten(list(lab ORDER BY side, ord)), ' ') AS concatenated_labels,
       array_to_string(flatten(list(list_resize([]::BIGINT[], len(ids),
                         ord + 1 + CASE WHEN side = 'rejected' THEN n_in_batch ELSE 0 END) ORDER BY side, ord)), ' ')
         AS concatenated_attention_mask,
       array_to_string(flatten(list(list_transform(ids, lambda x, i: i - 1) ORDER BY side, ord)), ' ') AS concatenated_position_ids,
       array_to_string(list(len(ids) ORDER BY side, ord), ' ') AS concatenated_seq_len
FROM cut GROUP BY batch_id
""")
def pack_pairs(spark, sf):
    p = K.pack_pairs(_pair_examples(spark, sf), "batch_id", "ord", PACK_LEN)
    names = ["input_ids", "labels", "attention_mask", "position_ids", "seq_len"]
    return p.select("batch_id", *[_s(f"concatenated_{n}").alias(f"concatenated_{n}") for n in names])


# -- T10: chosen over rejected, padded to one common length per batch
@register("stack_sides", f"""
WITH {_PAIR_ROWS_SQL},
mx AS (SELECT *, max(len(combined)) OVER (PARTITION BY batch_id) AS mc FROM pp)
SELECT batch_id::BIGINT AS batch_id, ord::BIGINT AS ord, side,
       array_to_string(list_concat(combined, list_resize([]::BIGINT[], mc - len(combined), 0)), ' ') AS ids,
       array_to_string(list_concat(labels, list_resize([]::BIGINT[], mc - len(labels), -100)), ' ') AS labels,
       array_to_string(list_concat(list_resize([]::BIGINT[], len(combined), 1),
                                   list_resize([]::BIGINT[], mc - len(combined), 0)), ' ') AS mask
FROM mx
""")
def stack_sides(spark, sf):
    s = K.stack_sides(_pair_examples(spark, sf), "batch_id", "ord")
    return s.select("batch_id", F.col("ord").cast("bigint").alias("ord"), "side", _s("ids").alias("ids"),
                    _s("labels").alias("labels"), _s("mask").alias("mask"))


# -- T11: two vocabularies in one row (target / weak_target), per-vocabulary ids
_VOCAB_A_SQL = _sql_vocab("vocab", "SELECT text FROM conversations")
_VOCAB_B_SQL = _sql_vocab("vocab_b", "SELECT text FROM documents")


@register("dual_encode", f"""
WITH {_VOCAB_A_SQL}, {_VOCAB_B_SQL},
sft AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS completion FROM conversations u JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
{_sql_encode('pa', 'sft', ['conv_id', 'turn'], 'prompt')},
{_sql_encode('ca', 'sft', ['conv_id', 'turn'], 'completion')},
{_sql_encode('pb', 'sft', ['conv_id', 'turn'], 'prompt', 'vocab_b')},
{_sql_encode('cb', 'sft', ['conv_id', 'turn'], 'completion', 'vocab_b')},
bothv AS (SELECT conv_id, turn, pa.ids AS pa, ca.ids AS ca, pb.ids AS pb, cb.ids AS cb
         FROM pa JOIN ca USING (conv_id, turn) JOIN pb USING (conv_id, turn) JOIN cb USING (conv_id, turn)),
t1 AS (SELECT *, CASE WHEN len(pa) + len(ca) > {MAX_LEN} AND len(pa) > {MAX_PROMPT} THEN list_slice(pa, 1, {MAX_PROMPT}) ELSE pa END AS pa2,
              CASE WHEN len(pb) + len(cb) > {MAX_LEN} AND len(pb) > {MAX_PROMPT} THEN list_slice(pb, 1, {MAX_PROMPT}) ELSE pb END AS pb2
       FROM bothv),
t2 AS (SELECT *, CASE WHEN len(pa2) + len(ca) > {MAX_LEN} THEN list_slice(ca, 1, {MAX_LEN} - len(pa2)) ELSE ca END AS ca2,
              CASE WHEN len(pb2) + len(cb) > {MAX_LEN} THEN list_slice(cb, 1, {MAX_LEN} - len(pb2)) ELSE cb END AS cb2
       FROM t1)
SELECT conv_id, turn, array_to_string(list_concat(pa2, list_append(ca2, 2)), ' ') AS target_combined,
       array_to_string(list_concat(pb2, list_append(cb2, 2)), ' ') AS weak_target_combined
FROM t2
""")
def dual_encode(spark, sf):
    sft = D.sft_examples(table(spark, sf, "conversations"))
    va, vb = _vocab(spark, sf, "conversations"), _vocab(spark, sf, "documents")
    key = ["conv_id", "turn"]
    e = sft
    for name, v in (("a", va), ("b", vb)):
        e = K.encode_columns(e, key, {"prompt": f"p_{name}", "completion": f"c_{name}"}, v)
    out = e
    for name, prefix in (("a", "target"), ("b", "weak_target")):
        out = K.build_example(out, f"p_{name}", f"c_{name}", prefix, MAX_LEN, MAX_PROMPT, "keep_start") \
            .withColumnRenamed("prompt_input_ids", f"{prefix}_prompt_ids")
    return out.select("conv_id", "turn", _s("target_combined_input_ids").alias("target_combined"),
                      _s("weak_target_combined_input_ids").alias("weak_target_combined"))


# -- T12: cut after the first EOS (pads after), completion mask, index of the last real token; whole
#    documents as generations, those over the budget end without EOS
@register("eos_cut", f"""
WITH {_VOCAB_B_SQL},
{_sql_encode('e', 'documents', ['doc_id'], 'text', 'vocab_b')},
g AS (SELECT doc_id, list_resize(CASE WHEN len(ids) <= {GEN_BUDGET} THEN list_append(ids, 2)
                                      ELSE list_slice(ids, 1, {GEN_BUDGET}) END, {GEN_BUDGET} + 1, 0) AS gen FROM e),
f AS (SELECT *, coalesce(list_position(gen, 2) - 1, len(gen)) AS t, coalesce(list_position(gen, 0), 0) AS p FROM g)
SELECT doc_id,
       array_to_string(list_transform(gen, lambda x, i: CASE WHEN i - 1 > t THEN 0 ELSE x END), ' ') AS cut,
       array_to_string(list_transform(gen, lambda x, i: CASE WHEN i - 1 > t THEN 0 ELSE 1 END), ' ') AS mask,
       ((CASE WHEN p > 0 THEN p - 1 ELSE 0 END) - 1 + len(gen)) % len(gen) AS last_idx
FROM f
""")
def eos_cut(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    enc = K.encode(docs, ["doc_id"], "text", _vocab(spark, sf, "documents"), out="ids")
    gen = F.when(F.size("ids") <= GEN_BUDGET, F.array_append("ids", F.lit(K.EOS))).otherwise(
        F.slice("ids", 1, GEN_BUDGET))
    g = enc.withColumn("gen", A.pad_right(gen, GEN_BUDGET + 1, K.PAD))
    return g.select("doc_id", _s(A.truncate_after("gen", K.EOS, K.PAD)).alias("cut"),
                    _s(A.completion_mask("gen", K.EOS)).alias("mask"),
                    A.last_real_index("gen", K.PAD).cast("bigint").alias("last_idx"))
