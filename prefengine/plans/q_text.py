"""Queries for projections, string scalars, filters and concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefengine.functions import text as T
from prefengine.operators import order as O
from prefengine.operators import text as X
from prefengine.plans.registry import register, table
from prefengine.sources import driver_tables as D

NL = "\n"
EOT = T.END_OF_TEXT
M = T.SUMMARY_MARKER


def _conv(spark, sf):
    return table(spark, sf, "conversations")


def _docs(spark, sf):
    return table(spark, sf, "documents")


# -- P1 P2 P3 P8: canonical (prompt, completion) from adjacent user -> assistant turns
@register("canonical_sft", """
SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS completion
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""")
def canonical_sft(spark, sf):
    return X.canonical_sft(D.sft_examples(_conv(spark, sf)), "prompt", "completion", keep=["conv_id", "turn"])


# -- P4: remove the end-of-text marker
@register("strip_marker", f"""
SELECT doc_id, replace(CASE WHEN doc_id % 2 = 0 THEN text || '{EOT}' ELSE text END, '{EOT}', '') AS completion
FROM documents
""")
def strip_marker(spark, sf):
    d = D.marker_docs(_docs(spark, sf))
    return X.strip_marker(d.select("doc_id", F.col("eot_text").alias("completion")), ["completion"])


# -- summarisation SFT recipe: hold out the tail (F2), select, strip marker, rename
SUMMARY_HOLDOUT = 100


@register("summary_sft", f"""
WITH m AS (SELECT doc_id,
                  CASE WHEN doc_id % 5 = 0 THEN text ELSE '{M} a ' || text || ' {M} b' END AS query,
                  CASE WHEN doc_id % 2 = 0 THEN text || '{EOT}' ELSE text END AS reference_response,
                  row_number() OVER (ORDER BY doc_id DESC) AS back
           FROM documents)
SELECT doc_id, query AS prompt, replace(reference_response, '{EOT}', '') AS completion
FROM m WHERE back > {SUMMARY_HOLDOUT}
""")
def summary_sft(spark, sf):
    d = D.marker_docs(_docs(spark, sf)).select("doc_id", F.col("marked").alias("query"),
                                               F.col("eot_text").alias("reference_response"))
    kept = O.drop_tail(d, SUMMARY_HOLDOUT, ["doc_id"], ["doc_id"])
    return X.strip_marker(X.canonical_sft(kept, "query", "reference_response", keep=["doc_id"]), ["completion"])


_DIALOGUE_SQL = f"""
asst AS (SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS cr, arg_min(text, turn) AS rr
         FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
ctx AS (SELECT c.conv_id, c.text,
               count(*) OVER (PARTITION BY c.conv_id) AS n,
               row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) - 1 AS i
        FROM conversations c JOIN asst a USING (conv_id)
        WHERE c.role <> 'system' AND c.turn < a.last_turn),
rendered AS (SELECT conv_id,
                    string_agg(CASE WHEN (i + (n + 1) % 2) % 2 = 0 THEN '{NL}{NL}Human: ' ELSE '{NL}{NL}Assistant: ' END
                               || text, '' ORDER BY i) || '{NL}{NL}Assistant:' AS prompt
             FROM ctx GROUP BY conv_id),
dlg AS (SELECT r.conv_id, r.prompt,
               ' ' || regexp_replace(a.cr, '^\\s+|\\s+$', '', 'g') AS chosen,
               ' ' || regexp_replace(a.rr, '^\\s+|\\s+$', '', 'g') AS rejected
        FROM rendered r JOIN asst a USING (conv_id))"""


def _dialogue(spark, sf):
    d = D.dialogue_turns(_conv(spark, sf))
    return X.render_dialogue(d, "context", "chosen_response", "rejected_response") \
        .select("conv_id", "prompt", "chosen", "rejected")


# -- P10: transcript render (last context turn is Human; assistant cue; " " + strip)
@register("transcript", f"WITH {_DIALOGUE_SQL} SELECT conv_id, prompt, chosen, rejected FROM dlg")
def transcript(spark, sf):
    return _dialogue(spark, sf)


# -- F1: helpful/harmless preference recipe drops pairs with identical texts
@register("drop_identical", f"WITH {_DIALOGUE_SQL} SELECT conv_id, prompt, chosen, rejected FROM dlg "
                            f"WHERE chosen <> rejected")
def drop_identical(spark, sf):
    return X.drop_identical(_dialogue(spark, sf))


# -- P14: truncation mode per prompt (transcripts keep the end, plain prompts the start)
@register("trunc_mode", f"""
WITH {_DIALOGUE_SQL}
SELECT 'dialogue' AS source, conv_id, -1::BIGINT AS turn,
       CASE WHEN contains(prompt, '{NL}{NL}Human:') THEN 'keep_end' ELSE 'keep_start' END AS mode FROM dlg
UNION ALL
SELECT 'sft' AS source, u.conv_id, u.turn,
       CASE WHEN contains(u.text, '{NL}{NL}Human:') THEN 'keep_end' ELSE 'keep_start' END AS mode
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""")
def trunc_mode(spark, sf):
    dlg = _dialogue(spark, sf).select(F.lit("dialogue").alias("source"), "conv_id",
                                      F.lit(-1).cast("bigint").alias("turn"), "prompt")
    sft = D.sft_examples(_conv(spark, sf)).select(F.lit("sft").alias("source"), "conv_id", "turn", "prompt")
    return dlg.unionByName(sft).select("source", "conv_id", "turn", T.truncation_mode("prompt").alias("mode"))


_PAIRS_SQL = """
ranked AS (SELECT d.doc_id, d.lang, l.quality,
                  row_number() OVER (PARTITION BY d.lang, l.quality ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - 1 AS rk
           FROM documents d JOIN labels l USING (doc_id)),
pairs AS (SELECT g.lang, g.rk, g.doc_id AS chosen_id, b.doc_id AS rejected_id
          FROM ranked g JOIN (SELECT lang, count(*) AS n FROM ranked WHERE quality = 0 GROUP BY lang) nb ON nb.lang = g.lang
          JOIN ranked b ON g.lang = b.lang AND g.rk % nb.n = b.rk AND g.quality = 1 AND b.quality = 0),
ptext AS (SELECT p.*, c.text AS chosen, r.text AS rejected, c.source
          FROM pairs p JOIN documents c ON c.doc_id = p.chosen_id JOIN documents r ON r.doc_id = p.rejected_id)"""

_INSTR_SQL = _PAIRS_SQL + """,
inst AS (SELECT chosen_id, rejected_id, lang AS instruction,
                CASE WHEN chosen_id % 3 = 0 THEN '' ELSE source END AS input,
                CASE WHEN (('0x' || substr(md5(chosen_id::VARCHAR), 1, 8))::BIGINT % 2) = 1 THEN rejected ELSE chosen END AS output_1,
                CASE WHEN (('0x' || substr(md5(chosen_id::VARCHAR), 1, 8))::BIGINT % 2) = 1 THEN chosen ELSE rejected END AS output_2,
                CASE WHEN (('0x' || substr(md5(chosen_id::VARCHAR), 1, 8))::BIGINT % 2) = 1 THEN 2 ELSE 1 END AS preference
         FROM ptext)"""


# -- P5 P6: instruction (+ optional input) prompt; preference picks chosen / rejected
@register("instruction_prefs", f"""
WITH {_INSTR_SQL}
SELECT chosen_id, rejected_id,
       CASE WHEN input IS NOT NULL AND input <> '' THEN instruction || '{NL}' || input ELSE instruction END AS prompt,
       CASE WHEN preference = 1 THEN output_1 ELSE output_2 END AS chosen,
       CASE WHEN preference = 2 THEN output_1 ELSE output_2 END AS rejected
FROM inst
""")
def instruction_prefs(spark, sf):
    rows = D.instruction_rows(_docs(spark, sf), table(spark, sf, "labels"))
    return X.instruction_preferences(rows).select("chosen_id", "rejected_id", "prompt", "chosen", "rejected")


# -- P7: nested message extraction, 0-based, NULL out of range
@register("message_extract", """
WITH m AS (SELECT conv_id, list(struct_pack(content := text, role := role) ORDER BY turn) AS messages
           FROM conversations GROUP BY conv_id)
SELECT conv_id, messages[1].content AS first_content, messages[2].content AS second_content,
       messages[2].role AS second_role, messages[41].content AS far_content
FROM m
""")
def message_extract(spark, sf):
    m = D.chat_messages(_conv(spark, sf), max_messages=41)   # indexes 0, 1 and 40 are read
    return m.select("conv_id", T.message_content("messages", 0).alias("first_content"),
                    T.message_content("messages", 1).alias("second_content"),
                    F.get("messages", 1).getField("role").alias("second_role"),
                    T.message_content("messages", 40).alias("far_content"))


# -- P9: keep the prompt from the last marker; cut the completion before its last marker
@register("last_marker", f"""
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE '{M} a ' || text || ' {M} b' END AS marked
           FROM documents)
SELECT doc_id,
       CASE WHEN contains(marked, '{M}') THEN '{M}' || string_split(marked, '{M}')[-1] ELSE marked END AS prompt,
       CASE WHEN contains(marked, '{M}')
            THEN left(marked, length(marked) - length(string_split(marked, '{M}')[-1]) - {len(M)})
            ELSE marked END AS completion
FROM m
""")
def last_marker(spark, sf):
    d = D.marker_docs(_docs(spark, sf))
    return d.select("doc_id", T.from_last_marker("marked").alias("prompt"),
                    T.before_last_marker("marked").alias("completion"))


# -- P11: right-strip all whitespace of every candidate (of each turn's own list, no gathering)
@register("rstrip_all", """
SELECT conv_id, turn, regexp_replace(text || chr(10) || ' ', '\\s+$', '') AS completion
FROM conversations WHERE role = 'assistant'
""")
def rstrip_all(spark, sf):
    a = _conv(spark, sf).filter(F.col("role") == "assistant")
    lists = a.select("conv_id", "turn", F.array(F.concat("text", F.lit("\n "))).alias("completion"))
    return lists.select("conv_id", "turn", T.rstrip_all("completion")[0].alias("completion"))


# -- P12: chat-template render of the prompt messages with the generation cue
@register("chat_render", f"""
WITH f AS (SELECT conv_id, min(turn) AS t0 FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.conv_id, string_agg('<|' || c.role || '|>{NL}' || c.text || '{NL}', '' ORDER BY c.turn) || '<|assistant|>{NL}' AS rendered
FROM conversations c JOIN f USING (conv_id) WHERE c.turn < f.t0 GROUP BY c.conv_id
""")
def chat_render(spark, sf):
    conv = _conv(spark, sf)
    first = conv.filter(F.col("role") == "assistant").groupBy("conv_id").agg(F.min("turn").alias("t0"))
    head = conv.join(first, "conv_id").filter(F.col("turn") < F.col("t0"))
    msgs = D.chat_messages(head.drop("t0"))
    return msgs.select("conv_id", X.render_chat("messages").alias("rendered"))


# -- P13: fixed few-shot exemplar block (first 3 benchmark items) + prompt
EXEMPLARS = 3


@register("exemplars", f"""
SELECT u.conv_id, u.turn,
       (SELECT string_agg(text, '{NL}{NL}' ORDER BY item_id)
        FROM (SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT {EXEMPLARS})) || '{NL}{NL}' || u.text AS prompt
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""")
def exemplars(spark, sf):
    sft = X.canonical_sft(D.sft_examples(_conv(spark, sf)), "prompt", "completion", keep=["conv_id", "turn"])
    return X.with_exemplars(sft, table(spark, sf, "benchmark"), EXEMPLARS, "text", "item_id") \
        .select("conv_id", "turn", "prompt")


# -- O1 P3: mix two SFT sources (duplicates kept), seeded shuffle position
MIX_SEED = 42


@register("mixed_sources", f"""
WITH u AS (
  SELECT 'chat' AS source, u.conv_id::VARCHAR || ':' || u.turn::VARCHAR AS key
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
  UNION ALL
  SELECT 'docs' AS source, doc_id::VARCHAR AS key FROM documents)
SELECT source, key, row_number() OVER (ORDER BY md5('{MIX_SEED}:' || source || ':' || key), source, key) - 1 AS pos
FROM u
""")
def mixed_sources(spark, sf):
    chat = X.canonical_sft(D.sft_examples(_conv(spark, sf)), "prompt", "completion", keep=["conv_id", "turn"])
    chat = chat.withColumn("key", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    docs = X.canonical_sft(_docs(spark, sf), "lang", "text", keep=["doc_id"]) \
        .withColumn("key", F.col("doc_id").cast("string"))
    mixed = O.mix({"chat": chat.drop("conv_id", "turn"), "docs": docs.drop("doc_id")}, MIX_SEED, "key")
    return mixed.select("source", "key", "pos")
