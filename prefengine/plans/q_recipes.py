"""Loader recipes as composed operators, including the file scans and sinks
(S1, S4, K1, K3) over data Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefengine.functions import text as T
from prefengine.operators import order as O
from prefengine.operators import text as X
from prefengine.operators.pairs import flatten_candidates
from prefengine.plans.q_pairs import _SCORED_SQL, label_offline
from prefengine.plans.q_text import _DIALOGUE_SQL, _dialogue
from prefengine.plans.q_train import _LOG_SQL, interval_means
from prefengine.plans.registry import register, sql_fixed_mean, sql_md5_bits, table
from prefengine.session import shared_dir
from prefengine.sources import driver_tables as D
from prefengine.sources import readers as R
from prefengine.sources.sinks import write_jsonl, write_metrics

SEED = 42
SLICE_PCT = 25
M = T.SUMMARY_MARKER


# -- chat SFT on a 25 % slice (S5 P7 B1): first two messages of each conversation
@register("chat_sft_slice", f"""
WITH m AS (SELECT conv_id, list(struct_pack(content := text, role := role) ORDER BY turn) AS messages
           FROM conversations GROUP BY conv_id),
o AS (SELECT conv_id, messages, row_number() OVER (ORDER BY md5('{SEED}:' || conv_id::VARCHAR), conv_id) - 1 AS idx FROM m)
SELECT conv_id, idx, messages[1].content AS prompt, messages[2].content AS completion FROM o
WHERE idx < floor((SELECT count(*) FROM m) * {SLICE_PCT} / 100)
""")
def chat_sft_slice(spark, sf):
    msgs = D.chat_messages(table(spark, sf, "conversations"), max_messages=2) \
        .withColumn("_k", O.shuffle_key(SEED, "conv_id"))
    head = O.head_fraction(msgs, SLICE_PCT, ["_k", "conv_id"], key="conv_id")
    return head.select("conv_id", "idx", T.message_content("messages", 0).alias("prompt"),
                       T.message_content("messages", 1).alias("completion"))


# -- sampled + refined summaries (K1 S1 E1 P9 B1): candidate sets with few-shot prompts are
#    written as JSON Lines, read back with a declared schema, flattened, the prompt kept from
#    its last marker, each completion cut before its last marker, then shuffled
CAND_SCHEMA = "conv_id bigint, prompt string, completion array<string>"


@register("refined_summaries", f"""
WITH f AS (SELECT conv_id, min(turn) AS t0 FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p AS (SELECT f.conv_id, (SELECT arg_max(u.text, u.turn) FROM conversations u
                         WHERE u.conv_id = f.conv_id AND u.role = 'user' AND u.turn < f.t0) AS prompt FROM f
      WHERE EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = f.conv_id AND u.role = 'user' AND u.turn < f.t0)),
c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cand_idx,
             CASE WHEN turn % 2 = 0 THEN text || ' {M} next' ELSE text END AS completion
      FROM conversations WHERE role = 'assistant'),
x AS (SELECT c.conv_id, c.cand_idx, 'shot {M} one {M} ' || p.prompt AS prompt, c.completion
      FROM p JOIN c USING (conv_id)),
r AS (SELECT conv_id, cand_idx,
             CASE WHEN contains(prompt, '{M}') THEN '{M}' || string_split(prompt, '{M}')[-1] ELSE prompt END AS prompt,
             CASE WHEN contains(completion, '{M}')
                  THEN left(completion, length(completion) - length(string_split(completion, '{M}')[-1]) - {len(M)})
                  ELSE completion END AS completion
      FROM x)
SELECT conv_id, cand_idx, prompt, completion,
       row_number() OVER (ORDER BY md5('{SEED}:' || conv_id::VARCHAR || ':' || cand_idx::VARCHAR), conv_id, cand_idx) - 1 AS pos
FROM r
""")
def refined_summaries(spark, sf):
    conv = table(spark, sf, "conversations")
    asst = conv.filter(F.col("role") == "assistant").withColumn(
        "text", F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(f" {M} next"))).otherwise(F.col("text")))
    sets = D.candidate_sets(conv.filter(F.col("role") != "assistant").unionByName(asst))
    sets = sets.select("conv_id", F.concat(F.lit(f"shot {M} one {M} "), F.col("prompt")).alias("prompt"), "completion")
    path = shared_dir(spark, "refine-candidates")
    write_jsonl(sets, path)
    rows = flatten_candidates(R.read_jsonl(spark, path, CAND_SCHEMA))
    rows = rows.select("conv_id", "cand_idx", T.from_last_marker("prompt").alias("prompt"),
                       T.before_last_marker("completion").alias("completion"))
    return O.shuffled_index(rows, SEED, ["conv_id", "cand_idx"], name="pos")


# -- preference pairs from a split-partitioned table (S4): written partitioned by split, the
#    'test' split resolves to 'validation' and only that directory is read
@register("split_pairs", f"""
WITH {_DIALOGUE_SQL}
SELECT conv_id, prompt, chosen, rejected FROM dlg
WHERE chosen <> rejected AND {sql_md5_bits('conv_id::VARCHAR')} % 4 = 0
""")
def split_pairs(spark, sf):
    pairs = X.drop_identical(_dialogue(spark, sf))
    split = F.when(O.shard_of(4, "conv_id") == 0, F.lit("validation")).otherwise(F.lit("train"))
    root = shared_dir(spark, "hh-pairs")
    pairs.withColumn("split", split).write.partitionBy("split").parquet(root)
    return R.read_split(spark, root, "test").select("conv_id", "prompt", "chosen", "rejected")


# -- metric records per logging interval appended to a run-partitioned table (K3), read back
@register("metrics_table", f"""
WITH {_LOG_SQL}
SELECT run, interval::BIGINT AS interval, count(*) AS examples, {sql_fixed_mean('value')} AS value
FROM iv GROUP BY run, interval
""")
def metrics_table(spark, sf):
    m = interval_means(spark, sf).select("run", "interval", "examples", "value")
    path = shared_dir(spark, "metrics-table")
    write_metrics(m, path, partition_by="run", batch="intervals")
    return spark.read.parquet(path).select(F.col("run").cast("bigint").alias("run"), "interval", "examples", "value")


# -- instruction SFT (P5 P8): instruction = lang, input = source (empty for doc_id % 3 = 0),
#    output = text -> (prompt, completion)
@register("instruction_sft", """
SELECT doc_id,
       CASE WHEN doc_id % 3 <> 0 AND source <> '' THEN lang || chr(10) || source ELSE lang END AS prompt,
       text AS completion
FROM documents
""")
def instruction_sft(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("instruction"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("input"),
        F.col("text").alias("output"))
    d = d.withColumn("prompt", T.instruction_prompt("instruction", "input"))
    return X.canonical_sft(d, "prompt", "output", keep=["doc_id"])


# -- chat preferences (P7 P7 B1): prompt = first message, chosen = second, rejected = fourth
#    (NULL when the conversation is shorter), shuffled
@register("chat_preferences", f"""
WITH m AS (SELECT conv_id, list(struct_pack(content := text, role := role) ORDER BY turn) AS messages
           FROM conversations GROUP BY conv_id)
SELECT conv_id, messages[1].content AS prompt, messages[2].content AS chosen, messages[4].content AS rejected,
       row_number() OVER (ORDER BY md5('{SEED}:' || conv_id::VARCHAR), conv_id) - 1 AS pos
FROM m
""")
def chat_preferences(spark, sf):
    m = D.chat_messages(table(spark, sf, "conversations"), max_messages=4)
    p = m.select("conv_id", T.message_content("messages", 0).alias("prompt"),
                 T.message_content("messages", 1).alias("chosen"), T.message_content("messages", 3).alias("rejected"))
    return O.shuffled_index(p, SEED, "conv_id", name="pos")


# -- mixed preferences (O1 P2 P3 B1): document pairs and dialogue pairs (identical texts
#    dropped), one frame with its source, duplicates kept, seeded shuffle
@register("mixed_preferences", f"""
WITH {_DIALOGUE_SQL},
ranked AS (SELECT d.doc_id, d.lang, l.quality,
                  row_number() OVER (PARTITION BY d.lang, l.quality ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - 1 AS rk
           FROM documents d JOIN labels l USING (doc_id)),
u AS (SELECT 'docs' AS source, g.doc_id::VARCHAR || ':' || b.doc_id::VARCHAR AS key
      FROM ranked g JOIN (SELECT lang, count(*) AS n FROM ranked WHERE quality = 0 GROUP BY lang) nb ON nb.lang = g.lang
          JOIN ranked b ON g.lang = b.lang AND g.rk % nb.n = b.rk AND g.quality = 1 AND b.quality = 0
      UNION ALL
      SELECT 'dialogue' AS source, conv_id::VARCHAR AS key FROM dlg WHERE chosen <> rejected)
SELECT source, key, row_number() OVER (ORDER BY md5('{SEED}:' || source || ':' || key), source, key) - 1 AS pos FROM u
""")
def mixed_preferences(spark, sf):
    docs = D.doc_pairs(table(spark, sf, "documents"), table(spark, sf, "labels"))
    docs = X.canonical_pref(docs, "prompt", "chosen", "rejected", keep=["chosen_id", "rejected_id"]).withColumn(
        "key", F.concat_ws(":", F.col("chosen_id").cast("string"), F.col("rejected_id").cast("string")))
    dlg = X.drop_identical(_dialogue(spark, sf)).withColumn("key", F.col("conv_id").cast("string"))
    mixed = O.mix({"docs": docs.drop("chosen_id", "rejected_id"), "dialogue": dlg.drop("conv_id")}, SEED, "key")
    return mixed.select("source", "key", "pos")


# -- labelled pairs reloaded (K1 S1 B1): offline labels written as JSON Lines, read back with a
#    declared schema and shuffled
LABEL_SCHEMA = ("conv_id bigint, pair_idx bigint, chosen_turn bigint, rejected_turn bigint, "
                "chosen_score double, rejected_score double")


@register("labelled_pairs_reload", f"""
{_SCORED_SQL},
lab AS (SELECT conv_id, pair_idx,
               CASE WHEN chosen_score > rejected_score THEN first_turn ELSE second_turn END AS chosen_turn,
               CASE WHEN chosen_score > rejected_score THEN second_turn ELSE first_turn END AS rejected_turn,
               greatest(chosen_score, rejected_score) AS chosen_score, least(chosen_score, rejected_score) AS rejected_score
        FROM scored)
SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || conv_id::VARCHAR || ':' || pair_idx::VARCHAR), conv_id, pair_idx) - 1 AS pos
FROM lab
""")
def labelled_pairs_reload(spark, sf):
    lab = label_offline(spark, sf)
    path = shared_dir(spark, "labelled-pairs")
    write_jsonl(lab, path)
    back = R.read_jsonl(spark, path, LABEL_SCHEMA)
    return O.shuffled_index(back, SEED, ["conv_id", "pair_idx"], name="pos")
