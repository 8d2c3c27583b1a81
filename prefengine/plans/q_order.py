"""Queries for ordering, indexing, batching, sharding and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefengine.functions.arrays import zip_checked
from prefengine.operators import order as O
from prefengine.operators.order import shuffle_key
from prefengine.operators.tokens import token_list
from prefengine.plans.registry import register, sql_md5_bits, sql_tokens, table
from prefengine.sources import driver_tables as D

SEED = 42
TAKE = 256
BATCH = 32
SHARDS = 4
EPOCHS = 2
REPEAT = 2
HEAD_PCT = 25
TAIL = 100

_SHUF = f"md5('{SEED}:' || doc_id::VARCHAR), doc_id"


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _shuffled(spark, sf):
    return _docs(spark, sf).select("doc_id", "lang").withColumn("_k", shuffle_key(SEED, "doc_id"))


# -- F3: shuffle then take N (bounded top-n, no global sort)
@register("shuffle_take", f"SELECT doc_id, lang FROM documents ORDER BY {_SHUF} LIMIT {TAKE}")
def shuffle_take(spark, sf):
    return O.sample_n(_docs(spark, sf).select("doc_id", "lang"), TAKE, SEED, "doc_id")


# -- B1 + B0: seeded shuffle position
@register("shuffle_positions", f"SELECT doc_id, row_number() OVER (ORDER BY {_SHUF}) - 1 AS pos FROM documents")
def shuffle_positions(spark, sf):
    return O.shuffled_index(_docs(spark, sf).select("doc_id"), SEED, "doc_id", name="pos")


# -- F2: hold out the last N rows in (n_chars, doc_id) order
@register("drop_tail", f"""
SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS back
                             FROM documents) WHERE back > {TAIL}
""")
def drop_tail(spark, sf):
    return O.drop_tail(_docs(spark, sf).select("doc_id", "n_chars"), TAIL, ["n_chars", "doc_id"], ["doc_id"])


# -- S5: first 25 % of the shuffled split
@register("head_fraction", f"""
SELECT doc_id, idx FROM (SELECT doc_id, row_number() OVER (ORDER BY {_SHUF}) - 1 AS idx FROM documents)
WHERE idx < floor((SELECT count(*) FROM documents) * {HEAD_PCT} / 100)
""")
def head_fraction(spark, sf):
    return O.head_fraction(_shuffled(spark, sf), HEAD_PCT, ["_k", "doc_id"], key="doc_id").select("doc_id", "idx")


# -- B2: fixed-size batches over the shuffled order (last batch partial)
@register("batches", f"""
SELECT doc_id, idx, (idx // {BATCH})::BIGINT AS batch_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY {_SHUF}) - 1 AS idx FROM documents)
""")
def batches(spark, sf):
    return O.assign_batches(_shuffled(spark, sf), BATCH, ["_k", "doc_id"]).select("doc_id", "idx", "batch_id")


# -- B3: shard by md5 bits of the key, co-located per shard
@register("shards", f"SELECT doc_id, ({sql_md5_bits('doc_id::VARCHAR')} % {SHARDS}) AS shard FROM documents")
def shards(spark, sf):
    return O.assign_shards(_docs(spark, sf).select("doc_id"), SHARDS, "doc_id")


# -- B5: two epochs, reshuffled per epoch
@register("epochs", f"""
SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch
                                         ORDER BY md5('{SEED}:' || epoch::VARCHAR || ':' || doc_id::VARCHAR), doc_id) - 1 AS pos
FROM documents, range(0, {EPOCHS}) e(epoch)
""")
def epochs(spark, sf):
    out = O.expand_epochs(_docs(spark, sf).select("doc_id"), EPOCHS, SEED, "doc_id")
    return out.select("doc_id", F.col("epoch").cast("bigint").alias("epoch"), "pos")


# -- B4: each prompt repeated n times
@register("repeat", f"""
SELECT u.conv_id, u.turn, r.rep
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1, range(0, {REPEAT}) r(rep)
WHERE u.role = 'user' AND a.role = 'assistant'
""")
def repeat(spark, sf):
    sft = D.sft_examples(table(spark, sf, "conversations")).select("conv_id", "turn")
    return O.repeat_rows(sft, REPEAT).withColumn("rep", F.col("rep").cast("bigint"))


# -- B6: length-checked zip of parallel lists (the words of a turn with their lengths)
@register("zip_checked", f"""
SELECT conv_id, turn, coalesce(array_to_string(list_transform({sql_tokens('text')},
                                                              lambda w: w || '=' || length(w)::VARCHAR), ','), '') AS zipped
FROM conversations WHERE role = 'assistant'
""")
def zip_checked_q(spark, sf):
    conv = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    lists = conv.select("conv_id", "turn", token_list("text").alias("words"))
    lists = lists.withColumn("sizes", F.transform("words", F.length))
    z = F.transform(zip_checked("words", "sizes"), lambda x: F.concat(x["words"], F.lit("="), x["sizes"].cast("string")))
    return lists.select("conv_id", "turn", F.array_join(z, ",").alias("zipped"))
