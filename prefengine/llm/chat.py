"""Chat formatting: cumulative snapshots collapse, then conversations are rendered.

Logs often hold a conversation several times, as it was after each exchange.  Rolling hashes of the
turn prefixes identify every conversation that is a prefix of a longer one (or equal to another);
anti-joins keep the maximal ones, which are rendered with role markers.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefengine.llm.common import running_sums, shared_table

#: Turns that are ordered together, and turns rendered into one output row.
BLOCK_TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def known(df: DataFrame, col: str) -> Column:
    """The column with some value for null (told apart by a flag beside it)."""
    return F.coalesce(F.col(col), F.lit("0").cast(df.schema[col].dataType))


def ordered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos, role, text): places from 0 in the order of turn (null first), role and text.

    No conversation is ordered in one task: turns are bucketed by their number first."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    t = t.withColumn("__no_conv", F.col("conv_id").isNull()).withColumn("__conv", known(t, "conv_id"))
    t = t.withColumn("__bucket", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))))
    t = running_sums(t, ["__conv", "__no_conv"], "__bucket", [F.col("turn"), F.col("role"), F.col("text")], {"pos": F.lit(1)})
    return t.select("conv_id", "pos", "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2): 128 bits that stand for the turns 0..pos.

    Each turn is hashed with its place, and the hashes are run up by exclusive or, first over blocks
    and then within each, so a very long conversation is spread over tasks."""
    h = lambda seed: F.xxhash64(F.lit(seed), "pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    t = turns.select("conv_id", known(turns, "conv_id").alias("c"), F.col("conv_id").isNull().alias("nc"), "pos",
                     F.floor(F.col("pos") / BLOCK_TURNS).alias("block"), h(1).alias("a"), h(2).alias("b"))
    xor = lambda c: F.expr(f"bit_xor({c})")
    keys = ["c", "nc", "block"]
    before = Window.partitionBy("c", "nc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(*keys).agg(xor("a").alias("a"), xor("b").alias("b"))
    blocks = blocks.select(*keys, F.coalesce(xor("a").over(before), F.lit(0)).alias("a0"), F.coalesce(xor("b").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(blocks, keys)
    return t.select("conv_id", "pos", F.col("a0").bitwiseXOR(xor("a").over(inside)).alias("h1"), F.col("b0").bitwiseXOR(xor("b").over(inside)).alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other one continues; of equal ones the smallest id.

    ``turns`` as from ``ordered_turns``.  A frequent first turn or a frequent conversation is one key
    with many rows; both sides are aggregated before they meet."""
    hashes = shared_table(prefix_hashes(turns), "turn-prefixes")
    last = hashes.groupBy("conv_id").agg(F.max("pos").alias("pos"))
    whole = hashes.alias("p").join(last.alias("l"), F.col("p.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("p.pos") == F.col("l.pos")))
    whole = whole.select("p.conv_id", "p.pos", "h1", "h2")
    one = whole.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    proper = hashes.alias("p").join(last.alias("l"), F.col("p.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.col("p.pos") < F.col("l.pos")))
    continued = proper.select("p.pos", "h1", "h2").distinct()
    kept = one.join(continued, ["pos", "h1", "h2"], "left_anti")
    return kept.select("conv_id", (F.col("pos") + 1).alias("n_turns"))


def render_turn(role: Column, text: Column) -> Column:
    """One turn with its markers; marker strings inside a text are broken by a space."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations, rendered.

    A row holds up to ``BLOCK_TURNS`` turns; parts of a conversation in order make its whole text, so no
    row or task grows with the longest conversation.  n_turns counts the whole conversation.  Defined
    cases: a null role is "unknown", a null text empty (but not equal to an empty one when prefixes
    are compared); turns with equal numbers are ordered by role and text; repeated rows are turns of
    their own; rows without conv_id are one conversation; an empty table gives no rows; other columns
    are ignored."""
    ordered = shared_table(ordered_turns(turns, conv_col, turn_col, role_col, text_col), "turns")
    kept = maximal_conversations(ordered).withColumnRenamed("conv_id", "kept_id")
    rows = ordered.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    part = F.floor(F.col("pos") / BLOCK_TURNS).cast("int").alias("part")
    turn = F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("text"))
    rows = rows.groupBy("conv_id", part, "n_turns").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", "part", "n_turns", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"))
