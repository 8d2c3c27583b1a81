"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a target number of words.  Its documents are shuffled (md5 order), laid end to
end and cut into blocks of equal word counts.  The schedule has one slot for each block that a
source may spend: slots are the points of the van der Corput sequence, mapped through the
cumulative slot counts of the sources, so every stretch of the schedule holds the sources in about
their target shares.  The k-th slot of a source takes its block k, starting over after the last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefengine.llm.common import WORD, running_sums, shared_table

#: Slots generated by one row of the chunk table, and slots ranked together.
CHUNK_BITS = 16


def source_targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3,
                   block_words: int = 2048, min_blocks: int = 1024) -> DataFrame:
    """Targets and slot counts from one row per source (source, source_size, n_docs).

    Sources in code-point order (null last) take ``weights`` in turn and share the sum of all sizes
    by weight; no target exceeds ``max_repeat`` times its source's size, and what is cut off goes to
    the others by weight.  That is the water level ``min(cap, level * weight)``: sources are passed
    in the order of cap / weight and stay capped until the level that the rest would get is lower.
    The windows without a partition run over one row per source, not over documents.

    Adds source_idx, weight, target, block (words of a block), n_blocks, slots and first_slot."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filling = Window.orderBy("__ratio", "source_idx")
    picks = F.array(*[F.lit(int(w)) for w in weights])
    s = (
        sources.withColumn("source_idx", F.row_number().over(everything))
        .withColumn("weight", F.get(picks, (F.col("source_idx") - 1) % len(weights)))
        .withColumn("__cap", F.col("source_size") * max_repeat)
        .withColumn("__ratio", F.col("__cap") / F.col("weight"))
        .withColumn("__all", F.sum("source_size").over(whole))
        .withColumn("__step", F.row_number().over(filling))
        .withColumn("__spent", F.coalesce(F.sum("__cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__share", (F.col("__all") - F.col("__spent")) * F.col("weight") / F.col("__open"))
    )
    below = F.when(F.col("__cap") > F.col("__share"), F.struct("__step", "__spent", "__open"))
    s = s.withColumn("__level", F.min(below).over(whole))
    free = F.col("__step") >= F.col("__level.__step")
    share = (F.col("__all") - F.col("__level.__spent")) * F.col("weight") / F.col("__level.__open")
    s = s.withColumn("target", F.when(free, share).otherwise(F.col("__cap")).cast("double"))

    size = F.col("source_size")
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(size / min_blocks))).cast("long"))
    s = s.withColumn("n_blocks", F.ceil(size / F.col("block")).cast("long"))
    rounds = F.floor(F.col("target") / size)
    slots = rounds * F.col("n_blocks") + F.round((F.col("target") - rounds * size) / F.col("block"))
    s = s.withColumn("slots", F.when(size > 0, F.least(slots, max_repeat * F.col("n_blocks"))).otherwise(0).cast("long"))
    s = s.withColumn("first_slot", F.sum("slots").over(Window.orderBy("source_idx")) - F.col("slots"))
    return s.select("source", "source_idx", "n_docs", "source_size", "weight", "target", "block", "n_blocks", "slots", "first_slot")


#: Tasks that make slots: each makes one row's chunk until there are so many.
MOST_TASKS = 20_000


def slot_schedule(targets: DataFrame) -> DataFrame:
    """(source_idx, slot, rank, block_no): the schedule.

    Point i of the van der Corput sequence in 2^m points is i with its m bits reversed; it falls
    into the source whose stretch of cumulative slot counts holds it.  Read the other way, the slot
    at place p of the cumulative counts comes at time ``slot`` = reversed bits of p, so no range
    join is needed, each source gets exactly its slots, and chunks of places spread a large source
    over many tasks.  ``rank`` counts the source's slots by time; block_no = rank mod n_blocks."""
    total = Window.partitionBy()
    t = targets.withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.sum("slots").over(total), F.lit(1)).cast("double")) - 1e-12)).cast("int"))
    t = t.filter(F.col("slots") > 0)
    chunk = 1 << CHUNK_BITS
    places = t.select("source_idx", "bits", "n_blocks", (F.col("first_slot") + F.col("slots")).alias("end"),
                      F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("slots") - 1, F.lit(chunk).cast("long"))).alias("start"))
    # each row makes up to 2^16 slots: the rows are dealt out before they are expanded, to a number of tasks that adaptive
    # execution keeps, since it judges by the few bytes that the rows have now
    n = t.agg(F.coalesce(F.sum(F.ceil(F.col("slots") / chunk)), F.lit(0))).first()[0]
    places = places.repartition(max(1, min(int(n), MOST_TASKS)), "source_idx", "start")
    p = places.select("source_idx", "bits", "n_blocks", F.explode(F.sequence("start", F.least(F.col("start") + (chunk - 1), F.col("end") - 1))).alias("place"))
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("place"), F.col("bits"), F.lit("0"))), 2, 10).cast("long")
    p = p.select("source_idx", "n_blocks", reversed_bits.alias("slot"))
    p = p.withColumn("__bucket", F.shiftright("slot", CHUNK_BITS))
    p = running_sums(p, ["source_idx"], "__bucket", [F.col("slot")], {"rank": F.lit(1)})
    return p.select("source_idx", "slot", "rank", (F.col("rank") % F.col("n_blocks")).alias("block_no"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, block_words: int = 2048, min_blocks: int = 1024,
                bucket_rows: int = 1_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mix and its documents.

    Returns ``(mix, members)``.  ``mix`` has a row per slot and document in its block: slot (order of
    the mix), source_idx, doc_pos, doc_id, first_word and n_words (the stretch of the document's words
    that the block holds).  ``members`` has a row per input row: doc_pos (place in the shuffled
    source), doc_id, source, source_idx, size (words), source_size and target.

    Defined cases: a null or blank text has size 0, belongs to its source and is never taken; null
    is a source of its own and comes last; a null id is an id like others; repeated rows are
    documents of their own; sources without words have target 0; an empty table gives empty results;
    other columns are ignored.  The shuffle depends on ids and ``seed`` only, so reruns agree."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sized = shared_table(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                     size.alias("size"), order.alias("__order")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = shared_table(source_targets(totals, weights, max_repeat, block_words, min_blocks), "mix-targets")

    own = targets.select(F.col("source").alias("__source"), "source_idx", "source_size", "target", "block", "n_docs")
    members = sized.join(own, F.col("source").eqNullSafe(F.col("__source")))
    buckets = F.ceil(F.col("n_docs") / bucket_rows)
    point = F.conv(F.substring("__order", 1, 8), 16, 10).cast("long")
    members = members.withColumn("__bucket", F.floor(point * buckets / F.lit(1 << 32)).cast("long"))
    members = running_sums(members, ["source_idx"], "__bucket", [F.col("__order"), F.col("size")],
                           {"doc_pos": F.lit(1), "start": F.col("size")})

    held = members.filter(F.col("size") > 0)
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("block"))
    pieces = held.select("source_idx", "doc_pos", "doc_id", "size", "start", "block",
                         F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), last)).alias("block_no"))
    low = F.greatest(F.col("start"), F.col("block_no") * F.col("block"))
    high = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block"))
    pieces = pieces.select("source_idx", "block_no", "doc_pos", "doc_id", "size", (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))
    mix = slot_schedule(targets).join(pieces, ["source_idx", "block_no"])
    return (mix.select("slot", "source_idx", "doc_pos", "doc_id", "size", "first_word", "n_words"),
            members.select("doc_pos", "doc_id", "source", "source_idx", "size", "source_size", "target"))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken (words that the mix takes
    of it, repeats counted).  Options and defined cases as in ``mix_sources``."""
    mix, members = mix_sources(docs, **options)
    rows = members.select("source_idx", "doc_pos", "doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("n_words"))
    spent = mix.select("source_idx", "doc_pos", "n_words")
    rows = rows.unionByName(spent, allowMissingColumns=True)
    own = [F.max(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    return (rows.groupBy("source_idx", "doc_pos").agg(*own, F.sum("n_words").alias("taken"))
            .select("doc_id", "source", "size", "source_size", "target", "taken"))
