"""DataFrame-level text operators (P1-P14, F1): projections, renames and renders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.functions import text as T
from prefengine.session import require_columns


def canonical_sft(df: DataFrame, prompt: str, completion: str, keep: list[str] | None = None) -> DataFrame:
    """Select + rename to (prompt, completion) (P1, P2, P8); everything else is dropped."""
    require_columns(df, prompt, completion, *(keep or []))
    return df.select(*(keep or []), F.col(prompt).alias("prompt"), F.col(completion).alias("completion"))


def canonical_pref(df: DataFrame, prompt: str, chosen: str, rejected: str, keep: list[str] | None = None) -> DataFrame:
    require_columns(df, prompt, chosen, rejected, *(keep or []))
    return df.select(*(keep or []), F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"),
                     F.col(rejected).alias("rejected"))


def strip_marker(df: DataFrame, cols: list[str], marker: str = T.END_OF_TEXT) -> DataFrame:
    """Remove the end-of-text marker from 1..n columns."""
    require_columns(df, *cols)
    return df.withColumns({c: T.strip_marker(c, marker) for c in cols})


def drop_identical(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Drop pairs whose two texts are equal (F1); pushed to the scan when columns are raw."""
    return df.filter(F.col(chosen) != F.col(rejected))


def instruction_preferences(df: DataFrame) -> DataFrame:
    """instruction/input/output_1/output_2/preference -> prompt/chosen/rejected."""
    require_columns(df, "instruction", "input", "output_1", "output_2", "preference")
    chosen, rejected = T.pick_by_preference("output_1", "output_2", "preference")
    return df.withColumns({"prompt": T.instruction_prompt("instruction", "input"),
                           "chosen": chosen, "rejected": rejected})


def render_dialogue(df: DataFrame, turns: str, chosen: str, rejected: str) -> DataFrame:
    """Dialogue turns -> (prompt transcript, " "+stripped chosen, " "+stripped rejected) (P10)."""
    require_columns(df, turns, chosen, rejected)
    return df.withColumns({"prompt": T.render_context(turns),
                           "chosen": T.response_text(chosen), "rejected": T.response_text(rejected)})


def render_chat(messages, role_open: str = "<|{role}|>\n", close: str = "\n", cue: str = "<|assistant|>\n"):
    """Chat-template render of an ordered array<struct<content, role>> plus the generation cue.

    ``role_open`` may contain ``{role}``; the template is applied in-row with transform."""
    pre, post = role_open.split("{role}") if "{role}" in role_open else (role_open, "")
    m = F.col(messages) if isinstance(messages, str) else messages
    parts = F.transform(m, lambda x: F.concat(F.lit(pre), x["role"], F.lit(post), x["content"], F.lit(close)))
    return F.concat(F.array_join(parts, ""), F.lit(cue))


def with_exemplars(df: DataFrame, exemplars: DataFrame, k: int, text: str, order: str,
                   col: str = "prompt", sep: str = "\n\n") -> DataFrame:
    """Prefix a fixed few-shot block (the first ``k`` exemplars) to every prompt.

    The block is a scalar subquery over a bounded top-k, evaluated once per query."""
    block = (exemplars.orderBy(order).limit(k)
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))),
                                           lambda x: x[text]), sep).alias("block")))
    return df.withColumn(col, F.concat(block.scalar(), F.lit(sep), F.col(col)))
