"""String column functions (all built-in expressions, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
END_OF_TEXT = "<|endoftext|>"
HUMAN_CUE = "\n\nHuman: "
ASSISTANT_CUE = "\n\nAssistant: "
HUMAN_MARKER = "\n\nHuman:"
SUMMARY_MARKER = "SUBREDDIT"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_marker(c, marker: str = END_OF_TEXT) -> Column:
    """Remove every occurrence of ``marker``."""
    return F.replace(_c(c), F.lit(marker), F.lit(""))


def instruction_prompt(instruction, inp) -> Column:
    """``instruction`` + "\\n" + ``input`` when input is non-empty, else the instruction (P5).

    A NULL input counts as empty."""
    i = _c(inp)
    return F.when(i.isNotNull() & (i != F.lit("")),
                  F.concat(_c(instruction), F.lit("\n"), i)).otherwise(_c(instruction))


def pick_by_preference(a, b, pref) -> tuple[Column, Column]:
    """(chosen, rejected): 1 picks ``a``, 2 picks ``b``; any other value gives b, b."""
    p = _c(pref)
    chosen = F.when(p == F.lit(1), _c(a)).otherwise(_c(b))
    rejected = F.when(p == F.lit(2), _c(a)).otherwise(_c(b))
    return chosen, rejected


def message_content(c, idx: int) -> Column:
    """``messages[idx].content``, 0-based; NULL when out of range."""
    return F.get(_c(c), idx).getField("content")


def from_last_marker(c, marker: str = SUMMARY_MARKER) -> Column:
    """Text from the last ``marker`` on (inclusive); unchanged when absent."""
    x = _c(c)
    return F.when(F.contains(x, F.lit(marker)),
                  F.concat(F.lit(marker), F.substring_index(x, marker, -1))).otherwise(x)


def before_last_marker(c, marker: str = SUMMARY_MARKER) -> Column:
    """Text before the last ``marker``; unchanged when absent."""
    x = _c(c)
    keep = F.length(x) - F.length(F.substring_index(x, marker, -1)) - F.lit(len(marker))
    return F.when(F.contains(x, F.lit(marker)), F.substring(x, F.lit(1), keep)).otherwise(x)


def rstrip_ws(c) -> Column:
    """Right-strip all whitespace (``rtrim`` strips spaces only)."""
    return F.regexp_replace(_c(c), r"\s+$", "")


def strip_ws(c) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def rstrip_all(c) -> Column:
    """Right-strip every element of an array<string>."""
    return F.transform(_c(c), rstrip_ws)


def truncation_mode(prompt) -> Column:
    """keep_end when the prompt is a multi-turn transcript, else keep_start."""
    return F.when(F.contains(_c(prompt), F.lit(HUMAN_MARKER)), F.lit("keep_end")).otherwise(F.lit("keep_start"))


def render_context(turns) -> Column:
    """Alternate Human/Assistant cues so that the *last* context turn is Human, then the
    assistant cue without its trailing blank (P10)."""
    t = _c(turns)
    n = F.size(t)
    shift = (n + F.lit(1)) % F.lit(2)
    parts = F.transform(t, lambda s, i: F.concat(
        F.when(((i + shift) % F.lit(2)) == F.lit(0), F.lit(HUMAN_CUE)).otherwise(F.lit(ASSISTANT_CUE)), s))
    return F.concat(F.array_join(parts, ""), F.lit(ASSISTANT_CUE.rstrip()))


def response_text(c) -> Column:
    """" " + strip(text) (P10)."""
    return F.concat(F.lit(" "), strip_ws(c))


def md5_bits(*parts) -> Column:
    """First 32 bits of md5 over the ':'-joined parts, as bigint (same in the SQL oracle)."""
    s = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")
