"""Array column functions for token ids, masks and labels.

Every function is linear in the array length: per-row offsets are computed once (``let``)
and referenced from inside the per-element lambda, never recomputed per element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
IGNORE_INDEX = -100


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def drop_last_if(a, token: int) -> Column:
    x = _c(a)
    return F.when(F.try_element_at(x, F.lit(-1)) == F.lit(token),
                  F.slice(x, F.lit(1), F.size(x) - F.lit(1))).otherwise(x)


def drop_first_if(a, token: int) -> Column:
    x = _c(a)
    return F.when(F.try_element_at(x, F.lit(1)) == F.lit(token),
                  F.slice(x, F.lit(2), F.greatest(F.size(x) - F.lit(1), F.lit(0)))).otherwise(x)


def clip_prompt(p, eos: int) -> Column:
    """Drop a trailing EOS from the prompt ids."""
    return drop_last_if(p, eos)


def clip_completion(c, bos: int, eos: int) -> Column:
    """Drop a leading BOS, then a trailing EOS, from the completion ids."""
    return drop_last_if(drop_first_if(c, bos), eos)


def truncate_prompt(p, c, max_length: int, max_prompt_length: int, mode) -> Column:
    """Cut the prompt only if the pair is over budget *and* the prompt is over its own cap.

    ``mode`` is 'keep_start' / 'keep_end' or a column holding one of them per row."""
    pa, ca = _c(p), _c(c)
    m = F.lit(mode) if isinstance(mode, str) else mode
    k = F.lit(max_prompt_length)
    over = (F.size(pa) + F.size(ca) > F.lit(max_length)) & (F.size(pa) > k)
    start = F.slice(pa, F.lit(1), k)
    end = F.slice(pa, F.greatest(F.size(pa) - k + F.lit(1), F.lit(1)), k)
    return (F.when(over & (m == F.lit("keep_start")), start)
            .when(over & (m == F.lit("keep_end")), end)
            .when(over, F.raise_error(F.concat(F.lit("unknown truncation mode: "), m)))
            .otherwise(pa))


def truncate_completion(p, c, max_length: int) -> Column:
    """Then cut the completion to the remaining budget (Python slice semantics for a
    negative remainder) (T3)."""
    pa, ca = _c(p), _c(c)
    room = F.lit(max_length) - F.size(pa)
    keep = F.when(room >= 0, room).otherwise(F.greatest(F.size(ca) + room, F.lit(0)))
    return F.when(F.size(pa) + F.size(ca) > F.lit(max_length), F.slice(ca, F.lit(1), keep)).otherwise(ca)


def append_token(a, token: int) -> Column:
    """T4."""
    return F.array_append(_c(a), F.lit(token))


def combined_ids(p, c) -> Column:
    """T5 sequence."""
    return F.concat(_c(p), _c(c))


def prompt_masked_labels(p, c) -> Column:
    """T5 labels: IGNORE_INDEX on every prompt position, then the completion ids."""
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.size(_c(p))), _c(c))


def ones_like(a) -> Column:
    return F.array_repeat(F.lit(1), F.size(_c(a)))


def pad_right(a, length, value: int) -> Column:
    x = _c(a)
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(n - F.size(x), F.lit(0))))


def pad_left(a, length, value: int) -> Column:
    x = _c(a)
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.array_repeat(F.lit(value), F.greatest(n - F.size(x), F.lit(0))), x)


def position_ids(mask) -> Column:
    """cumsum(mask) - 1, 0 on pads; real tokens form one contiguous block."""
    m = _c(mask)
    return let(F.array_position(m, 1), lambda first: F.transform(
        m, lambda x, i: F.when(x == F.lit(0), F.lit(0)).otherwise((i - first + F.lit(1)).cast("int"))))


def has_token(a, token: int) -> Column:
    """F4."""
    return F.array_contains(_c(a), F.lit(token))


def _first_index(a, token: int) -> Column:
    """0-based index of the first ``token``; the array length when absent."""
    x = _c(a)
    p = F.array_position(x, F.lit(token))
    return F.when(p > 0, p - F.lit(1)).otherwise(F.size(x))


def truncate_after(a, stop: int, pad: int) -> Column:
    """Positions after the first ``stop`` become ``pad``; length kept."""
    x = _c(a)
    return let(_first_index(x, stop), lambda t: F.transform(
        x, lambda v, i: F.when(i > t, F.lit(pad)).otherwise(v)))


def completion_mask(a, stop: int) -> Column:
    """1 up to and including the first ``stop``, 0 after."""
    x = _c(a)
    return let(_first_index(x, stop), lambda t: F.transform(
        x, lambda v, i: F.when(i > t, F.lit(0)).otherwise(F.lit(1))))


def last_real_index(a, pad: int) -> Column:
    """(index of first pad - 1) mod length; with no pad this is the last index."""
    x = _c(a)
    p = F.array_position(x, F.lit(pad))
    first = F.when(p > 0, p - F.lit(1)).otherwise(F.lit(0))
    return F.when(F.size(x) > 0, F.pmod(first - F.lit(1), F.size(x)))


def target_length(labels) -> Column:
    """Scored tokens: labels shifted by one, != IGNORE_INDEX."""
    return F.size(F.filter(_c(labels), lambda x, i: (i > F.lit(0)) & (x != F.lit(IGNORE_INDEX))))


def zip_checked(*cols) -> Column:
    """arrays_zip that raises when lengths differ."""
    cs = [_c(c) for c in cols]
    same = F.lit(True)
    for c in cs[1:]:
        same = same & (F.size(c) == F.size(cs[0]))
    return F.when(same, F.arrays_zip(*cs)).otherwise(
        F.raise_error(F.lit("zip_checked: parallel lists differ in length")))
