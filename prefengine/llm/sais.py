"""Suffix array of a byte string by induced sorting, and its permuted common prefixes, in numpy.

The scans of induced sorting run bucket by bucket: what a bucket induces into later buckets is
placed at once, what it induces into itself in rounds (as many as its longest run of one byte).
"""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S-type flags, and the places of the leftmost S-type suffixes.  The last symbol is the unique smallest."""
    last = np.flatnonzero(np.append(t[:-1] != t[1:], True))  # ends of the runs of equal symbols
    rises = np.append(t[last[:-1]] < t[last[:-1] + 1], True)
    s = np.repeat(rises, np.diff(np.concatenate([[-1], last])))
    return s, np.flatnonzero(s[1:] & ~s[:-1]) + 1


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array that the leftmost S-type suffixes, in the order given, induce."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    tail = np.cumsum(size)
    head = tail - size
    marks = np.bincount(t[lms], minlength=256)
    by_symbol = lms[np.argsort(t[lms], kind="stable")]
    mark_at = np.cumsum(marks) - marks

    def place(found: list[np.ndarray], put: np.ndarray, step: int) -> None:
        """Append suffixes, in scan order, at the pointers of their symbols' buckets."""
        all_ = np.concatenate(found) if len(found) > 1 else found[0]
        if not len(all_):
            return
        symbol = t[all_]
        order = np.argsort(symbol, kind="stable")
        all_, symbol = all_[order], symbol[order]
        edge = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        for lo, hi in zip(edge, np.append(edge[1:], len(all_))):
            c, k = symbol[lo], hi - lo
            if step > 0:
                sa[put[c]:put[c] + k] = all_[lo:hi]
            else:
                sa[put[c] - k:put[c]] = all_[lo:hi][::-1]
            put[c] += step * k

    def before(suffixes: np.ndarray, kind: bool) -> np.ndarray:
        p = suffixes[suffixes > 0] - 1
        return p[s[p] == kind]

    # left to right: L-type suffixes from their successors
    put = head.copy()
    for c in range(256):
        if not size[c]:
            continue
        at, later = head[c], []
        while at < put[c]:
            p = before(sa[at:put[c]], False)
            at = put[c]
            own = t[p] == c
            k = int(own.sum())
            if k:
                sa[put[c]:put[c] + k] = p[own]
                put[c] += k
                p = p[~own]
            later.append(p)
        later.append(before(by_symbol[mark_at[c]:mark_at[c] + marks[c]], False))
        place(later, put, 1)
    ends = put  # of the L parts
    # right to left: S-type suffixes from their successors
    put = tail.copy()
    for c in range(255, -1, -1):
        if not size[c]:
            continue
        at, later = tail[c], []
        while at > put[c]:
            p = before(sa[put[c]:at][::-1], True)
            at = put[c]
            own = t[p] == c
            k = int(own.sum())
            if k:
                sa[put[c] - k:put[c]] = p[own][::-1]
                put[c] -= k
                p = p[~own]
            later.append(p)
        later.append(before(sa[head[c]:ends[c]][::-1], True))
        place(later, put, -1)
    sa[0] = n - 1
    return sa


def names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between leftmost S-type places, in text order; ``order`` is sorted by them."""
    length = np.zeros(len(t), np.int32)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    at, k = np.flatnonzero(same), 0
    while len(at):
        equal = t[a[at] + k] == t[b[at] + k]
        same[at[~equal]] = False
        at = at[equal]
        k += 1
        at = at[length[a[at]] > k]
    rank = np.zeros(len(t), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(~same)])
    return rank[lms]


def sort_names(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names.

    Each level names pairs of the level before, so names stand for twice as many substrings; it ends
    when all names differ."""
    n, span = len(rank), 1
    while rank.max() + 1 < n:
        after = np.append(rank[span:], np.full(min(span, n), -1))[:n] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        steps = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(steps)])
        span *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of ``t`` (uint8, ends with its only 0) in the order of the suffixes that start there."""
    size = np.bincount(t, minlength=256)
    s, lms = types(t)
    if len(lms) == 0:
        return induce(t, s, np.array([len(t) - 1]), size)
    first = induce(t, s, lms, size)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    rank = names(t, lms, first[is_lms[first]])
    return induce(t, s, lms[sort_names(rank)], size)


def repeated(t: np.ndarray, length: int) -> np.ndarray:
    """Flags of the places whose next ``length`` symbols also start at another place.

    Permuted common prefixes: for each place in text order the common prefix with the suffix sorted
    before it.  It shrinks by one a place at most, so every eighth is compared and hands a lower bound
    to the seven after it."""
    sa = suffix_array(t)
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    stride, cap = 8, length + 7
    padded = np.concatenate([t, np.zeros(cap + 16, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):  # eight symbols from each place on
        padded = padded[:-k] | padded[k:] << np.uint64(8 * k)

    def extend(p: np.ndarray, have: np.ndarray) -> np.ndarray:
        out, active = have.copy(), np.flatnonzero((before[p] >= 0) & (have < cap))
        while len(active):
            x = padded[p[active] + out[active]] ^ padded[before[p[active]] + out[active]]
            whole = x == 0
            ended = active[~whole]
            y = x[~whole]
            out[ended] += np.bitwise_count((y & (~y + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
            active = active[whole]
            out[active] += 8
            active = active[out[active] < cap]
        return out

    prefix = np.zeros(n, np.int64)
    some = np.arange(0, n, stride)
    prefix[some] = extend(some, np.zeros(len(some), np.int64))
    rest = np.flatnonzero(np.arange(n) % stride != 0)
    least = np.maximum(prefix[rest - rest % stride] - rest % stride, 0)
    prefix[rest] = least
    open_ = (least < length)
    prefix[rest[open_]] = extend(rest[open_], least[open_])
    long_ = np.flatnonzero(prefix >= length)
    found = np.zeros(n, bool)
    found[long_] = True
    found[before[long_]] = True
    return found
