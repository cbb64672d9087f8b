"""Suffix arrays by two-stage sorting, in numpy, for the texts of one bucket.

Only suffixes smaller than their successors are sorted directly; all others follow from scans over
the buckets of first bytes: a suffix that is larger than its successor stands in its own bucket in
the order in which the successors are met. Order is by the first `depth` bytes at least. Common
prefixes of neighbours are computed up to a limit.
"""

from __future__ import annotations

import numpy as np

DEPTH = 56
#: Ends every text; not a byte of UTF-8.
END = 0xFF


def words_at(data: np.ndarray) -> np.ndarray:
    """Big-endian value of the eight bytes from each place; data ends in padding."""
    value = data.astype(np.uint64)
    for size in (1, 2, 4):
        nxt = np.zeros_like(value)
        nxt[: len(value) - size] = value[size:]
        value = value << np.uint64(8 * size) | nxt
    return value


def smaller_than_successor(data: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one at the next; the last one is not."""
    n = len(data)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1].astype(np.int16))
    step[-1] = -1
    place = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(place[::-1])[::-1]
    return step[decided] > 0


def direct_sort(places: np.ndarray, words: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """`places` in the order of their next `depth` bytes at least; only ties are looked at further."""
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    tied = np.concatenate(([False], key[1:] == key[:-1]))
    group = np.cumsum(~tied)
    for at_byte in range(8, depth, 8):
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = order[at]
        value = words[np.minimum(own + at_byte, len(words) - 1)]
        sub = np.lexsort((value, group[at]))
        order[at] = own[sub]
        value = value[sub]
        same = np.zeros(len(at), bool)
        same[1:] = (value[1:] == value[:-1]) & (group[at][1:] == group[at][:-1])
        tied = np.zeros(len(order), bool)
        tied[at] = same
        fresh = np.zeros(len(order), np.int64)
        fresh[at] = ~same
        fresh[~open_] = 1
        group = np.cumsum(fresh)
    return order


def suffix_array(data: np.ndarray, words: np.ndarray | None = None, depth: int = DEPTH) -> np.ndarray:
    """Places of all suffixes of `data` (uint8, padded at its end), sorted to `depth` bytes at least."""
    n = len(data)
    words = words_at(data) if words is None else words
    small = smaller_than_successor(data)
    counts = np.bincount(data, minlength=256)
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
    ends = begins + counts
    table = np.full(n, -1, np.int64)
    direct = direct_sort(np.flatnonzero(small), words, depth)
    firsts = data[direct]
    # the directly sorted ones fill the ends of their buckets
    per = np.bincount(firsts, minlength=256)
    for c in np.flatnonzero(per):
        table[ends[c] - per[c] : ends[c]] = direct[np.searchsorted(firsts, c) : np.searchsorted(firsts, c, side="right")]
    front = begins.copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        number = np.bincount(first, minlength=256)
        starts = np.concatenate(([0], np.cumsum(number)[:-1]))
        table[front[first] + np.arange(len(before)) - starts[first]] = before
        front[:] += number

    induce(np.array([n]))
    for c in np.flatnonzero(counts):
        done = begins[c]
        while done < front[c]:
            stop = front[c]
            induce(table[done:stop])
            done = stop
        induce(table[ends[c] - per[c] : ends[c]])
    return table


def common_prefixes(words: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, in bytes and up to about `limit`, of each suffix in `order` and the next one."""
    left, right = order[:-1], order[1:]
    found = np.zeros(len(left), np.int64)
    open_ = np.arange(len(left))
    for at_byte in range(0, limit, 8):
        last = len(words) - 1
        differ = words[np.minimum(left[open_] + at_byte, last)] ^ words[np.minimum(right[open_] + at_byte, last)]
        # leading bytes that agree: 8 where nothing differs
        agree = (differ == 0).astype(np.int64)
        for k in range(1, 8):
            agree += differ < np.uint64(1 << 8 * k)
        found[open_] += agree
        open_ = open_[agree == 8]
    return found
