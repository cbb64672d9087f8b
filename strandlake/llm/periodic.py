"""Maximal periodic runs of words, by masking of repeated k-grams and Main-Lorentz on what survives.

A run is a stretch of words that equal those `q` places before, where q is its smallest period, of
`LEAST` words and two periods at least, and as long as it can be. Words q apart are then equal in
at least max(LEAST - q, q) places, so a run is covered by k-grams that the document has twice, for
k = LEAST / 2. Words outside such k-grams can't be in a run. In each stretch that is left, blocks
are halved (Main-Lorentz): for every middle and period, how far the words before and after it
agree with those a period away tells the one run of that period at the middle. All middles and
periods of a level are one numpy step; agreement is measured by exact codes of 2^j words.

Defined results: a null, empty or wordless text has no runs and an empty collapsed text; repeated
rows stay repeated; other columns are carried only if asked for; an empty table gives an empty
result. A text is handled whole, whatever its length: memory is its surviving words times the
logarithm of the longest stretch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import with_columns

#: Words of the shortest run.
LEAST = 12
#: Bytes of text that one call handles, one text at least; pairs of words that one step compares.
CALL_BYTES, STEP = 1 << 20, 1 << 20


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of the pairs (a, b): equal pairs, equal codes."""
    return pd.factorize(a * np.int64(b.max(initial=0) + 1) + b)[0].astype(np.int64)


def gram_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the k words from each place, for all places that have as many."""
    if k == 1:
        return codes
    half = gram_codes(codes, k // 2)
    n = len(codes) - k + 1
    if n <= 0:
        return codes[:0]
    made = paired(half[: len(codes) - k // 2 * 2 + 1], half[k // 2 : k // 2 + len(codes) - k // 2 * 2 + 1])
    return made if k % 2 == 0 else paired(made[:n], codes[k - 1 : k - 1 + n])


def surviving(codes: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Whether each word is in a k-gram that its document has twice or more."""
    n = len(codes)
    if n < k:
        return np.zeros(n, bool)
    starts = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    own = paired(gram_codes(codes, k)[starts], doc[starts])
    twice = starts[np.bincount(own, minlength=1)[own] > 1]
    edge = np.zeros(n + 1, np.int64)
    edge[twice] += 1  # places are distinct
    edge[twice + k] -= 1
    return np.cumsum(edge[:-1]) > 0


class Agreement:
    """How far two places of `data` agree, forwards and backwards, by codes of 2^j entries."""

    def __init__(self, data: np.ndarray, longest: int) -> None:
        self.codes = [data]
        span = 1
        while span * 2 <= longest:
            last = self.codes[-1]
            wide = np.arange(len(data)) + len(data)  # near the end there are too few entries: codes that equal no other
            wide[: len(data) - span] = paired(last[: len(data) - span], last[span:])
            self.codes.append(wide)
            span *= 2

    def forwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal entries from a and from b > a on."""
        size, last = np.zeros(len(a), np.int64), len(self.codes[0]) - 1
        for level in range(len(self.codes) - 1, -1, -1):
            x, y = a + size, np.minimum(b + size, last)
            size += (self.codes[level][x] == self.codes[level][y]).astype(np.int64) << level
        return size

    def backwards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal entries before a and before b > a."""
        size = np.zeros(len(a), np.int64)
        for level in range(len(self.codes) - 1, -1, -1):
            x, y = a - size - (1 << level), b - size - (1 << level)
            size += ((x >= 0) & (self.codes[level][np.maximum(x, 0)] == self.codes[level][np.maximum(y, 0)])).astype(np.int64) << level
        return size

    def promising(self, a: np.ndarray, q: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Whether a and a + q may agree in `need` entries around: half of them lie on one side."""
        level = np.log2((need + 1) // 2).astype(np.int64)
        keep = np.zeros(len(a), bool)
        for j in np.unique(level):
            at = np.flatnonzero(level == j)
            x, y = a[at], a[at] + q[at]
            codes, width = self.codes[min(j, len(self.codes) - 1)], 1 << min(j, len(self.codes) - 1)
            back = (x >= width) & (codes[np.maximum(x - width, 0)] == codes[np.maximum(y - width, 0)])
            keep[at] = back | (codes[x] == codes[np.minimum(y, len(codes) - 1)])
        return keep


def steps(sizes: np.ndarray, most: int) -> list[slice]:
    """Slices of consecutive entries with a sum of about `most`."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    bounds = [0, *edges.tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def repetitions(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all runs in the stretches [lo, hi) of `codes`, sorted by start, then period."""
    size = hi - lo
    keep = size >= least
    lo, size = lo[keep], size[keep]
    if not len(lo):
        return (np.zeros(0, np.int64),) * 3
    # stretches stand side by side, each after an entry of its own that equals no other
    first = np.cumsum(size + 1) - size
    place = np.repeat(lo - first, size) + (at := np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum()))
    data = np.empty(len(place) + len(lo) + 1, np.int64)
    marks = np.concatenate((first - 1, [len(data) - 1]))
    data[marks] = codes.max() + 1 + np.arange(len(marks))
    data[at] = codes[place]
    source = np.zeros(len(data), np.int64)
    source[at] = place
    agree = Agreement(data, int(size.max()))
    found = []
    low, high = first, first + size
    while len(low):
        mid = (low + high) // 2
        # left of the middle and right of it: periods 1 to the middle's distance from the block's ends
        reach = np.concatenate((mid - low, high - mid))
        centre, left = np.concatenate((mid, mid)), np.arange(len(reach)) < len(mid)
        for part in steps(reach, STEP):
            n = reach[part]
            q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            a = np.repeat(centre[part], n) - np.where(np.repeat(left[part], n), q, 0)
            need = np.maximum(q, least - q)
            ok = agree.promising(a, q, need)
            a, q, need = a[ok], q[ok], need[ok]
            after, before = agree.forwards(a, a + q), agree.backwards(a, a + q)
            ok = after + before >= need
            found.append(np.stack((a - before, a + q + after, q))[:, ok])
        low, high = np.concatenate((low, mid)), np.concatenate((mid, high))
        keep = high - low >= least
        low, high = low[keep], high[keep]
    start, end, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(start)]
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    start, length, q = source[start[order]], (end - start)[order], q[order]
    return start, start + length, q


def runs_of(texts: list[bytes | None]) -> dict[str, list]:
    """Starts, lengths and periods of every text's runs, and its words without those after a run's first period."""
    words = [t.split() if t else [] for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(n_words) - n_words
    flat = np.empty(int(n_words.sum()), object)
    flat[:] = [w for each in words for w in each]
    codes = pd.factorize(flat)[0].astype(np.int64)
    doc = np.repeat(np.arange(len(words)), n_words)
    alive = surviving(codes, doc, LEAST // 2)
    edge = np.diff(np.concatenate(([0], np.where(alive, doc + 1, 0), [0])))
    bounds = np.flatnonzero(edge)  # stretches of one document, and those between
    lo, hi = (bounds[:-1], bounds[1:]) if len(bounds) else (bounds, bounds)
    inside = alive[lo] if len(lo) else np.zeros(0, bool)
    start, end, period = repetitions(codes, lo[inside], hi[inside])
    dropped = np.zeros(len(flat) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    owner = doc[start] if len(start) else start
    cuts = np.searchsorted(owner, np.arange(len(words) + 1))
    out: dict[str, list] = {"starts": [], "lengths": [], "periods": [], "collapsed": []}
    for k, own in enumerate(words):
        at = slice(cuts[k], cuts[k + 1])
        out["starts"].append((start[at] - first[k]).tolist())
        out["lengths"].append((end - start)[at].tolist())
        out["periods"].append(period[at].tolist())
        if cuts[k + 1] > cuts[k]:
            own = flat[first[k] : first[k] + n_words[k]][kept[first[k] : first[k] + n_words[k]]].tolist()
        out["collapsed"].append(b" ".join(own))
    return out


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id), `runs` (structs start, length, period by start, then period) and `collapsed` for every row; no shuffle."""
    schema = "starts array<long>, lengths array<long>, periods array<long>, collapsed string"
    made = with_columns(docs, text, runs_of, schema, keep or ["doc_id"], limit=CALL_BYTES)
    runs = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")))
    return made.withColumn("runs", runs).drop("starts", "lengths", "periods")
