"""Byte-level BPE on length-bucketed, padded numpy matrices.

Distinct pieces of a chunk are put into buckets by byte length, padded matrices of token ids of
bounded size. In every round each row merges its leftmost pair of minimum rank and is compacted; the
ranks of pairs are kept beside the ids, and only the two pairs that a merge makes are looked up, in
an open-addressing hash table. Finished rows leave the matrix. A piece longer than `LONGEST_ROW` is
one row folded into a matrix: a round merges its leftmost pair of minimum rank likewise, but compacts
only the fold that it stands in, and the minimum of each fold is remembered.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows stay
repeated; whole texts are encoded whatever their length; an empty table gives an empty result;
other columns are carried only if asked for.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256

import numpy as np
import regex
from pyspark.sql import DataFrame

from .batches import with_columns

#: Longest piece, in bytes, that is not folded, and the width of a fold.
LONGEST_ROW, FOLD = 2048, 512
#: Cells of a matrix.
CELLS = 1 << 18
#: Bytes of pieces and ids that a worker remembers before it starts anew; what each piece and id takes besides.
REMEMBERED, PIECE_BYTES, ID_BYTES = 96 << 20, 200, 40
_NONE = np.int64(1 << 40)


class PairTable:
    """Hash table from a pair of token ids to the id (and rank) of the merged token."""

    def __init__(self, tokens: dict[bytes, int]):
        keys, values = [], []
        for token, rank in tokens.items():
            for k in range(1, len(token)):
                left, right = tokens.get(token[:k]), tokens.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    values.append(rank)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        waiting_k, waiting_v = np.array(keys, np.int64), np.array(values, np.int64)
        slot, self.probes = self._slot(waiting_k), 0
        while len(waiting_k):
            free = self.keys[slot] == -1
            _, firsts = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(slot), bool)
            put[firsts] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = waiting_k[put], waiting_v[put]
            waiting_k, waiting_v, slot = waiting_k[~put], waiting_v[~put], (slot[~put] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, `_NONE` where there is none. Ids of -1 are padding."""
        keys = left.astype(np.int64) << 20 | right
        keys[(left < 0) | (right < 0)] = -2
        flat = keys.ravel()
        slot = self._slot(flat)
        out = np.where(self.keys[slot] == flat, self.values[slot], _NONE)
        open_ = np.flatnonzero((self.keys[slot] != flat) & (self.keys[slot] != -1) & (flat >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == flat[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out.reshape(keys.shape)


class Codec:
    def __init__(self, tiktoken_ranks: bytes, pattern: str):
        self.tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in tiktoken_ranks.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.table = PairTable(self.tokens)
        self.bytes_of = [b""] * (max(self.tokens.values()) + 1)
        for token, rank in self.tokens.items():
            self.bytes_of[rank] = token
        self.byte_ids = np.array([self.tokens[bytes([b])] for b in range(256)], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _rows(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """All pieces have a length of at most one bucket's width."""
        width = max(map(len, pieces))
        ids = np.full((len(pieces), width), -1, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        done: list[tuple[int, ...]] = [()] * len(pieces)
        rows = np.arange(len(pieces))
        # the last column has no pair and never a rank
        ranks = np.full(ids.shape, _NONE)
        ranks[:, :-1] = self.table.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(ids)), at]
            over = best == _NONE
            if over.any():
                for row, values in zip(rows[over].tolist(), ids[over].tolist(), strict=True):
                    done[row] = tuple(v for v in values if v >= 0)
                if over.all():
                    return done
                ids, ranks, at, best, rows = ids[~over], ranks[~over], at[~over], best[~over], rows[~over]
            each = np.arange(len(ids))
            keep = np.arange(ids.shape[1]) != at[:, None] + 1
            ids[each, at] = best
            ids, ranks = ids[keep].reshape(len(ids), -1), ranks[keep].reshape(len(ids), -1)
            last = ids.shape[1] - 1
            after = np.minimum(at + 1, last)
            ranks[each, at] = np.where(at < last, self.table.ranks(best, ids[each, after]), _NONE)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.table.ranks(ids[before, at[before] - 1], best[before])

    def _folded(self, piece: bytes) -> tuple[int, ...]:
        flat = self.byte_ids[np.frombuffer(piece, np.uint8)]
        folds = -(-len(flat) // FOLD)
        ids, ranks = np.full(folds * FOLD, -1, np.int64), np.full(folds * FOLD, _NONE)
        ids[: len(flat)] = flat
        ranks[: len(flat) - 1] = self.table.ranks(flat[:-1], flat[1:])
        ids, ranks = ids.reshape(folds, FOLD), ranks.reshape(folds, FOLD)
        sizes = [FOLD] * (folds - 1) + [len(flat) - (folds - 1) * FOLD]
        left, right = list(range(-1, folds - 1)), [*range(1, folds), -1]
        least = ranks.min(1)
        while True:
            f = int(least.argmin())
            best = least[f]
            if best == _NONE:
                return tuple(ids[ids >= 0].tolist())
            k = int(ranks[f].argmin())
            # the second token of the pair stands in this fold or is the first of the next one
            g, j = (f, k + 1) if k + 1 < sizes[f] else (right[f], 0)
            for own, empty in ((ids, -1), (ranks, _NONE)):
                own[g, j:-1] = own[g, j + 1 :]
                own[g, -1] = empty
            sizes[g] -= 1
            if not sizes[g]:
                left_of, right_of = left[g], right[g]
                right[left_of] = right_of
                if right_of >= 0:
                    left[right_of] = left_of
            ids[f, k] = best
            touched = {f, g}
            places, pairs = [], []
            after = ids[f, k + 1] if k + 1 < sizes[f] else ids[right[f], 0] if right[f] >= 0 else -1
            places.append((f, k))
            pairs.append((best, after))
            if k > 0 or left[f] >= 0:
                h, i = (f, k - 1) if k > 0 else (left[f], sizes[left[f]] - 1)
                places.append((h, i))
                pairs.append((ids[h, i], best))
                touched.add(h)
            found = self.table.ranks(*np.array(pairs, np.int64).T)
            for place, rank in zip(places, found, strict=True):
                ranks[place] = rank
            for t in touched:
                least[t] = ranks[t].min()

    def pieces(self, pieces: list[str]) -> None:
        """Encode distinct pieces that are not yet known."""
        buckets: dict[int, list[str]] = {}
        for piece in pieces:
            size = len(piece.encode())
            buckets.setdefault(1 << (size - 1).bit_length() if size <= LONGEST_ROW else 0, []).append(piece)
        for width, own in buckets.items():
            step = max(1, CELLS // width) if width else 1
            for first in range(0, len(own), step):
                raw = [p.encode() for p in own[first : first + step]]
                made = self._rows(raw) if width else [self._folded(b) for b in raw]
                self.known.update(zip(own[first : first + step], made, strict=True))
                self.held += PIECE_BYTES * len(raw) + sum(map(len, raw)) + ID_BYTES * sum(map(len, made))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        self.pieces(list(dict.fromkeys(p for each in cut for p in each if p not in self.known)))
        known = self.known
        return [[i for p in each for i in known[p]] for each in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(maxsize=2)
def codec(tiktoken_ranks: bytes, pattern: str) -> Codec:
    return Codec(tiktoken_ranks, pattern)


def ranks_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, n_tokens, ids (little-endian unsigned 32-bit) and the bytes they decode to.

    The rank file (a fixed vocabulary, under 1 MB) is read once and broadcast, so that executors
    need no copy at the same place.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_file(ranks_path))

    def run(texts: list[str | None]) -> dict[str, list]:
        own = codec(ranks.value, pattern)
        ids = own.encode(texts)
        packed = [np.array(x, "<u4").tobytes() for x in ids]
        return {"n_tokens": list(map(len, ids)), "ids": packed, "decoded": [own.decode(x) for x in ids]}

    return with_columns(docs, text, run, "n_tokens long, ids binary, decoded binary", keep or ["doc_id"], as_bytes=False)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As `encode`, with digests made beside the ids, so that neither ids nor bytes leave the worker."""
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_file(ranks_path))

    def run(texts: list[str | None]) -> dict[str, list]:
        own = codec(ranks.value, pattern)
        ids = own.encode(texts)
        return {
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [sha256(own.decode(x)).hexdigest() for x in ids],
        }

    return with_columns(docs, text, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep or ["doc_id"], as_bytes=False)
