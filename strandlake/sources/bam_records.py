"""Records of binary alignments, a batch at a time: Arrow columns to bytes and back, and what an index needs.

Numpy moves whole columns of a batch; what differs from row to row only by few texts (CIGARs, tag
names) is read once for each text. Batches with letters outside ASCII, or with values that a field
can't hold, go row by row through `encoded`, which raises what there is to raise.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the format.
LETTERS, OPERATORS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: Numbers of the operators that cover the reference: M, D, N, = and X.
COVERING = {0, 2, 3, 7, 8}
#: Positions of a window of the linear index and of the smallest bins, in bits; the first bin of each level, smallest bins first.
WINDOW_BITS = 14
FIRST_BINS = [(14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)]
#: Bin of records without a place.
NO_BIN = 4680

#: The fixed part of a record, with its size in front.
HEAD = np.dtype([("size", "<i4"), ("contig", "<i4"), ("start", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("length", "<i4"), ("mate", "<i4"), ("mate_start", "<i4"), ("tlen", "<i4")])

_CODES = str.maketrans({c: "0123456789abcdef"[LETTERS.index(c)] if c in LETTERS else "f" for c in map(chr, range(256))})
_PHREDS = bytes(max(k - 33, 0) for k in range(256))
_STEP = re.compile(r"(\d+)([MIDNSHP=X])")
_SCORES = np.minimum(np.arange(256) + 33, 255).astype(np.uint8)
_CODE_OF = np.array([LETTERS.index(chr(k)) if chr(k) in LETTERS else 15 for k in range(256)], np.uint8)
_PHRED_OF = np.frombuffer(_PHREDS, np.uint8)
_PAIRS = np.array([[ord(LETTERS[k >> 4]), ord(LETTERS[k & 15])] for k in range(256)], np.uint8)


def bin_of(start: int, last: int) -> int:
    for bits, first in FIRST_BINS:
        if start >> bits == last >> bits:
            return first + (start >> bits)
    return 0


def bins_of(start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """`bin_of` of arrays."""
    found = np.zeros(len(start), np.int64)
    for bits, first in reversed(FIRST_BINS):
        found = np.where(start >> bits == last >> bits, first + (start >> bits), found)
    return found


def tag_bytes(name: str, value: str, kind: str) -> bytes:
    head = name.encode() + kind.encode()
    if kind in "ZH":
        return head + value.encode() + b"\0"
    if kind == "A":
        return head + value.encode()[:1]
    if kind == "B":
        code, *numbers = value.split(",")
        return head + code.encode() + struct.pack(f"<i{len(numbers)}{NUMBERS[code]}", len(numbers), *(float(n) if code == "f" else int(n) for n in numbers))
    return head + struct.pack("<" + NUMBERS[kind], float(value) if kind == "f" else int(value))


def encoded(row: dict, contigs: dict[str, int], kinds: dict[str, str]) -> bytes:
    """A record, with its size in front; a contig that the header lacks is an error."""
    steps = [(int(n), OPERATORS.index(o)) for n, o in _STEP.findall(row["cigar"])] if row["cigar"] not in (None, "*") else []
    seq = "" if row["seq"] in (None, "*") else row["seq"]
    name = (row["qname"] or "*").encode()
    if len(name) > 254 or any(c not in contigs for c in (row["contig"], row["mate_contig"])):
        raise ValueError(f"read {row['qname']} has a name of over 254 bytes, or a contig that the header lacks")
    start = -1 if row["start"] is None else row["start"]
    covered = sum(n for n, o in steps if o in COVERING)
    bin_ = bin_of(max(start, 0), max(start, 0) + max(covered, 1) - 1) if start >= 0 else NO_BIN
    qual = row["qual"]
    scores = b"\xff" * len(seq) if qual in (None, "*") or len(qual) != len(seq) else qual.encode("latin-1").translate(_PHREDS)
    parts = [
        struct.pack("<iiBBHHHiiii", contigs[row["contig"]], start, len(name) + 1, row["mapq"] or 0, bin_, len(steps), row["flag"] or 0, len(seq), contigs[row["mate_contig"]], -1 if row["mate_start"] is None else row["mate_start"], row["tlen"] or 0),
        name + b"\0",
        struct.pack(f"<{len(steps)}I", *(n << 4 | o for n, o in steps)),
        bytes.fromhex(seq.translate(_CODES) + "0" * (len(seq) & 1)),
        scores,
        *(tag_bytes(k, v, kinds.get(k, "Z")) for k, v in sorted(row["tags"] or []) if v is not None),
    ]
    body = b"".join(parts)
    return struct.pack("<i", len(body)) + body


def tags(data: bytes) -> dict[str, str]:
    made, at = {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            stop = data.index(0, at)
            value, at = data[at:stop].decode("utf-8", "replace"), stop + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            code, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            form = f"<{n}{NUMBERS[code]}"
            value = ",".join([code, *map(str, struct.unpack_from(form, data, at + 5))])
            at += 5 + struct.calcsize(form)
        else:
            value = str(struct.unpack_from("<" + NUMBERS[kind], data, at)[0])
            at += struct.calcsize(NUMBERS[kind])
        made[name] = value
    return made


# ---- stretches of bytes of different lengths


def firsts(lengths: np.ndarray) -> np.ndarray:
    """Where each stretch begins if all lie one behind the other."""
    return np.cumsum(lengths) - lengths


def move(target: np.ndarray, to: np.ndarray, source: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> None:
    """Copy stretches of `source` to places of `target`."""
    within = np.arange(int(lengths.sum())) - np.repeat(firsts(lengths), lengths)
    target[np.repeat(to, lengths) + within] = source[np.repeat(begin, lengths) + within]


def gathered(source: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of `source`, one behind the other."""
    shift = np.repeat(begin - firsts(lengths), lengths)
    return source[shift + np.arange(len(shift))]


def texts(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array of stretches that lie one behind the other; strings are checked."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    made = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return made if kind == pa.binary() else made.cast(pa.string())


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, beginnings and lengths of an array of strings without nulls."""
    column = column.cast(pa.string())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


# ---- columns to bytes


def whole_numbers(column: pa.Array, missing: int) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), missing).to_numpy(zero_copy_only=False)


def without_star(column: pa.Array) -> pa.Array:
    filled = pc.fill_null(column.cast(pa.string()), "*")
    return pc.if_else(pc.equal(filled, "*"), "", filled)


def encoded_batch(rows: pa.RecordBatch, contigs: dict[str, int], kinds: dict[str, str]) -> tuple[bytes, np.ndarray]:
    """The records of a batch, one behind the other, and their sizes; the same bytes as `encoded` row by row."""
    made = _encoded_columns(rows, contigs, kinds) if len(rows) else (b"", np.zeros(0, np.int64))
    if made is None:
        each = [encoded(row, contigs, kinds) for row in rows.to_pylist()]
        made = b"".join(each), np.array([len(e) for e in each], np.int64)
    return made


def _encoded_columns(rows: pa.RecordBatch, contigs: dict[str, int], kinds: dict[str, str]) -> tuple[bytes, np.ndarray] | None:
    n, of = len(rows), rows.column
    of = lambda name: rows.column(rows.schema.get_field_index(name))
    seq, qual = without_star(of("seq")), without_star(of("qual"))
    if not (pc.all(pc.string_is_ascii(seq)).as_py() and pc.all(pc.string_is_ascii(qual)).as_py()):
        return None
    name = pc.fill_null(of("qname").cast(pa.string()), "*")
    name = pc.if_else(pc.equal(name, ""), "*", name)
    known = [c for c in contigs if c is not None]
    numbers = np.array([contigs[c] for c in known], np.int64)
    places = {}
    for column in ("contig", "mate_contig"):
        found = pc.index_in(pc.fill_null(of(column).cast(pa.string()), "*"), value_set=pa.array(known, pa.string()))
        if found.null_count:
            return None
        places[column] = numbers[found.to_numpy(zero_copy_only=False)]
    values = {"mapq": whole_numbers(of("mapq"), 0), "flag": whole_numbers(of("flag"), 0), "start": whole_numbers(of("start"), -1), "mate_start": whole_numbers(of("mate_start"), -1), "tlen": whole_numbers(of("tlen"), 0)}

    kept = pc.dictionary_encode(without_star(of("cigar")))
    steps = [[int(k) << 4 | OPERATORS.index(o) for k, o in _STEP.findall(text)] for text in kept.dictionary.to_pylist()]
    of_text = kept.indices.to_numpy(zero_copy_only=False)
    n_steps = np.array([len(s) for s in steps], np.int64)
    step_bytes = np.array([s for text in steps for s in text], "<u4").view(np.uint8)
    covered = np.array([sum(s >> 4 for s in text if s & 15 in COVERING) for text in steps], np.int64)[of_text]
    ops = n_steps[of_text]

    start = values["start"]
    low = np.maximum(start, 0)
    bins = np.where(start >= 0, bins_of(low, low + np.maximum(covered, 1) - 1), NO_BIN)
    names, name_begin, name_size = bytes_of(name)
    letters, seq_begin, size = bytes_of(seq)
    scores, qual_begin, qual_size = bytes_of(qual)
    limits = [(name_size, 0, 254), (values["mapq"], 0, 255), (values["flag"], 0, 65535), (ops, 0, 65535), (bins, 0, 65535)]
    limits += [(values[c], -(1 << 31), (1 << 31) - 1) for c in ("start", "mate_start", "tlen")]
    if any(int(v.min()) < a or int(v.max()) > z for v, a, z in limits):
        return None

    tag_data, tag_size = tag_columns(of("tags"), kinds)
    half = (size + 1) // 2
    body = 32 + name_size + 1 + 4 * ops + half + size + tag_size
    sizes = body + 4
    at = firsts(sizes)
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros(n, HEAD)
    fields = {"size": body, "contig": places["contig"], "start": start, "name": name_size + 1, "mapq": values["mapq"], "bin": bins, "ops": ops, "flag": values["flag"], "length": size, "mate": places["mate_contig"], "mate_start": values["mate_start"], "tlen": values["tlen"]}
    for field, value in fields.items():
        head[field] = value
    out[at[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(n, HEAD.itemsize)
    at = at + HEAD.itemsize
    move(out, at, names, name_begin, name_size)
    at = at + name_size + 1
    move(out, at, step_bytes, 4 * firsts(n_steps)[of_text], 4 * ops)
    at = at + 4 * ops
    nibbles = np.zeros(2 * int(half.sum()), np.uint8)
    move(nibbles, 2 * firsts(half), _CODE_OF[letters], seq_begin, size)
    packed = nibbles[::2] << 4 | nibbles[1::2]
    move(out, at, packed, firsts(half), half)
    at = at + half
    given = (qual_size == size) & (qual_size > 0)
    move(out, at[given], _PHRED_OF[scores], qual_begin[given], size[given])
    out[np.repeat((at - firsts(np.where(given, 0, size)))[~given], size[~given]) + np.arange(int(size[~given].sum()))] = 255
    move(out, at + size, tag_data, firsts(tag_size), tag_size)
    return out.tobytes(), sizes


def tag_columns(column: pa.Array, kinds: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tags by row and name, one behind the other, and the bytes of each row."""
    n = len(column)
    ends = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
    entries = np.repeat(ends[:-1] - firsts(lengths), lengths) + np.arange(int(lengths.sum()))
    row = np.repeat(np.arange(n), lengths)
    keys, items = column.keys.take(pa.array(entries)).cast(pa.string()), column.items.take(pa.array(entries)).cast(pa.string())
    valid = items.is_valid().to_numpy(zero_copy_only=False)
    row, keys, items = row[valid], keys.filter(pa.array(valid)), items.filter(pa.array(valid))
    if not len(row):
        return np.zeros(0, np.uint8), np.zeros(n, np.int64)
    kept = pc.dictionary_encode(keys)
    named = kept.dictionary.to_pylist()
    rank = np.argsort(np.argsort(np.array(named, object)))[kept.indices.to_numpy(zero_copy_only=False)]
    by_name = np.argsort(rank, kind="stable")
    stops = np.cumsum(np.bincount(rank))
    blobs, sizes = [], []
    for k, (name, stop) in enumerate(zip(sorted(named), stops, strict=True)):
        own = items.take(pa.array(by_name[stops[k - 1] if k else 0 : stop]))
        data, size = one_tag(name, own, kinds.get(name, "Z"))
        blobs.append(data)
        sizes.append(size)
    data, size = np.concatenate(blobs), np.concatenate(sizes)
    begin, order = firsts(size), np.lexsort((rank[by_name], row[by_name]))
    return gathered(data, begin[order], size[order]), np.bincount(row[by_name], weights=size, minlength=n).astype(np.int64)


def one_tag(name: str, items: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of one tag's values, one behind the other, and their sizes."""
    head = np.frombuffer(name.encode() + kind.encode(), np.uint8)
    if kind in "ZH":
        source, begin, size = bytes_of(items)
        sizes = size + len(head) + 1
        out = np.zeros(int(sizes.sum()), np.uint8)
        out[firsts(sizes)[:, None] + np.arange(len(head))] = head
        move(out, firsts(sizes) + len(head), source, begin, size)
        return out, sizes
    if kind in "cCsSiI":
        try:
            values = items.cast(pa.int64()).to_numpy(zero_copy_only=False)
        except pa.ArrowInvalid:
            values = np.array([int(v) for v in items.to_pylist()], np.int64)
        form = np.dtype("<" + NUMBERS[kind])
        if values.min() < np.iinfo(form).min or values.max() > np.iinfo(form).max:
            raise ValueError(f"tag {name} has a value that its kind {kind} can't hold")
        out = np.empty((len(values), len(head) + form.itemsize), np.uint8)
        out[:, : len(head)] = head
        out[:, len(head) :] = values.astype(form).view(np.uint8).reshape(len(values), form.itemsize)
        return out.ravel(), np.full(len(values), out.shape[1])
    each = [tag_bytes(name, v, kind) for v in items.to_pylist()]
    return np.frombuffer(b"".join(each), np.uint8), np.array([len(e) for e in each], np.int64)


# ---- bytes to columns


class Heads:
    """The fixed parts of records that begin at `begin` (at their size) of `data`."""

    def __init__(self, data: np.ndarray, begin: np.ndarray):
        self.data, self.begin = data, begin
        self.head = data[begin[:, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
        wide = lambda field: self.head[field].astype(np.int64)
        self.contig, self.start, self.flag = wide("contig"), wide("start"), wide("flag")
        self.name_size, self.ops, self.length = wide("name"), wide("ops"), wide("length")
        self.end = begin + 4 + wide("size")
        self.at_cigar = begin + HEAD.itemsize + self.name_size
        kept = pc.dictionary_encode(texts(gathered(data, self.at_cigar, 4 * self.ops), 4 * self.ops, pa.binary()))
        steps = [struct.unpack(f"<{len(s) // 4}I", s) for s in kept.dictionary.to_pylist()]
        self._cigars, self._of = steps, kept.indices.to_numpy(zero_copy_only=False)
        covered = np.array([sum(c >> 4 for c in s if c & 15 in COVERING) for s in steps], np.int64)[self._of]
        self.last = self.start + np.maximum(covered, 1) - 1

    def cigars(self) -> pa.Array:
        return pa.array(["".join(f"{c >> 4}{OPERATORS[c & 15]}" for c in s) or "*" for s in self._cigars], pa.string()).take(pa.array(self._of))


def decoded_batch(data: np.ndarray, begin: np.ndarray, contigs: list[str]) -> tuple[list[pa.Array], np.ndarray]:
    """Columns of the reads schema of records of `data`, positions 0-based, and the last positions covered."""
    r = Heads(data, begin)
    named = pa.array([*contigs, "*"], pa.string())
    of = lambda k: named.take(pa.array(np.where(k >= 0, k, len(contigs))))
    ints = lambda v: pa.array(v.astype(np.int32), pa.int32())
    name = texts(gathered(data, begin + HEAD.itemsize, r.name_size - 1), r.name_size - 1)
    half = (r.length + 1) // 2
    at = r.at_cigar + 4 * r.ops
    # letters of all records, and a star behind them for those without
    letters = np.append(_PAIRS[gathered(data, at, half)].ravel(), np.uint8(ord("*")))
    none, shown = r.length == 0, np.maximum(r.length, 1)
    seq = texts(gathered(letters, np.where(none, len(letters) - 1, 2 * firsts(half)), shown), shown)
    at = at + half
    absent = none | (data[np.minimum(at, len(data) - 1)] == 255)
    shown = np.where(absent, 1, r.length)
    scores = _SCORES[gathered(data, np.where(absent, 0, at), shown)]
    scores[firsts(shown)[absent]] = ord("*")
    qual = texts(scores, shown) if scores.max(initial=0) < 128 else pa.array([b.decode("latin-1") for b in texts(scores, shown, pa.binary()).to_pylist()], pa.string())
    columns = [name, ints(r.flag), of(r.contig), ints(r.start), ints(r.head["mapq"]), r.cigars(), of(r.head["mate"].astype(np.int64)), ints(r.head["mate_start"]), ints(r.head["tlen"]), seq, qual, decoded_tags(data, at + r.length, r.end)]
    return columns, r.last


def decoded_tags(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> pa.Array:
    """Tags of records as maps; one round of the loop reads the next tag of every record that has one."""
    n, zeros = len(at), None
    active, at = np.arange(n), at.copy()
    rows, rounds, keys, values, names = [], [], [], [], {}
    turn = 0
    while len(active := active[at[active] < end[active]]):
        here = at[active]
        if (here + 3 > end[active]).any():
            raise ValueError("a record ends inside a tag")
        code = data[here].astype(np.int64) << 16 | data[here + 1].astype(np.int64) << 8 | data[here + 2]
        found, of = np.unique(code, return_inverse=True)
        for k, c in enumerate(found.tolist()):
            own = active[of == k]
            begin, kind, name = at[own] + 3, chr(c & 255), bytes([c >> 16, c >> 8 & 255]).decode()
            if kind in "ZH":
                zeros = np.flatnonzero(data == 0) if zeros is None else zeros
                which = np.searchsorted(zeros, begin)
                stop = zeros[np.minimum(which, len(zeros) - 1)] if len(zeros) else begin - 1
                if (which >= len(zeros)).any() or (stop >= end[own]).any():
                    raise ValueError("a record ends inside a tag")
                text = gathered(data, begin, stop - begin)
                try:
                    value = texts(text, stop - begin)
                except pa.ArrowInvalid:
                    value = pa.array([b.decode("utf-8", "replace") for b in texts(text, stop - begin, pa.binary()).to_pylist()], pa.string())
                at[own] = stop + 1
            elif kind == "A":
                value = pa.array([chr(b) for b in data[begin].tolist()], pa.string())
                at[own] = begin + 1
            elif kind == "B":
                raw = [data[b:e].tobytes() for b, e in zip(begin.tolist(), end[own].tolist(), strict=True)]
                sizes = [5 + struct.unpack_from("<i", b, 1)[0] * struct.calcsize(NUMBERS[chr(b[0])]) for b in raw]
                value = pa.array([next(iter(tags(b"xxB" + b[:s]).values())) for b, s in zip(raw, sizes, strict=True)], pa.string())
                at[own] = begin + np.array(sizes)
            elif kind in NUMBERS:
                form = np.dtype("<" + NUMBERS[kind])
                read = data[begin[:, None] + np.arange(form.itemsize)].reshape(-1).view(form)
                value = pa.array([str(v) for v in read.astype(np.float64).tolist()], pa.string()) if kind == "f" else pa.array(read.astype(np.int64)).cast(pa.string())
                at[own] = begin + form.itemsize
            else:
                raise ValueError(f"a tag has the unknown kind {kind!r}")
            rows.append(own)
            rounds.append(np.full(len(own), turn))
            keys.append(np.full(len(own), names.setdefault(name, len(names))))
            values.append(value)
        turn += 1
    kind = pa.map_(pa.string(), pa.string())
    if not rows:
        return pa.array([[]] * n, kind)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((np.concatenate(rounds), row))
    row, key, value = row[order], key[order], pa.concat_arrays(values).take(pa.array(order))
    if len(np.unique(row * len(names) + key)) < len(row):  # a name twice in a record: the last value holds
        listed, each = list(names), [{} for _ in range(n)]
        for i, k, v in zip(row.tolist(), key.tolist(), value.to_pylist(), strict=True):
            each[i][listed[k]] = v
        return pa.array([list(e.items()) for e in each], kind)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=n), out=ends[1:])
    return pa.MapArray.from_arrays(pa.array(ends), pa.array(list(names), pa.string()).take(pa.array(key)), value)


# ---- what an index needs


class IndexParts:
    """Chunks, windows and counts of the records seen so far, by contig."""

    def __init__(self):
        self.chunks: dict[tuple[int, int], list[list[int]]] = {}
        self.windows: dict[tuple[int, int], int] = {}
        self.totals: dict[int, list[int]] = {}
        self.without = 0

    def add(self, r: Heads, place: np.ndarray, after: np.ndarray) -> None:
        """Records in the order of their places; `after` is where the next one begins."""
        placed = (r.contig >= 0) & (r.start >= 0)
        self.without += int((~placed).sum())
        contig, start, last, flag, place, after = (v[placed] for v in (r.contig, r.start, r.last, r.flag, place, after))
        if not len(contig):
            return
        bins = bins_of(start, last)
        order = np.lexsort((place, bins, contig))
        c, b, p, z = contig[order], bins[order], place[order], after[order]
        new = np.append(True, (c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (p[1:] >> 16 > z[:-1] >> 16))
        first = np.flatnonzero(new)
        for k, number, begin, end in zip(c[first].tolist(), b[first].tolist(), p[first].tolist(), z[np.append(first[1:], len(p)) - 1].tolist(), strict=True):
            runs = self.chunks.setdefault((k, number), [])
            if runs and begin >> 16 <= runs[-1][1] >> 16:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([begin, end])
        low = start >> WINDOW_BITS
        n = (last >> WINDOW_BITS) - low + 1
        over = np.repeat(low - firsts(n), n) + np.arange(int(n.sum()))
        code, at = np.unique(np.repeat(contig, n) << 32 | over, return_index=True)  # the first is the least place
        for w, p in zip(code.tolist(), np.repeat(place, n)[at].tolist(), strict=True):
            key = w >> 32, w & 0xFFFFFFFF
            self.windows[key] = min(p, self.windows.get(key, p))
        for k in np.unique(contig).tolist():
            own = contig == k
            unmapped = int((flag[own] & 4 != 0).sum())
            seen = self.totals.setdefault(k, [int(place[own][0]), 0, 0, 0])
            self.totals[k] = [min(seen[0], int(place[own].min())), max(seen[1], int(after[own].max())), seen[2] + int(own.sum()) - unmapped, seen[3] + unmapped]

    def rows(self, file: str, contigs: list[str]) -> list[tuple]:
        """(file, contig, kind, bin, begin, end), as `bam.INDEX` has it."""
        made = [(file, contigs[k], "chunk", number, b, e) for (k, number), runs in self.chunks.items() for b, e in runs]
        made += [(file, contigs[k], "window", w, p, None) for (k, w), p in self.windows.items()]
        for k, (begin, end, mapped, unmapped) in self.totals.items():
            made += [(file, contigs[k], "span", None, begin, end), (file, contigs[k], "count", None, mapped, unmapped)]
        return made + ([(file, "*", "count", None, 0, self.without)] if self.without else [])
