"""Removal of byte strings that also start in a document with a smaller doc_id.

A string of `length` bytes is known by the part of k bytes in it with the smallest hash, the leftmost
of several (its minimizer), and the bytes that reach from this part into the string's longer side: its
key is a hash of both, so equal strings always have one key, and strings that agree in a few words only
seldom do. Texts are dealt to homes by a hash of the text. Stages, all keyed and bounded:

1. texts go to their homes, packed and once; a home sends each key of its strings, with the number of
   its texts that have it, to the key's bucket;
2. there the keys that two homes have are told to these homes (texts of one home find there what they
   share);
3. homes cut out the stretches of strings under such a key (their contents, each once with its
   smallest document) and send them to the keys' buckets;
4. there a suffix array of the contents (two-stage sorting) and the common prefixes of neighbours
   give the smallest document of every string, which goes back to the homes;
5. homes mark what is covered, and hash what is left.

A key of over `HOT` different texts (a very common passage) has no stretches: its strings are sent one
by one as digests, once by each home, to buckets of the digests, and get the smallest document of all
homes there. So no group holds the edges of a common passage's copies, and of one string there is an
entry for each home (some 6 MB of text) at most. Equal texts are one text with its smallest document, in
every stage. All that is sent travels in packs, compressed. Nothing is sampled or capped.

Defined results: a null text is empty; a text shorter than `length` keeps all; of equal texts all
but those with the smallest id lose every byte (if long enough); repeated rows of one id are no
copies of each other; a null doc_id counts as the largest; an id that is no whole number is an error;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .batches import chunks, small_batches
from .suffixes import END, common_prefixes, suffix_array, words_at

PART = 16
BUCKET_BYTES = 6 << 20
FEWEST_BUCKETS = 256
BATCH_BYTES = 8 << 20
WORK_BYTES = 256 << 10
LAST = (1 << 63) - 1
#: Bits of a home beside a key in one number, of a key, and of a place in a text beside a part's hash.
HOME_BITS, KEY_BITS, PLACE_BITS = 24, 39, 31
#: Buckets of contents for each bucket of keys, which are smaller.
KEYS_WIDE = 4
#: Texts beyond which a key is hot.
HOT = 4096
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_PACK = zstandard.ZstdCompressor(level=1, write_checksum=False)
_UNPACK = zstandard.ZstdDecompressor()

TEXTS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
KEYS = pa.schema([("bucket", pa.int32()), ("source", pa.int32()), ("blob", pa.binary())])
#: single: digests of hot strings in place of contents.
CONTENTS = pa.schema([("bucket", pa.int32()), ("source", pa.int32()), ("single", pa.bool_()), ("blob", pa.binary())])
ANSWERS = pa.schema([("bucket", pa.int32()), ("single", pa.bool_()), ("blob", pa.binary())])
DONE = pa.schema([("k", pa.int64()), ("n", pa.int32()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def part_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the PART bytes from each place. It only brings strings together: where two parts
    have one hash, strings meet that differ, and are told apart by their bytes."""
    value = words_at(data)
    nxt = np.zeros_like(value)
    nxt[: len(value) - 8] = value[8:]
    value = (value ^ (value >> np.uint64(29))) * _ODD[0] + (nxt ^ (nxt >> np.uint64(31))) * _ODD[1]
    value ^= value >> np.uint64(32)
    value *= _ODD[2]
    return value ^ (value >> np.uint64(29))


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """KEY_BITS of a hash of two parts' hashes."""
    value = a * _ODD[3] + (b ^ (b >> np.uint64(31)))
    value ^= value >> np.uint64(32)
    value *= _ODD[1]
    return ((value ^ (value >> np.uint64(29))) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first place in the text, strings, key) of runs of strings with one key.

    Texts are taken some at a time, so that the arrays of a place each stay in cache.
    """
    found, begin, size = [], 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= WORK_BYTES or k + 1 == len(texts):
            owner, *rest = _stretches(texts[begin : k + 1], length)
            found.append((owner + begin, *rest))
            begin, size = k + 1, 0
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (empty, empty, empty, np.zeros(0, np.int64))


def _stretches(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts) + bytes(64), np.uint8)
    total = int(sizes.sum())
    empty = np.zeros(0, np.int64)
    if total < length:
        return empty, empty, empty, np.zeros(0, np.int64)
    hashes = part_hashes(data)
    # of equal hashes the leftmost is least
    least = hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(data), dtype=np.uint64)
    span, want = 1, length - PART + 1
    while 2 * span <= want:
        np.minimum(least[: len(least) - span], least[span:], out=least[: len(least) - span])
        span *= 2
    if want > span:
        np.minimum(least[: len(least) - (want - span)], least[want - span :], out=least[: len(least) - (want - span)])
    at = (least[:total] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    half = (length - PART) // 2
    late = at - np.arange(total) >= half
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    new = np.ones(total, bool)
    new[1:] = (at[1:] != at[:-1]) | (late[1:] != late[:-1])
    whole = sizes >= length
    valid = np.zeros(total + 1, np.int8)
    valid[starts[whole]] = 1
    np.add.at(valid, (starts + sizes - length + 1)[whole], -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    new[starts[sizes > 0]] = True
    begins = np.flatnonzero(new & valid)
    owner = np.searchsorted(starts, begins, side="right") - 1
    # a string's longer side holds `half` bytes before its part or behind it
    near = np.where(late[begins], at[begins] - half, at[begins])
    key = _key(hashes[near], hashes[near + half])
    more = np.ones(len(begins), bool)
    more[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    begins, owner, key = begins[more], owner[more], key[more]
    stops = np.minimum(np.append(begins[1:], total), starts[owner] + sizes[owner] - length + 1)
    return owner, begins - starts[owner], stops - begins, key


def key_of(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 42)


def pack(items: list[bytes], *numbers: np.ndarray) -> bytes:
    """Byte strings and arrays of as many whole numbers, compressed."""
    sizes = np.fromiter(map(len, items), "<i4", len(items))
    raw = b"".join([struct.pack("<i", len(items)), sizes.tobytes(), *[np.asarray(v, "<i8").tobytes() for v in numbers], *items])
    return _PACK.compress(raw)


def unpack(blob: bytes) -> tuple[list[bytes], Callable[[int], np.ndarray]]:
    """The byte strings, and a function from an array's place to the array."""
    raw = _UNPACK.decompress(blob)
    n = struct.unpack_from("<i", raw)[0]
    ends = np.cumsum(np.frombuffer(raw, "<i4", n, 4), dtype=np.int64) + (len(raw) - int(np.frombuffer(raw, "<i4", n, 4).sum()))
    starts = np.concatenate((ends[:0], [len(raw) - int(np.frombuffer(raw, "<i4", n, 4).sum())], ends[:-1])) if n else ends
    items = [raw[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
    return items, lambda k: np.frombuffer(raw, "<i8", n, 4 + 4 * n + 8 * n * k)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def pack_keys(keys: np.ndarray, numbers: np.ndarray) -> bytes:
    """Ascending keys with a number each, by steps and bytes of one weight, compressed."""
    return _PACK.compress(_planes(np.diff(keys, prepend=0)) + _planes(numbers))


def unpack_keys(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, numbers, place of the pack) of some packs."""
    found = [np.frombuffer(_UNPACK.decompress(blob), np.uint8).reshape(2, 8, -1) for blob in blobs]
    values = [np.ascontiguousarray(x.transpose(0, 2, 1)).view("<i8")[:, :, 0] for x in found]
    empty = [np.zeros(0, np.int64)]
    keys, numbers = np.concatenate(empty + [np.cumsum(v[0]) for v in values]), np.concatenate(empty + [v[1] for v in values])
    return keys, numbers, np.repeat(np.arange(len(values)), [v.shape[1] for v in values])


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Whether each value is one of the ascending ones."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) of each distinct key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(keys[places[0]]), places


def _smallest(pairs: Iterator[tuple[bytes, int]]) -> dict[bytes, int]:
    found: dict[bytes, int] = {}
    for text, doc in pairs:
        if found.get(text, LAST + 1) > doc:
            found[text] = doc
    return found


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _batches(docs: DataFrame, function: Callable[[dict[bytes, int]], pa.Table], ddl: str, length: int) -> DataFrame:
    """Rows that `function` makes of the distinct texts (with their smallest document) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, values in chunks(batch.column(1), BATCH_BYTES):
                for text, doc in _smallest(zip(values, ids[first : first + len(values)], strict=True)).items():
                    if text not in held:
                        size += len(text)
                        held[text] = doc
                    elif doc < held[text]:
                        held[text] = doc
                if size >= BATCH_BYTES:
                    yield from function(held).to_batches()
                    held, size = {}, 0
        if held:
            yield from function(held).to_batches()

    narrow = docs.select("doc", "text").where(F.octet_length("text") >= length).select("doc", F.col("text").cast("binary"))
    return narrow.mapInArrow(run, ddl)


def homes(texts: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((key_of(t) % buckets for t in texts), np.int64, len(texts))


def minimizer_rows(texts: dict[bytes, int], length: int, buckets: int) -> np.ndarray:
    """Each key with the home of each text that has it, in one number, ascending by keys."""
    every = list(texts)
    owner, _, _, key = stretches(every, length)
    x = np.sort(key << HOME_BITS | owner)
    x = x[np.concatenate((x[:1] >= 0, x[1:] != x[:-1]))]
    return x >> HOME_BITS << HOME_BITS | homes(every, buckets)[x & ((1 << HOME_BITS) - 1)]


def text_rows(texts: dict[bytes, int], buckets: int) -> list[tuple[int, bytes]]:
    every = list(texts)
    docs = np.fromiter(texts.values(), np.int64, len(every))
    return [(b, pack([every[k] for k in p.tolist()], docs[p])) for b, p in _split(homes(every, buckets))]


def _texts_of(table: pa.Table) -> dict[bytes, int]:
    def pairs() -> Iterator[tuple[bytes, int]]:
        for blob in table["blob"].to_pylist():
            texts, arrays = unpack(blob)
            yield from zip(texts, arrays(0).tolist(), strict=True)

    return _smallest(pairs())


def _keys(length: int, buckets: int, few: int):
    """Keys of a home's strings, each with the number of texts that have it, for the keys' buckets."""

    def run(key: tuple, texts: pa.Table) -> pa.Table:
        every = minimizer_rows(_texts_of(texts), length, buckets) >> HOME_BITS
        begins = np.flatnonzero(np.concatenate((every[:1] >= 0, every[1:] != every[:-1])))
        keys, number = every[begins], np.diff(np.append(begins, len(every)))
        source = key[0].as_py()
        return _table([(b, source, pack_keys(keys[p], number[p])) for b, p in _split(keys * few >> KEY_BITS)], KEYS)

    return run


def _tell(most: int):
    """Keys of several homes to each of these, and whether over `most` texts have them."""

    def run(table: pa.Table) -> pa.Table:
        keys, number, pack_of = unpack_keys(table["blob"].to_pylist())
        order = np.argsort(keys)
        keys, number, source = keys[order], number[order], table["source"].to_numpy()[pack_of[order]]
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(begins, len(keys)))
        hot = np.repeat(np.add.reduceat(number, begins) > most, size)
        shared = np.flatnonzero(np.repeat(size > 1, size))
        return _table([(s, pack_keys(keys[p], hot[p])) for s, p in ((s, shared[p]) for s, p in _split(source[shared]))], TEXTS)

    return run


def _met_here(m: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys that two texts of the home itself have."""
    x = np.sort(m << HOME_BITS | owner)
    m = x >> HOME_BITS
    return m[1:][(m[1:] == m[:-1]) & (x[1:] != x[:-1])]


def _cut_out(length: int, buckets: int):
    """Contents under shared keys, and every string under a hot key, with their smallest and largest document in the home."""

    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        found = _texts_of(texts)
        if not found:
            return _table([], CONTENTS)
        every, source = list(found), key[0].as_py()
        owner, first, n, least = stretches(every, length)
        keys, is_hot, _ = unpack_keys(told["blob"].to_pylist())
        hot = np.sort(keys[is_hot == 1])
        cold = np.setdiff1d(np.concatenate((keys, _met_here(least, owner))), hot)
        contents: dict[bytes, list[int]] = {}
        use = np.flatnonzero(_among(least, cold))
        for o, a, z, m in zip(owner[use].tolist(), first[use].tolist(), (first + n)[use].tolist(), least[use].tolist(), strict=True):
            text = every[o]
            content, doc = text[a : z + length - 1], found[text]
            old = contents.get(content)
            if old is None:
                contents[content] = [doc, doc, m]
            elif doc < old[0]:
                old[0] = doc
            elif doc > old[1]:
                old[1] = doc
        strings: dict[bytes, list[int]] = {}
        use = np.flatnonzero(_among(least, hot))
        for o, a, size, m in zip(owner[use].tolist(), first[use].tolist(), n[use].tolist(), least[use].tolist(), strict=True):
            text = every[o]
            doc = found[text]
            for k in range(a, a + size):
                old = strings.setdefault(text[k : k + length], [doc, doc, m])
                old[0], old[1] = min(old[0], doc), max(old[1], doc)
        rows = []
        for single, made in ((False, contents), (True, strings)):
            if not made:
                continue
            low, high, m = np.array(list(made.values()), np.int64).T
            listed = [xxhash.xxh3_128_digest(c) for c in made] if single else list(made)
            deal = np.frombuffer(b"".join(listed), "<u8")[::2] % np.uint64(buckets) if single else m % buckets
            rows += [(b, source, single, pack([listed[k] for k in p.tolist()], low[p], high[p], m[p])) for b, p in _split(deal)]
        return _table(rows, CONTENTS)

    return run


def smallest_documents(contents: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest document of the string from each place of each content, and where contents begin.

    The strings of a content are its first ones in the flat result; `length` values follow that
    belong to no string.
    """
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    data = np.frombuffer(b"".join(c + bytes([END]) for c in contents) + bytes(length + 16), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    words = words_at(data)
    order = suffix_array(data, words, length)
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    own = order[order < len(owner)]
    own = own[own - starts[owner[own]] <= sizes[owner[own]] - length]
    # strings are equal where the suffixes' common prefix reaches their length
    new = np.concatenate(([True], common_prefixes(words, own, length) < length))
    least = np.minimum.reduceat(docs[owner[own]], np.flatnonzero(new))
    at = np.full(len(data), LAST, np.int64)
    at[own] = least[np.cumsum(new) - 1]
    return at, starts


def _answer(length: int):
    def run(table: pa.Table) -> pa.Table:
        singles = table["single"].to_numpy()
        rows = _answer_strings(table.filter(pa.array(singles))) if singles.any() else []
        table = table.filter(pa.array(~singles))
        if not table.num_rows:
            return _table(rows, ANSWERS)
        number: dict[bytes, int] = {}
        asked = []
        for source, blob in zip(table["source"].to_pylist(), table["blob"].to_pylist(), strict=True):
            items, arrays = unpack(blob)
            asked.append((source, np.array([number.setdefault(c, len(number)) for c in items], np.int64), arrays(0), arrays(1), arrays(2)))
        every = np.concatenate([a[1] for a in asked])
        docs, m = np.full(len(number), LAST, np.int64), np.zeros(len(number), np.int64)
        np.minimum.at(docs, every, np.concatenate([a[2] for a in asked]))
        m[every] = np.concatenate([a[4] for a in asked])
        listed = list(number)
        # a content that is alone under its key has no string in common with another
        _, back, counts = np.unique(m, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[back] > 1)
        lowest, runs = docs.copy(), {}
        if len(several):
            some = [listed[k] for k in several.tolist()]
            at, starts = smallest_documents(some, docs[several], length)
            lowest[several] = np.minimum.reduceat(at, starts)
            for k, s, content in zip(several.tolist(), starts.tolist(), some, strict=True):
                runs[k] = (s, s + len(content) - length + 1)
        for source, places, _, high, marked in asked:
            # a string of a smaller document matters only to a text of a larger one
            tell = np.flatnonzero(lowest[places] < high)
            if len(tell):
                own = places[tell].tolist()
                least = [_runs(at[slice(*runs[k])]) if k in runs else _one_run(len(listed[k]) - length + 1, int(docs[k])) for k in own]
                rows.append((source, False, pack([xxhash.xxh3_128_digest(listed[k]) + v for k, v in zip(own, least, strict=True)], marked[tell])))
        return _table(rows, ANSWERS)

    return run


def _answer_strings(table: pa.Table) -> list[tuple]:
    """The smallest document of each digest, for the homes that have a larger one."""
    packs = [unpack(blob) for blob in table["blob"].to_pylist()]
    digests = np.frombuffer(b"".join(d for items, _ in packs for d in items), "<u8").reshape(-1, 2)
    low, high, m = (np.concatenate([arrays(k) for _, arrays in packs]) for k in range(3))
    source = np.repeat(table["source"].to_numpy(), [len(items) for items, _ in packs])
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    ranked = digests[order]
    begins = np.flatnonzero(np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1))))
    least = np.empty_like(low)
    least[order] = np.repeat(np.minimum.reduceat(low[order], begins), np.diff(np.append(begins, len(order))))
    tell = np.flatnonzero(least < high)
    return [(s, True, pack([digests[k].tobytes() for k in p.tolist()], least[p], m[p])) for s, p in ((s, tell[p]) for s, p in _split(source[tell]))]


def _one_run(size: int, value: int) -> bytes:
    return struct.pack("<qq", size, value)


def _runs(values: np.ndarray) -> bytes:
    """Run ends and values, as signed 64-bit numbers."""
    last = np.flatnonzero(values[1:] != values[:-1])
    if not len(last):
        return _one_run(len(values), int(values[0]))
    last = np.append(last, len(values) - 1)
    return np.column_stack((last + 1, values[last])).astype("<i8").tobytes()


def merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of the places that spans cover."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _finish(length: int):
    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        known: dict[bytes, bytes] = {}
        least_of: dict[bytes, int] = {}
        cold, hot = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for single, blob in zip(answers["single"].to_pylist(), answers["blob"].to_pylist(), strict=True):
            items, arrays = unpack(blob)
            if single:
                hot.append(arrays(1))
                least_of.update(zip(items, arrays(0).tolist(), strict=True))
            else:
                cold.append(arrays(0))
                known.update((item[:16], item[16:]) for item in items)
        found = _texts_of(texts)
        every = list(found)
        edges: dict[int, list[tuple[int, int]]] = {}
        if known or least_of:
            owner, first, n, m = stretches(every, length)
            is_hot = _among(m, np.sort(np.concatenate(hot)))
            use = np.flatnonzero(is_hot | _among(m, np.sort(np.concatenate(cold))))
            digest = xxhash.xxh3_128_digest
            for o, a, size, single in zip(owner[use].tolist(), first[use].tolist(), n[use].tolist(), is_hot[use].tolist(), strict=True):
                text = every[o]
                doc = found[text]
                if single:
                    spans = [(k, k + length) for k in range(a, a + size) if least_of.get(digest(text[k : k + length]), LAST) < doc]
                else:
                    begin, spans = 0, []
                    for end, least in struct.iter_unpack("<qq", known.get(digest(text[a : a + size + length - 1]), b"")):
                        if least < doc:
                            spans.append((a + begin, a + end + length - 1))
                        begin = end
                if spans:
                    edges.setdefault(o, []).extend(spans)
        out = []
        for o, spans in edges.items():
            text = every[o]
            merged = merge(spans)
            bounds = [0, *[x for span in merged for x in span], len(text)]
            kept = b"".join([text[a:z] for a, z in zip(bounds[::2], bounds[1::2], strict=True)])
            k = key_of(text)
            out.append((k - (1 << 64) if k >> 63 else k, len(text), len(text) - len(kept), len(merged), sha256(kept).hexdigest()))
        return _table(out, DONE)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} is no column of whole numbers")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), value.alias("text"))
    small_batches(docs)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    buckets = min(1 << HOME_BITS, max(FEWEST_BUCKETS, -(-total // BUCKET_BYTES)))

    texts = _batches(rows, lambda found: _table(text_rows(found, buckets), TEXTS), _ddl(TEXTS), length).groupBy("bucket")
    keys = texts.applyInArrow(_keys(length, buckets, max(FEWEST_BUCKETS, buckets // KEYS_WIDE)), _ddl(KEYS)).groupBy("bucket")
    told = keys.applyInArrow(_tell(HOT), _ddl(TEXTS)).groupBy("bucket")
    contents = texts.cogroup(told).applyInArrow(_cut_out(length, buckets), _ddl(CONTENTS)).groupBy("bucket")
    answers = contents.applyInArrow(_answer(length), _ddl(ANSWERS)).groupBy("bucket")
    done = texts.cogroup(answers).applyInArrow(_finish(length), _ddl(DONE))

    narrow = rows.select("doc_id", "doc", F.xxhash64("text").alias("k"), F.octet_length("text").alias("n"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    least = narrow.where(F.col("n") >= length).groupBy("k", "n").agg(F.min("doc").alias("least"))
    # cut here, so that the last join meets two plain shuffles and a hot text's rows can be split
    found = cut(least.join(done, ["k", "n"], "left"))
    joined = narrow.join(found, ["k", "n"], "left")
    copy = F.col("doc") > F.col("least")
    return joined.select(
        "doc_id",
        F.col("n").cast("long").alias("n_bytes"),
        F.when(copy, F.col("n").cast("long")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
