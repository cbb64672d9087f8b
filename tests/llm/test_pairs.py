"""SimHash groups, components, repeated strings and contamination against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import components, decontaminate, repeats, simhash, suffixes

ODD = [None, "", " \n\t ", "a", "Ärger ß 漢字 😀", "x" * 5000, "word " * 3000, "same text here", "same text here", "\x00\x01\x7f", "'s 't 12 ,,, \r\n"]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    """Smallest id reachable from each id, by plain union of all pairs."""
    parent = list(range(len(values)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(values)):
        for b in range(a):
            if near(values[a], values[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(values))]


def close(a, b):
    return (a ^ b).bit_count() <= 3


def test_fingerprints_and_groups(spark, documents, docs):
    texts = [r["text"] for r in documents.orderBy("doc_id").limit(150).collect()] + ODD
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs(*texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [found[k]["fp"] % (1 << 64) for k in range(len(texts))] == prints
    assert [found[k]["component_id"] for k in range(len(texts))] == groups(prints, close)


def test_links_of_chosen_fingerprints(spark, monkeypatch):
    """Sparse cells, dense cells and blocks all keep every connection."""
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(150)}
    for seed in list(values)[:20]:
        for _ in range(6):
            value = seed
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                value ^= 1 << bit
            values.add(value)
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(1, 64, 3)}
    values = sorted(values | {0, 1, (1 << 64) - 1})
    expected = groups(values, close)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for dense, block in ((48, 1024), (2, 16), (10_000, 4)):
        monkeypatch.setattr(simhash, "DENSE", dense)
        monkeypatch.setattr(simhash, "BLOCK", block)
        edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
        assert all(close(e["a"] % (1 << 64), e["b"] % (1 << 64)) for e in edges)
        place = {v: k for k, v in enumerate(signed)}
        linked = {(place[e["a"]], place[e["b"]]) for e in edges}
        linked |= {(b, a) for a, b in linked}
        reach = groups(list(range(len(signed))), lambda a, b: (a, b) in linked)
        assert reach == expected


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(300)], "a long, b long")
    made = rows.select("a", "b", simhash.manhattan(simhash.embedding(F.col("a")), simhash.embedding(F.col("b"))).alias("m"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h"))
    for r in made.collect():
        counts = lambda v: [(v >> (2 * s) & 3).bit_count() for s in range(32)]
        assert r["m"] == sum(abs(x - y) for x, y in zip(counts(r["a"] % (1 << 64)), counts(r["b"] % (1 << 64)), strict=True)) <= r["h"]


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(301)}, **{k: 1000 for k in range(1000, 1200)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_simhash_table_cases(spark, docs):
    rows = docs((None, "a b c"), (7, "a b c"), (7, "a b c"), (9, None), (8, ""))
    found = sorted(((str(r["doc_id"]), r["component_id"]) for r in simhash.near_duplicates(rows.withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))).collect()), key=str)
    assert found == [("7", 7), ("7", 7), ("8", 8), ("9", 8), ("None", 7)]
    assert simhash.near_duplicates(docs("x").limit(0)).collect() == []


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(60):
        text = bytes(rng.choices(rng.choice([b"a", b"ab", b"abcdefgh"]), k=rng.choice([1, 5, 60, 500, 1500])))
        data = np.frombuffer(text + b"\xff" + bytes(64), np.uint8)
        order = suffixes.suffix_array(data)
        assert sorted(order.tolist()) == list(range(len(data)))
        keys = [data.tobytes()[k : k + suffixes.DEPTH] for k in order]
        assert keys == sorted(keys)


def test_common_prefixes():
    rng = random.Random(8)
    for _ in range(40):
        text = bytes(rng.choices(rng.choice([b"a", b"ab", b"abcd"]), k=rng.choice([2, 60, 700])))
        data = np.frombuffer(text + b"\xff" + bytes(80), np.uint8)
        words, order = suffixes.words_at(data), suffixes.suffix_array(data)
        got = suffixes.common_prefixes(words, order, 56).tolist()
        raw = data.tobytes()
        for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), got, strict=True):
            x, y = raw[a : a + 56], raw[b : b + 56]
            true = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), 56)
            assert n == true or (n >= true and min(len(x), len(y)) < 56)


def plain_repeats(rows, length=50):
    first = {}
    for doc, text in rows:
        for k in range(len(text) - length + 1):
            part = text[k : k + length]
            first[part] = min(first.get(part, doc), doc)
    out = []
    for doc, text in rows:
        gone = bytearray(len(text))
        for k in range(len(text) - length + 1):
            if first[text[k : k + length]] < doc:
                gone[k : k + length] = b"1" * length
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((doc, len(text), len(text) - len(kept), spans, sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_of_documents(documents):
    rows = documents.limit(200)
    plain = [(r["doc_id"], (r["text"] or "").encode()) for r in rows.collect()]
    assert sorted(tuple(r) for r in repeats.remove_repeats(rows).collect()) == plain_repeats(plain)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_hard_texts(docs, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(90):
        kind = rng.random()
        if kind < 0.3:
            text = "a" * rng.randint(0, 300)
        elif kind < 0.6:
            text = "".join(rng.choices("ab", k=rng.randint(0, 90)))
        elif kind < 0.8:
            text = "xy" * rng.randint(10, 80) + str(k)
        else:
            text = "".join(rng.choices("é漢a", k=rng.randint(0, 30))) + "The quick brown fox jumps over the lazy dog, far away from here. " * rng.randint(1, 3)
        rows.append((rng.randint(0, 60), text))
    found = sorted(tuple(r) for r in repeats.remove_repeats(docs(*rows, partitions=5)).collect())
    assert found == plain_repeats([(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize("hot", [0, 1, 3])
def test_repeats_of_hot_passages(docs, monkeypatch, hot):
    """Common passages in different surroundings, by the way of hot minimizers."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(hot)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passages = [letters(n) for n in (50, 51, 90, 400)]
    rows = [(rng.randint(0, 60), letters(rng.randint(0, 80)) + rng.choice(passages) + letters(rng.randint(0, 80))) for _ in range(80)]
    found = sorted(tuple(r) for r in repeats.remove_repeats(docs(*rows, partitions=7)).collect())
    assert found == plain_repeats([(i, t.encode()) for i, t in rows])


def test_rows_of_the_first_stage_do_not_grow_with_buckets():
    rng = random.Random(4)
    texts = {"".join(rng.choices("abcdefghijklmnop ", k=2000)).encode(): k for k in range(300)}
    sizes = [len(repeats.minimizer_rows(texts, 50, buckets)) for buckets in (256, 5_000, 500_000)]
    assert max(sizes) - min(sizes) < 0.01 * max(sizes)
    # what homes get of texts is packed text by text at worst
    raw = sum(map(len, texts))
    assert all(sum(len(b) for _, b in repeats.text_rows(texts, buckets)) < 1.1 * raw for buckets in (256, 5_000, 500_000))


def test_common_words_are_no_shared_keys():
    """Texts that share pieces far shorter than a string don't meet; those that share a string do."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    words = [letters(28) for _ in range(30)]
    keys = []
    for _ in range(2):
        texts = {"".join(letters(22) + rng.choice(words) for _ in range(40)).encode(): k for k in range(40)}
        keys.append(np.unique(repeats.minimizer_rows(texts, 50, 256).astype(np.uint64) >> np.uint64(repeats.HOME_BITS)))
    assert len(np.intersect1d(*keys)) < 0.001 * len(keys[0])
    one, other = ({(letters(a) + "x" * 9 + words[0] + words[1] + letters(a)).encode(): 1} for a in (100, 37))
    same = np.intersect1d(*[repeats.minimizer_rows(t, 50, 256) >> repeats.HOME_BITS for t in (one, other)])
    assert len(same) > 0


def test_copies_of_a_text_are_not_hot(docs, monkeypatch):
    """What is hot are keys of many different texts, in how many batches they may be."""
    monkeypatch.setattr(repeats, "HOT", 3)
    singles = []
    keys = [pa.table({"bucket": [0], "source": [k], "blob": [repeats.pack_keys(np.array([7, 9]), np.array([1, 2]))]}) for k in range(2)]
    told = repeats._tell(3)(pa.concat_tables(keys))
    for blob in told["blob"].to_pylist():
        found, hot, _ = repeats.unpack_keys([blob])
        singles.append((found.tolist(), hot.tolist()))
    assert singles == [([7, 9], [0, 1])] * 2
    rows = [(k, "The same sentence of a good sixty bytes, told over and over." + "!" * (k % 3)) for k in range(40)]
    found = sorted(tuple(r) for r in repeats.remove_repeats(docs(*rows, partitions=8)).collect())
    assert found == plain_repeats([(i, t.encode()) for i, t in rows])


def test_repeats_of_other_columns_and_ids(docs):
    rows = docs((1, "y" * 60), (2, "y" * 60)).withColumns({c: F.lit("x") for c in ("doc", "k", "n", "least", "bucket", "blob", "whole")})
    assert sorted((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(rows).collect()) == [(1, 0), (2, 60)]
    with pytest.raises(TypeError):
        repeats.remove_repeats(rows.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_repeats_table_cases(docs):
    text = "y" * 60
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs((None, text), (3, text), (3, text), (4, None), (5, ""))).collect())
    assert found == [("3", 60, 0, 0), ("3", 60, 0, 0), ("4", 0, 0, 0), ("5", 0, 0, 0), ("None", 60, 60, 1)]
    assert repeats.remove_repeats(docs("x").limit(0)).collect() == []


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        n = min(width, len(words))
        for k in range(len(words) - n + 1) if n else []:
            windows[tuple(words[k : k + n])].add(str(item))
    out = []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                own = windows.get(tuple(words[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((doc, len(words), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 50_000])
def test_contamination_against_loops(spark, docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "ß", "Éa", "x1", "漢"])
    items = [(k, " ".join(word() for _ in range(rng.randint(0, 16)))) for k in range(25)] + [(3, "a B"), (98, None), (99, "... !")]
    texts = [(k, "-".join([*(word() for _ in range(rng.randint(0, 30))), rng.choice(items)[1] or "", *(word() for _ in range(5))])) for k in range(60)] + [(60, None), (61, ""), (61, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs(*texts), bench).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got), key=str) == plain_contamination(texts, items)
    assert sorted(r["doc_id"] for r in got) == sorted(k for k, _ in texts)


def test_contamination_of_clashing_columns(spark, docs):
    names = ("h", "w", "at", "token", "items", "size", "window", "n_words", "start", "length", "copies")
    bench = spark.createDataFrame([(1, "a b c"), (None, "c d")], "item_id long, text string").withColumns({c: F.lit("x") for c in names})
    rows = decontaminate.contamination(docs("x a b c", None, "c d").withColumns({c: F.lit(1) for c in names}), bench).collect()
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in rows) == [(0, 3, ["1"]), (1, 0, []), (2, 2, [])]


def test_contamination_of_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(docs("x").limit(0), bench).collect() == []
    rows = decontaminate.contamination(docs("a b c", None), bench.limit(0)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in rows) == [(0, 3, 0), (1, 0, 0)]
