"""Merkle manifest, mixing of sources and periodic runs against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import merkle, mixing, periodic, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, size long, runs string, __p string, key string"
LONG = "word and more " * 80_000
ODD = [
    (1, None, "en", "a", None),
    (1, "", "en", "a", 0),
    (2, " \t ", None, "a", 1),
    (None, "Ärger ß 漢字", "de", None, 3),
    (None, "x y z", "de", None, 3),
    (None, "x y z", "de", None, 3),
    (7, "same same", "en", "b", 1),
    (7, "same same", "en", "b", 1),
    (8, LONG, "en", "", 5),
    (9, "A b C " * 10, "en", "b", 1),
]


def table(spark, rows, partitions=3):
    """A documents table with further columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "k") for r in rows], SCHEMA).repartition(partitions)


# ---- Merkle manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """(root, for each node the (before, after) of every level)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            run = nodes[a // 16 * 16 : a // 16 * 16 + 16]
            steps[k].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return (nodes[0] if nodes else None), steps


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, text, lang, source, n_chars) rows, sorted."""
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        trees[(source is not None, (source or "").encode())].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), doc_id))
    own = {}
    for name in sorted(trees):
        trees[name].sort(key=lambda r: r[:3])
        own[name] = plain_tree([r[2] for r in trees[name]])
    root, above = plain_tree([own[name][0] for name in own])
    return sorted(
        ((r[3], r[2], own[name][0], root, own[name][1][k] + above[i]) for i, name in enumerate(own) for k, r in enumerate(trees[name])),
        key=str,
    )


def made_manifest(frame, top):
    found = merkle.manifest(frame, queries.LEAF, top=top).proofs()
    assert found.where("folded_root <> root").count() == 0
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["proof"]]) for r in found.collect()), key=str)


def test_manifest_of_odd_rows(spark):
    assert made_manifest(table(spark, ODD), merkle.TOP) == plain_manifest(ODD)
    assert merkle.manifest(table(spark, ODD[:1]), queries.LEAF).root == leaf(1, "a", "en", None, None)


def test_manifest_of_no_rows(spark):
    empty = merkle.manifest(table(spark, ODD).limit(0), queries.LEAF)
    assert empty.root is None and empty.proofs().count() == 0


@pytest.mark.parametrize("top", [merkle.TOP, 5, 2])
def test_rounds_give_the_same_tree(spark, top):
    """Trees of several blocks; few nodes for the driver, so that rounds repeat and sources are joined in rounds as well."""
    rows = [(k, f"t{k}", None, "hot" if k > 20 else None if k > 12 else f"s{k % 3}", k) for k in range(9_000)]
    assert made_manifest(table(spark, rows, 5), top) == plain_manifest(rows)


def test_probes_fail_unless_equal(spark):
    frame = table(spark, [(k, f"T{k}", "en", "s", 1) for k in range(40)])
    probe = F.when(F.col("doc_id") % 4 == 0, merkle.digest([F.lower(c) if c == "text" else F.col(c) for c in queries.LEAF]))
    found = merkle.manifest(frame, queries.LEAF, probe=probe, keep=["lang"]).proofs()
    assert {(r["doc_id"], r["folded_root"] == r["root"]) for r in found.collect()} == {(k, k % 4 != 0) for k in range(40)}
    assert found.columns[:2] == ["doc_id", "lang"]


# ---- mixing


def plain_targets(sizes, weights, epochs=3):
    """Shares of the total by weight; what is above a limit is shared again among the others."""
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in capped]
        rest, shares = total - sum(capped.values()), sum(weights[s] for s in open_)
        over = [s for s in open_ if rest * weights[s] / shares > epochs * sizes[s]]
        if not over:
            return capped | {s: rest * weights[s] / shares for s in open_}
        capped |= {s: epochs * sizes[s] for s in over}


def by_source(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    return {s: sizes[s] for s in names}, {s: k % 3 + 1 for k, s in enumerate(names)}


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), "en", "hot" if k % 3 else rng.choice(["a", "b", "c", "d", None]), 1) for k in range(600)] + ODD
    sizes, weights = by_source(rows)
    found = mixing.mix(table(spark, rows)).collect()
    assert len(found) == len(rows)
    expected, taken = plain_targets(sizes, weights), Counter()
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in expected.items())
    again = mixing.mix(table(spark, rows, 7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    other = mixing.mix(table(spark, rows), seed="other").collect()
    assert sorted(map(str, found)) != sorted(map(str, other))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 9)), min_size=1, max_size=9))
def test_targets_equal_repeated_sharing(spark, sources):
    rows = [(f"0s{k}", size, weight) for k, (size, weight) in enumerate(sources)]
    found = mixing.targets(spark.createDataFrame(rows, "__group string, __all long, __weight long"))
    expected = plain_targets({g: s for g, s, _ in rows}, {g: w for g, _, w in rows})
    assert {r["__group"]: r["target"] for r in found.collect()} == pytest.approx(expected)


def test_mix_of_nothing(spark):
    assert mixing.mix(table(spark, ODD).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, ODD[:3])).collect()] == [0, 0, 0]


def test_given_weights_and_epochs(spark):
    rows = [(k, "one two three four five", "en", "ab"[k % 2], 1) for k in range(20)]
    weights = spark.createDataFrame([("a", 4), ("b", 1)], "source string, weight int")
    mixed = mixing.mix(table(spark, rows), weights, keep=["text"])
    assert {r["source"]: r["target"] for r in mixed.collect()} == {"a": 80.0, "b": 20.0}
    copies = mixing.epochs_of(mixed).collect()
    words, most = Counter(), Counter()
    for r in copies:
        assert len(r["text"].split()) == r["words"] > 0
        words[r["source"]] += r["words"]
        most[r["doc_id"]] = max(most[r["doc_id"]], r["epoch"] + 1)
    assert words == {"a": 80, "b": 20} and max(most.values()) == 2


def test_mix_has_no_python(spark, capsys):
    mixing.mix(table(spark, ODD)).explain("formatted")
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


# ---- periodic runs


def plain_runs(words, least=12):
    best = {}
    for q in range(1, len(words)):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def spliced(rng):
    words = [rng.choice("abcdefghijklmnop"[: rng.choice([1, 2, 3, 16])]) for _ in range(rng.randint(0, 70))]
    for _ in range(rng.randint(0, 2) if words else 0):
        a, n = rng.randrange(len(words)), len(words)
        q = 1 + (n - a) // rng.randint(2, 9)
        words = words[:a] + [words[a + (i - a) % q] for i in range(a, n)] + [rng.choice("xyz")] * rng.randint(0, 2)
    return words


def test_runs_equal_all_periods():
    rng = random.Random(5)
    texts = [spliced(rng) for _ in range(1500)]
    found = periodic.runs_of([" ".join(w).encode() for w in texts])
    for k, words in enumerate(texts):
        runs = list(zip(found["starts"][k], found["lengths"][k], found["periods"][k], strict=True))
        assert runs == plain_runs(words)
        assert found["collapsed"][k].decode() == plain_collapsed(words, runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), max_size=4))
def test_runs_of_two_letters(texts):
    found = periodic.runs_of([" ".join(w).encode() for w in texts])
    assert [list(zip(*x, strict=True)) for x in zip(found["starts"], found["lengths"], found["periods"], strict=True)] == [plain_runs(w) for w in texts]


def test_words_are_masked_exactly():
    """No word of a run is masked, and words without a repeated six-gram are."""
    codes = periodic.pd.factorize(list("abcdefghijkl" + "mnopqrst" + "mnopqrst" + "uvwxyz"))[0]
    alive = periodic.surviving(codes, periodic.np.zeros(len(codes), int), 6)
    assert alive.tolist() == [False] * 12 + [True] * 16 + [False] * 6


def test_runs_in_frames(spark):
    found = {str(r["doc_id"]) + str(r["collapsed"])[:9]: r for r in periodic.find_runs(table(spark, ODD)).collect()}
    assert len(periodic.find_runs(table(spark, ODD)).collect()) == len(ODD)
    long = found["8word and "]
    assert [tuple(x) for x in long["runs"]] == [(0, 240_000, 3)] and long["collapsed"] == "word and more"
    assert [tuple(x) for x in found["9A b C"]["runs"]] == [(0, 30, 3)]
    assert periodic.find_runs(table(spark, ODD).limit(0)).count() == 0


def test_planted_periods(spark):
    """The query's own change of texts, against a loop."""
    import zlib

    rows = [(k, " ".join(f"w{(i * i) % 97}" for i in range(k % 90)), "en", "s", 1) for k in range(300)] + ODD
    found = {(r["doc_id"], r["text"]) for r in queries.with_periods(table(spark, rows)).collect()}
    expected = set()
    for doc_id, text, *_ in rows:
        words, crc = (text or "").split(), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if crc % 10 == 0 and words:
            g, n = crc // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
        expected.add((doc_id, text))
    assert found == expected
