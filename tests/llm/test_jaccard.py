"""Near duplicates by five-word Jaccard against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import jaccard, simhash

FOLDER = "/root/testdata/sf0.01"


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def roots_of(texts):
    """Smallest key of each text's component, over all pairs with 5 * common >= 4 * either."""
    sets = {k: grams(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def found_roots(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "t long, text string").repartition(3)
    found = {r["t"]: r["root"] for r in simhash.similar_texts(rows).collect()}
    return {k: found.get(k, k) for k in texts}


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["t"]: r["text"] for r in docs.select(jaccard.text_key(F.col("text")).alias("t"), "text").collect()}
    assert found_roots(spark, texts) == roots_of(texts)


def test_large_groups_and_chains_equal_all_pairs(spark):
    """More near copies than a dense shingle has, chains between them, and a passage in unlike texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(12)]
    rows = []
    for k in range(90):
        own = list(base)
        for at in rng.sample(range(120), k % 5):
            own[at] = f"c{k}x{at}"
        rows.append(own)
    drift = list(base)
    for k in range(60):
        drift = list(drift)
        drift[k * 2] = f"d{k}"
        rows.append(drift)
    rows += [passage + [word() for _ in range(rng.randrange(2, 60))] for _ in range(80)]
    texts = {k: " ".join(w) for k, w in enumerate(rows)} | {500: "", 501: " \n", 502: None, 503: "a b", 504: "A  b"}
    assert found_roots(spark, texts) == roots_of(texts)


def test_stage_keeps_one_of_each_component(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stays = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {2, 56} <= stays
    assert stays == set(roots_of(texts).values())


def test_texts_without_or_under_one_id_stay(spark, docs):
    one, two, three = (" ".join(f"{p}{k}" for k in range(30)) for p in "abc")
    rows = docs((None, one), (None, two), (7, two), (7, three), (8, three + " end"), (8, "clean and short"), (None, one))
    kept = corpus_pipeline.near_duplicates(spark, rows, FOLDER).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("None", one), ("7", two), ("7", three), ("8", "clean and short")])


def test_near_copies_below_the_bound_make_no_pairs(spark, monkeypatch):
    """A group whose pairs lie about the bound goes block against block; a join made a row for each of its pairs."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(160):
        own = list(base)
        for at in rng.sample(range(100), 2 + k % 3):
            own[at] = f"c{k}x{at}"
        rows.append(own)
    texts = {k: " ".join(w) for k, w in enumerate(rows)}
    joined, plausible = [], jaccard.plausible
    monkeypatch.setattr(jaccard, "plausible", lambda pairs, made, percent: joined.append(pairs.count()) or plausible(pairs, made, percent))
    monkeypatch.setattr(jaccard, "PAIRS", 2048, raising=False)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 50, raising=False)
    expected = roots_of(texts)
    assert len(set(expected.values())) > 1
    assert found_roots(spark, texts) == expected
    assert joined[1] <= 20 * len(texts)


def test_families_that_cost_more_than_their_shingles_are_split(spark, monkeypatch):
    """Shingles that share a few texts each: all pairs of the chain would be more than those of its shingles."""
    rows = [(g, t, 10, t % 2 == 0) for g in range(1000, 1020) for t in range((g - 1000) * 9, (g - 1000) * 9 + 10)]
    letters = "abcdefghij"
    texts = {t: " ".join(letters[:9]) + f" {letters[t % 10]}{t // 10}" for t in range(190)}
    texts_rows = spark.createDataFrame(list(texts.items()), "t long, text string")
    found = jaccard._family_links(spark.createDataFrame(rows, "g long, t long, n int, out boolean"), texts_rows, 5, 60)
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in found.collect()}
    linked = {(a, b) for a, b in pairs if len(grams(texts[a]) & grams(texts[b])) * 100 >= 60 * len(grams(texts[a]) | grams(texts[b]))}
    assert pairs == linked and pairs
    members = {}
    for g, t, *_ in rows:
        members.setdefault(g, set()).add(t)
    assert all(any({a, b} <= own for own in members.values()) for a, b in pairs)


def test_few_texts_of_families_are_fetched_without_shuffling_texts(spark, monkeypatch):
    """Texts of crowded shingles were chosen by a join that moved all texts; both ways give the same links."""
    rows = [(1, t, 10, t % 2 == 0) for t in range(12)]
    texts = spark.createDataFrame([(t, " ".join("abcdefghij"[: 9 + t % 2])) for t in range(40)], "t long, text string")
    plans, sets, found = [], jaccard._sets, []
    monkeypatch.setattr(jaccard, "_sets", lambda once, size: plans.append(once._jdf.queryExecution().executedPlan().toString()) or sets(once, size))
    for most in (jaccard.BROADCAST, 0):
        monkeypatch.setattr(jaccard, "BROADCAST", most)
        links = jaccard._family_links(spark.createDataFrame(rows, "g long, t long, n int, out boolean"), texts, 5, 80)
        found.append({t for pair in links.collect() for t in pair})
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
    assert found == [set(range(12))] * 2


def test_pairs_that_share_only_late_shingles_are_not_made(spark, monkeypatch):
    """Texts of a common passage, and else unlike: from its shingles on, most of them have too little left."""
    rng = random.Random(3)
    place = lambda words: int(jaccard.shingle_hashes(" ".join(words).encode(), 5)[0]) / 2**64
    # about ten of the texts' own 60 shingles come before this one: within the prefix of 13, but over the 6 that may go before
    passage = next(p for p in ([f"p{k}x{j}" for j in range(5)] for k in range(10_000)) if 0.17 < place(p) < 0.18)
    texts = {k: " ".join([f"w{rng.randrange(10**6)}" for _ in range(60)] + passage) for k in range(60)}
    joined, plausible = [], jaccard.plausible
    monkeypatch.setattr(jaccard, "plausible", lambda pairs, made, percent: joined.append(pairs.distinct().count()) or plausible(pairs, made, percent))
    assert found_roots(spark, texts) == roots_of(texts)
    assert joined[1] < 60 * 59 / 8
