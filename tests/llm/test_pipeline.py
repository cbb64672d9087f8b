"""Stages of the corpus pipeline against plain versions of their decisions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import decontaminate, langid, secrets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, documents):
    made, rows = [], documents
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, FOLDER).cache()
        made.append(rows)
    return made


def test_columns(stages, documents):
    for rows in stages[:-1]:
        assert rows.columns == documents.columns and dict(rows.dtypes) == dict(documents.dtypes)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]


def test_languages_keep_clean_documents(stages, documents):
    assert stages[0].count() >= 0.99 * documents.count()
    model = langid.fit(documents)
    verdicts = {r["doc_id"]: r["rejected"] for r in langid.identify(documents, model).collect()}
    assert {r["doc_id"] for r in stages[0].collect()} == {k for k, rejected in verdicts.items() if not rejected}


def test_one_document_of_each_group_stays(stages):
    """Groups of a five-word Jaccard similarity of 0.8 or more, over all pairs."""
    rows = stages[0].collect()

    def grams(text):
        words = (text or "").lower().split()
        return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = [grams(r["text"]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for r, k in zip(rows, root):
        least[k] = min(r["doc_id"], least.get(k, r["doc_id"]))
    assert sorted(r["doc_id"] for r in stages[1].collect()) == sorted(least.values())


def test_no_passage_of_the_benchmark_stays(spark, stages):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontaminate.contamination(stages[2], bench).where("contaminated").count() == 0
    before = decontaminate.contamination(stages[1], bench)
    assert {r["doc_id"] for r in stages[2].collect()} == {r["doc_id"] for r in before.where("NOT contaminated").collect()}


def test_no_secret_stays(stages):
    after = secrets.scan(stages[3], secrets.train(stages[2]))
    assert after.where(F.exists("spans", lambda s: s["kind"] != "markov")).count() == 0
    assert stages[3].count() == stages[2].count()
    assert stages[3].where("n_chars <> char_length(text)").count() == 0


def test_tokens_decode_to_the_texts(stages):
    from strandlake.llm import bpe
    from strandlake.llm.queries import tokenizer

    path, pattern = tokenizer()
    codec = bpe.codec(bpe.ranks_file(path), pattern)
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[4].collect():
        assert codec.decode(np.frombuffer(r["ids"], "<u4").tolist()).decode() == texts[r["doc_id"]]


def test_run_is_the_last_stage(spark, stages):
    got = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == sorted((r["doc_id"], r["n_tokens"]) for r in stages[4].collect())


def test_odd_documents_pass(spark, docs):
    rows = docs((None, None), (1, None), (2, ""), (3, "ein Text"), (3, "ein Text"), (4, "x" * 3000))
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, FOLDER)
    assert {r["doc_id"] for r in rows.collect()} <= {3, 4}
    rows = docs("x").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, FOLDER)
    assert rows.collect() == []


def test_extra_columns_do_not_matter(spark, docs):
    """Every stage takes tables with further columns of names that it uses itself."""
    texts = ["ein kurzer Text mit token=abcdef und mehr", None, "noch ein anderer Text ohne etwas"]
    names = ("spans", "root", "t", "__t", "__key", "r", "h", "w", "ids", "n_tokens", "decoded", "lang_pred", "score", "rejected", "items", "value", "label")
    for _, stage in corpus_pipeline.STAGES:
        plain = stage(spark, docs(*texts), FOLDER)
        more = stage(spark, docs(*texts).withColumns({n: F.lit("x") for n in names}), FOLDER)
        assert more.columns == plain.columns
        assert sorted(map(str, more.collect())) == sorted(map(str, plain.collect()))


LEAK = " ".join(f"leak{k}" for k in range(12))


@pytest.fixture
def bench_folder(spark, tmp_path):
    spark.createDataFrame([("i1", LEAK)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_decontamination_takes_only_rows_that_hold_a_passage(spark, docs, bench_folder):
    """Ids that are missing or shared with a contaminated row don't take clean rows away."""
    rows = [(None, f"first {LEAK}"), (None, "a clean text"), (5, f"second {LEAK} end"), (5, "another clean text"), (6, "the last one"), (6, "the last one"), (7, None), (None, ""), (8, LEAK + " and so on" * 100_000)]
    kept = corpus_pipeline.decontamination(spark, docs(*rows), bench_folder).collect()
    expected = [(i, t) for i, t in rows if LEAK not in (t or "")]
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in kept])) == sorted(map(str, expected))


def test_near_duplicates_keep_one_row_of_each_group(spark, docs):
    """Missing and shared ids, repeated rows, null and empty texts, a very long text."""
    one = " ".join(f"w{k}" for k in range(200))
    near = one + " more"
    other = " ".join(f"x{k}" for k in range(50))
    long = " ".join(f"y{k}" for k in range(150_000))
    rows = [(None, one), (4, near), (3, other), (3, one + " end"), (None, other + " tail end here of it all and many many more other words than before"), (9, None), (8, ""), (2, long), (1, long + " z"), (2, long)]
    kept = corpus_pipeline.near_duplicates(spark, docs(*rows), FOLDER).collect()
    assert sorted(str((r["doc_id"], (r["text"] or "")[-20:])) for r in kept) == sorted(
        str((i, (t or "")[-20:])) for i, t in [(3, one + " end"), (3, other), (None, other + " tail end here of it all and many many more other words than before"), (8, ""), (1, long + " z")]
    )


def test_keys_that_meet_by_chance_lose_no_text(spark, docs, monkeypatch):
    """All texts share a key; each is still there."""
    monkeypatch.setattr(corpus_pipeline.jaccard, "text_key", lambda text: F.lit(1).cast("long"))
    rows = [(k, f"text number {k} " + " ".join(f"u{k}v{j}" for j in range(20))) for k in range(6)]
    kept = corpus_pipeline.near_duplicates(spark, docs(*rows), FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(6))


def test_last_stages_keep_odd_rows(spark, docs):
    rows = [(None, "a text with token=abcdefgh in it"), (1, None), (1, ""), (2, "same"), (2, "same"), (3, "long words " * 100_000)]
    scanned = corpus_pipeline.secret_scan(spark, docs(*rows), FOLDER)
    assert sorted(str(r["doc_id"]) for r in scanned.collect()) == sorted(str(i) for i, _ in rows)
    coded = corpus_pipeline.tokens(spark, scanned, FOLDER).collect()
    assert sorted(str(r["doc_id"]) for r in coded) == sorted(str(i) for i, _ in rows)
    assert sum(r["n_tokens"] == 0 for r in coded) == 2


def test_language_stage_of_odd_rows(spark, documents):
    more = [(None, documents.first()["text"], "xx", "s", 1), (7, None, "xx", "s", 1), (7, "", None, "s", 0), (7, "123 456", None, "s", 0)]
    kept = corpus_pipeline.language(spark, documents.union(spark.createDataFrame(more, documents.schema)), FOLDER)
    assert kept.count() >= 0.99 * documents.count()
    assert kept.where("text IS NULL OR text = '' OR text = '123 456'").count() == 0
    assert corpus_pipeline.language(spark, documents.limit(0), FOLDER).count() == 0
