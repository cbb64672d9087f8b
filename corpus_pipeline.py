"""A corpus pipeline of five stages over `documents`.

Every stage takes (spark, docs, sf_dir) and returns the rows that it keeps; all but the last return
the columns of `documents`. Decisions take effect: rejected rows are gone and secrets are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, decontaminate, jaccard, langid, secrets, simhash
from strandlake.llm.queries import tokenizer
from strandlake.session import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the rest is rejected.

    The model learns from labelled documents of this stage's own input. A missing lang is filled
    with the prediction. Null and empty texts, and those without a letter, have no language and go;
    rows without an id or with a repeated one are judged by their own text; repeated rows stay
    repeated; an empty table, or one without labelled documents, gives no rows.
    """
    rows = langid.identify(docs, langid.fit(docs), keep=COLUMNS)
    return rows.where("NOT rejected").select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the one with the smallest doc_id, nulls last.

    Near duplicates have a Jaccard similarity of 0.8 or more of their five-word shingles; SimHash links are
    verified, and completed so that all pairs are found. Rows are known by doc_id and text, so different texts of one doc_id, or without one, are
    rows of their own; of repeated rows one stays.
    """
    row = [F.col("doc_id"), jaccard.text_key(F.col("text"))]
    second = F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", row[1].alias("__t"), "text", second.alias("__u"))
    roots = simhash.similar_texts(keyed.select(F.col("__t").alias("t"), "text"))
    # texts that share a key by chance: all but one of them are groups of their own, by a second hash
    first_of = keyed.groupBy(F.col("__t").alias("t")).agg(F.min("__u").alias("first")).join(roots, "t", "left")
    chance = F.when(F.col("__u") == F.col("first"), F.lit(0).cast("long")).otherwise(F.col("__u"))
    rooted = keyed.select("doc_id", "__t", "__u").join(first_of, F.col("__t") == first_of["t"]).select("doc_id", "__t", "__u", F.coalesce("root", "__t").alias("root"), chance.alias("chance"))
    least = rooted.groupBy("root", "chance").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__t").alias("t"), F.col("__u").alias("u"))).alias("r"))
    # null has a key of its own, and one key serves the join and the grouping: texts move once
    key = lambda doc_id, t, u: F.concat_ws(" ", t.cast("string"), u.cast("string"), doc_id.cast("string")).alias("__key")
    chosen = least.select(key(F.col("r.doc_id"), F.col("r.t"), F.col("r.u")))
    kept = docs.select(key(*row, second), *COLUMNS).join(chosen, "__key", "left_semi")
    first = kept.groupBy("__key").agg(F.min(F.struct("text", "lang", "source", "n_chars", "doc_id")).alias("r"))
    return first.select(*[F.col(f"r.{c}").alias(c) for c in COLUMNS])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    A row goes by its own text: others of the same doc_id, or without one, stay. Null and empty texts
    hold no passage and stay; repeated rows stay repeated or go together; an empty table gives no rows.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    leaks = found.where("contaminated").select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__hash")).distinct()
    own = decontaminate.text_hash(F.col("text")) == F.col("__hash")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["__doc_id"]) & own, "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and n_chars brought up to date.

    Null and empty texts, repeated rows, ids and missing ids stay as they are; an empty table gives
    no rows.
    """
    found = secrets.scan(docs, secrets.train(docs), keep=COLUMNS)
    text = secrets.redact(F.col("text"), F.col("spans"))
    n_chars = F.when(F.size("spans") > 0, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; those that don't decode to the text would be an error.

    A null text has no tokens, as an empty one; repeated rows stay repeated, with or without an id;
    an empty table gives no rows.
    """
    made = bpe.encode(docs, *tokenizer(), keep=["doc_id", "text", "lang", "source"])
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")
    checked = F.when(whole, F.col("ids")).otherwise(F.raise_error(F.lit("decoded ids differ from the text")).cast("binary"))
    return made.select("doc_id", "lang", "source", "n_tokens", checked.alias("ids"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: The models of the first and fourth stage aren't SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
