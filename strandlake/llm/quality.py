"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger row holds the measurements and one
failure bit a rule. A policy is a versioned set of rules, so applying one is a single bitwise test
on the stored mask, and the ablation of any rule comes from an aggregate over distinct masks.

Defined results: a null or wordless text has zero in all measurements and fails TOO_FEW_WORDS;
repeated rows stay repeated; other columns are carried only if asked for; an empty table gives an
empty ledger.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import with_columns

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bars", "n_shouts", "n_upper", "n_lines", "n_stutters"]

#: Rules in bit order: name and failure condition over the measurements.
RULES: list[tuple[str, str]] = [
    ("TOO_FEW_WORDS", "n_words < 20"),
    ("REPEATED_WINDOWS", "100 * n_repeat_words > 30 * n_words"),
    ("SYMBOLS", "5 * n_symbols > n_words"),
    ("TABLE_BARS", "5 * n_bars > n_words"),
    ("SHOUTING", "10 * n_shouts > 3 * n_words"),
    ("CAPITALS", "2 * n_upper > word_chars"),
    ("DUPLICATE_LINES", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    ("LONG_WORDS", "word_chars > 25 * n_words"),
    ("STUTTER", "10 * n_stutters > 3 * n_words"),
]

#: Policies by version: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base": ["TOO_FEW_WORDS", "REPEATED_WINDOWS"],
    "v1": ["TOO_FEW_WORDS", "REPEATED_WINDOWS", "SYMBOLS", "TABLE_BARS", "SHOUTING", "CAPITALS", "DUPLICATE_LINES", "LONG_WORDS", "STUTTER"],
}

_SPACE = np.zeros(256, np.uint8)
_SPACE[[32, 9, 10, 11, 12, 13]] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_POINT = np.ones(256, np.uint8)
_POINT[0x80:0xC0] = 0


def repeated_window_words(codes: np.ndarray, lengths: np.ndarray, width: int = 8) -> np.ndarray:
    """For each document, the words inside windows of `width` words that its text has twice or more.

    codes: word codes of all documents in a row; lengths: words of each document. `width` is a
    power of two: codes of doubled windows are made from pairs of codes, exactly.
    """
    n = len(codes)
    out = np.zeros(len(lengths), np.int64)
    if n < width:
        return out
    span = 1
    while span < width:
        pairs = codes[:-span] * np.int64(codes.max() + 1) + codes[span:]
        codes = pd.factorize(pairs)[0].astype(np.int64)
        span *= 2
    doc = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
    if not len(starts):
        return out
    found = pd.factorize(codes[starts] * np.int64(len(lengths)) + doc[starts])[0]
    twice = starts[np.bincount(found)[found] > 1]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=len(lengths)).astype(np.int64)


def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    texts = [t or b"" for t in texts]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts) + b"\n", np.uint8)
    first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size

    def total(flags: np.ndarray) -> np.ndarray:
        summed = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return summed[first + size] - summed[first]

    words = [t.split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(n_words.sum()), object)
    flat[:] = [w for each in words for w in each]
    codes, vocabulary = pd.factorize(flat)
    ends = np.fromiter((w.endswith(b"!!") for w in vocabulary), np.int64, len(vocabulary))
    doc = np.repeat(np.arange(len(texts)), n_words)
    lines = [[line for line in t.split(b"\n") if line.strip()] for t in texts]
    n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
    return {
        "n_words": n_words,
        "word_chars": total(_POINT[data]) - total(_SPACE[data]),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, len(lines)),
        "n_repeat_words": repeated_window_words(codes.astype(np.int64), n_words),
        "n_bars": total(data == ord("|")),
        "n_shouts": np.bincount(doc, weights=ends[codes] if len(codes) else None, minlength=len(texts)).astype(np.int64),
        "n_upper": total(_UPPER[data]),
        "n_lines": n_lines,
        "n_stutters": np.bincount(doc[1:], weights=(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1]), minlength=len(texts)).astype(np.int64),
    }


def failures(rules: list[tuple[str, str]] = RULES) -> Column:
    mask = F.lit(0).cast("long")
    for bit, (_, condition) in enumerate(rules):
        mask = mask.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(doc_id, measurements, fail_bits) for every row; no shuffle."""
    made = with_columns(docs, text, measure, ", ".join(f"{m} long" for m in MEASURES), [doc_id])
    return made.withColumnRenamed(doc_id, "doc_id").withColumn("fail_bits", failures(rules))


def bit(name: str, rules: list[tuple[str, str]] = RULES) -> int:
    return [own for own, _ in rules].index(name)


def policy_mask(version: str, rules: list[tuple[str, str]] = RULES, policies: dict[str, list[str]] = POLICIES) -> int:
    return sum(1 << bit(name, rules) for name in policies[version])


def apply_policy(rows: DataFrame, version: str, column: str = "kept") -> DataFrame:
    return rows.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablations(rows: DataFrame, version: str, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(rule, n_failed, n_only): rows that fail a rule of the policy, and rows that no other one rejects.

    The ledger is first reduced to its distinct masks, of which there are at most 2^rules.
    """
    mask = policy_mask(version, rules)
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    bits = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(rules) if mask >> k & 1])
    each = masks.select("bits", "n", F.explode(bits).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
