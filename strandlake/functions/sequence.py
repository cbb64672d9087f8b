"""Column functions over sequences, barcodes, read names and positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC letters and their complements.
IUPAC = "ACGTNYRWSBDHKMVacgtnyrwsbdhkmv"
COMPLEMENT = "TGCANRYWSVHDMKBtgcanrywsvhdmkb"

#: Position of a read that has no mate, in keys (null in output).
NO_MATE = 2147482647


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC, COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(seq))


def effective_length(seq: Column, negative: Column) -> Column:
    """Bases left without trailing N (or leading N on the negative strand, the last base always counts)."""
    forward = F.length(F.regexp_replace(seq, "N+$", ""))
    backward = F.greatest(F.length(F.regexp_replace(seq, "^N+", "")), F.least(F.length(seq), F.lit(1)))
    return F.when(negative, backward).otherwise(forward)


def phreds(quality: Column) -> Column:
    """Phred scores of a quality string (offset 33)."""
    return F.transform(F.split(quality, ""), lambda c: F.ascii(c) - 33)


def upper_median(values: Column) -> Column:
    """Element n div 2 (from 0) of the sorted array; null if empty."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, (F.floor(F.size(values) / 2) + 1).cast("int")))


def sorted_element(values: Column, share: float) -> Column:
    """Element int(n * share) (from 0) of the sorted array; null if empty."""
    ordered = F.array_sort(values)
    return F.when(F.size(values) > 0, F.element_at(ordered, (F.floor(F.size(values) * share) + 1).cast("int")))


def integer_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, F.floor(total / F.size(values)).cast("int"))


def mismatches(a: Column, b: Column, length: int, n_matches: bool = True) -> Column:
    """Hamming distance of two barcodes of `length` letters; N fits anything if `n_matches`."""
    total = F.lit(0)
    for k in range(1, length + 1):
        x, y = F.substring(a, k, 1), F.substring(b, k, 1)
        differ = x != y
        if n_matches:
            differ = differ & (x != "N") & (y != "N")
        total = total + F.when(differ, 1).otherwise(0)
    return total


def matches_reference(allele: Column, reference: Column) -> Column:
    """Whether a base agrees with a reference letter; only Y, R and W stand for two bases."""
    return (
        (allele == reference)
        | ((reference == "Y") & allele.isin("C", "T"))
        | ((reference == "R") & allele.isin("A", "G"))
        | ((reference == "W") & allele.isin("A", "T"))
    )


def context(sequence: Column, position: Column, flank: int = 5) -> Column:
    """Letters within `flank` of a 0-based position, clipped at the ends."""
    first = F.greatest(position - flank, F.lit(0))
    last = F.least(position + flank, F.length(sequence) - 1)
    return F.substr(sequence, first + 1, last - first + 1)


def parse_location(text: Column) -> tuple[Column, Column, Column]:
    """(contig, 0-based position, half) of `chr:1,234` or `chr:1,234.5`."""
    number = F.regexp_replace(F.substring_index(text, ":", -1), ",", "")
    return F.substring_index(text, ":", 1), (F.substring_index(number, ".", 1).cast("int") - 1), F.endswith(number, F.lit(".5"))


def format_location(contig: Column, position: Column, half: Column) -> Column:
    return F.concat(contig, F.lit(":"), (position + 1).cast("string"), F.when(half, ".5").otherwise(""))


def run_tile(name: Column) -> Column:
    """The first five fields of a read name, which tell lane and tile."""
    return F.array_join(F.slice(F.split(name, ":"), 1, 5), ":")


def tile_coordinate(name: Column, field: int) -> Column:
    """Leading digits of a colon-separated field (6 for x, 7 for y)."""
    return F.regexp_extract(F.element_at(F.split(name, ":"), field), r"^\d+", 0).cast("int")


def name_barcode(name: Column, occurrence: int = 1) -> Column:
    """Barcode number `occurrence` of `..._BC:Z:xxx_...` in a read name; null if there is none."""
    found = F.regexp_extract_all(name, F.lit(r"BC:Z:([A-Z]+)"), F.lit(1))
    return F.try_element_at(found, F.lit(occurrence))


def chebyshev(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.abs(start_a - start_b), F.abs(end_a - end_b))


def euclid(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    dx, dy = (start_a - start_b).cast("double"), (end_a - end_b).cast("double")
    return F.floor(F.sqrt(dx * dx + dy * dy)).cast("int")


def index_score(read: Column, expected: Column, length: int) -> Column:
    """+1 for each equal letter, 0 for N in the read, -1 for each other one."""
    total = F.lit(0)
    for k in range(1, length + 1):
        x, y = F.substring(read, k, 1), F.substring(expected, k, 1)
        total = total + F.when(x == "N", 0).when(x == y, 1).otherwise(-1)
    return total


def header_indexes(header: Column) -> tuple[Column, Column]:
    """The two indexes of a FASTQ header that ends in `:i7+i5`."""
    return F.regexp_extract(header, r":([^:+]*)\+[^+]*$", 1), F.regexp_extract(header, r"\+([^+]*)$", 1)


def change_text(kind: Column, wildtype: Column, sequence: Column) -> Column:
    """Text of a change: `A->T`, `-SEQ-` for a deletion, `^SEQ^` for an insertion, else the wildtype base."""
    return (
        F.when(kind == "SUBSTITUTION", F.concat(wildtype, F.lit("->"), sequence))
        .when(kind == "DELETION", F.concat(F.lit("-"), sequence, F.lit("-")))
        .when(kind == "INSERTION", F.concat(F.lit("^"), sequence, F.lit("^")))
        .otherwise(F.coalesce(wildtype, sequence))
    )


def parse_change(text: Column) -> tuple[Column, Column, Column]:
    """(kind, wildtype, sequence) of `AT`, `-SEQ-` or `^SEQ^`."""
    deletion, insertion = text.rlike("^-.*-$"), text.rlike(r"^\^.*\^$")
    inner = F.substr(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
    kind = F.when(deletion, "DELETION").when(insertion, "INSERTION").when(F.length(text) == 2, "SUBSTITUTION").otherwise("WILDTYPE")
    return kind, F.when(~deletion & ~insertion, F.substring(text, 1, 1)), F.when(deletion | insertion, inner).when(F.length(text) == 2, F.substring(text, 2, 1))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def drawn(seed: int, *parts: Column) -> Column:
    """A number from 0 to 999,999 that texts and a seed give; any engine with MD5 gives the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 1_000_000


def read_key(name: Column, first: Column, negative: Column, start: Column, supplementary: Column) -> Column:
    """Key of a read: name, number in the pair, strand and start, with a suffix for supplementary ones."""
    suffix = F.when(supplementary, "--suppl").otherwise("")
    return F.concat(name, F.lit("--"), F.when(first, "1").otherwise("2"), F.lit("--"), F.when(negative, "-").otherwise("+"), start.cast("string"), suffix)


def adapter_start(seq: Column, adapter: str, most: int = 3, least_overlap: int = 5) -> Column:
    """Place (from 1) where the adapter's beginning fits best, within `most` edits of a whole adapter.

    Best: fewest edits for the letters that overlap, then the first place; null if it fits nowhere.
    """

    @F.pandas_udf("int")
    def place(texts: pd.Series) -> pd.Series:
        return pd.Series(_adapter_places(texts.tolist(), adapter, most, least_overlap), dtype="Int32")

    return place(seq)


#: Places of reads whose adapter edits are counted together.
ADAPTER_PLACES = 1 << 20


def _adapter_places(texts: list[str | None], adapter: str, most: int, least_overlap: int) -> list[int | None]:
    """`adapter_start` of each text; edits are counted for all places of many texts at once."""
    found: list[int | None] = []
    while len(found) < len(texts):
        part, n = [], 0
        for text in texts[len(found) :]:
            part.append(text if isinstance(text, str) else "")
            n += len(part[-1])
            if n >= ADAPTER_PLACES:
                break
        found += _best_places(part, adapter, most, least_overlap)
    return found


def _best_places(texts: list[str], adapter: str, most: int, least_overlap: int) -> list[int | None]:
    size = len(adapter)
    lengths = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.maximum(lengths - max(least_overlap, 1) + 1, 0)
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(texts)), n)
    k = np.arange(len(row)) - first[row]
    at, rest = (np.cumsum(lengths) - lengths)[row] + k, np.minimum(lengths[row] - k, size)
    edits = np.zeros(len(row), np.int32)
    # distances of beginnings: after letter i, edit[j] is that of i letters and the adapter's first j
    edit = [np.full(len(row), j, np.int16) for j in range(size + 1)]
    for i in range(1, size + 1):
        letter = letters[np.minimum(at + i - 1, max(len(letters) - 1, 0))]
        before, edit[0] = edit[0], np.full(len(row), i, np.int16)
        for j in range(1, size + 1):
            changed = before + (letter != ord(adapter[j - 1]))
            before = edit[j]
            edit[j] = np.minimum(np.minimum(changed, before + 1), edit[j - 1] + 1)
        edits = np.where(rest == i, edit[i], edits)
    share = np.where(edits.astype(np.int64) * size <= most * rest, edits / np.maximum(rest, 1), np.inf)
    best: list[int | None] = [None] * len(texts)
    some = np.flatnonzero(n > 0)
    if len(some):
        least = np.minimum.reduceat(share, first[some])
        hits = np.flatnonzero((share == np.repeat(least, n[some])) & np.isfinite(share))
        own, where = np.unique(row[hits], return_index=True)
        for r, p in zip(own.tolist(), k[hits[where]].tolist(), strict=True):
            best[r] = p + 1
    return best


def mask_from(seq: Column, place: Column) -> Column:
    """`seq` with N from `place` (from 1) onward."""
    return F.when(place.isNull(), seq).otherwise(F.concat(F.substr(seq, F.lit(1), place - 1), F.repeat(F.lit("N"), F.length(seq) - place + 1)))
