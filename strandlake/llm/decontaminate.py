"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is `width` consecutive words of an item (a shorter item is one window). Its tokens are its
word shingles, ordered by how often they stand in all documents. A document that contains the window
contains every token, so the single rarest one is the necessary prefix, and windows with a token of
no document are out at once. Documents are joined on prefix tokens only; a match at a position gives
the only place where the window can stand (positional bound), which must lie inside the text (length
bound), and the words there are compared with the window's.

All of it is DataFrame operations. Documents keep their words inside one stage up to the exact
comparison, so that only hits are shuffled. The benchmark is taken in blocks of at most
`BLOCK_WINDOWS` windows and about `BLOCK_BYTES` bytes, so what is broadcast stays bounded however
large the benchmark is.

Defined results: null and wordless texts have no words and no hits; null and wordless items have no
window; items of equal id count once, an item without id never; repeated documents stay repeated;
empty tables give zero hits or no rows; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# The letters to fold and what separates words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BLOCK_WINDOWS, BLOCK_BYTES = 50_000, 32 << 20
#: Token of the row that stands for the document itself.
ITSELF = 0


def fold(text: Column) -> Column:
    """A-Z lower-cased, other letters untouched."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(fold(text), F.lit("")), BETWEEN_WORDS), "")


def text_hash(text: Column) -> Column:
    """Two independent 64-bit hashes; null counts as the empty text."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b"))


def windows(items: DataFrame, width: int, shingle: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (window, length, size, items) with the items that have them; size: words of a token."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    length = F.least(F.lit(width), F.size("w"))
    each = rows.select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"))
    each = each.select("item", F.slice("w", F.col("at"), F.col("length")).alias("window"), "length")
    return each.groupBy("window", "length").agg(F.collect_set("item").alias("items")).withColumn("size", F.least(F.lit(shingle), F.col("length")))


def tokens(found: DataFrame) -> DataFrame:
    """All tokens (token, offset) of each window; offset counts words."""
    offsets = F.sequence(F.lit(0), F.col("length") - F.col("size"))
    each = found.select("*", F.explode(offsets).alias("offset"))
    return each.withColumn("token", F.xxhash64(F.slice("window", F.col("offset") + 1, F.col("size"))))


def placed_tokens(docs: DataFrame, size: int, with_itself: bool) -> DataFrame:
    """(doc_id, h, w, at, token): a row for each token of `size` words; place 0 is the document itself."""
    first = 0 if with_itself else 1
    last = F.size("w") - size + 1
    positions = F.sequence(F.lit(first), F.greatest(last, F.lit(first)))
    placed = docs.select("doc_id", "h", "w", F.explode(positions).alias("at"))
    token = F.when((F.col("at") > 0) & (F.col("at") <= last), F.xxhash64(F.slice("w", F.greatest(F.col("at"), F.lit(1)), F.lit(size))))
    return placed.withColumn("token", F.when(F.col("at") == 0, F.lit(ITSELF).cast("long")).otherwise(token))


def blocks_of(rows: DataFrame, key: str, weight: Column) -> list[tuple[int, DataFrame]]:
    """(size, rows) of each token size, in blocks of at most about BLOCK_WINDOWS rows and BLOCK_BYTES bytes."""
    measured = rows.groupBy("size").agg(F.count("*").alias("n"), F.sum(weight.cast("long")).alias("bytes")).collect()
    out = []
    for r in sorted(measured, key=lambda r: -r["size"]):
        blocks = max(1, -(-r["n"] // BLOCK_WINDOWS), -(-(r["bytes"] or 0) // BLOCK_BYTES))
        out += [(r["size"], rows.where((F.col("size") == r["size"]) & (F.pmod(F.xxhash64(key), F.lit(blocks)) == b))) for b in range(blocks)]
    return out


def rarity(docs: DataFrame, all_tokens: DataFrame) -> DataFrame:
    """(token, size, n): how often each token of the windows stands in the documents."""
    counts = None
    for size, own in blocks_of(all_tokens.select("token", "size").distinct(), "token", F.lit(16)):
        met = placed_tokens(docs, size, False).select("token").join(F.broadcast(own), "token")
        part = met.groupBy("token", "size").agg(F.count("*").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    return all_tokens.select("token", "size", F.lit(0).cast("long").alias("n")).limit(0) if counts is None else counts


def prefixes(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Each window with its rarest token: fewest places in the documents, then the smallest hash.

    A window that has a token of no document stands in none; it is left out.
    """
    every = tokens(found)
    ranked = every.join(rarity(docs, every), ["token", "size"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("window").agg(F.min(F.struct("n", "token", "offset")).alias("r")).where("r.n > 0")
    return found.join(rarest, "window").select("window", "length", "size", "items", "r.token", "r.offset")


def hits(docs: DataFrame, needed: DataFrame, size: int, with_itself: bool) -> DataFrame:
    """(doc_id, h, n_words, start, length, items) of exact occurrences; start 0 is the document itself.

    docs: (doc_id, h, w). needed: prefixes of one token size, bounded.
    """
    probe = placed_tokens(docs, size, with_itself)
    table = needed.select("window", "length", "items", "token", "offset")
    if with_itself:
        kinds = dict(table.dtypes)
        itself = needed.sparkSession.range(1).select(
            F.lit(None).cast(kinds["window"]).alias("window"),
            F.lit(0).alias("length"),
            F.lit(None).cast(kinds["items"]).alias("items"),
            F.lit(ITSELF).cast("long").alias("token"),
            F.lit(0).alias("offset"),
        )
        table = table.unionByName(itself)
    start = F.col("at") - F.col("offset")
    inside = (start >= 1) & (start + F.col("length") - 1 <= F.size("w"))
    same = F.slice("w", F.greatest(start, F.lit(1)), F.greatest(F.col("length"), F.lit(0))) == F.col("window")
    matched = probe.join(F.broadcast(table), "token").where(
        ((F.col("at") == 0) & F.col("window").isNull()) | ((F.col("at") > 0) & F.col("window").isNotNull() & inside & same)
    )
    return matched.select("doc_id", "h", F.size("w").alias("n_words"), F.when(F.col("at") > 0, start).otherwise(0).alias("start"), "length", "items")


def covered(spans: Column) -> Column:
    """Words inside the union of (start, length) spans, counted in one pass over the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, span: Column) -> Column:
        end = span["start"] + span["length"] - 1
        fresh = F.greatest(F.lit(0), end - F.greatest(acc["end"], span["start"] - 1))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"])


def contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated, text_hash) for every row of `docs`.

    The text's hash tells rows apart that share an id, or have none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_hash(F.col(text)).alias("h"), words(F.col(text)).alias("w"))
    found = cut(prefixes(windows(items, width, shingle), rows))
    held = F.octet_length(F.array_join("window", " ")) + 24 * F.size("items") + 8 * F.col("length")
    blocks = blocks_of(found, "window", held) or [(shingle, found)]
    every = None
    for size, needed in blocks:
        part = hits(rows, needed, size, with_itself=every is None)
        every = part if every is None else every.unionByName(part)
    is_hit = F.col("start") > 0
    grouped = every.groupBy("doc_id", "h", "n_words").agg(
        F.sum(F.when(is_hit, 0).otherwise(1)).alias("copies"),
        F.collect_set(F.when(is_hit, F.struct("start", "length"))).alias("spans"),
        F.collect_set(F.when(is_hit, F.col("items"))).alias("sets"),
    )
    each = grouped.select("doc_id", "h", "n_words", "spans", "sets", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    ids = F.array_sort(F.array_distinct(F.flatten("sets")))
    made = each.select("doc_id", "h", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).alias("n_hit"), ids.alias("items"))
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), F.col("h").alias("text_hash"))
