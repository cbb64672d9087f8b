"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed URL or a rule is a host and a path beginning; it fits its host and all subdomains. Its
canonical key is the host, lower-cased and without scheme, query and fragment, with the path up to its
last slash. A URL has one candidate key for each pair of a host suffix and a path beginning that ends
in a slash, never longer than the longest listed one. Keys are probed in a blocked Bloom filter (512
bits a block, eight bits a key, one in each of the block's words) before anything is shuffled; what
passes goes to an exact join on key, where false positives and entries whose last path part doesn't
fit are removed. The longest fitting entry wins. Rows meet their entry by a hash of host and path.

The filter has `BITS_PER_KEY` bits a key up to `MAX_BLOCKS` blocks (8 MB); beyond that it lets more
false positives through to the exact join and stays right. It is broadcast, being bounded.

Defined results: a null url, or one without `://`, has empty host and path and no rule; an empty
list gives no rule to any row; ties in length go to the longer host, then to block; repeated rows
stay repeated; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17
WORDS = 8
SEED_BLOCK, SEED_BITS = 11, 29

# Letters that host names fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without `://`."""
    after = F.substring_index(F.concat(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit("")), "#", 1)
    after = F.substring_index(after, "?", 1)
    host = F.substring_index(after, "/", 1)
    path = F.substr(after, F.char_length(host) + 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def directory(path: Column) -> Column:
    """The path up to its last slash, included."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _bits(key: Column, blocks: Column) -> tuple[Column, list[Column]]:
    h = F.xxhash64(key, F.lit(SEED_BLOCK))
    b = F.xxhash64(key, F.lit(SEED_BITS))
    return F.pmod(h, blocks), [F.shiftrightunsigned(b, 6 * w).bitwiseAND(F.lit(63)).cast("int") for w in range(WORDS)]


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom(keys: DataFrame) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the keys' filter, and its number of blocks."""
    n = keys.count()
    blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_KEY // (64 * WORDS))))
    block, bits = _bits(F.col("key"), F.lit(blocks))
    rows = keys.select(block.alias("block"), *[_one(b).alias(f"w{w}") for w, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]), blocks


def listed(entries: DataFrame) -> DataFrame:
    """Canonical (key, e_host, e_path, verdict, is_rule, rule) of entries (host, path, verdict, is_rule)."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce(F.col("path"), F.lit(""))
    return (
        entries.where("host IS NOT NULL AND host <> ''")
        .select(host.alias("e_host"), path.alias("e_path"), "verdict", "is_rule")
        .distinct()
        .withColumn("key", F.concat("e_host", F.lit(" "), directory(F.col("e_path"))))
        .withColumn("rule", F.concat("e_host", "e_path"))
    )


def candidates(labels: int, slashes: int) -> Column:
    """Keys of (host, path): each host suffix of at most `labels` labels with each path of at most `slashes` slashes."""
    label = F.split("host", r"\.")
    n = F.size(label)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(0), n - labels), n - 1), lambda k: F.array_join(F.slice(label, k + 1, n), "."))
    piece = F.split("path", "/")
    depth = F.least(F.lit(slashes), F.size(piece) - 1)
    heads = F.transform(
        F.sequence(F.lit(0), depth), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(piece, 1, k), "/"), F.lit("/")))
    )
    return F.flatten(F.transform(suffixes, lambda suffix: F.transform(heads, lambda h: F.concat(suffix, F.lit(" "), h))))


def possible(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, path, key) of keys that the Bloom filter of the entries lets through; no shuffle of `urls`."""
    reach = entries.agg(F.max(F.size(F.split("e_host", r"\."))).alias("labels"), F.max(F.size(F.split("e_path", "/")) - 1).alias("slashes")).first()
    filter_rows, blocks = bloom(entries.select("key").distinct())
    probe = urls.where("host <> ''").select("host", "path", F.explode(candidates(reach["labels"] or 1, reach["slashes"] or 0)).alias("key"))
    block, bits = _bits(F.col("key"), F.lit(blocks))
    hit = F.lit(True)
    for w, bit in enumerate(bits):
        hit = hit & (F.col(f"w{w}").bitwiseAND(_one(bit)) != 0)
    return probe.withColumn("block", block).join(F.broadcast(filter_rows), "block").where(hit).select("host", "path", "key")


def best_entries(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, path, rule, verdict, listed_as) of urls (host, path) that an entry fits: the longest rule and the longest listed one."""
    table = listed(entries)
    found = possible(urls, table).distinct().join(table, "key").where(F.startswith(F.col("path"), F.col("e_path")))
    order = F.struct(F.char_length("rule"), F.char_length("e_host"), F.col("verdict"), F.col("rule"))
    ruled, blocked = F.when(F.col("is_rule"), order), F.when(~F.col("is_rule"), order)
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), ruled).alias("r"), F.max_by("rule", blocked).alias("listed_as"))
    return best.select("host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"), "listed_as")


def judge(pages: DataFrame, rules: DataFrame, blocklist: DataFrame, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, host, path, rule, verdict and listed_as of every row.

    rules: (host, path, verdict) with verdict `block` or `allow`; they decide where one fits.
    blocklist: (url) of listed pages; what lies below one is blocked where no rule decides.
    """
    keep = keep or ["page_id"]
    host, path = parts(F.col(f"`{url}`"))
    rows = pages.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("own"), host.alias("host"), path.alias("path"))
    l_host, l_path = parts(F.col("url"))
    listing = blocklist.select(l_host.alias("host"), l_path.alias("path"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))
    entries = rules.select("host", "path", "verdict", F.lit(True).alias("is_rule")).unionByName(listing)
    best = best_entries(rows, entries)
    found = best.select(F.xxhash64("host", "path").alias("h"), F.col("host").alias("b_host"), F.col("path").alias("b_path"), "rule", F.col("verdict").alias("ruled"), "listed_as")
    # rows are joined by a hash of host and path; those without a host, which nothing fits, are spread
    key = F.when(F.col("host") != "", F.xxhash64("host", "path")).otherwise(F.xxhash64(F.col("own").cast("string"), F.lit(3)))
    joined = rows.withColumn("k", key).join(found, (F.col("k") == F.col("h")) & (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    verdict = F.coalesce("ruled", F.when(F.col("listed_as").isNotNull(), "block").otherwise("allow"))
    return joined.select(*[F.col("own")[k].alias(k) for k in keep], "host", "path", "rule", verdict.alias("verdict"), "listed_as")
