"""The registered query of each operator, with its production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import bpe, decontaminate, html_text, langid, merkle, mixing, periodic, quality, repeats, secrets, sharding, simhash, url_filter

#: The operators' rank file, in the folder of public tokenizers.
RANKS = "byte_bpe_50k.tiktoken"

# The rules that the URL filter must apply.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
# Names of sites that are listed, under each of the example domains.
LISTED_NAMES = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x"]
#: Canonical URLs that are blocked, with all below them, where no rule decides.
URL_BLOCKLIST = [f"http://{name}.example.{end}/" for name in LISTED_NAMES for end in ("com", "net", "org")]


def tokenizer() -> tuple[str, str]:
    """(path of the rank file, pre-token pattern) of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = secrets.listing(F.filter("spans", lambda s: s["kind"] != "markov"))
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(base, 256).alias("base_sha256"),
        secrets.listing(F.col("spans")).alias("spans"),
        of("markov").alias("n_markov"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.deal(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out"))
    return langid.identify(rows, langid.fit(docs), keep=["doc_id", "held_out"])


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), *tokenizer())


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    rows = quality.apply_policy(quality.apply_policy(rows, "base", "base_kept"), "v1", "kept")
    measured = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = [c for c in rows.columns if c not in ("doc_id", *measured, "base_kept", "kept")]
    return rows.select("doc_id", *measured, (~F.col("base_kept")).alias("base_failed"), "kept", *more, F.lit("v1").alias("policy"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and what it alone rejects, over all documents."""
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    each = [quality.ablations(rows, version).withColumn("policy", F.lit(version)) for version in quality.POLICIES]
    return reduce(DataFrame.unionByName, each)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    blocklist = spark.createDataFrame([(u,) for u in URL_BLOCKLIST], "url string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, blocklist)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, url_filter.UPPER, url_filter.LOWER)


def _id_crc(doc_id: Column) -> Column:
    """Unsigned CRC-32 of the decimal id; null without one."""
    return F.crc32(doc_id.cast("string").cast("binary"))


#: Columns of `documents` that a leaf of the manifest is made of, in order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = merkle.digest([_ascii_lower(F.col("text")) if c == "text" else F.col(c) for c in LEAF])
    probe = F.when(_id_crc(F.col("doc_id")) % 5 == 0, tampered)
    found = merkle.manifest(table(spark, sf_dir, "documents"), LEAF, probe=probe).proofs()
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def with_periods(docs: DataFrame) -> DataFrame:
    """`docs` with a period planted in the words of every tenth text, by the CRC-32 of its id."""
    crc = _id_crc(F.col("doc_id"))
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))
    rows = docs.withColumn("__w", F.when(crc % 10 == 0, words)).withColumn("__n", F.size("__w").cast("long")).withColumn("__g", F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) div 10"))
    rows = rows.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    rows = rows.withColumn("__p", F.expr("1 + (__n - __a) div (3 + __g % 8)"))
    planted = F.expr("array_join(transform(sequence(0, __n - 1), i -> get(__w, CAST(IF(i < __a, i, __a + (i - __a) % __p) AS INT))), ' ')")
    return rows.withColumn("text", F.when(F.col("__a").isNotNull(), planted).otherwise(F.col("text"))).select(*docs.columns)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(with_periods(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_text, op2_decontamination, op3_secrets, op4_sharding, op5_langid, op6_bpe, op7_simhash, op8_repeats, op9_quality_rules, op10_url_filter, op11_merkle_manifest, op12_source_mix, op13_periodic_runs)
}

#: Further queries of the operators' own results.
REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"quality_ablations": quality_ablations}

_SPACES = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_SPACES}')"

_LEDGER_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), windows AS (
  SELECT k, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM rows WHERE len(words) >= 8)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT k, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY k
), lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM rows)
  WHERE regexp_matches(line, '{_SPACES}') GROUP BY k
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^|]', '', 'g'))::BIGINT AS n_bars,
    len(list_filter(words, lambda x: ends_with(x, '!!')))::BIGINT AS n_shouts,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1]))::BIGINT AS n_stutters
  FROM rows LEFT JOIN repeated USING (k) LEFT JOIN lines USING (k)
), failed AS (
  SELECT *, ({' + '.join(f'CASE WHEN {c} THEN {1 << b} ELSE 0 END' for b, (_, c) in enumerate(quality.RULES))})::BIGINT AS fail_bits FROM measured
)
"""

OP9_SQL = f"""{_LEDGER_SQL}
SELECT *, fail_bits & {quality.policy_mask('base')} <> 0 AS base_failed, fail_bits & {quality.policy_mask('v1')} = 0 AS kept, 'v1' AS policy FROM failed
"""

_POLICY_ROWS = ", ".join(f"('{v}', {quality.policy_mask(v)}, '{r}', {1 << quality.bit(r)})" for v, rs in quality.POLICIES.items() for r in rs)

ABLATIONS_SQL = f"""{_LEDGER_SQL}, policies(policy, mask, rule, bit) AS (VALUES {_POLICY_ROWS})
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only
FROM failed, policies GROUP BY policy, rule
"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}', true)" for h, p, v in URL_RULES)
_LIST_ROWS = ", ".join(f"('{u.split('/')[2]}', '/', 'block', false)" for u in URL_BLOCKLIST)

OP10_SQL = f"""
WITH entries(e_host, e_path, verdict, is_rule) AS (VALUES {_RULE_ROWS}, {_LIST_ROWS}),
rows AS (
  SELECT row_number() OVER () AS k, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, regexp_extract(url, '(?s)^.*?://(.*)$', 1) AS rest FROM pages)
), fits AS (
  SELECT k, e_host || e_path AS rule, verdict, is_rule FROM rows JOIN entries
  ON (host = e_host OR ends_with(host, '.' || e_host)) AND starts_with(path, e_path)
), best AS (
  SELECT k, arg_max(rule, length(rule)) FILTER (is_rule) AS rule, arg_max(verdict, length(rule)) FILTER (is_rule) AS verdict,
    arg_max(rule, length(rule)) FILTER (NOT is_rule) AS listed_as FROM fits GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed_as IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed_as
FROM rows LEFT JOIN best USING (k)
"""

_FOLDED = f"regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2_SQL = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, {_FOLDED} AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS size
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS k, doc_id, {_FOLDED} AS w FROM documents
), doc_windows AS (
  SELECT k, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)
), hits AS (
  SELECT k, i, d.size, item FROM doc_windows d JOIN item_windows v ON d.win = v.win AND d.size = v.size
), words_hit AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + size)) AS p FROM hits) GROUP BY k
), items_hit AS (
  SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (k) LEFT JOIN items_hit USING (k)
"""

OP8_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, encode(coalesce(text, '')) AS b FROM documents
), strings AS (
  SELECT r, doc, k, array_slice(b, k, k + 49) AS part FROM (SELECT r, doc, b, unnest(range(1, octet_length(b) - 48)) AS k FROM rows WHERE octet_length(b) >= 50)
), least_doc AS (
  SELECT part, min(doc) AS low FROM strings GROUP BY part
), hits AS (
  SELECT r, k FROM strings JOIN least_doc USING (part) WHERE low < doc
), marked AS (
  SELECT r, k, CASE WHEN k - lag(k) OVER (PARTITION BY r ORDER BY k) <= 50 THEN 0 ELSE 1 END AS f FROM hits
), spans AS (
  SELECT r, min(k) AS a, max(k) + 50 AS z FROM (SELECT r, k, sum(f) OVER (PARTITION BY r ORDER BY k) AS i FROM marked) GROUP BY r, i
), pieces AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS p, a AS q FROM spans UNION ALL SELECT r, max(z), NULL FROM spans GROUP BY r
), kept AS (
  SELECT r, string_agg(CASE WHEN coalesce(q, octet_length(b) + 1) > p THEN hex(array_slice(b, p, coalesce(q, octet_length(b) + 1) - 1)) ELSE '' END, '' ORDER BY p) AS h
  FROM pieces JOIN rows USING (r) GROUP BY r
), removed AS (
  SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
FROM rows LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""

def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _leaf_sql(text: str) -> str:
    values = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in LEAF]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


OP11_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}')")} END AS probe
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM rows
), nodes AS (
  SELECT tree, 0 AS level, k, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, k // 16, sha256(string_agg(node, '' ORDER BY k)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY tree, level, n, k // 16
), subs AS (
  SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS k FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, k, node, (SELECT count(*) FROM subs) AS n FROM subs
  UNION ALL
  SELECT level + 1, k // 16, sha256(string_agg(node, '' ORDER BY k)), (n + 15) // 16 FROM upper WHERE n > 1 GROUP BY level, n, k // 16
), beside AS (
  SELECT a.tree, a.level, a.k, coalesce(string_agg(b.node, '' ORDER BY b.k) FILTER (b.k < a.k), '') AS early, coalesce(string_agg(b.node, '' ORDER BY b.k) FILTER (b.k > a.k), '') AS late
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.k // 16 = b.k // 16 WHERE a.n > 1 GROUP BY a.tree, a.level, a.k
  UNION ALL
  SELECT NULL, a.level, a.k, coalesce(string_agg(b.node, '' ORDER BY b.k) FILTER (b.k < a.k), ''), coalesce(string_agg(b.node, '' ORDER BY b.k) FILTER (b.k > a.k), '')
  FROM upper a JOIN upper b ON a.level = b.level AND a.k // 16 = b.k // 16 WHERE a.n > 1 GROUP BY a.level, a.k
), fold AS (
  SELECT r, tree, 0 AS step, 0 AS level, k, false AS above, coalesce(probe, leaf) AS node, '' AS siblings, false AS done FROM placed
  UNION ALL
  SELECT f.r, f.tree, f.step + 1, CASE WHEN b.tree IS NULL AND NOT f.above THEN 0 ELSE f.level + 1 END,
    CASE WHEN b.level IS NOT NULL THEN f.k // 16 ELSE s.k END, f.above OR b.level IS NULL,
    CASE WHEN b.level IS NOT NULL THEN sha256(b.early || f.node || b.late) ELSE f.node END, f.siblings || coalesce(b.early || b.late, ''), f.above AND b.level IS NULL
  FROM fold f LEFT JOIN beside b ON b.tree IS NOT DISTINCT FROM (CASE WHEN f.above THEN NULL ELSE f.tree END) AND b.level = f.level AND b.k = f.k
  JOIN subs s ON s.tree = f.tree WHERE NOT f.done
)
SELECT p.doc_id, p.leaf, s.node AS subroot, u.node AS root, sha256(f.siblings) AS proof_sha256, f.node AS folded_root, f.node = u.node AS verified
FROM placed p JOIN subs s USING (tree) JOIN fold f ON f.r = p.r AND f.done, (SELECT node FROM upper WHERE n = 1) u
"""

OP12_SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS grp, len({_WORDS})::BIGINT AS size,
    md5(concat_ws(':', '{mixing.SEED}', coalesce(doc_id::VARCHAR, '-'), coalesce(md5(text), '-'))) AS key
  FROM documents
), sources AS (
  SELECT grp, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY grp) - 1) % 3 AS weight FROM rows GROUP BY grp
), rated AS (
  SELECT *, {mixing.EPOCHS} * source_size AS most, ({mixing.EPOCHS} * source_size)::DOUBLE / weight AS ratio FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - (sum(most) OVER w - most))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER w - weight))::DOUBLE AS level
  FROM rated WINDOW w AS (ORDER BY ratio, grp)
), found AS (
  SELECT arg_min(level, (ratio, grp)) AS level FROM levels WHERE ratio > level
), aims AS (
  SELECT grp, source_size, CASE WHEN found.level IS NULL OR ratio <= found.level THEN most::DOUBLE ELSE found.level * weight END AS target FROM rated, found
), sorted AS (
  SELECT *, sum(size) OVER (PARTITION BY grp ORDER BY key, doc_id NULLS FIRST, size, r) - size AS before, floor(target)::BIGINT AS budget FROM rows JOIN aims USING (grp)
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size * size ELSE 0 END + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size * source_size ELSE 0 END - before)))::BIGINT AS taken
FROM sorted
"""

OP13_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, coalesce({_crc_sql("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents
), planned AS (
  SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM texts
), rows AS (
  SELECT r, doc_id, CASE WHEN a = len(w) THEN w ELSE list_transform(range(0, len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END]) END AS w FROM planned
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM rows
), equal AS (
  SELECT a.r, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.r = b.r AND a.word = b.word AND a.i < b.i
), stretches AS (
  SELECT r, q, min(i) AS s, max(i) + q + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM equal)
  GROUP BY r, q, g HAVING count(*) >= greatest(q, {periodic.LEAST} - q)
), runs AS (
  SELECT r, s, e, min(q) AS q FROM stretches GROUP BY r, s, e
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS runs, min((-(e - s), s, q)) AS best FROM runs GROUP BY r
), dropped AS (
  SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[2]::BIGINT AS start, (-best[1])::BIGINT AS length, best[3]::BIGINT AS period,
  (1000 * -best[1] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM rows LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op8_repeats": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_url_filter": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_source_mix": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
REPORT_SQL: dict[str, str] = {"quality_ablations": ABLATIONS_SQL}
