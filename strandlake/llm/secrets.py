"""Secret scans: three fixed kinds of matches, and strings that look random to Markov models.

Two first-order character models, one of random strings and one of ordinary identifiers, are
trained on labelled samples: long values of fixed matches are random, runs of token characters in
texts without any are ordinary. A run of `RUN` is a span of kind `markov` if the log-likelihood ratio
of the models is above `THRESHOLD` and no fixed match overlaps it. All of it is DataFrame functions
on single rows, in time linear in a text's length and its spans; scanning needs no shuffle.

Sample bound: about `SAMPLE_DOCS` distinct whole texts that have a fixed match and as many that have
none, chosen by a hash of the text among all of them, so that file layout doesn't matter. What comes
to the driver is two counts and two tables of 68 x 68 counts.

Defined results: a null text has no span; positions count code points; fixed matches of different
kinds may overlap and are all kept; without any sample every string scores zero; repeated rows stay
repeated; an empty table gives an empty result; other columns are carried only if asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, with pattern, group to measure and least length.
KINDS: list[tuple[str, str, int, int]] = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
]
#: Quick tests that any qualifying match of a kind passes.
QUICK = {
    "assign": r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Runs that the models judge, and runs that teach what is ordinary.
RUN = r"([A-Za-z0-9+/_=-]{12,})"
ORDINARY = r"([A-Za-z0-9+/_=-]{4,})"
THRESHOLD = math.log(1e4)
SAMPLE_DOCS = 2000
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
FOUND = "struct<spans:array<struct<start:int,end:int,value:string>>,cover:binary>"
#: Elements that running totals take at a time.
STRETCH = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of non-negative ints by an associative step, in stretches.

    An array that grows is copied at each step, so totals are made within stretches, then over them.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        at = step(acc["at"], x)
        return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

    def shift(acc: Column, stretch: Column) -> Column:
        return F.struct(step(acc["at"], stretch["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

    def joined(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(STRETCH))
        stretches = F.transform(starts, lambda k: F.aggregate(F.slice(v, k, STRETCH), zero, add))
        return let(stretches, lambda each: F.flatten(F.zip_with(each, F.aggregate(each, zero, shift, lambda acc: acc["out"]), lambda own, before: F.transform(own["out"], lambda x: step(before, x)))))

    return let(values, joined)


def _matches(text: Column, pattern: str, group: int, keep: Callable[[Column], Column]) -> Column:
    """(spans, cover) of the matches whose value (the group) `keep` accepts.

    cover has a byte for each code point up to the last match: 1 inside of spans, else 0.
    """
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def measured(w: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(w))
        return F.zip_with(F.arrays_zip(w.alias("w"), value.alias("v")), between, lambda m, b: F.struct(F.char_length(b).alias("gap"), F.char_length(m["w"]).alias("size"), m["v"].alias("value"), keep(m["v"]).alias("kept")))

    def placed(each: Column) -> Column:
        ends = running(F.transform(each, lambda m: m["gap"] + m["size"]), lambda a, b: a + b)
        spans = F.zip_with(each, ends, lambda m, end: F.struct((end - m["size"]).alias("start"), end.alias("end"), m["value"].alias("value"), m["kept"].alias("kept")))
        own = F.transform(F.filter(spans, lambda s: s["kept"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        cover = F.array_join(F.transform(each, lambda m: F.concat(F.repeat(F.lit("0"), m["gap"]), F.repeat(F.when(m["kept"], "1").otherwise("0"), m["size"]))), "")
        return F.struct(own.alias("spans"), cover.cast("binary").alias("cover"))

    return let(let(whole, measured), placed)


def fixed(text: Column, kind: str) -> Column:
    """(spans, cover) of one fixed kind; null where there is none."""
    pattern, group, least = next((p, g, n) for k, p, g, n in KINDS if k == kind)
    return F.when(text.rlike(QUICK[kind]), _matches(text, pattern, group, lambda v: F.char_length(v) >= least)).cast(FOUND)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def bigram_counts(strings: DataFrame) -> DataFrame:
    """(label, cell, n) over the neighbouring characters of (label, value)."""
    pair = let(codes(F.col("value")), lambda c: F.arrays_zip(F.slice(c, F.lit(1), F.size(c) - 1).alias("a"), F.slice(c, F.lit(2), F.size(c) - 1).alias("b")))
    each = strings.where(F.char_length("value") > 1).select("label", F.explode(pair).alias("p"))
    coded = each.select("label", (F.col("p.a") - 1).alias("a"), (F.col("p.b") - 1).alias("b"))
    return coded.where("a >= 0 AND b >= 0").groupBy("label", (F.col("a") * len(ALPHABET) + F.col("b")).alias("cell")).agg(F.count("*").alias("n"))


def log_ratios(counts: dict[tuple[str, int], int]) -> list[float]:
    """Log of random over ordinary transition probability for each pair of characters.

    The random model is half what its samples show and half uniform, since samples of one encoding
    must not make another look ordinary; the ordinary one is mixed with its single characters and a
    uniform part, since identifiers may hold any character now and then.
    """
    size = len(ALPHABET)
    seen = {label: [[counts.get((label, a * size + b), 0) for b in range(size)] for a in range(size)] for label in ("random", "ordinary")}
    after = [sum(row[b] for row in seen["ordinary"]) + 1 for b in range(size)]
    single = [n / sum(after) for n in after]
    out = []
    for a in range(size):
        random, ordinary = seen["random"][a], seen["ordinary"][a]
        n, m = sum(random), sum(ordinary)
        for b in range(size):
            p = 0.5 * (random[b] / n if n else 1 / size) + 0.5 / size
            q = 0.9 * (ordinary[b] / m if m else single[b]) + 0.08 * single[b] + 0.02 / size
            out.append(math.log(p) - math.log(q) if n or m else 0.0)
    return out


def train(docs: DataFrame, text: str = "text") -> list[float]:
    """The models' log ratios from a bounded sample of `docs`."""
    rows = docs.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    matching = F.col("text").rlike("|".join(f"(?:{p})" for p in QUICK.values()))
    n = rows.agg(F.count("*").alias("all"), F.count_if(matching).alias("having")).first()
    share = {label: int(min(1.0, SAMPLE_DOCS / max(m, 1)) * (1 << 30)) for label, m in (("random", n["having"]), ("ordinary", n["all"] - n["having"]))}
    draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30))
    labelled = rows.where(draw < max(share.values())).withColumn("label", F.when(matching, "random").otherwise("ordinary"))
    drawn = labelled.where(draw < F.when(F.col("label") == "random", share["random"]).otherwise(share["ordinary"])).distinct()
    spans = F.concat(*[F.coalesce(fixed(F.col("text"), kind)["spans"], _none()) for kind, *_ in KINDS])
    secret = F.filter(F.transform(spans, lambda s: s["value"]), lambda v: v.rlike("[0-9]") & (F.char_length(v) >= 16))
    values = F.when(F.col("label") == "random", secret).otherwise(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(1)))
    counts = bigram_counts(drawn.select("label", F.explode(values).alias("value")))
    return log_ratios({(r["label"], r["cell"]): r["n"] for r in counts.collect()})


def codes(value: Column) -> Column:
    """Places of a string's characters in the alphabet, from 1; 0 for others."""
    return F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))


def score(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string; characters outside the alphabet end no run and count zero."""
    table = F.array(*[F.lit(float(r)) for r in ratios])

    def total(c: Column) -> Column:
        n = F.greatest(F.size(c) - 1, F.lit(0))
        steps = F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.when((a > 0) & (b > 0), F.element_at(table, (a - 1) * len(ALPHABET) + b)).otherwise(0.0))
        return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)

    return let(codes(value), total)


def _ranked(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def scan(docs: DataFrame, ratios: list[float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns and `spans` array<struct<start, rank, end, kind>> in order, for every row.

    rank is the kind's place: fixed kinds first, markov last.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none, no_runs = F.array().cast(SPANS), _none()

    def spans(base: Column, runs: Column) -> Column:
        def is_free(s: Column) -> Column:
            free = F.lit(True)
            for kind, *_ in KINDS:
                own = F.substring(base[kind]["cover"], s["start"] + 1, s["end"] - s["start"])
                free = free & (base[kind].isNull() | (F.call_function("instr", own.cast("string"), F.lit("1")) == 0))
            return free

        fixed_ones = F.concat(*[F.coalesce(F.transform(base[kind]["spans"], _ranked(k, kind)), none) for k, (kind, *_) in enumerate(KINDS)])
        markov = F.transform(F.filter(runs, is_free), _ranked(len(KINDS), "markov"))
        return F.array_sort(F.concat(fixed_ones, markov))

    def found(t: Column) -> Column:
        runs = F.when(t.rlike(RUN), _matches(t, RUN, 1, lambda v: score(v, ratios) > THRESHOLD)["spans"])
        base = F.struct(*[fixed(t, kind).alias(kind) for kind, *_ in KINDS])
        return let(base, lambda b: let(F.coalesce(runs, no_runs), lambda r: spans(b, r)))

    return docs.select(*[F.col(f"`{k}`") for k in keep or ["doc_id"]], let(value, found).alias("spans"))


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """`text` with each stretch that spans (in order of start) cover replaced by `mark`."""

    def piece(points: Column, a: Column, n: Column) -> Column:
        """n code points from place a, by their places in a fixed-width encoding."""
        return F.decode(F.substring(points, 4 * a + 1, 4 * F.greatest(n, F.lit(0))), "UTF-32")

    def replaced(points: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return let(reach, lambda r: F.concat(F.array_join(parts(points, r), ""), piece(points, F.element_at(r, -1), F.octet_length(points))))

    def parts(points: Column, r: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(r, F.lit(1), F.size(r) - 1))
        return F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(piece(points, at, s["start"] - at), F.lit(mark))).otherwise(""))

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), replaced)).otherwise(text)
