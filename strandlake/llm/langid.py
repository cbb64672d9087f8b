"""Language identification: averaged hashed subword embeddings with a linear softmax.

Every letter n-gram (1 to 4 UTF-8 bytes of a lower-cased word with its boundaries) is hashed to a
row of an embedding matrix; a text is the average of its rows; a linear softmax gives the language,
or a class of its own for nonsense, which is learned from the same texts read backwards. Matrix and
softmax are trained together by stochastic gradient descent in numpy on a bounded sample of labelled
rows; then a temperature and a rejection threshold are fitted on a part held back. A text is rejected
if its best language has a score below the threshold: texts that look like nonsense, or like several
languages at once.

Sample bound: about `PER_LANGUAGE` distinct texts a language and `MOST_TEXTS` in all, whole texts,
chosen by a hash of the text, of every language that has any. Executors turn them
into counts of at most BUCKETS buckets, so what the driver holds doesn't depend on how long they are.

Defined results: a text that is null or has no letter is `und` with score 0 and is rejected;
rows without a language are never learned from; repeated rows get equal results; with no labelled
row at all every text is `und`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import with_columns

BUCKETS = 1 << 13
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
PER_LANGUAGE, MOST_TEXTS = 400, 4000
#: Share of held-back texts, rightly named, that the threshold may reject; a language that is likelier than all
#: else together is never rejected.
REJECTED_SHARE, SURE = 0.001, 0.5
#: Steps of descent that training takes at least.
LEAST_STEPS = 1500
#: Weight of all classes alike in the labels of calibration, against overconfidence.
SMOOTHING = 0.02
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:97] = _FOLD[123:128] = 32


def _hashes(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each size."""
    out, acc = [], np.zeros(len(data), np.uint32)
    for k, size in enumerate(SIZES):
        acc = acc.copy()
        stop = len(data) - size + 1
        if stop > 0:
            acc[:stop] = acc[:stop] * np.uint32(31) + data[size - 1 :].astype(np.uint32) * _MULTIPLIERS[k] + np.uint32(k)
        out.append(((acc * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64))
    return out


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _lower(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def _joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each with a space before and after, and the texts' bounds.

    All but letters is a space: of the characters beyond ASCII, signs of Latin-1 and punctuation.
    """
    parts = [b" " + _lower(t or b"") + b" " for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    data = _FOLD[np.frombuffer(b"".join(parts), np.uint8)]
    # lead bytes of U+0080 to U+00BF, U+2000 to U+207F and U+3000 to U+303F; a space ends the data
    signs = np.flatnonzero(data == 0xC2)
    three = np.flatnonzero((data[:-1] == 0xE2) & (data[1:] >> 1 == 0x40) | (data[:-1] == 0xE3) & (data[1:] == 0x80))
    for places, size in ((signs, 2), (three, 3)):
        for k in range(size):
            data[places + k] = 32
    return data, bounds


def backwards(text: bytes | None) -> bytes:
    """The text's characters in reverse: letters of a language in an order that it doesn't have."""
    return (text or b"").decode("utf-8", "replace")[::-1].encode()


def bag(text: bytes | None) -> bytes:
    """Counts of the buckets of a text's n-grams, packed: which buckets, then how often."""
    data, _ = _joined([text])
    # an n-gram starts at a letter or at the space before one, and has no space further on
    word = data != 32
    starts = word | np.concatenate((word[1:], [False]))
    counts = np.zeros(BUCKETS, np.int64)
    for size, bucket in zip(SIZES, _hashes(data), strict=True):
        counts += np.bincount(bucket[_inside(word, starts, size)], minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return used.astype("<u2").tobytes() + counts[used].astype("<u4").tobytes()


def shares(packed: list[bytes]) -> np.ndarray:
    """(texts, BUCKETS) share of each bucket among a text's n-grams."""
    out = np.zeros((len(packed), BUCKETS), np.float32)
    for k, data in enumerate(packed):
        n = len(data) // 6
        counts = np.frombuffer(data, "<u4", n, 2 * n)
        out[k, np.frombuffer(data, "<u2", n)] = counts / max(int(counts.sum()), 1)
    return out


def _inside(word: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    use = starts.copy()
    if size == 1:
        return use & word
    for step in range(1, min(size, len(word))):
        use[: len(word) - step] &= word[step:]
        use[len(word) - step :] = False
    if size > len(word):
        use[:] = False
    return use


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages and nonsense): embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float
    #: On texts held back: share kept, share of these named rightly, and shares rejected of mixtures and of nonsense.
    report: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Calibrated probabilities of the languages and of nonsense, a row a text; averages are over whole texts."""
        data, bounds = _joined(texts)
        word = data != 32
        starts = word | np.concatenate((word[1:], [False]))
        sums = np.zeros((len(texts), self.table.shape[1]))
        total = np.zeros(len(texts))
        for size, bucket in zip(SIZES, _hashes(data), strict=True):
            place = np.flatnonzero(_inside(word, starts, size))
            own = np.searchsorted(bounds, place, side="right") - 1
            total += np.bincount(own, minlength=len(texts))
            for k in range(self.table.shape[1]):
                sums[:, k] += np.bincount(own, weights=self.table[bucket[place], k], minlength=len(texts))
        logits = (sums / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
        return softmax(logits)

    def predict(self, texts: list[bytes | None]) -> dict[str, list]:
        letters = np.array([has_letter(t) for t in texts], bool)
        if not self.languages:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "rejected": [True] * len(texts)}
        shares = self.scores(texts)[:, : len(self.languages)]
        best = shares.argmax(1)
        score = np.where(letters, shares[np.arange(len(texts)), best], 0.0)
        return {
            "lang_pred": [self.languages[b] if has else UNKNOWN for b, has in zip(best.tolist(), letters.tolist(), strict=True)],
            "score": np.clip(score, 0.0, 1.0),
            "rejected": ~letters | (score < self.threshold),
        }


def softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(1, keepdims=True)
    e = np.exp(logits)
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, nonsense: np.ndarray, labels: list[str], width: int = 16, epochs: int = 12, rate: float = 12.0, seed: int = 7) -> Model:
    """SGD over shuffled minibatches of bucket shares; a fifth of the texts is held back for calibration.

    `nonsense` holds the bucket shares of the same texts backwards. The threshold rejects a held-back
    text that is named rightly with a share of REJECTED_SHARE at most, and never one above SURE.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    n, classes = len(labels), len(languages) + 1
    x = np.concatenate((x, nonsense))
    y = np.concatenate(([languages.index(v) for v in labels], np.full(n, classes - 1)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    held, used = order[: n // 5], np.concatenate((order[n // 5 :], order[n // 5 :] + n))
    embed = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (width, classes)).astype(np.float32), np.zeros(classes, np.float32)
    one = np.eye(classes, dtype=np.float32)
    # small samples are gone through more often, so that there are enough steps
    epochs = max(epochs, -(-LEAST_STEPS * 32 // max(len(used), 1)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(used)
        for a in range(0, len(used), 32):
            rows = used[a : a + 32]
            hidden = x[rows] @ embed
            error = (softmax(hidden @ out + bias) - one[y[rows]]) / len(rows)
            back = error @ out.T
            out -= 0.1 * step * (hidden.T @ error)
            bias -= 0.02 * step * error.sum(0)
            embed -= step * (x[rows].T @ back)
    table = embed @ out
    model = Model(languages, table.astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        both = np.concatenate((held, held + n))
        logits = x[both] @ table + bias
        grid = np.geomspace(0.1, 20.0, 60)
        target = (1 - SMOOTHING) * one[y[both]] + SMOOTHING / classes
        loss = [-(target * np.log(softmax(logits / t) + 1e-12)).sum(1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        best = lambda v: softmax((v @ table + bias) / model.temperature)[:, :-1]
        shares = best(x[held])
        right = shares.argmax(1) == y[held]
        if right.any():
            model.threshold = min(SURE, float(np.quantile(shares.max(1)[right], REJECTED_SHARE)))
        kept = shares.max(1) >= model.threshold
        other = rng.permutation(held)
        differ = y[held] != y[other]
        mixed = best((x[held] + x[other])[differ] / 2).max(1) if differ.any() else np.zeros(0)
        odd = best(x[held + n]).max(1)
        model.report = {"kept": kept.mean(), "right": right[kept].mean(), "mixed": (mixed < model.threshold).mean() if len(mixed) else 0.0, "nonsense": (odd < model.threshold).mean()}
    return model


def sample(rows: DataFrame, per_language: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bucket shares, those of the texts backwards, and languages of a bounded number of whole texts."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return np.zeros((0, BUCKETS), np.float32), np.zeros((0, BUCKETS), np.float32), []
    each = min(per_language, max(1, MOST_TEXTS // languages))
    draw = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    # a row a language: the model has a class for each of them anyway
    drawn = rows.join(F.broadcast(counts), "lang").where(draw * F.col("n") < each).select("lang", "text").distinct()

    def packed(texts: list[bytes | None]) -> dict[str, list]:
        return {"bag": [bag(t) for t in texts], "odd": [bag(backwards(t)) for t in texts], "letters": [has_letter(t) for t in texts]}

    got = with_columns(drawn, "text", packed, "bag binary, odd binary, letters boolean", ["lang"]).where("letters").toArrow()
    use = sorted(zip(got["lang"].to_pylist(), got["bag"].to_pylist(), got["odd"].to_pylist(), strict=True))
    return shares([b for _, b, _ in use]), shares([o for _, _, o in use]), [lang for lang, _, _ in use]


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return train(*sample(rows, per_language))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, lang_pred, score and rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs, text, lambda texts: shared.value.predict(texts), "lang_pred string, score double, rejected boolean", keep or ["doc_id"])
