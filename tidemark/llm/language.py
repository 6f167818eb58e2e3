"""Hierarchical language identification.

A text is first given a language family, by one linear model over families; then
one-versus-one linear support vector machines, trained on the family's own languages
alone, vote on the language. Features are square roots of the relative frequencies of
hashed byte trigrams of the lower-cased text, so their vector has length 1.

The models are fitted in numpy on the driver, on ``per_language`` documents of each
language at most, drawn by a hash of doc_id; their texts are turned into hashed counts
on the executors. Scoring takes whole texts.

Nulls and odd input: a null text, or one without a Unicode letter, is ``und`` with score
0. A text with letters but under three bytes has no trigram and gets the model's prior.
With nothing to learn from, every text is ``und``. Input columns stay; ``lang_pred`` and
``score`` are set, also where the input has columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import prepare
from tidemark.llm.textkit import LOWER, blocks, raw

BITS = 13
PER_LANGUAGE = 500
#: The family of a language; one that isn't here is a family of its own.
FAMILIES = {
    "de": "germanic", "en": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic", "bg": "slavic",
}


def trigram_counts(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Documents x 2**bits counts of hashed byte trigrams; no trigram crosses documents."""
    n, size = len(offsets) - 1, 1 << bits
    if len(data) < 3:
        return np.zeros((n, size), np.float32)
    low = LOWER[data].astype(np.uint32)
    code = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
    doc = np.repeat(np.arange(n), np.diff(offsets))[:-2]
    inside = np.arange(len(slot)) + 2 < offsets[1:][doc]
    at = (doc * size + slot)[inside]
    return np.bincount(at, minlength=n * size).reshape(n, size).astype(np.float32)


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies, in place."""
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
    return np.sqrt(counts, out=counts)


def svm(x: np.ndarray, sign: np.ndarray, l2: float = 1e-4, steps: int = 250) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, classes weighing the same."""
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    w, velocity, gradient = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    for _ in range(steps):
        pull = 2 * weight * sign * np.maximum(0, 1 - sign * (x @ w[:-1] + 0.3 * w[-1]))
        gradient[:-1], gradient[-1] = l2 * w[:-1] - pull @ x, l2 * w[-1] - 0.3 * pull.sum()
        velocity = 0.9 * velocity - 0.25 * gradient
        w = w + velocity
    return w


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]
    family_weights: np.ndarray  # families x (features + 1)
    pairs: list[tuple[int, int]]
    pair_weights: np.ndarray  # pairs x (features + 1)
    sharpness: float = 6.0

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray) -> LanguageModel:
        languages = sorted(set(labels))
        y, names = np.searchsorted(languages, labels), [FAMILIES.get(x, x) for x in languages]
        families = [[i for i, f in enumerate(names) if f == g] for g in sorted(set(names))]
        x = unit(counts)
        family = [svm(x, np.where(np.isin(y, members), 1, -1).astype(np.float32)) for members in families]
        pairs = [(a, b) for members in families for k, a in enumerate(members) for b in members[k + 1 :]]
        own = [svm(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1, -1).astype(np.float32)) for a, b in pairs]
        width = x.shape[1] + 1
        return cls(languages, families, np.array(family, np.float32).reshape(-1, width), pairs, np.array(own, np.float32).reshape(-1, width))

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Documents x languages: the family's probability times the votes of the SVMs in it."""
        x = unit(counts)
        z = self.sharpness * (x @ self.family_weights[:, :-1].T + 0.3 * self.family_weights[:, -1])
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        votes = 1 / (1 + np.exp(-self.sharpness * (x @ self.pair_weights[:, :-1].T + 0.3 * self.pair_weights[:, -1])))
        out = np.zeros((len(x), len(self.languages)))
        for f, members in enumerate(self.families):
            share = np.ones((len(x), len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    share[:, members.index(a)] *= votes[:, k]
                    share[:, members.index(b)] *= 1 - votes[:, k]
            out[:, members] = p[:, [f]] * share / share.sum(1, keepdims=True)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        parts = [self.probabilities(trigram_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in blocks(offsets, 1 << 18)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))


def class_shares(docs: DataFrame, label: str, per_class: int) -> dict:
    """The share of each class's rows that about ``per_class`` of them are, 1 at most."""
    return {r[label]: min(1.0, per_class / r["count"]) for r in docs.groupBy(label).count().collect()}


def sample_per_class(docs: DataFrame, label: str, shares: dict) -> DataFrame:
    """The given shares of the classes, drawn by a hash of doc_id."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, part in shares.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(part)).otherwise(share)
    return docs.where(draw < share)


def _sparse_counts(batches):
    for batch in batches:
        data, offsets = raw(batch.column("text"))
        found = []
        for lo, hi in blocks(offsets, 1 << 18):
            for row in trigram_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                at = np.flatnonzero(row)
                found.append(np.concatenate([at.astype(np.float32), row[at]]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.binary())], ["lang", "counts"])


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit on a bounded sample of the rows that have a language and a text."""
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = sample_per_class(known, "lang", class_shares(known, "lang", per_language)).select("lang", "text").mapInArrow(_sparse_counts, "lang string, counts binary").collect()
    if not rows:
        return None
    counts = np.zeros((len(rows), 1 << BITS), np.float32)
    for i, r in enumerate(rows):
        at, n = np.frombuffer(r["counts"], np.float32).reshape(2, -1)
        counts[i, at.astype(np.int64)] = n
    return LanguageModel.fit(counts, np.array([r["lang"] for r in rows]))


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every document."""
    prepare(docs.sparkSession)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})

    def predict(text: pa.Array) -> pa.Array:
        p = model.score(*raw(text))
        best = p.argmax(1)
        names = pa.array(np.array(model.languages, object)[best], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(p[np.arange(len(p)), best], pa.float64())], ["lang_pred", "score"])

    guess = F.arrow_udf(predict, "struct<lang_pred:string,score:double>")(F.col("text"))
    out = docs.withColumn("__guess", guess)
    return out.withColumns({"lang_pred": F.when(letters, F.col("__guess.lang_pred")).otherwise("und"), "score": F.when(letters, F.col("__guess.score")).otherwise(0.0)}).drop("__guess")
