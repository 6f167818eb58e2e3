"""A convolutional toxicity classifier in numpy, its thresholds calibrated by language.

A word is the sum of two rows of an embedding table, under two hashes, so that two words
are the same to the model only where both hashes collide. Filters one, two and three
words wide run over the whole text; each filter's maximum over the text goes into a
logistic layer. Training is minibatch Adam on the driver over a bounded sample of
labelled rows; the first embedding coordinate starts at the word's log-odds in the
sample, the rest at small random values. A quarter of the sample is kept back, and for
each language that the language model *predicts* a threshold is chosen on it, its rows
weighted by the inverse of their class's share in the sample; a score is
``sigmoid(slope * (logit - threshold))``. Language, source and doc_id never go in.

Nulls: a null or empty text has no word and gets the score of the bias alone. With no
labelled row to learn from, every score is 0. Input columns stay; ``score`` and
``predicted`` are set, also where the input has columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import LanguageModel, class_shares, sample_per_class
from tidemark.llm.runtime import prepare
from tidemark.llm.textkit import U, blocks, mix, raw, words

BITS, DIM, FILTERS, WIDTHS = 16, 8, 6, (1, 2, 3)
PER_CLASS = 3000
_STRIP = np.zeros(256, bool)
_STRIP[[ord(c) for c in ".,;:!?*#%&$|\"'()[]{}<>-_"]] = True


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' two embedding rows (2 x words), punctuation blanked out, and document offsets."""
    clean = data.copy()
    clean[_STRIP[data]] = 0x20
    _, _, h, at = words(clean, offsets)
    first = (h >> U(64 - BITS)).astype(np.int32)
    second = (mix(h) >> U(64 - BITS)).astype(np.int32) + np.int32(1 << BITS)
    return np.stack([first, second]), at


@dataclass
class ToxicityModel:
    table: np.ndarray  # 2 * 2**BITS x DIM
    filters: list[np.ndarray]  # by width: width * DIM x FILTERS
    biases: np.ndarray  # widths * FILTERS
    out: np.ndarray  # widths * FILTERS + 1
    language: LanguageModel | None = None
    thresholds: np.ndarray | None = None  # by predicted language
    slope: float = 2.0

    @classmethod
    def start(cls, seed: int = 7) -> ToxicityModel:
        rng = np.random.default_rng(seed)
        table = (0.02 * rng.standard_normal((2 << BITS, DIM))).astype(np.float32)
        filters = [(rng.standard_normal((w * DIM, FILTERS)) * (0.5 / np.sqrt(w * DIM))).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[0] = 0.7  # the log-odds coordinate of the first word
        return cls(table, filters, np.full(len(WIDTHS) * FILTERS, -0.2, np.float32), np.append(np.full(len(WIDTHS) * FILTERS, 0.3), -1.0).astype(np.float32))

    def pooled(self, rows: np.ndarray, at: np.ndarray, keep: bool = False):
        """Documents x features: each filter's maximum (0 at least), and where it was."""
        n, m = len(at) - 1, rows.shape[1]
        features, where = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.full((n, len(WIDTHS) * FILTERS), -1)
        emb = self.table[rows[0]] + self.table[rows[1]]
        emb = np.vstack([emb, np.zeros((max(WIDTHS), DIM), np.float32)])
        doc = np.repeat(np.arange(n), np.diff(at))
        full = np.flatnonzero(np.diff(at) > 0)
        for k, w in enumerate(WIDTHS):
            act = np.zeros((m, FILTERS), np.float32)
            for j in range(w):  # words past the document's end count as zeros
                part = emb[j : m + j] @ self.filters[k][j * DIM : (j + 1) * DIM]
                if j:
                    part[np.arange(m) + j >= at[1:][doc]] = 0
                act += part
            act += self.biases[k * FILTERS : (k + 1) * FILTERS]
            if len(full):
                top = np.maximum.reduceat(act, at[:-1][full], axis=0)
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                features[full, cols] = np.maximum(top, 0)
                if keep:
                    for c in range(FILTERS):
                        hit = np.flatnonzero(act[:, c] == features[:, k * FILTERS + c][doc])
                        where[doc[hit[::-1]], k * FILTERS + c] = hit[::-1]
        return (features, where, emb) if keep else features

    def logits(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(rows, at) @ self.out[:-1] + self.out[-1]

    def train(self, rows: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.biases, self.out]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        squares, step = np.full(len(self.table), 1e-6, np.float32), 0
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                take = np.concatenate([np.arange(at[i], at[i + 1]) for i in own]) if len(own) else np.zeros(0, int)
                sub, sub_at = rows[:, take], np.concatenate([[0], np.cumsum(at[own + 1] - at[own])])
                f, where, emb = self.pooled(sub, sub_at, keep=True)
                p = 1 / (1 + np.exp(-(f @ self.out[:-1] + self.out[-1])))
                d = ((p - y[own]) * weight[own] / len(own)).astype(np.float32)
                grads = [np.zeros_like(g) for g in params]
                grads[-1][:-1], grads[-1][-1] = d @ f, d.sum()
                df = d[:, None] * self.out[:-1] * (f > 0)
                grads[-2][:] = df.sum(0)
                at_rows, at_grad = [], []
                for k, w in enumerate(WIDTHS):
                    for c in range(FILTERS):
                        col = k * FILTERS + c
                        docs = np.flatnonzero((df[:, col] != 0) & (where[:, col] >= 0))
                        if not len(docs):
                            continue
                        for j in range(w):
                            t = where[docs, col] + j
                            ok = t < sub_at[docs + 1]
                            t, g = t[ok], df[docs[ok], col]
                            grads[k][j * DIM : (j + 1) * DIM, c] += g @ emb[t]
                            at_rows.append(sub[:, t].ravel())
                            at_grad.append(np.tile(g[:, None] * self.filters[k][j * DIM : (j + 1) * DIM, c], (2, 1)))
                step += 1
                for q, g, m1, m2 in zip(params, grads, first, second):
                    m1 += 0.1 * (g - m1)
                    m2 += 0.01 * (g * g - m2)
                    q -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
                if at_rows:  # Adagrad for the table, of which a batch touches a few rows
                    r, g = np.concatenate(at_rows), np.concatenate(at_grad)
                    u, inv = np.unique(r, return_inverse=True)
                    total = np.zeros((len(u), DIM), np.float32)
                    np.add.at(total, inv, g)
                    squares[u] += (total**2).mean(1)
                    self.table[u] -= 5 * rate * total / np.sqrt(squares[u] + 1e-6)[:, None].clip(1e-3)

    def languages_of(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.language is None:
            return np.zeros(len(offsets) - 1, np.int64)
        return self.language.score(data, offsets).argmax(1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for lo, hi in blocks(offsets):
            d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            z = self.logits(*word_rows(d, o)) - self.thresholds[self.languages_of(d, o)]
            out.append(1 / (1 + np.exp(-np.clip(self.slope * z, -40, 40))))
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def log_odds(rows: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By table row: the clipped log-odds of its documents being toxic, near 0 where seldom seen."""
    doc = np.repeat(np.arange(len(y)), np.diff(at))
    out = np.zeros(2 << BITS, np.float32)
    for r in rows:
        pair = np.unique(r.astype(np.int64) * len(y) + doc)
        row, toxic = pair // len(y), y[pair % len(y)]
        a = np.bincount(row, toxic, 2 << BITS) / max(y.sum(), 1)
        b = np.bincount(row, 1 - toxic, 2 << BITS) / max((1 - y).sum(), 1)
        floor = 4.0 / len(y)
        out += np.clip(np.log((a + floor) / (b + floor)), -2, 3)
    return out


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The cut between logits with the best F1 of the weighted rows, mid-gap, and that F1."""
    if not y.any():
        return float(z.max(initial=0) + 1), 0.0
    order = np.argsort(-z, kind="stable")
    hit, z = np.cumsum((weight * y)[order]), z[order]
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    k = int(f1.argmax())
    return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 1)) / 2), float(f1[k])


def fit_toxicity(docs: DataFrame, labels: DataFrame, language: LanguageModel | None, per_class: int = PER_CLASS) -> ToxicityModel | None:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic 0 or 1) and their documents' texts.

    The sample is drawn from the labels before they meet the texts. It has ``per_class``
    rows of a class in expectation, so it may be broadcast, and no text is shuffled.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    shares = class_shares(known, "toxic", per_class)
    drawn = F.broadcast(sample_per_class(known, "toxic", shares))
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(drawn, "doc_id").toArrow().sort_by("doc_id")
    if not len(sample):
        return None
    data, offsets = raw(sample["text"])
    y = sample["toxic"].to_numpy().astype(np.float64)
    parts = [word_rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in blocks(offsets)]
    rows = np.concatenate([p[0] for p in parts], 1)
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    spoken = language.score(data, offsets).argmax(1) if language else np.zeros(len(y), int)
    del parts, data, offsets, sample
    back = np.random.default_rng(11).random(len(y)) < 0.25
    fit = np.flatnonzero(~back)

    def pick(own):
        take = np.concatenate([np.arange(at[i], at[i + 1]) for i in own]) if len(own) else np.zeros(0, int)
        return rows[:, take], np.concatenate([[0], np.cumsum(at[own + 1] - at[own])])

    model = ToxicityModel.start()
    own_rows, own_at = pick(fit)
    model.table[:, 0] = 0.5 * log_odds(own_rows, own_at, y[fit])
    model.train(own_rows, own_at, y[fit])
    held = np.flatnonzero(back) if back.any() else fit
    z, y_held = model.logits(*pick(held)), y[held]
    weight = np.array([1 / shares[k] for k in y_held.astype(int)])  # thresholds are for the classes' real shares
    model.language = language
    overall, _ = best_threshold(z, y_held, weight)
    n_lang = len(language.languages) if language else 1
    model.thresholds = np.full(n_lang, overall)
    spoken = spoken[held]
    for k in range(n_lang):  # few toxic rows pull a language's threshold less
        own = spoken == k
        n = y_held[own].sum()
        if n >= 5:
            cut, _ = best_threshold(z[own], y_held[own], weight[own])
            model.thresholds[k] = (n * cut + 10 * overall) / (n + 10)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """Add ``score`` and ``predicted`` to every document."""
    prepare(docs.sparkSession)
    if model is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def score(text: pa.Array) -> pa.Array:
        return pa.array(shipped.value.score(*raw(text)), pa.float64())

    out = docs.withColumn("score", F.arrow_udf(score, "double")(F.col("text")))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
