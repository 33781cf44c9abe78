"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score over hashed words and word beginnings;
the document's score is their noisy-or, 1 - prod(1 - s), calibrated on labels outside each fold's fit.  Only document labels are learned from, yet the fitted
model gives sentence scores, which locate the offending sentences.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, held_out, labelled_sample, mapped, sigmoid, texts

BINS = 1 << 18
SAMPLE_ROWS = 8000  # labelled rows that the fit reads at most
BEGINNINGS = (3, 4, 5, 6, 7, 8)
WHOLE = 5  # longer words are known by their beginnings only, so that unseen inflected forms are known as well
DECAY = 1e-4  # pulls the weights of features without evidence to 0
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def word_features(word: str) -> tuple[int, ...]:
    """Hash bins of the word and of its beginnings, which stand for inflected forms."""
    parts = [f"={word}"] * (len(word) <= WHOLE) + [f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n]
    return tuple(zlib.crc32(p.encode()) % BINS for p in parts)


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each sentence that has a word."""
    found = ((m.start(), m.end(), WORD.findall(m[0].lower())) for m in SENTENCE.finditer(text))
    return [x for x in found if x[2]]


@dataclass
class NoisyOr:
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.words = WordCache(lambda w: float(self.weights[list(word_features(w))].sum()))

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "scale": self.scale, "shift": self.shift}

    def __setstate__(self, state):
        self.__init__(**state)

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        of, bias = self.words.__getitem__, self.bias
        parts = sentences(text)
        scores = sigmoid(np.array([bias + sum(map(of, set(w))) for _, _, w in parts])) if parts else []
        return [(s, e, float(p)) for (s, e, _), p in zip(parts, scores)]

    def document_score(self, scores: list[tuple[int, int, float]]) -> float:
        """The noisy-or of the sentences, calibrated; an empty text has no sentence and scores 0."""
        if not scores:
            return 0.0
        log_none = np.log1p(-np.minimum([p for *_, p in scores], 1 - 1e-12)).sum()
        return float(sigmoid(self.scale * odds(log_none) + self.shift))


def odds(log_none: float) -> float:
    """log(p / (1 - p)) of a noisy-or, from log(1 - p)."""
    return float(np.log(max(-np.expm1(log_none), 1e-12)) - log_none)


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit of labels on log odds, lightly damped towards scale 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * z + b)
        w = p * (1 - p) + 1e-6
        x = np.stack([z, np.ones_like(z)])
        h = (x * w) @ x.T + np.diag([0.05, 0.05])
        step = np.linalg.solve(h, x @ (p - y) + np.array([0.05 * (a - 1), 0.05 * b]))
        a, b = max(0.05, a - float(np.clip(step[0], -0.5, 0.5))), b - float(np.clip(step[1], -1, 1))
    return a, b


def fold_scores(bags: list[tuple[np.ndarray, np.ndarray, int]], f: int, folds: int) -> tuple[list[float], list[int]]:
    """Log odds and labels of every folds-th bag, from a model of the others."""
    part = train([b for i, b in enumerate(bags) if i % folds != f])
    z, y = [], []
    for idx, sizes, mark in bags[f::folds]:
        if len(sizes):
            s = sigmoid(part.bias + np.bincount(np.repeat(np.arange(len(sizes)), sizes), part.weights[idx], len(sizes)))
            z.append(odds(np.log1p(-np.minimum(s, 1 - 1e-12)).sum()))
            y.append(mark)
    return z, y


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.5, seed: int = 3) -> NoisyOr:
    """Adaptive stochastic gradient on the noisy-or likelihood of bags (bins, their number in each sentence, label).

    Weights stay at 0 or more, so that harmless words cannot outweigh an offence in the same sentence.  Without labels
    of both kinds nothing is toxic."""
    weights, grads = np.zeros(BINS, dtype=np.float64), np.full(BINS, 1e-3)
    bias, g_bias = -5.0, 1.0
    if len({y for *_, y in bags}) < 2:
        return NoisyOr(weights.astype(np.float32), -20.0)
    rng = np.random.default_rng(seed)
    flat = [bag for bag in bags if len(bag[1])]
    for _ in range(epochs):
        for i in rng.permutation(len(flat)):
            idx, sizes, y = flat[i]
            n = len(sizes)
            owner = np.repeat(np.arange(n), sizes)
            s = sigmoid(bias + np.bincount(owner, weights[idx], n))
            log_none = np.log1p(-np.minimum(s, 1 - 1e-9)).sum()
            none = np.exp(log_none)
            dz = s if y == 0 else -s * none / max(1 - none, 1e-6)
            total = dz.sum()
            if abs(total) < 1e-4:
                continue
            step = dz[owner]
            # each bin of a sentence gets the sentence's gradient; repeated bins of the bag add up
            bins, where = np.unique(idx, return_inverse=True)
            g = np.bincount(where, step) + DECAY
            grads[bins] += g * g
            weights[bins] = np.maximum(0, weights[bins] - rate * g / np.sqrt(grads[bins]))  # evidence only adds up
            g_bias += total * total
            bias -= 0.1 * total / np.sqrt(g_bias)
    return NoisyOr(weights.astype(np.float32), float(bias))


def bag_of(text: str, features=word_features) -> tuple[list[int], list[int]]:
    """The bins of all sentences, one after another, and how many each has."""
    parts = [[i for w in set(words) for i in features(w)] for _, _, words in sentences(text)]
    return [i for p in parts for i in p], [len(p) for p in parts]


FITTED = "fold int, bins array<int>, weights array<float>, bias double, z array<double>, y array<int>"
FITTED_ARROW = pa.schema([("fold", pa.int32()), ("bins", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32())), ("bias", pa.float64()), ("z", pa.list_(pa.float64())), ("y", pa.list_(pa.int32()))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = 3) -> NoisyOr:
    """Fits on at most `rows` labelled rows outside the held-out fold, and calibrates on the scores that each fold gets from
    a model of the others.

    The model and those of the folds are fitted by a task each, on a copy each of the bounded sample; the driver receives
    the weights that are not 0, and two numbers a sample row."""

    def bags(batch: pa.RecordBatch) -> dict:
        cache = WordCache(word_features)
        found = [bag_of(t, cache.__getitem__) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bins": [b for b, _ in found], "sizes": [s for _, s in found]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: defaultdict[int, list] = defaultdict(list)
        for batch in batches:
            bins, sizes = batch.column("bins"), batch.column("sizes")
            for i, (fold, doc_id, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("fold", "doc_id", "label")))):
                of[fold].append((doc_id, bins[i].values.to_numpy(), sizes[i].values.to_numpy(), label))
        for fold, found in of.items():
            ordered = [x[1:] for x in sorted(found, key=lambda x: (x[0], x[1].tobytes()))]
            model, (z, y) = (train(ordered), ([], [])) if fold == folds else (NoisyOr(np.zeros(0, np.float32), 0.0), fold_scores(ordered, fold, folds))
            used = np.flatnonzero(model.weights)
            yield pa.RecordBatch.from_pylist([{"fold": fold, "bins": used.tolist(), "weights": model.weights[used].tolist(), "bias": model.bias, "z": z, "y": y}], schema=FITTED_ARROW)

    sample = mapped(labelled_sample(docs, labels, "toxic", rows), bags, "doc_id long, label int, bins array<int>, sizes array<int>")
    copies = sample.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(folds + 1)])))
    fitted = {r.fold: r for r in copies.repartitionById(folds + 1, F.col("fold")).mapInArrow(run, FITTED).collect()}
    if not fitted:
        return train([])
    last = fitted.pop(folds)
    weights = np.zeros(BINS, dtype=np.float32)
    weights[last.bins] = last.weights
    model = NoisyOr(weights, last.bias)
    z, y = ([x for f in sorted(fitted) for x in fitted[f][name]] for name in ("z", "y"))
    if len(set(y)) == 2:
        model.scale, model.shift = calibrated(np.array(z), np.array(y, dtype=float))
    return model


def score(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, offending array<struct<start, end, score>> for each row's whole text.

    `offending` lists the sentences of a predicted document that score at least half of its highest.  A null or
    empty text scores 0.  Repeated rows score alike; a null doc_id goes through; an empty table gives an empty one."""

    def run(batch: pa.RecordBatch) -> dict:
        scores, where = [], []
        for t in texts(batch):
            parts = model.sentence_scores(t)
            p = model.document_score(parts)
            top = max((x[2] for x in parts), default=0.0)
            scores.append(p)
            where.append([{"start": s, "end": e, "score": q} for s, e, q in parts if q >= top / 2] if p >= threshold else [])
        return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": [int(p >= threshold) for p in scores], "offending": where}

    out = mapped(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int, offending array<struct<start: int, end: int, score: double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "offending")
