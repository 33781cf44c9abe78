"""Text quality by attention-based multiple-instance learning.

A document is a bag of passages of 100 words.  Each passage is encoded from its character make-up, its repetition
and its hashed character pairs; gated attention, learned from document labels, weighs the passages, and the
weighted sum of their representations is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, mapped, sigmoid, texts, through

PASSAGE_WORDS = 100
SAMPLE_ROWS = 6000  # labelled rows that the fit reads at most
PAIR_BINS = 64
CLASSES = 10
HIDDEN = 24
ATTENTION = 12


def _classes() -> np.ndarray:
    """The class of each byte: lower, upper, digit, space, newline, sentence end, inner mark, sign, control, beyond ASCII."""
    out = np.full(256, 7, dtype=np.uint8)
    out[128:] = 9
    out[:32] = 8
    for k, group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".!?", b",;:'\"()-")):
        out[list(group)] = k
    return out


CLASS_OF = _classes()
FEATURES = CLASSES + 8 + PAIR_BINS


def passage_features(words: list[bytes]) -> np.ndarray:
    joined = b" ".join(words)
    raw = np.frombuffer(joined, dtype=np.uint8)
    n, size = len(words), max(len(joined), 1)
    kinds = CLASS_OF[raw]
    counts = np.bincount(kinds, minlength=CLASSES) / size
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    marks = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n
    alone = sum(len(w) == 1 and w[0] < 128 and not w.isalnum() for w in words) / n
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    extra = (np.log(n + 1) / 5, len(set(words)) / n, same, lengths.mean() / 10, lengths.std() / 10, marks, alone, float(np.count_nonzero(kinds[1:] != kinds[:-1])) / size)
    low = raw | 32
    pairs = (low[:-1].astype(np.int64) * 31 + low[1:]) % PAIR_BINS
    return np.concatenate([counts * 3, extra, np.sqrt(np.bincount(pairs, minlength=PAIR_BINS) / size) * 2])


def bag_of(text: str) -> np.ndarray:
    """Features of each passage; a text without words is one passage of zeros."""
    words = text.encode().split()
    if not words:
        return np.zeros((1, FEATURES))
    return np.stack([passage_features(words[i : i + PASSAGE_WORDS]) for i in range(0, len(words), PASSAGE_WORDS)])


@dataclass
class GatedAttention:
    """h = tanh(xA + a); weight = softmax(w . (tanh(hV) * sigmoid(hU))); score = sigmoid(c . sum(weight * h) + d)."""

    p: dict

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict:
        p = self.p
        x = (x - p["mean"]) / p["std"]
        h = np.tanh(x @ p["A"] + p["a"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(weight[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "sizes": sizes, "score": sigmoid(z @ p["c"] + p["d"])}

    def scores(self, bags: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The score of each bag and the attention over its passages."""
        starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
        out = self.forward(np.concatenate(bags), starts)
        return out["score"], np.split(out["weight"], starts[1:])


def train(bags: list[np.ndarray], labels: list[int], epochs: int = 25, batch: int = 64, seed: int = 7) -> GatedAttention:
    """Adam on the log loss.  With one label only, or none, every document gets the share of label 1 (1/2 if none)."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    p = {"mean": every.mean(0), "std": every.std(0) + 1e-2, "A": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "a": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    model = GatedAttention(p)
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        p["c"], p["d"] = np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])
        return model
    learned = [k for k in p if k not in ("mean", "std")]
    m, v = {k: np.zeros_like(p[k]) for k in learned}, {k: np.zeros_like(p[k]) for k in learned}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            starts = np.cumsum([0] + [len(bags[i]) for i in pick[:-1]])
            f = model.forward(np.concatenate([bags[i] for i in pick]), starts)
            error = (f["score"] - y[pick]) / len(pick)
            dz = np.repeat(error[:, None] * p["c"], f["sizes"], axis=0)
            dweight = (dz * f["h"]).sum(1)
            mean = np.repeat(np.add.reduceat(f["weight"] * dweight, starts), f["sizes"])
            de = f["weight"] * (dweight - mean)
            dtg = de[:, None] * p["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (dz * f["weight"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grads = {"A": f["x"].T @ dh + 1e-5 * p["A"], "a": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ error, "d": np.array([error.sum()])}
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for k in learned:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.99 * v[k] + 0.01 * grads[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> GatedAttention:
    """Fits on at most `rows` labelled rows outside the held-out fold; the driver receives their passage features."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "bag": [bag_of(t).astype(np.float32).ravel() for t in texts(batch)]}

    sample = mapped(labelled_sample(docs, labels, "quality", rows), run, "doc_id long, label int, bag array<float>").toArrow()
    order = np.argsort(sample.column("doc_id").to_numpy(), kind="stable")
    bags, marks = sample.column("bag"), sample.column("label").to_pylist()
    return train([np.asarray(bags[int(i)].values.to_numpy(), dtype=np.float64).reshape(-1, FEATURES) for i in order], [marks[i] for i in order])


def score(docs: DataFrame, model: GatedAttention, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, passage (the passage that weighs most) for each row's whole text.

    A null or empty text is one passage of zeros and gets that passage's score.  Repeated rows score alike; a null
    doc_id goes through; an empty table gives an empty one."""

    def run(batch: pa.RecordBatch) -> dict:
        found, weights = model.scores([bag_of(t) for t in texts(batch)])
        return {"doc_id": batch.column("doc_id"), "score": found, "predicted": (found >= threshold).astype(np.int32), "passage": [int(w.argmax()) for w in weights]}

    out = mapped(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int, passage int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passage")


def accepted(docs: DataFrame, model: GatedAttention, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold.

    A null or empty text scores as one passage of zeros; repeated rows fare alike; a null doc_id plays no part; an empty
    table gives an empty one; columns of any name go through."""

    def change(piece: pa.RecordBatch, at) -> pa.RecordBatch:
        keep, _ = model.scores([bag_of(t or "") for t in piece.column(at("text")).to_pylist()])
        return piece.filter(pa.array(keep >= threshold))

    return through(docs, change)
