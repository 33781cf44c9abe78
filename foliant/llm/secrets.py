"""Secret scanning: base patterns, plus a character convolutional network over wider candidates.

The network reads every candidate with its surrounding context.  It is trained on labelled findings
(context before, candidate, context after, kind, label); its scores are calibrated by a logistic fit on
findings held back from training, and each kind's threshold keeps the wanted recall there, with a margin for chance.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, sigmoid, texts, through

# The base kinds, in their order of listing, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the length may stand in the pattern
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")

CONTEXT = 24
WIDTH = 5
FILTERS = 16
BLOCK = 8192


def base_spans(text: str, long_runs: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, sorted by start, then by kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if long_runs:
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def codes(text: str) -> np.ndarray:
    """0 outside the text, 1..95 printable ASCII, 96 white space, 97 any other letter, 98 the rest."""
    out = np.fromiter(map(ord, text), dtype=np.int64, count=len(text))
    small = np.where((out >= 32) & (out < 127), out - 31, np.where(out < 32, 96, np.where(out >= 192, 97, 98)))
    return small


def coded(before: str, candidate: str, after: str) -> np.ndarray:
    """The characters of the window; those of the candidate are told apart by an offset."""
    pad = np.zeros(WIDTH - 1, dtype=np.int64)
    return np.concatenate([pad, codes(before), codes(candidate) + 99, codes(after), pad])


@dataclass
class CharCnn:
    """One-hot characters, one convolution, ReLU, maximum over all positions, a logistic output per kind bias."""

    table: np.ndarray  # WIDTH x 198 x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict | None = None

    def peaks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of each filter and where it is; long windows go block by block, so none is cut."""
        best = np.full(FILTERS, -np.inf)
        at = np.zeros(FILTERS, dtype=np.int64)
        n = len(x) - WIDTH + 1
        for s in range(0, n, BLOCK):
            e = min(n, s + BLOCK)
            a = self.bias + sum(self.table[k][x[s + k : e + k]] for k in range(WIDTH))
            j = a.argmax(0)
            m = a[j, np.arange(FILTERS)]
            at = np.where(m > best, s + j, at)
            best = np.maximum(best, m)
        return best, at

    def logit(self, x: np.ndarray) -> float:
        best, _ = self.peaks(x)
        return float(np.maximum(best, 0) @ self.out + self.out_bias)

    def score(self, before: str, candidate: str, after: str) -> float:
        """Calibrated probability that the candidate is a secret."""
        return float(sigmoid(self.scale * self.logit(coded(before, candidate, after)) + self.shift))


def train(findings: list[tuple[str, str, str, str, int]], recall: float = 0.98, epochs: int = 6, seed: int = 5) -> CharCnn:
    """Fits the network on (before, candidate, after, kind, label); every fifth finding only calibrates.

    Without findings of both labels the result scores everything 0 and has thresholds that nothing reaches."""
    rng = np.random.default_rng(seed)
    net = CharCnn(rng.normal(0, 0.12, (WIDTH, 198, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS), 0.0, thresholds={})
    data = [(coded(b, c, a), kind, y) for b, c, a, kind, y in findings]
    fit, held = [d for i, d in enumerate(data) if i % 5], data[::5]
    if len({y for *_, y in fit}) < 2 or len({y for *_, y in held}) < 2:
        net.shift, net.scale = -35.0, 0.0
        return net
    g_table, g_out, g_bias = np.full(net.table.shape, 1e-3), np.full(FILTERS, 1e-3), 1e-3
    rows = np.arange(FILTERS)
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            x, _, y = fit[i]
            best, at = net.peaks(x)
            hidden = np.maximum(best, 0)
            error = float(sigmoid(hidden @ net.out + net.out_bias)) - y
            if abs(error) < 1e-3:
                continue
            back = error * net.out * (best > 0)
            step = error * hidden
            g_out += step**2
            net.out -= 0.1 * step / np.sqrt(g_out)
            g_bias += error**2
            net.out_bias -= 0.1 * error / np.sqrt(g_bias)
            for k in range(WIDTH):
                c = x[at + k]
                g_table[k, c, rows] += back**2
                net.table[k, c, rows] -= 0.1 * back / np.sqrt(g_table[k, c, rows])
    z = np.array([net.logit(x) for x, *_ in held])
    y = np.array([t for *_, t in held], dtype=float)
    a, b = 1.0, 0.0
    for _ in range(200):  # calibration: logistic regression of the label on the logit, slightly damped
        p = sigmoid(a * z + b)
        a -= 0.5 * (((p - y) * z).mean() / (1 + (z**2).mean()) + 1e-3 * (a - 1))
        b -= 0.5 * (p - y).mean()
    net.scale, net.shift = a, b
    p = sigmoid(a * z + b)
    for kind in {k for _, k, _ in held}:
        own = np.sort(p[[k == kind and t == 1 for _, k, t in held]])
        other = p[[k == kind and t == 0 for _, k, t in held]]
        lost = (1 - recall) * len(own)  # findings that may fall below, less what chance may add
        most = float(own[max(0, int(lost - 1.645 * lost**0.5))]) if len(own) else 1.1
        # any threshold up to `most` keeps the recall: halfway down to the look-alikes, if these lie lower
        net.thresholds[kind] = (most + min(most, float(other.max(initial=0.0)))) / 2
    return net


def kind_of(candidate: str) -> str:
    """The shape of a candidate; each has a threshold of its own."""
    if re.fullmatch(r"[0-9a-f-]+", candidate):
        return "lowhex"
    if re.fullmatch(r"[A-Z0-9]+", candidate):
        return "upper"
    return "mixed"


def findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings made by rule: secrets after key-like words, look-alikes in ordinary surroundings."""
    rng = np.random.default_rng(seed)
    sets = {"hex": "0123456789abcdef", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "low": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789"}

    def draw(name: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(sets[name]), int(rng.integers(low, high + 1))))

    def words(k: int) -> str:
        return " ".join(draw("low", 2, 9) for _ in range(k))

    keys = ("password", "passwd", "secret", "token", "api_key", "apikey", "auth", "bearer", "access_key", "client_secret", "private_key", "credential")
    out = []
    for i in range(n):
        before, after = words(4) + " ", " " + words(4)
        if i % 2:
            joint = ("=", " = ", ": ", ' = "', ":", '="', " ")[int(rng.integers(7))]
            key = keys[int(rng.integers(len(keys)))]
            body = [draw("hex", 16, 48), draw("b64", 16, 44), draw("upper", 16, 24), "AKIA" + draw("upper", 16, 16)][int(rng.integers(4))]
            before = before + key + joint if i % 4 == 1 or not body.startswith("AKIA") else before
        else:
            stem = [lambda: draw("low", 16, 30), lambda: "-".join(draw("hex", k, k) for k in (8, 4, 4, 4, 12)), lambda: "/".join(draw("low", 3, 9) for _ in range(5)), lambda: draw("digit", 16, 24), lambda: ".".join(draw("low", 3, 8) for _ in range(3)) + "." + draw("digit", 4, 4), lambda: "_".join(draw("low", 3, 8) for _ in range(4)), lambda: "=" * int(rng.integers(16, 40)), lambda: "v" + ".".join(draw("digit", 1, 3) for _ in range(4)) + "-" + draw("low", 5, 8)]
            body = stem[int(rng.integers(len(stem)))]()
            if rng.random() < 0.3:
                before += ("id=", "build: ", "page ", "path = ", "uuid ")[int(rng.integers(5))]
        out.append((before[-CONTEXT:], body, after[:CONTEXT], kind_of(body), i % 2))
    return out


def scan_text(text: str, net: CharCnn) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], float]:
    """Base spans, all spans (with the network's own findings), and the highest score of any candidate."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    base = base_spans(text, any(e - s >= 32 for s, e in runs))
    every, top = list(base), 0.0
    for s, e in runs:
        body = text[s:e]
        kind = kind_of(body)
        score = net.score(text[max(0, s - CONTEXT) : s], body, text[e : e + CONTEXT])
        top = max(top, score)
        if score >= net.thresholds.get(kind, 1.1) and not any(a < e and s < b for a, b, _ in base):
            every.append((s, e, "network"))
    order = {k: i for i, k in enumerate((*KINDS, "network"))}
    return base, sorted(every, key=lambda x: (x[0], order[x[2]])), top


def said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, net: CharCnn) -> DataFrame:
    """doc_id, base array<struct>, spans array<struct>, top_score: findings in each row's whole text.

    A null or empty text has none.  Rows are independent: repeats and a null doc_id go through as they are, and
    an empty table gives an empty one.  The network is a few thousand numbers, whatever the corpus."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [scan_text(t, net) for t in texts(batch)]
        as_rows = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        return {"doc_id": batch.column("doc_id"), "base": [as_rows(f[0]) for f in found], "spans": [as_rows(f[1]) for f in found], "top_score": [f[2] for f in found]}

    span = "array<struct<start: int, end: int, kind: string>>"
    return mapped(docs.select("doc_id", "text"), run, f"doc_id long, base {span}, spans {span}, top_score double")


def digest(docs: DataFrame, net: CharCnn) -> DataFrame:
    """The counts, digest and joined spans of scan(), built where the findings are."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [scan_text(t, net) for t in texts(batch)]
        counts = {f"n_{k}": [sum(x[2] == k for x in f[0]) for f in found] for k in KINDS}
        return {"doc_id": batch.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(said(f[0]).encode()).hexdigest() for f in found], "spans": [said(f[1]) for f in found], "top_score": [f[2] for f in found]}

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, top_score double")


def redacted(text: str, net: CharCnn, mark: str = "[secret]") -> str:
    """The text with every finding replaced; overlapping findings are one."""
    _, spans, _ = scan_text(text, net)
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: CharCnn) -> DataFrame:
    """The rows and columns of docs, with the findings in `text` replaced; `n_chars` follows if it is there.

    A null text stays null; rows without a finding are untouched, as are all other columns, whatever their names; an empty
    table gives an empty one."""

    def change(piece: pa.RecordBatch, at) -> pa.RecordBatch:
        columns, i, j = list(piece.columns), at("text"), at("n_chars")
        old = columns[i].to_pylist()
        new = [t and redacted(t, net) for t in old]
        columns[i] = pa.array(new, type=columns[i].type)
        if j >= 0:
            was = columns[j].to_pylist()
            columns[j] = pa.array([w if a == b else len(b) for w, a, b in zip(was, old, new)], type=columns[j].type)
        return pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    return through(docs, change)
