"""Improbable-feature digests of documents.

Every window of 16 bytes is ranked by how rare its entropy is; windows that are the rarest of their surroundings
often enough are the document's features.  They go, hashed, into a chain of Bloom filters, and two digests are
compared by the overlap of their filters' bits, normalised against the overlap that chance gives.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64

WINDOW = 16
SURROUNDINGS = 32  # consecutive windows among which the rarest is looked for
POPULAR = 8  # times that a window must be the rarest
FILTER_BITS = 2048
PER_FILTER = 160
PROBES = 5
CUTOFF = 0.3  # share of the way from chance to full overlap that still counts as nothing
SCALE = 1 << 16
CHUNK = 1 << 18
BLOCK = 4096  # windows that are hashed at once

_COUNTS = np.arange(WINDOW + 1)
#: n log2 n as integers, so that a window's entropy is the same wherever it stands.
_NLOGN = np.rint(SCALE * _COUNTS * np.log2(np.maximum(_COUNTS, 1))).astype(np.int64)
_STEP = np.diff(_NLOGN)
#: Typical sum of n log2 n in running text: an entropy of about 3.2 bits in a window of 16.
TYPICAL = int(SCALE * WINDOW * (np.log2(WINDOW) - 3.2))
_POWERS = np.array([pow(0x100000001B3, WINDOW - 1 - i, 1 << 64) for i in range(WINDOW)], dtype=np.uint64)
_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint16)


def rarity(raw: np.ndarray) -> np.ndarray:
    """For each window, how far its entropy lies from the typical one (0 to 1000)."""
    n = len(raw)
    before, after = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for lag in range(1, WINDOW):
        same = (raw[lag:] == raw[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    # the sum over the first window, then what each step adds and takes away
    first = _NLOGN[np.bincount(raw[:WINDOW], minlength=256)].sum()
    # entering byte i meets its equals among the WINDOW-1 bytes before it; leaving byte i-WINDOW those after it
    change = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    sums = np.empty(n - WINDOW + 1, dtype=np.int64)
    sums[0] = first
    np.cumsum(change, out=sums[1:])
    sums[1:] += first
    return np.minimum(np.abs(sums - TYPICAL) // (SCALE * WINDOW // 256), 1000)


def rules(windows: int) -> tuple[int, int]:
    """How many consecutive windows compete, and how many times one must be the rarest of them.

    Texts of fewer than 8 * SURROUNDINGS windows keep more of their windows, among them those that long ones would."""
    span = min(SURROUNDINGS, max(1, windows // 8))
    return span, max(1, POPULAR * span // SURROUNDINGS)


def rarest(rare: np.ndarray, span: int, at: int = 0) -> np.ndarray:
    """For each `span` consecutive windows the key of the rarest (first, if equal): (1000 - rarity) << 40, plus its place from `at`."""
    low, reach = ((1000 - rare) << 40) + np.arange(at, at + len(rare)), 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    return low


def places(raw: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places of popular windows: the rarest of enough surroundings in a row.

    Long texts go chunk by chunk, to bound memory; a run that reaches a chunk's end is carried into the next, so that the
    places are those of the text as one piece."""
    windows = len(raw) - WINDOW + 1
    span, need = rules(windows)
    found, last, length = [], np.int64(-1), 0
    for at in range(0, windows - span + 1, chunk):
        low = rarest(rarity(raw[at : at + chunk + span + WINDOW - 2]), span, at)
        edges = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        keys, runs = low[edges], np.diff(np.append(edges, len(low)))
        if keys[0] == last:
            runs[0] += length
        elif length:
            keys, runs = np.concatenate(([last], keys)), np.concatenate(([length], runs))
        last, length = keys[-1], int(runs[-1])
        found.append(keys[:-1][runs[:-1] >= need])
    found.append(np.array([last])[: length >= need])
    return np.concatenate(found) & ((1 << 40) - 1)


def features(raw: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """64-bit hashes of the selected windows, in order of their first place, each once; a text shorter than a window is one feature, an empty none."""
    if len(raw) == 0:
        return np.zeros(0, dtype=np.uint64)
    if len(raw) < WINDOW:
        return np.array([int.from_bytes(hashlib.sha256(raw.tobytes()).digest()[:8], "little")], dtype=np.uint64)
    windows, chosen = np.lib.stride_tricks.sliding_window_view(raw, WINDOW), places(raw, chunk)
    parts = [mix64((windows[chosen[i : i + BLOCK]].astype(np.uint64) * _POWERS).sum(1, dtype=np.uint64)) for i in range(0, len(chosen), BLOCK)]
    joined = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return joined[np.sort(np.unique(joined, return_index=True)[1])]


def filters(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chain: packed bits (filters x bytes) and the number of features in each."""
    n = max(1, -(-len(hashes) // PER_FILTER))
    bits = np.zeros((n, FILTER_BITS), dtype=bool)
    which = np.arange(len(hashes)) // PER_FILTER
    for k in range(PROBES):
        bits[which, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
    return np.packbits(bits, axis=1), np.bincount(which, minlength=n)


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    return filters(features(np.frombuffer(text.encode(), dtype=np.uint8)))


def as_string(chain: tuple[np.ndarray, np.ndarray]) -> str:
    """Counts, then the filters in base64."""
    packed, counts = chain
    return ".".join(map(str, counts.tolist())) + ":" + base64.b64encode(packed.tobytes()).decode()


def from_string(s: str) -> tuple[np.ndarray, np.ndarray]:
    counts, _, body = s.partition(":")
    return np.frombuffer(base64.b64decode(body), dtype=np.uint8).reshape(-1, FILTER_BITS // 8), np.array(list(map(int, counts.split("."))))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: each filter of the shorter chain against its best match in the other, weighed by its features.

    Two digests without features are alike (1) only with one another.  Equal digests score 1."""
    (pa_, ca), (pb, cb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if ca.sum() == 0 or cb.sum() == 0:
        return float(ca.sum() == cb.sum())
    if pa_.shape == pb.shape and np.array_equal(pa_, pb):
        return 1.0
    ones_a, ones_b = _BITS[pa_].sum(1), _BITS[pb].sum(1).astype(np.float64)
    total = 0.0
    for f in range(len(pa_)):
        overlap = _BITS[pb & pa_[f]].sum(1).astype(np.float64)
        most = np.minimum(ones_b, ones_a[f])
        chance = ones_b * ones_a[f] / FILTER_BITS
        floor = chance + CUTOFF * (most - chance)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(most > floor, (overlap - floor) / (most - floor), 0.0)
        total += ca[f] * float(np.clip(score, 0, 1).max())
    return min(1.0, total / float(ca.sum()))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """docs dealt into id ranges, sorted within a task, each range followed by a copy of the next range's first rows.

    Adds _bucket and _copy.  Range bounds come from approximate quantiles of the id; the copies are the rows with the
    smallest id of each non-empty bucket, found from ids alone, so what is broadcast is one row a bucket at most."""
    bounds = docs.where("doc_id is not null").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.25 / buckets) if buckets > 1 else []
    at = F.array(*[F.lit(b).cast("long") for b in sorted({int(b) for b in bounds})]).cast("array<long>")
    bucket = F.size(F.filter(at, lambda b: b <= F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))  # bounds at or below the id
    placed = docs.select("doc_id", "text", bucket.alias("_bucket"))
    firsts = placed.groupBy("_bucket").agg(F.min("doc_id").alias("_first"), F.max(F.col("doc_id").isNull()).alias("_null"))
    w = Window.orderBy("_bucket")  # one row a bucket
    ring = firsts.withColumn("_before", F.coalesce(F.lag("_bucket").over(w), F.max("_bucket").over(Window.partitionBy())))
    copies = placed.join(F.broadcast(ring), "_bucket").where("doc_id <=> if(_null, cast(null as bigint), _first)").select("doc_id", "text", F.col("_before").alias("_bucket"), F.lit(1).alias("_copy"))
    both = placed.withColumn("_copy", F.lit(0)).unionByName(copies)
    return both.withColumn("_tie", F.xxhash64("text")).repartitionById(buckets, F.col("_bucket")).sortWithinPartitions("_bucket", "_copy", F.col("doc_id").asc_nulls_first(), "_tie", "text")


def compare_neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likenesses, as contract op4 names them.

    The next document is the next row by (doc_id, hash of the text, text), nulls first; the last is followed by the first; a
    lone row follows itself.  A null text counts as empty.  An empty table gives an empty one.  Only doc_id and text are read,
    so other columns may have any name.  All rows of one doc_id are one task's."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    target = pa.schema(list(zip(names, kinds)))

    def run(batches):
        held, out = None, []  # the row before, which waits for its next
        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for doc_id, text, bucket, copy in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "_bucket", "_copy"))):
                    text = text or ""
                    row = (doc_id, text, fingerprint(text), bucket, copy)
                    if held is not None and held[3] == bucket and not held[4]:
                        _, was, print_, *_ = held
                        new = edited(was, text)
                        other = fingerprint(new)
                        out.append((held[0], len(was), hashlib.sha256(new.encode()).hexdigest(), as_string(print_), as_string(other), likeness(print_, other), likeness(print_, row[2])))
                    held = row
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], schema=target)
                    out = []

    return in_order(docs, buckets).mapInArrow(run, schema)
