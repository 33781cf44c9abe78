"""Long word passages that repeat are removed from all places but the first: a De Bruijn graph, compacted by joins.

An edge of the graph is a window of 20 words, from the node of its first 19 words to that of its last 19.  Every document is
a walk.  An edge's anchor is the smallest hash among the runs of 5 words in it; edges that follow one another and have one
anchor occurrence are written as one row, a path.  Where an anchor has one path in the whole corpus, that path cannot branch
and stands for all its edges.  Where it has several, the first occurrence of each is opened into its edges again.  So joins
see about one row for eight or nine words, and edges only where walks part.

Equal windows have equal anchors at equal places, so none is missed; what hashes say is verified on the words at the source
coordinates by a second, independent hash of both spans, before a word goes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, mapped, mix64, scratch, texts, written

WINDOW, ANCHOR = 20, 5
PIECE = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a list for about each PIECE bytes of it, so that a very long text is never held as words at once."""
    raw = text.encode()
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and raw[end] not in SPACES:
            end += 1
        yield raw[at:end].split()  # splits at the six characters of SPACES
        at = end


@lru_cache(maxsize=1)
def digests() -> WordCache:
    """One cache a Python worker."""
    return WordCache(xxhash.xxh3_128_digest)


def hashed(batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of all words, and where each text begins (with the end as last)."""
    get, parts, sizes = digests().__getitem__, [], []
    for text in batch_texts:
        got = [b"".join(map(get, words)) for words in pieces(text)]
        sizes.append(sum(map(len, got)) // 16)
        parts += got
    both = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class Spans:
    """Hashes of word spans, each from two values of a running polynomial modulo 2^64."""

    #: An odd multiplier and its inverse modulo 2^64.
    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)
    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        if len(Spans.powers) <= len(values):
            for name, base in (("powers", self.BASE), ("inverses", self.INVERSE)):
                steps = np.full(2 * len(values) + 1, base, np.uint64)
                steps[0] = 1
                setattr(Spans, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * Spans.powers[: len(values)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * Spans.inverses[start])


def anchored(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The paths of a batch: text, start (in all words), number of windows, anchor hash, hash of the whole path."""
    spans, n = Spans(values), len(values)
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    at = np.arange(n - ANCHOR + 1)
    small = spans.of(at, at + ANCHOR)
    best, width = at, 1
    while width < WINDOW - ANCHOR + 1:  # the leftmost smallest of 2, 4, 8, 16 in a row
        step = min(width, WINDOW - ANCHOR + 1 - width)
        left, right = best[:-step], best[step:]
        best = np.where(small[right] < small[left], right, left)
        width += step
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(at[: len(best)] + WINDOW <= bounds[text[: len(best)] + 1])
    anchor = best[inside]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(anchor)))
    start = inside[first]
    return text[start], start, count, small[anchor[first]], spans.of(start, start + count + WINDOW - 1)


def find_paths(docs: DataFrame) -> DataFrame:
    """doc_id, start (a word's place), n (windows), anchor, path (hash): every window of every text is in one row."""

    def run(batch: pa.RecordBatch) -> dict:
        values, _, bounds = hashed(texts(batch))
        text, start, n, anchor, path = anchored(values, bounds)
        ids = batch.column("doc_id").take(pa.array(text))
        return {"doc_id": ids, "start": start - bounds[text], "n": n.astype(np.int32), "anchor": anchor.view(np.int64), "path": path.view(np.int64)}

    return mapped(docs.select("doc_id", "text").where("doc_id is not null"), run, "doc_id long, start long, n int, anchor long, path long")


def listed(batch: pa.RecordBatch, name: str, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of arrays of structs: each item's row, and the fields as arrays."""
    lists = batch.column(name)
    items = lists.flatten()
    rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return rows, [items.field(f).to_numpy(zero_copy_only=False) for f in fields]


def read_sources(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each path of `wanted` (doc_id, start, n, anchor, path, opened), read in its source: a second hash of its words, and,
    where it is opened, two hashes of each window.  Where several rows have the doc_id, only one with that path answers."""
    asks = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "anchor", "path", "opened")).alias("asks"))

    def run(batch: pa.RecordBatch) -> dict:
        values, others, bounds = hashed(texts(batch))
        row, (start, n, anchor, path, opened) = listed(batch, "asks", ("start", "n", "anchor", "path", "opened"))
        begin = bounds[row] + start
        end = begin + n + WINDOW - 1
        fits = np.flatnonzero(end <= bounds[row + 1])
        spans, second = Spans(values), Spans(others)
        fits = fits[spans.of(begin[fits], end[fits]).view(np.int64) == path[fits]]
        row, start, n, anchor, path, opened, begin, end = (x[fits] for x in (row, start, n, anchor, path, opened, begin, end))
        many = np.where(opened, n, 0)
        limits = np.concatenate([[0], np.cumsum(many)])
        each = np.repeat(begin, many) + np.arange(limits[-1]) - np.repeat(limits[:-1], many)
        windows, checks = (s.of(each, each + WINDOW).view(np.int64) for s in (spans, second))
        as_lists = lambda x: pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(x))
        return {"doc_id": batch.column("doc_id").take(pa.array(row)), "start": start, "anchor": anchor, "path": path, "check": second.of(begin, end).view(np.int64), "windows": as_lists(windows), "checks": as_lists(checks)}

    return mapped(docs.select("doc_id", "text").join(asks, "doc_id"), run, "doc_id long, start long, anchor long, path long, check long, windows array<long>, checks array<long>")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, start, n (windows), check, src_doc, src_start: the paths and single windows whose words also start at the source
    coordinates, the earliest place there is.  `check` is the second hash of the words there."""
    spark = docs.sparkSession
    with scratch(spark):  # an anchor that occurs once is in no repeated window; one with several paths may branch
        paths = written(find_paths(docs), "paths")
        anchors = written(paths.groupBy("anchor").agg(F.count("*").alias("times"), F.min("path").alias("lo"), F.max("path").alias("hi")).where("times > 1").select("anchor", F.expr("lo < hi").alias("opened")), "anchors")
        paths = written(paths.join(anchors, "anchor"), "shared-paths", keep=True)
    with scratch(spark):
        place = F.struct("doc_id", "start")
        firsts = paths.groupBy("anchor", "path").agg(F.min(place).alias("at"), F.first("n").alias("n"), F.first("opened").alias("opened"), F.count("*").alias("copies"))
        wanted = written(firsts.where("opened or copies > 1").select("at.*", "n", "anchor", "path", "opened"), "wanted-paths")
        sources = written(read_sources(docs, wanted).dropDuplicates(["anchor", "path"]), "sources", keep=True)
    known = sources.select("anchor", "path", "check", F.col("doc_id").alias("src_doc"), F.col("start").alias("src_start"))
    columns = ("doc_id", "start", "n", "check", "src_doc", "src_start")
    whole = paths.select("anchor", "path", "doc_id", "start", "n").join(known, ["anchor", "path"])
    with scratch(spark):
        opened = sources.where("size(windows) > 0").select("doc_id", "start", "anchor", F.posexplode(F.arrays_zip("windows", "checks")).alias("nth", "w"))
        edges = opened.select("doc_id", (F.col("start") + F.col("nth")).alias("start"), F.lit(1).alias("n"), "anchor", F.col("w.windows").alias("window"), F.col("w.checks").alias("check"))
        first_edges = edges.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "start", "check")).alias("src"), F.count("*").alias("times")).where("times > 1")
        first_edges = written(first_edges.select("anchor", "window", "src.check", F.col("src.doc_id").alias("src_doc"), F.col("src.start").alias("src_start")), "first-edges", keep=True)
    single = edges.drop("check").join(first_edges, ["anchor", "window"])
    later = "doc_id > src_doc or doc_id = src_doc and start > src_start"
    return whole.select(*columns).unionByName(single.select(*columns)).where(later)


def kept_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    A word goes if a window of 20 words that covers it also starts earlier: in a smaller doc_id, or before in the document.
    A null or empty text has no words.  Rows of one doc_id are judged by (doc_id, start) alone, so equal rows fare alike and
    are not copies of one another.  Rows without a doc_id are left as they are and are nobody's source.  An empty table
    gives an empty one; other columns are not read."""
    with scratch(docs.sparkSession):
        gone = written(repeated(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "check")).alias("gone")), "gone", keep=True)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
        row, (start, n, check) = listed(batch, "gone", ("start", "n", "check"))
        limits = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for i, text in enumerate(texts(batch)):
            lo, hi = limits[i], limits[i + 1]
            keep = covered(text, start[lo:hi], n[lo:hi], check[lo:hi]) if hi > lo else None
            digest, at, glue, removed = hashlib.sha256(), 0, b"", 0
            for words in pieces(text):
                stay = words if keep is None else list(compress(words, keep[at : at + len(words)]))
                at += len(words)
                removed += len(words) - len(stay)
                if stay:
                    digest.update(glue + b" ".join(stay))
                    glue = b" "
            for name, value in zip(out, (at, removed, digest.hexdigest())):
                out[name].append(value)
        return {"doc_id": batch.column("doc_id"), **out}

    joined = docs.select("doc_id", "text").join(gone, "doc_id", "left")
    return mapped(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def covered(text: str, start: np.ndarray, n: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which words of a text stay: those outside the spans whose second hash is that of their source."""
    _, values, _ = hashed([text])
    end = start + n + WINDOW - 1
    fits = np.flatnonzero(end <= len(values))
    fits = fits[Spans(values).of(start[fits], end[fits]).view(np.int64) == check[fits]]
    depth = np.zeros(len(values) + 1, np.int64)
    np.add.at(depth, start[fits], 1)
    np.add.at(depth, end[fits], -1)
    return np.cumsum(depth[:-1]) == 0
