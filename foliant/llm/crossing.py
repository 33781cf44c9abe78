"""Two tokenizers' tokens aligned by bytes, over the distinct segments of the corpus.

Texts are cut before runs of white space, but only at characters that no token of either vocabulary holds behind a solid one,
so no token can lie across a cut and segments tokenise as they do in their text.  A block of documents becomes codes into a
dictionary of its own segments.  The rows of all dictionaries meet by segment, where each distinct one is tokenised and aligned
once; its groups go back to the rows' blocks, and documents are composed block by block.  Counts of linked ids are summed over blocks, and joined back to the
pairs of each block.  Blocks are bounded by characters; a longer document is a block of its own."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import mapped, scratch, sliced, small_batches, texts, written

BLOCK_CHARS = 32 << 20
PIECE_CHARS = 1 << 20
ROWS = 50_000
#: White space in any of the libraries' senses, and B's sign for a space: nothing is cut behind one of these.
SPACE = r"\s\x1c-\x1f\x85\u180e\u200b\ufeff\u2581"
CUTS = " \t\n\x0b\x0c\r"


class Codec:
    """Both tokenizers, the bytes of their tokens, and where texts may be cut."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(byte_of.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(size)]
        with open(b_path, "rb") as f:
            model = f.read()
        # a later field of a message wins: normalizer_spec.add_dummy_prefix = false, as segments bring their space along
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = [len(t) for t in self.a_bytes], [len(t) for t in self.b_bytes]
        self.cuts = "".join(c for c in CUTS if not self._inside(c))
        if not self.cuts:
            raise ValueError("these vocabularies hold tokens across every kind of white space")
        stop = f"(?![{self.cuts}])"
        self.find = re.compile(f"[{SPACE}]*[^{SPACE}]+(?:{stop}[{SPACE}]+[^{SPACE}]*)*|[{SPACE}]+").findall
        self.next_cut = re.compile(f"(?<=[^{SPACE}])(?=[{self.cuts}])").search

    def _inside(self, cut: str) -> bool:
        """Whether a token of either vocabulary has this character right behind one that is not white space."""
        behind = re.compile(f"[^{SPACE}]{re.escape(cut)}")
        return any(behind.search(t.decode("utf-8", "surrogateescape")) for t in (*self.a_bytes, *self.b_bytes))

    def segments(self, text: str) -> Iterator[list[str]]:
        """The segments of space+text, a list for about each PIECE_CHARS of it; a text without characters has none."""
        at, text = 0, " " + text if text else ""
        while at < len(text):
            cut = self.next_cut(text, at + PIECE_CHARS) if at + PIECE_CHARS < len(text) else None
            end = cut.start() if cut else len(text)
            yield self.find(text[at:end] if at or cut else text)
            at = end

    def aligned(self, segments: list[str]) -> list[str]:
        """For each segment its groups as text, '' if the tokens' bytes are not those of the segment."""
        a_ids = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b_ids = self.b.encode(segments, num_threads=1)
        out = []
        for text, a, b in zip(segments, a_ids, b_ids):
            raw = text.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
            out.append(aligned_groups(a, b, self.a_len, self.b_len) if same else "")
        return out

    def links(self, groups: str, out: array) -> int:
        """Adds a segment's links to `out`, A id * 2^32 + B id for each two tokens that overlap; returns its number of A tokens."""
        n_a = 0
        for group in groups.split(";"):
            a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
            n_a += len(a)
            if len(a) == 1 or len(b) == 1:
                out.extend(x << 32 | y for x in a for y in b)
                continue
            i = j = 0
            a_end, b_end = self.a_len[a[0]], self.b_len[b[0]]
            while True:  # within a group no two ends meet but the last
                out.append(a[i] << 32 | b[j])
                if a_end < b_end:
                    i += 1
                    a_end += self.a_len[a[i]]
                elif b_end < a_end:
                    j += 1
                    b_end += self.b_len[b[j]]
                else:
                    break
        return n_a


def aligned_groups(a: list[int], b: list[int], a_len: list[int], b_len: list[int]) -> str:
    """`a1,a2|b1;a3|b2,b3`: the tokens between the byte offsets where tokens of both end; both cover the same bytes."""
    groups, i, j, a_end, b_end = [], 0, 0, 0, 0
    while i < len(a):
        from_i, from_j = i, j
        a_end, b_end = a_end + a_len[a[i]], b_end + b_len[b[j]]
        while a_end != b_end:
            if a_end < b_end:
                i += 1
                a_end += a_len[a[i]]
            else:
                j += 1
                b_end += b_len[b[j]]
        i, j = i + 1, j + 1
        groups.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
    return ";".join(groups)


@lru_cache(maxsize=2)
def codec(a_path: str, b_path: str) -> Codec:
    """One a Python worker; the vocabulary files are installed on every machine."""
    return Codec(a_path, b_path)


class Codes(dict):
    """segment -> its code, in order of appearance."""

    def __missing__(self, segment: str) -> int:
        self[segment] = code = len(self)
        return code


def pack(values: np.ndarray) -> bytes:
    """Small integers as zstd of their byte planes."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(block: bytes) -> np.ndarray:
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(zstandard.decompress(block), np.uint8).reshape(4, -1).T).tobytes(), "<u4")


def rows_of(schema: pa.Schema, **columns) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows at most; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, ROWS):
        size = min(ROWS, n - at)
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][at : at + size], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


CODED = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("code", pa.int64()), ("segment", pa.string())])


def coded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (block, doc_id, codes) and of dictionaries (block, code, segment).  A text without characters has null
    codes.  Blocks are numbered within their task, so a task that runs again numbers them alike."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block = codec(a_path, b_path), TaskContext.get().partitionId() << 32
        table, ids, blobs, chars = Codes(), [], [], 0

        def filled() -> Iterator[pa.RecordBatch]:
            yield from rows_of(CODED, block=[block] * len(ids), doc_id=ids, codes=blobs)
            if table:
                yield from rows_of(CODED, block=[block] * len(table), code=range(len(table)), segment=list(table))

        for piece in (p for batch in batches for p in sliced(batch)):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts(piece)):
                parts = [np.fromiter(map(table.__getitem__, found), np.uint32, len(found)) for found in both.segments(text)]
                ids.append(doc_id)
                blobs.append(pack(np.concatenate(parts)) if parts else None)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield from filled()
                    table, ids, blobs, chars, block = Codes(), [], [], 0, block + 1
        if ids:
            yield from filled()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, doc_id long, codes binary, code long, segment string")


ALIGNED = pa.schema([("in_block", pa.int64()), ("code", pa.int64()), ("groups", pa.string())])


def align_segments(words: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """in_block, code, groups for dictionary rows (block, code, segment): rows of one segment come together, sorted, and it is
    tokenised and aligned once for all of them.  A block has a segment once, so no segment has more rows than there are blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, groups = None, ""
        for piece in (p for batch in batches for p in sliced(batch)):
            segments = piece.column("segment").to_pylist()
            new = [s for s, before in zip(segments, [last, *segments]) if s != before]
            found, out = iter(codec(a_path, b_path).aligned(new)), []
            for s in segments:
                if s != last:
                    last, groups = s, next(found)
                out.append(groups)
            yield pa.RecordBatch.from_arrays([piece.column("block"), piece.column("code"), pa.array(out, pa.string())], schema=ALIGNED)

    return words.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "in_block long, code long, groups string")


COMPOSED = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("place", pa.int64()), ("pair", pa.int64()), ("docs", pa.int64())])
COMPOSED_SQL = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, place long, pair long, docs long"


def compose(docs: pa.Table, words: pa.Table, both: Codec) -> pa.Table:
    """A block's documents from its dictionary: their counts and digest, which of the block's pairs they hold how often (places,
    times); and rows for the block's pairs, with the number of its documents that hold them."""
    groups = words.sort_by("code")["groups"].to_pylist()
    n_a, starts, links = np.full(len(groups), -1, np.int64), np.zeros(len(groups) + 1, np.int64), array("q")
    for i, g in enumerate(groups):
        if g:
            n_a[i] = both.links(g, links)
        starts[i + 1] = len(links)
    sizes = np.diff(starts)
    pairs, place = np.unique(np.frombuffer(links, np.int64) if links else np.zeros(0, np.int64), return_inverse=True)
    n_groups = np.array([g.count("|") for g in groups], np.int64)
    holders = np.zeros(len(pairs), np.int64)
    block, out = docs["block"][0].as_py(), {name: [] for name in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times")}
    for blob in docs["codes"].to_pylist():
        row = (0, 0, 0, 0, "", None, None)
        codes = unpack(blob) if blob else np.zeros(0, np.uint32)
        if len(codes) and (n_a[codes] >= 0).all():
            many = sizes[codes]
            ends = np.cumsum(many)
            held = place[np.repeat(starts[codes], many) + np.arange(ends[-1]) - np.repeat(ends - many, many)]
            places, times = np.unique(held, return_counts=True)
            holders[places] += 1
            told = hashlib.sha256(";".join(map(groups.__getitem__, codes.tolist())).encode()).hexdigest()
            a, g = int(n_a[codes].sum()), int(n_groups[codes].sum())
            # a group of m A tokens and n B tokens has m + n - 1 links
            row = (a, len(held) + g - a, g, len(held), told, pack(np.diff(places, prepend=0)), pack(times))
        for name, value in zip(out, row):
            out[name].append(value)
    parts = [*rows_of(COMPOSED, block=[block] * len(docs), doc_id=docs["doc_id"].to_pylist(), **out)]
    parts += rows_of(COMPOSED, block=np.full(len(pairs), block), place=np.arange(len(pairs)), pair=pairs, docs=holders)
    return pa.Table.from_batches(parts, COMPOSED)


def weigh(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents, from what its pairs count in the whole corpus."""
    pairs = pairs.sort_by("place")
    count, best = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    n_best, total = [], []
    for places, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist()):
        if places is None:
            n_best.append(0), total.append(0)
            continue
        at, times = np.cumsum(unpack(places)), unpack(times).astype(np.int64)
        n_best.append(int(times[best[at]].sum()))
        total.append(int((count[at] * times).sum()))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def link_counts(pairs: DataFrame) -> DataFrame:
    """pair, count (documents that hold it), best (no pair of its A id has more), from the blocks' pairs.

    There are at most as many pairs as two vocabularies have, and as many to an A id as B has ids."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count")).where("count > 0")
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == most)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs, each a document of its own.

    Texts that are null or empty, or whose tokens do not give back their bytes, have no tokens: zeros and ''.  Repeated rows
    count as often as they are there; a null doc_id goes through; an empty table gives an empty one; other columns are not
    read."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = written(coded(docs, a_path, b_path), "coded")
        words = align_segments(rows.where("segment is not null").select("block", "code", "segment"), a_path, b_path)
        of_docs = rows.where("segment is null").select("block", "doc_id", "codes")

        def composer(left: pa.Table, right: pa.Table) -> pa.Table:
            return compose(left, right, codec(a_path, b_path))

        composed = written(of_docs.groupBy("block").cogroup(words.groupBy("in_block")).applyInArrow(composer, COMPOSED_SQL), "composed", keep=True)
    pairs = composed.where("pair is not null").select("block", "place", "pair", "docs")
    with scratch(spark):
        counts = written(link_counts(pairs), "link-counts", keep=True)
    weighed = pairs.select("block", "place", "pair").join(counts, "pair", "left").select(F.col("block").alias("in_block"), "place", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(False)).alias("best"))
    of_docs = composed.where("pair is null").drop("place", "pair", "docs")
    return of_docs.groupBy("block").cogroup(weighed.groupBy("in_block")).applyInArrow(weigh, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
