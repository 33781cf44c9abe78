"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary, all words of the corpus, and one smoothing.  The background
is all documents, its counts scaled to the target's number of tokens, so that smoothing weighs alike in both.  A
document's score is the mean over its tokens of target loss minus background loss: lower is more like the target.  A target
document is scored by the target without itself, so that having been in the target is no merit.

Counts are exact for every word and bigram, keyed by 64-bit hashes, and never gathered in one place: documents are dealt
into blocks, each block sends its pre-aggregated counts to the buckets of hash ranges, and each bucket answers with the
sums of the keys that the block asked for, and with its share of the corpus's totals.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches

PRIOR = 50.0  # pseudo-count of the unigram distribution in each context
FIRST = 2  # entries of the vocabulary that are no words: the unknown word and the begin of a document
BLOCKS = 4  # blocks of documents for each shuffle partition, or more where one would hold more than BLOCK_BYTES of the table
BLOCK_BYTES = 16 << 20
BEGIN = np.uint64(0)  # stands before the first word

SENT = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("n_words", pa.binary()), ("pairs", pa.binary()), ("n_pairs", pa.binary())])
ANSWERS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n_words", pa.binary()), ("n_pairs", pa.binary()), ("vocabulary", pa.int64()), ("every", pa.int64()), ("target", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def hashed(texts_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the word before, hash of the word, document) of each token; BEGIN stands before the first."""
    ids: defaultdict = defaultdict(count().__next__)
    parts = [np.fromiter(map(ids.__getitem__, ws), dtype=np.int32, count=len(ws)) for ws in map(words_of, texts_)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    digests = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in ids)
    word = np.frombuffer(digests, dtype="<u8")[np.concatenate(parts)] if ids else np.zeros(0, np.uint64)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = BEGIN
    return before, word, np.repeat(np.arange(len(parts)), sizes)


def pairs_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) + word)


def packed(x: np.ndarray) -> bytes:
    """The array's bytes plane by plane, which compresses well for small or sorted numbers."""
    return x.ravel().view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpacked(raw: bytes, kind: type, rows: int = 1) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).ravel().view(kind).reshape(rows, -1)


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins and ends in sorted keys."""
    starts = np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def texts_of(table: pa.Table) -> list[str]:
    return [t or "" for t in table.column("text").to_pylist()]


def parted(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A block's documents, and which of them are targets, by the rows of marks among its rows."""
    marks = table.filter(table.column("mark"))
    docs = table.filter(pc.invert(table.column("mark")))
    wanted = set(marks.column("doc_id").to_pylist())
    return docs, np.array([i in wanted for i in docs.column("doc_id").to_pylist()], dtype=bool)


def sender(buckets: int):
    """A block's counts, a row a bucket: sorted word hashes with four counts (as word, as context; every, target), pairs with two."""

    def run(table: pa.Table) -> pa.Table:
        docs, wanted = parted(table)
        if not docs.num_rows:
            return SENT.empty_table()
        before, word, doc = hashed(texts_of(docs))
        target = wanted[doc]
        words, at = np.unique(np.concatenate([word, before]), return_inverse=True)
        n, m = len(word), len(words)
        uses = (at[:n], at[n:], at[:n][target], at[n:][target])
        n_words = np.array([np.bincount(u, minlength=m) for u in uses], dtype=np.uint32).reshape(4, -1)
        pairs, at = np.unique(pairs_of(before, word), return_inverse=True)
        n_pairs = np.array([np.bincount(u, minlength=len(pairs)) for u in (at, at[target])], dtype=np.uint32).reshape(2, -1)
        w, p = bounds(words, buckets), bounds(pairs, buckets)
        block = docs.column("block")[0].as_py()
        rows = [(block, b, packed(words[w[b] : w[b + 1]]), packed(n_words[:, w[b] : w[b + 1]]), packed(pairs[p[b] : p[b + 1]]), packed(n_pairs[:, p[b] : p[b + 1]])) for b in range(buckets)]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), SENT)], schema=SENT)

    return run


def summed(keys: list[np.ndarray], counts: list[np.ndarray], rows: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Sums over all blocks of each count, those of each block's own keys, and the number of different keys."""
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((rows, len(every)), dtype=np.int64)
    many = np.concatenate(counts, axis=1)
    for r in range(rows):
        sums[r] = np.bincount(at, many[r], len(every))  # float64 is exact up to 2^53
    ends = np.cumsum([len(k) for k in keys])
    return sums, [sums[:, at[e - len(k) : e]] for k, e in zip(keys, ends)], len(every) - int(BEGIN in every)


def answered(sent: pa.Table) -> pa.Table:
    """A bucket's answers to the blocks, in the order of the keys that each sent, and the bucket's totals."""
    column = lambda name, kind, rows: [unpacked(x, kind, rows) for x in sent.column(name).to_pylist()]
    sums, own_words, n = summed([x[0] for x in column("words", np.uint64, 1)], column("n_words", np.uint32, 4), 4)
    _, own_pairs, _ = summed([x[0] for x in column("pairs", np.uint64, 1)], column("n_pairs", np.uint32, 2), 2)
    m = sent.num_rows
    columns = [sent.column("block").combine_chunks(), sent.column("bucket").combine_chunks(), [packed(x) for x in own_words], [packed(x) for x in own_pairs], [n] * m, [int(sums[0].sum())] * m, [int(sums[2].sum())] * m]
    return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, ANSWERS)], schema=ANSWERS)


def within(doc: np.ndarray, key: np.ndarray, keys: int) -> np.ndarray:
    """For each token how often its document has its key."""
    _, at, times = np.unique(doc * keys + key, return_inverse=True, return_counts=True)
    return times[at]


def losses(pair: np.ndarray, context: np.ndarray, uni: np.ndarray, mass: float | np.ndarray, v: int, scale: float) -> np.ndarray:
    """Losses of bigrams by the counts of one side, scaled by `scale`."""
    one = (uni * scale + 0.01) / (mass * scale + 0.01 * v)
    return -np.log((pair * scale + PRIOR * one) / (context * scale + PRIOR))


def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The scores of a block's documents from the sums that all buckets gave for its words and pairs."""
    docs, wanted = parted(table)
    if not docs.num_rows:
        return SCORES.empty_table()
    before, word, doc = hashed(texts_of(docs))
    rows = answers.sort_by("bucket")
    joined = lambda name, k: np.concatenate([unpacked(x, np.int64, k) for x in rows.column(name).to_pylist()], axis=1)
    n_words, n_pairs = joined("n_words", 4), joined("n_pairs", 2)
    total = {name: sum(rows.column(name).to_pylist()) for name in ("vocabulary", "every", "target")}
    v = total["vocabulary"] + FIRST
    _, at = np.unique(np.concatenate([word, before]), return_inverse=True)
    w, b = at[: len(word)], at[len(word) :]
    _, p = np.unique(pairs_of(before, word), return_inverse=True)
    far = losses(n_pairs[0][p], n_words[1][b], n_words[0][w], total["every"], v, total["target"] / total["every"] if total["target"] else 1.0)
    n = np.bincount(doc, minlength=docs.num_rows)
    if total["target"]:
        own = wanted[doc]  # what a target document itself gave is taken off again
        less = lambda key, keys: np.where(own, within(doc, key, keys), 0)
        m = len(at) and int(at.max()) + 1
        near = losses(n_pairs[1][p] - less(p, len(p)), n_words[3][b] - less(b, m), n_words[2][w] - less(w, m), total["target"] - np.where(own, n[doc], 0), v, 1.0)
    else:
        near = far
    with np.errstate(invalid="ignore", divide="ignore"):
        near, far = (np.bincount(doc, x, docs.num_rows) / n for x in (near, far))
    as_null = lambda x: pa.array(x, mask=n == 0)
    return pa.Table.from_arrays([docs.column("doc_id").combine_chunks(), pa.array(n), as_null(near), as_null(far), as_null(near - far)], schema=SCORES)


def score(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for each row's whole text.

    A null or empty text has no tokens and null losses and score.  Without any target tokens both models are the
    background's and every score is 0.  Repeated rows count as often as they occur and score alike; a null doc_id is
    never a target; an empty table gives an empty one."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    blocks = min(max(BLOCKS * buckets, -(-size // BLOCK_BYTES)), (1 << 31) - 1)
    block = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int").alias("block")
    ident: Column = F.col("doc_id").cast("long")
    # the same rows are dealt alike for counting and for scoring, so both read one exchange
    rows = docs.select(block(F.coalesce(ident, F.xxhash64("text"))), ident.alias("doc_id"), "text", F.lit(False).alias("mark"))
    marks = wanted.where("doc_id is not null").select(block(ident), ident.alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark")).distinct()
    rows = rows.unionByName(marks)
    sent = rows.groupBy("block").applyInArrow(sender(buckets), "block int, bucket int, words binary, n_words binary, pairs binary, n_pairs binary")
    answers = sent.groupBy("bucket").applyInArrow(answered, "block int, bucket int, n_words binary, n_pairs binary, vocabulary long, every long, target long")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
