"""Approximate nearest neighbours: a forest of random-projection trees.

Each tree has one random direction a level and, at each node, a threshold: the median of a bounded sample.  Every row is
indexed by its leaf in each tree.  A query walks all trees through one shared priority queue, nearest margin first, and
takes a fixed number of leaves; the rows of those leaves are its candidates, and the best are reranked by exact cosine in
double precision.

How many leaves a query takes is fitted on the sample: the least with which the wanted share of the sample's own nearest
neighbours is found there.  In the whole table the nearest lie closer than in a sample of it, so recall there is not lower,
up to chance.  A wanted recall of 1 takes every leaf: the exact way.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, new_path, written

TREES = 32
DEPTH = 8  # at most; a leaf has LEAF_ROWS rows of the sample at least
LEAF_ROWS = 32
SAMPLE_ROWS = 8192  # rows that the trees are fitted on at most
TRIALS = 256  # rows of the sample on which the number of leaves is fitted
FIRST_ROWS = 1024  # rows of a task's first join, which gives each query something to beat
RECALL = 0.95
QUERY_BLOCK = 16384  # queries handled in one pass over the index
CHUNK_ROWS = 32768  # rows that a task joins with the queries at once
SLACK = 1e-5  # what single precision may be wrong by
FOUND = "query_id long, vec_id long, score double"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, v: vectors with an id, not null, without null or non-finite components, not zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", v.alias("v")).where("vec_id is not null").where(fine & F.exists("v", lambda x: x != 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square leaves the range of doubles; directions stay exactly as they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Forest:
    """Heap-ordered trees: node i has children 2i and 2i+1; the leaves of all trees are numbered through."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 23):
        u = unit(sample)
        rng = np.random.default_rng(seed)
        self.trees = trees
        self.depth = int(np.clip(np.log2(max(1, len(u) / LEAF_ROWS)), 1, depth))
        self.leaves = 1 << self.depth
        away = rng.normal(size=(trees * self.depth, sample.shape[1]))
        self.directions = away / np.linalg.norm(away, axis=1, keepdims=True)
        self.thresholds = np.zeros((trees, self.leaves))
        reach = (u @ self.directions.T).reshape(len(u), trees, self.depth)
        for t in range(trees):
            at = np.ones(len(u), dtype=np.int64)
            for level in range(self.depth):
                r = reach[:, t, level]
                order = np.lexsort((r, at))
                nodes, starts, sizes = np.unique(at[order], return_index=True, return_counts=True)
                low, high = order[starts + (sizes - 1) // 2], order[starts + sizes // 2]
                self.thresholds[t, nodes] = (r[low] + r[high]) / 2
                at = 2 * at + (r > self.thresholds[t, at])

    def reach(self, u: np.ndarray) -> np.ndarray:
        return (u @ self.directions.T).reshape(len(u), self.trees, self.depth)

    def codes(self, u: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        reach, each = self.reach(u), np.arange(self.trees)
        at = np.ones((len(u), self.trees), dtype=np.int64)
        for level in range(self.depth):
            at = 2 * at + (reach[:, :, level] > self.thresholds[each, at])
        return (at - self.leaves + each * self.leaves).astype(np.int32)

    def order(self, u: np.ndarray, least: int) -> list[int]:
        """The first `least` leaves of one query from the queue that all trees share, nearest margin first."""
        reach = self.reach(u[None])[0].tolist()
        queue = [(0.0, t, 1, 0) for t in range(self.trees)]
        taken: list[int] = []
        while queue and len(taken) < least:
            far, t, node, level = heapq.heappop(queue)
            of, bounds = reach[t], self.thresholds[t]
            while level < self.depth:
                margin = of[level] - bounds[node]
                near = 2 * node + (margin > 0)
                heapq.heappush(queue, (far + margin * margin, t, near ^ 1, level + 1))
                node, level = near, level + 1
            taken.append(t * self.leaves + node - self.leaves)
        return taken

    def needed(self, u: np.ndarray, k: int, recall: float, pairs: int) -> int:
        """How many leaves find `recall` of the k nearest of the rows u for the first TRIALS of them, with a margin for what
        chance may take away where only so many pairs are looked for."""
        every = self.trees * self.leaves
        recall += 1.645 * (recall * (1 - recall) / max(1, pairs)) ** 0.5 if recall < 1 else 0.0
        if recall >= 1 or len(u) <= k + 1:
            return every
        codes = self.codes(u)
        ranks = []
        for i in range(min(TRIALS, len(u))):
            near = u @ u[i]
            near[i] = -np.inf
            far = self.distances(u[i])
            ordered = np.sort(far)
            ranks += np.searchsorted(ordered, far[codes[np.argpartition(-near, k)[:k]]].min(1)).tolist()
        # as many leaves as trees at least: a query's own leaves hold rows of the sample, which were dealt evenly
        return max(self.trees, int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1)

    def distances(self, u: np.ndarray) -> np.ndarray:
        """What each leaf costs a query: the sum of the squared margins of the turns to its far side, by which the queue is ordered."""
        reach = self.reach(u[None])[0]
        far = np.zeros((self.trees, 1))
        for level in range(self.depth):
            margin = reach[:, level, None] - self.thresholds[:, 1 << level : 2 << level]
            both = np.where(margin[:, :, None] > 0, [1.0, 0.0], [0.0, 1.0]) * (margin * margin)[:, :, None]
            far = (far[:, :, None] + both).reshape(self.trees, -1)
        return far.ravel()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed in one fixed order, so that equal pairs have equal scores wherever they are computed."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def neighbours(rows: DataFrame, k: int = 5, every: int = 50, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest candidates of each row whose id is divisible by `every`.

    Rows that share an id are one: each of its vectors is searched for and can be found, and the best score counts.
    Vectors of another length than the sample's most common one take no part, as unusable ones.  Ties go to the smaller
    id.  An empty table gives an empty one; other columns, whatever their names, are not read.

    A block of queries takes one pass over the index without a shuffle, so a vector that a third of the rows share makes
    no hot task, and only each task's best k a query are shuffled.  The driver holds one block at a time; each pass is
    written before the next begins."""
    spark = rows.sparkSession
    good = usable(rows)
    sample = good.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(SAMPLE_ROWS).toArrow()
    sizes = np.array([len(x) for x in sample.column("v")])
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sizes):
        return spark.createDataFrame([], schema)
    dim = int(np.bincount(sizes).argmax())
    vectors = np.unique(matrix(sample.filter(pa.array(sizes == dim)).column("v"), dim), axis=0)  # copies would crowd the thresholds
    vectors = vectors[np.random.default_rng(19).permutation(len(vectors))]
    forest = Forest(vectors, trees, depth)
    least = forest.needed(unit(vectors), k, recall, k * len(vectors) // every)
    good = good.where(F.size("v") == dim)

    def index(batch: pa.RecordBatch) -> dict:
        return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "codes": list(forest.codes(unit(matrix(batch.column("v"), dim))) % forest.leaves)}

    indexed = written(mapped(good, index, "vec_id long, v array<double>, codes array<short>"), "ann-index")

    def probes(batch: pa.RecordBatch) -> dict:
        u = unit(matrix(batch.column("v"), dim))
        return {"query_id": batch.column("vec_id"), "v": batch.column("v"), "leaves": [np.array(forest.order(x, least), dtype=np.int32) for x in u]}

    distinct = indexed.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    queries = written(mapped(distinct.repartition(distinct.sparkSession.sparkContext.defaultParallelism), probes, "query_id long, v array<double>, leaves array<int>"), "ann-queries")
    passes = -(-queries.count() // QUERY_BLOCK)
    path = new_path(spark, "ann-found")
    for part in range(passes):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == part).toArrow()
        scan(indexed, block, dim, k, forest.trees, forest.leaves).write.mode("append").parquet(path)
    if not passes:
        return spark.createDataFrame([], schema)
    best = spark.read.schema(FOUND).parquet(path).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan(indexed: DataFrame, block: pa.Table, dim: int, k: int, trees: int, leaves: int) -> DataFrame:
    """Each task's k best candidates (query_id, vec_id, score) of every query of the block.

    A task joins its rows with the queries leaf by leaf: the rows of a leaf are multiplied, in single precision, with the
    queries that took it, and what may be among a query's k best so far is scored exactly."""
    ids = block.column("query_id").to_numpy()
    q = matrix(block.column("v"), dim)
    sizes = np.array([len(x) for x in block.column("leaves")])
    taken = block.column("leaves").combine_chunks().flatten().to_numpy()

    def run(batches):
        by_leaf = np.argsort(taken, kind="stable")
        asking = np.repeat(np.arange(len(ids)), sizes)[by_leaf]
        asked = np.searchsorted(taken[by_leaf], np.arange(trees * leaves + 1))
        q32 = unit(q).astype(np.float32)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(ids), -np.inf, dtype=np.float32)
        for vec, v, codes in chunks(batches, dim, trees, leaves):
            vec, v, codes = thinned(vec, v, codes, k)
            held = joined(held, vec, v, codes, asking, asked, ids, q, q32, least, k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "score"])

    return indexed.mapInArrow(run, FOUND)


def chunks(batches, dim: int, trees: int, leaves: int):
    """(ids, vectors, leaves) of FIRST_ROWS rows, then of CHUNK_ROWS each time."""
    parts, n, most = [], 0, FIRST_ROWS
    for batch in batches:
        parts.append(batch)
        n += batch.num_rows
        if n >= most:
            yield opened(parts, dim, trees, leaves)
            parts, n, most = [], 0, CHUNK_ROWS
    if n:
        yield opened(parts, dim, trees, leaves)


def opened(parts: list[pa.RecordBatch], dim: int, trees: int, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(parts)
    return t.column("vec_id").to_numpy(), matrix(t.column("v"), dim), matrix(t.column("codes"), trees).astype(np.int32) + leaves * np.arange(trees, dtype=np.int32)


def thinned(vec: np.ndarray, v: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with equal vectors, those with the k + 1 smallest different ids: no other can be among a query's k nearest."""
    order = np.lexsort((vec, *v.T[:8]))  # rows with equal vectors need not be neighbours here, but copies of one vector mostly are
    same = (v[order][1:] == v[order][:-1]).all(1)
    again = np.concatenate(([False], same & (vec[order][1:] == vec[order][:-1])))
    order = order[~again]
    fresh = np.concatenate(([True], (v[order][1:] != v[order][:-1]).any(1)))
    starts = np.flatnonzero(fresh)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    order = order[place <= k]
    return vec[order], v[order], codes[order]


def joined(held, vec, v, codes, asking, asked, ids, q, q32, least, k):
    """held with what the chunk adds; `least`, the k-th best score of each query so far, is raised in place."""
    v32 = unit(v).astype(np.float32)
    flat = codes.T.ravel()
    order = np.argsort(flat, kind="stable")
    row = (order % len(vec)).astype(np.int64)
    found = np.searchsorted(flat[order], np.arange(len(asked)))
    hits, n = [], 0

    def settled(held):
        i, j, near = (np.concatenate(x) for x in zip(*hits))
        i, j, near = (x[ids[i] != vec[j]] for x in (i, j, near))
        # first by the rough scores: what falls short of the k-th best of them by more than they may be wrong is no hit
        rough = raised(kept(i, vec[j], near, k), least, k)
        fair = near >= rough[i]
        pair = np.unique(i[fair] * len(vec) + j[fair])
        i, j = pair // len(vec), pair % len(vec)
        score = np.concatenate([cosine(q[i[s : s + 65536]], v[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
        out = kept(np.concatenate([held[0], i]), np.concatenate([held[1], vec[j]]), np.concatenate([held[2], score]), k)
        least[:] = raised(out, least, k)
        hits.clear()
        return out

    for leaf in np.flatnonzero((np.diff(asked) > 0) & (np.diff(found) > 0)):
        qs, rs = asking[asked[leaf] : asked[leaf + 1]], row[found[leaf] : found[leaf + 1]]
        for s in range(0, len(qs), 2048):
            own = qs[s : s + 2048]
            near = q32[own] @ v32[rs].T
            a, b = np.nonzero(near >= least[own, None])
            if len(a):
                hits.append((own[a], rs[b], near[a, b]))
                n += len(a)
            if n > 1 << 20:
                held, n = settled(held), 0
    return settled(held) if hits else held


def raised(best: tuple[np.ndarray, np.ndarray, np.ndarray], least: np.ndarray, k: int) -> np.ndarray:
    """least, raised to a little below the last of each query that has k of the best (as kept() gives them)."""
    out = least.copy()
    query, _, score = best
    if len(query):
        last = np.append(query[1:] != query[:-1], True)
        full = np.bincount(query, minlength=len(least))[query[last]] >= k
        out[query[last][full]] = np.maximum(out[query[last][full]], score[last][full] - SLACK)
    return out


def kept(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, best first; equal ids of a query count once, with their best score, ties go to the smaller id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    fresh = np.ones(len(query), dtype=bool)
    pairs = np.lexsort((np.arange(len(query)), vec, query))
    repeat = (query[pairs][1:] == query[pairs][:-1]) & (vec[pairs][1:] == vec[pairs][:-1])
    fresh[pairs[1:][repeat]] = False
    query, vec, score = query[fresh], vec[fresh], score[fresh]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[place < k], vec[place < k], score[place < k]
