"""Near-duplicate documents: MinHash with tensored banding, verified on full shingle sets.

Two small collections of bands, A and B, of ROWS minhash values each are computed; the key of table (i, j) combines
A_i with B_j.  So SIDE * SIDE tables of 2 * ROWS values each cost only 2 * SIDE * ROWS minhash values.  A pair of
similarity s is in no common table with probability of at most 2 * (1 - s**ROWS)**SIDE: for 0.8, 8e-5.

Equal sets are one class from the start.  Candidates are not all pairs of a bucket: first each class is tried against
the bucket's smallest document.  Where a cluster of classes that share buckets is still in several components, its
sets are compared block against block, by size, inside tasks that hand on links only.  So components are those of
all candidate pairs, while the rows made stay in proportion to the documents and blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, mapped, mix64, texts, unused, written

SIDE = 10
ROWS = 2
HOT_CLASSES = 1000
EACH = 20_000  # documents to a task where each is many rows, or a text
SALTS = 8  # parts into which the rows that look up one id are dealt
BLOCK = 256  # sets of one size level that are compared at once with as many others
#: Similarity of at least NUMERATOR / DENOMINATOR, in whole numbers so that no rounding decides.
NUMERATOR, DENOMINATOR = 80, 100

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64)
_WORD_STEP = np.uint64(0xD1B54A32D192ED03)


class Shingler:
    """Text to the sorted distinct 64-bit hashes of its shingles of n words.

    A-Z are lower-cased, words end at ASCII white space.  Fewer than n words make one shingle; no words none."""

    def __init__(self, n: int):
        self.n = n
        self.words = WordCache(xxhash.xxh3_64_intdigest, 150_000)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(self.n, len(h))
        total = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            total = mix64(total * _WORD_STEP + h[k : len(h) - n + 1 + k])
        return np.unique(total)


def bands(shingles: np.ndarray) -> np.ndarray:
    """2 * SIDE band values: A then B.  Long sets go block by block."""
    best = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        h = shingles[at : at + 4096, None] * _FACTORS + _ADDENDS
        best = np.minimum(best, (h ^ (h >> np.uint64(32))).min(0))
    out = np.zeros(2 * SIDE, dtype=np.uint64)
    for r in range(ROWS):
        out = mix64(out * _WORD_STEP + best[r::ROWS] + np.uint64(r))
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), set_hash (32 hex digits; null for an empty set), bands; a null text counts as empty."""
    shingler = Shingler(words)

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingler(t) for t in texts(batch)]
        return {
            "doc_id": batch.column("doc_id"),
            "n": [len(s) for s in sets],
            "set_hash": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets],
            "bands": [bands(s).view(np.int64) if len(s) else None for s in sets],
        }

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n long, set_hash string, bands array<long>")


def buckets(reps: DataFrame) -> DataFrame:
    """id, n, first_id, first_n for each place of a class in a bucket that holds two classes or more; the first is the
    bucket's smallest id.

    Firsts are found with partial aggregation; the join back is one row a key against a key's members, which adaptive
    execution may split."""
    tables = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(SIDE + j).alias("j")) for i in range(SIDE) for j in range(SIDE)])
    rows = reps.select("id", "n", F.explode(F.transform(tables, lambda t: F.xxhash64(t["i"], t["j"], F.element_at("bands", t["i"] + 1), F.element_at("bands", t["j"] + 1)))).alias("key"))
    full = rows.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("size"), F.min("id").alias("first_id"), F.min_by("n", "id").alias("first_n")).where("size > 1")
    return rows.join(full, F.col("key") == F.col("k")).select("id", "n", "first_id", "first_n")


def of_class(known: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, id: the class of each row of known (doc_id, set_hash); classes has set_hash, id, copies, one row a class.

    Classes with a thousandth of all rows or more, of which there can be no more than a thousand, are broadcast, so that
    a group of copies, however large, is not shuffled into one task."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(classes.where(F.col("copies") * HOT_CLASSES >= total).select(F.col("set_hash").alias("hot"), F.col("id").alias("hot_id")))
    told = known.select("doc_id", "set_hash").join(hot, F.col("set_hash") == F.col("hot"), "left")
    rest = told.where("hot is null").select("doc_id", "set_hash").join(classes.where(F.col("copies") * HOT_CLASSES < total).select("set_hash", "id"), "set_hash")
    return told.where("hot is not null").select("doc_id", F.col("hot_id").alias("id")).unionByName(rest.select("doc_id", "id"))


def sizes_allow(a: str, b: str):
    """A pair of set sizes whose similarity can reach the threshold."""
    return F.least(a, b) * DENOMINATOR >= F.greatest(a, b) * NUMERATOR


def candidate_texts(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """id, z: the compressed texts of the documents in ids, repeated rows once; the one time that texts are shuffled."""
    used = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi").distinct()

    def squeeze(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=3).compress
        return {"id": batch.column("doc_id"), "z": [pack(t.encode()) for t in texts(batch)]}

    return written(mapped(used, squeeze, "id long, z binary"), "candidates", most, EACH)


def opened(shingler: Shingler, z: bytes) -> np.ndarray:
    return shingler(zstandard.ZstdDecompressor().decompress(z).decode())


def verified(pairs: DataFrame, held: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    shingler = Shingler(words)

    def compare(batch: pa.RecordBatch) -> dict:
        found = lru_cache(maxsize=128)(lambda z: opened(shingler, z))
        same = []
        for x, y in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist()):
            s, t = found(x), found(y)
            common = len(np.intersect1d(s, t, assume_unique=True))
            same.append(bool(common and common * DENOMINATOR >= NUMERATOR * (len(s) + len(t) - common)))
        return {"a": batch.column("a"), "b": batch.column("b"), "same": same}

    both = pairs.join(held.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(held.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    return mapped(both, compare, "a long, b long, same boolean").where("same").select("a", "b").distinct()


def block_links(ids: np.ndarray, groups: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets of different groups, enough of them to join whatever all links join.

    A set of which over a fifth occurs nowhere else in the block can have no partner in it and is left out of the
    product; the others are compared by a product of 0/1 matrices, a bounded number of shingles at a time."""
    alive = np.arange(len(sets))
    for _ in range(3):
        sizes = np.array([len(sets[i]) for i in alive], dtype=np.int64)
        if len(alive) < 2:
            return []
        flat = np.concatenate([sets[i] for i in alive])
        owner = np.repeat(np.arange(len(alive)), sizes)
        values, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[code] > 1
        kept = np.bincount(owner[shared], minlength=len(alive)) * DENOMINATOR >= NUMERATOR * sizes
        if kept.all():
            break
        alive = alive[kept]
    if len(alive) < 2:
        return []
    sizes = np.array([len(sets[i]) for i in alive], dtype=np.int64)
    flat = np.concatenate([sets[i] for i in alive])
    owner = np.repeat(np.arange(len(alive)), sizes)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    many = times > 1
    column = np.cumsum(many) - 1
    use = many[code]
    owner, code = owner[use], column[code[use]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(alive), len(alive)), dtype=np.float32)
    for low in range(0, int(many.sum()), 4096):
        s, e = np.searchsorted(code, (low, low + 4096))
        part = np.zeros((len(alive), 4096), dtype=np.float32)
        part[owner[s:e], code[s:e] - low] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    x, y = np.nonzero(np.triu(common * DENOMINATOR >= NUMERATOR * union, 1))
    root = {}

    def top(g):
        while root.get(g, g) != g:
            root[g] = root.get(root[g], root[g])
            g = root[g]
        return g

    links = []
    for i, j in zip(alive[x], alive[y]):
        g, h = top(groups[i]), top(groups[j])
        if g != h:
            root[g] = h
            links.append((int(ids[i]), int(ids[j])))
    return links


def block_pairs(members: DataFrame) -> DataFrame:
    """members (id, n, cluster, component), each with the keys of all the block pairs in which it meets others.

    Within a cluster, sets whose similarity can reach the threshold lie on the same or on neighbouring levels of size;
    a level is dealt into blocks of about BLOCK sets."""
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(DENOMINATOR / NUMERATOR))).cast("int")
    placed = members.withColumn("level", level)
    sizes = written(placed.groupBy("cluster", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "levels", placed.count())
    near = sizes
    for name, step in (("below", 1), ("above", -1)):
        near = near.join(sizes.select("cluster", (F.col("level") + step).alias("level"), F.col("blocks").alias(name)), ["cluster", "level"], "left")
    placed = placed.join(near, ["cluster", "level"]).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    to = lambda count, key: F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), count - 1), key)).otherwise(F.array().cast("array<bigint>"))
    own, lv, cl = F.col("own"), F.col("level"), F.col("cluster")
    keys = F.concat(
        to(F.col("blocks"), lambda k: F.xxhash64(cl, lv, F.lit(0), F.least(own, k), F.greatest(own, k))),
        to(F.col("above"), lambda k: F.xxhash64(cl, lv, F.lit(1), own, k)),
        to(F.col("below"), lambda k: F.xxhash64(cl, lv - 1, F.lit(1), k, own)),
    )
    return placed.select("id", "component", F.explode(keys).alias("key"))


def links_in_blocks(members: DataFrame, held: DataFrame, words: int) -> DataFrame:
    """Links (a, b) between members of one cluster that lie in different components."""
    shingler = Shingler(words)

    def compare(table: pa.Table) -> pa.Table:
        sets = [opened(shingler, z) for z in table.column("z").to_pylist()]
        found = block_links(table.column("id").to_numpy(), table.column("component").to_numpy(), sets)
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    return block_pairs(members).join(held, "id").groupBy("key").applyInArrow(compare, "a long, b long").distinct()


def relabelled(rows: DataFrame, column: str, other: str, hooks: DataFrame) -> DataFrame:
    """rows with the ids in `column` replaced by their labels in hooks (id, label), if they have one.

    Many rows may hold one id, as that of a large group does: they are dealt by a hash of their other column over SALTS
    parts, to each of which the labels are given."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    known = hooks.select(F.col("id").alias(column), F.col("label").alias("_to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return salted.join(known, [column, "_salt"], "left").withColumn(column, F.coalesce("_to", column)).drop("_to", "_salt").select(*rows.columns)


def components(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """id, component: the smallest id reachable over edges (a, b); ids without an edge are their own component.

    Each round hooks every linked id onto its smallest neighbour, shortens the paths by one jump, and contracts the
    edges onto the new labels, so that the graph shrinks from round to round.  The smallest id of a component is never
    relabelled.  Every round is written to the shared folder.  `most`, if known, bounds the number of edges."""
    graph = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph", most)
    labels, known = None, 0  # known: ids with a label, at most
    while n := graph.count():
        hooks = graph.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
        hooks = written(relabelled(hooks, "label", "id", hooks), "hooks", n)
        known += n
        graph = written(relabelled(relabelled(graph, "a", "b", hooks), "b", "a", hooks).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph", n)
        if labels is None:
            labels = hooks
        else:
            # ids that were roots until now have no row in labels yet
            labels = written(relabelled(labels, "label", "id", hooks).unionByName(hooks.join(labels.select("id"), "id", "left_anti")), "labels", known)
    if labels is None:
        return nodes.select("id").distinct().withColumn("component", F.col("id"))
    return nodes.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def linked(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Rows that share a doc_id are one document: one component.  Empty sets are linked with nothing; a null doc_id takes
    no part and has a null component_id and kept true.  An empty table gives an empty one."""
    sig = written(signatures(docs, words), "signatures")
    n = sig.count()
    known = sig.where("set_hash is not null and doc_id is not null")
    classes = written(known.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes", n)
    rows = written(of_class(known, classes).distinct(), "class-rows", n)
    # a doc_id with several texts ties their classes together
    several = rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z")
    tied = rows.join(several.select("doc_id", "a"), "doc_id").where("a < id").select("a", F.col("id").alias("b"))
    reps = known.join(rows.where("doc_id = id").select("id"), F.col("doc_id") == F.col("id")).groupBy("set_hash", "id").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    # each class becomes SIDE * SIDE rows, so tasks get few of them
    in_bucket = written(buckets(reps.repartition(max(1, -(-n // EACH)))), "buckets", SIDE * SIDE * n)
    nodes, places = rows.select("id"), in_bucket.count()

    held = candidate_texts(docs, in_bucket.select("id").distinct(), n)
    meet = written(in_bucket.where("first_id < id").select(F.col("first_id").alias("a"), F.col("id").alias("b"), F.col("first_n").alias("na"), F.col("n").alias("nb")).distinct(), "pairs", places)
    edges = written(verified(meet.where(sizes_allow("na", "nb")).select("a", "b"), held, words).union(tied), "edges", places + n)
    found = written(components(nodes, edges, edges.count()), "components", n)

    clusters = components(in_bucket.select("id").distinct(), meet, places).withColumnRenamed("component", "cluster")
    members = in_bucket.select("id", "n").distinct().join(clusters, "id").join(found, "id")
    torn = members.groupBy(F.col("cluster").alias("c")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("c")
    members = written(members.join(torn, F.col("cluster") == F.col("c")).drop("c"), "members", n)
    more = written(links_in_blocks(members, held, words), "links")
    if more_links := more.count():
        found = written(components(nodes, edges.union(more), edges.count() + more_links), "components", n)

    of_doc = rows.join(found, "id").groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sig.select("doc_id", "n").join(of_doc, "doc_id", "left")
    whole = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of docs, all columns, of which one document of each group stays, once.

    Of several rows with one doc_id the one whose text has the smallest hash stays (of equal texts any, as they may differ
    in other columns only).  Rows with a null doc_id stay, as do documents without words.  An empty table gives an empty
    one; columns of any name go through."""
    keep = linked(docs, words).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"))
    once, twice = unused(docs, "_once"), unused(docs, "_twice")
    named = docs.where("doc_id is not null")
    alone = named.join(keep.where("times = 1").select(F.col("doc_id").alias(once)), F.col("doc_id") == F.col(once), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    again = named.join(keep.where("times > 1").select(F.col("doc_id").alias(once)), F.col("doc_id") == F.col(once), "left_semi")
    again = again.withColumn(twice, place).where(F.col(twice) == 1).drop(twice)
    return alone.unionByName(again).unionByName(docs.where("doc_id is null"))
