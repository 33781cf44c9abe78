"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
CACHE_WORDS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares.  Only in a local session that sets none (tests) is it one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliant-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


TASK_BYTES = 64 << 20


def tasks_for(df: DataFrame) -> int:
    """How many tasks a table, as it is read, is worth: twice the cores, or more where one would have more than TASK_BYTES to
    read.  More small tasks write many small files, and each costs time and, where files are local, processes of its own."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


_scratch: ContextVar[tuple[list, ...]] = ContextVar("scratch", default=())


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder in the shared one.  It goes with the scratch block that it is made in or, to `keep`, with the one around that."""
    path = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    if blocks := _scratch.get()[: -1 if keep else None]:
        blocks[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that were written inside as soon as the block is left, but for those written to `keep`.  Shuffle files
    of finished steps go as well: Spark's cleaner deletes them once the driver has collected its garbage."""
    paths: list[str] = []
    token = _scratch.set((*_scratch.get(), paths))
    try:
        yield
    finally:
        _scratch.reset(token)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


FILE_ROWS = 200_000


def written(df: DataFrame, name: str, most: int | None = None, each: int = FILE_ROWS, keep: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: short lineage that outlives executors.

    Where it is known that df has `most` rows at most, tasks are put together until each has about `each` of them: a shuffle
    of few rows may have many partitions, and every file costs time and, where files are local, a process of its own."""
    path = new_path(df.sparkSession, name, keep)
    (df if most is None else df.coalesce(max(1, -(-most // each)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows and bytes per Arrow batch to BATCH_ROWS and BATCH_BYTES, unless they are lower still: texts
    may be very long, and a batch lies in memory several times on its way between the JVM and Python."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")  # bytes are told as "67108864b"
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, most)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns; the Spark schema gives their order and types."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                columns = fn(piece)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def through(docs: DataFrame, change: Callable[[pa.RecordBatch, Callable[[str], int]], pa.RecordBatch]) -> DataFrame:
    """docs with its batches changed; `change` gets a batch and the place of a column by its name (-1 if there is none).

    Meanwhile columns go by their places, as mapInArrow cannot resolve names with dots."""
    small_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    places = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                yield change(piece, lambda name: places.get(name, -1))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def sliced(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Small pieces of a batch, so that what a function builds for one of them stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, mod 5, is 0; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most `rows` training rows (doc_id, text, label): labelled, not held out, chosen by a hash of the id.

    The bound makes the label side small by construction, which is why it may be broadcast."""
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
        .limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordCache(dict):
    """word -> make(word), kept for the first `limit` words of a worker."""

    def __init__(self, make: Callable, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        value = self.make(word)
        if len(self) < self.limit:
            self[word] = value
        return value


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case: the given one, with as many underscores more as that takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
