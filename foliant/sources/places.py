"""Where intermediate and published tables lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.  Only a local session that names none gets one of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliant-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: what several later steps read is worked out once, and their
    plans begin here.  The tables are left to the cluster's clean-up of that folder."""
    path = f"{shared_folder(df.sparkSession)}/foliant-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """written(), and merged by sorting where it is joined: a table that packs into a few megabytes may be far too large, once
    it is read, for the driver to hold as a broadcast."""
    return written(df, name).hint("merge")


DEAL_BYTES = 1 << 20  # of a table as it is read, packed; rows take ten times that and more once they are made
DEAL_ROWS = 1 << 16  # of a table whose rows are counted, a task
DEAL_FIRST = 200  # spark.shuffle.sort.bypassMergeThreshold: a shuffle into no more tasks writes row by row and keeps none in memory


def dealt(rows: DataFrame, *keys: str, table: DataFrame | None = None, read: bool = True, once: bool = False) -> DataFrame:
    """rows of a table, dealt by keys into a number of tasks that rises with the table, so that what one task sorts does not.

    Made rows repeat few texts, which pack so well that tasks merged by their packed size grow far too large.  All steps by
    these keys, and by more than these, then need no further shuffle.  Meant for a table as it is read, whose size is known, and
    for rows made of it, whose size Spark estimates by their columns.

    table: the table as it is read, if its rows shall be counted too (which reads the ends of its files only): how many rows go
    into a megabyte rises with the table where it repeats itself.

    read: the rows come straight from a table's files.  A task then reads a whole split of a file, of which a shuffle into many
    tasks would keep all rows in memory; so it deals them into DEAL_FIRST first, and each of these into its share of the tasks."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // DEAL_BYTES), -(-table.count() // DEAL_ROWS) if table is not None else 1)
    whole = rows.columns
    if once:
        rows = rows.select(*keys, F.struct(*[c for c in whole if c not in keys]).alias("_packed"))
    if read and n > DEAL_FIRST:
        n = -(-n // DEAL_FIRST) * DEAL_FIRST  # a multiple, so that each of the first tasks has tasks of its own
        names = rows.columns
        first = rows.toDF(*[f"_{c}" for c in names]).repartition(DEAL_FIRST, *[f"_{k}" for k in keys])
        rows = first.toDF(*names)  # of two deals with nothing in between, Spark would drop the first
    rows = rows.repartition(n, *keys)
    if not once:
        return rows
    here = rows.select(*keys, F.when(F.spark_partition_id() >= 0, F.col("_packed")).alias("_packed"))
    return here.select(*[c if c in keys else F.col(f"_packed.`{c}`") for c in whole])
