"""Conversations put together again from turns that arrive late, twice and out of order, on Structured Streaming.

Conversations are dealt by a hash over buckets; a bucket is one group of applyInPandasWithState and holds many of them.  Every
batch brings one tick row a bucket, so that silence is noticed without timers.  A bucket's state is one zstd block of columns:
a row for each open conversation, a row for each turn that waits for an earlier one, and the ids of those that are closed.
A batch is merged with numpy: the first arrival of a turn stays, the gapless run from the first turn on is released, and
conversations without arrivals for SILENCE batches are closed.

Texts stay in the state only until they are released; what stays longer is 8 bytes for a closed conversation.  The number of
buckets follows the rows and bytes of the input, so that a bucket stays small at any size.  A conversation is the unit: its
waiting turns lie in one bucket.  Equal arrivals of a turn are put together before they are dealt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import FILE_ROWS, new_path, small_batches, written

BATCHES, SILENCE = 12, 3
BUCKET_ROWS, BUCKET_BYTES = 1000, 1 << 20
ARRIVAL = "bucket long, conv_id long, turn long, first long, role string, text string, batch int"
EVENT = "event string, conv_id long, turn long, batch long, role string, text string, waiting array<long>, n_missing long, n_breaks long"


def arrivals(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """conv_id, turn, first, role, text, batch: every row's arrivals, a turn's smallest payload in each batch.

    Rows without turn or conv_id are dropped; a null role or text is empty.  Of equal payloads that cut role and text at
    different places, that with the shorter role arrives."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and turn is not null")
    firsts = written(rows.groupBy("conv_id").agg(F.min("turn").alias("first")), "first-turns")
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "conv_id", "turn"), 256), 1, 8), 16, 10).cast("long")

    def at(batch: Column, role: Column) -> Column:
        return F.struct(batch.cast("int").alias("batch"), role.alias("as"))

    once = at(h % batches, F.col("role"))
    again = at((h + 3) % batches, F.lit("user"))
    dealt = rows.withColumn("a", F.explode(F.when(h % 7 < 2, F.array(once, again)).otherwise(F.array(once))))
    least = F.min(F.struct(F.concat("a.as", F.lit("|"), "text").alias("payload"), F.char_length("a.as").alias("cut"))).alias("p")
    kept = dealt.groupBy("conv_id", "turn", F.col("a.batch").alias("batch")).agg(least).join(firsts.hint("merge"), "conv_id")
    role, text = F.expr("substring(p.payload, 1, p.cut)"), F.expr("substring(p.payload, p.cut + 2)")
    return kept.select("conv_id", "turn", "first", role.alias("role"), text.alias("text"), "batch")


def buckets_for(conversations: DataFrame) -> int:
    """So many that one has about BUCKET_ROWS turns and BUCKET_BYTES of text, and several for each core."""
    size = conversations.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(2 * conversations.sparkSession.sparkContext.defaultParallelism, -(-size[0] // BUCKET_ROWS), -(-size[1] // BUCKET_BYTES))


def feeds(rows: DataFrame, buckets: int, batches: int = BATCHES) -> DataFrame:
    """The arrivals with their buckets, and a tick row for each bucket and batch; batch number `batches` is the end."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)))
    ticks = rows.sparkSession.range(0, buckets, 1, -(-buckets // FILE_ROWS)).select(F.col("id").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(batches))).alias("batch"))
    return dealt.unionByName(ticks, allowMissingColumns=True)


class Bucket:
    """The conversations of one bucket, as columns."""

    def __init__(self):
        self.conv = self.first = self.next = self.seen = self.breaks = np.zeros(0, np.int64)
        self.last_role = np.zeros(0, object)
        self.owner = self.turn = np.zeros(0, np.int64)
        self.role = self.text = np.zeros(0, object)
        self.closed = np.zeros(0, np.int64)

    OPEN, WAITING, CLOSED = ("conv", "first", "next", "seen", "breaks", "last_role"), ("owner", "turn", "role", "text"), ("closed",)

    def dump(self) -> bytes:
        sink = pa.BufferOutputStream()
        for names in (self.OPEN, self.WAITING, self.CLOSED):
            arrays = [pa.array(x, pa.string() if x.dtype == object else pa.int64()) for x in (getattr(self, n) for n in names)]
            batch = pa.record_batch(arrays, names=list(names))
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
        return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())

    @classmethod
    def load(cls, block: bytes) -> Bucket:
        bucket, source = cls(), pa.BufferReader(zstandard.ZstdDecompressor().decompress(block))
        for _ in range(3):
            columns = pa.ipc.open_stream(source).read_all()
            for name in columns.schema.names:
                setattr(bucket, name, columns.column(name).to_numpy())
        return bucket

    def advance(self, batch: int, rows: pd.DataFrame, end: int) -> pd.DataFrame:
        """Takes in a batch's arrivals (conv_id, turn, first, role, text) and returns its events."""
        rows = least_payloads(rows)
        conv, turn, first = (rows[c].to_numpy(np.int64) for c in ("conv_id", "turn", "first"))
        role, text = (rows[c].to_numpy(object) for c in ("role", "text"))
        late = np.isin(conv, self.closed)
        events = [event("reject", conv[late], turn[late], batch, role[late], text[late])]
        conv, turn, first, role, text = (x[~late] for x in (conv, turn, first, role, text))
        self._open(conv, first)
        self.seen = self.seen.copy()
        self.seen[np.searchsorted(self.conv, conv)] = batch
        self._merge(conv, turn, role, text)
        events += [self._release(batch), self._close(batch, batch >= end)]
        return pd.concat([e for e in events if len(e)] or events[:1], ignore_index=True)

    def _open(self, conv: np.ndarray, first: np.ndarray) -> None:
        new, where = np.unique(conv, return_index=True)
        fresh = ~np.isin(new, self.conv)
        new, first = new[fresh], first[where[fresh]]
        if len(new):
            order = np.argsort(np.concatenate([self.conv, new]))
            zeros = np.zeros(len(new), np.int64)
            added = {"conv": new, "first": first, "next": first, "seen": zeros, "breaks": zeros, "last_role": np.full(len(new), "", object)}
            for name, more in added.items():
                setattr(self, name, np.concatenate([getattr(self, name), more])[order])

    def _merge(self, conv: np.ndarray, turn: np.ndarray, role: np.ndarray, text: np.ndarray) -> None:
        """Adds turns that are neither released nor waiting; waiting turns stay sorted by conversation and turn."""
        news = turn >= self.next[np.searchsorted(self.conv, conv)]
        owner, turn = np.concatenate([self.owner, conv[news]]), np.concatenate([self.turn, turn[news]])
        order = np.lexsort((turn, owner))  # stable: what waits already comes before its repeats
        owner, turn = owner[order], turn[order]
        stays = np.concatenate([[True], (owner[1:] != owner[:-1]) | (turn[1:] != turn[:-1])])[: len(owner)]
        self.owner, self.turn = owner[stays], turn[stays]
        self.role, self.text = np.concatenate([self.role, role[news]])[order][stays], np.concatenate([self.text, text[news]])[order][stays]

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each waiting turn: its conversation's place, and its own place among the turns of that one."""
        place = np.searchsorted(self.conv, self.owner)
        begins = np.searchsorted(self.owner, self.conv)
        return place, np.arange(len(place)) - begins[place]

    def _release(self, batch: int) -> pd.DataFrame:
        place, nth = self._places()
        go = self.turn - nth == self.next[place]
        out = event("release", self.owner[go], self.turn[go], batch, self.role[go], self.text[go])
        place, nth, turn, role = place[go], nth[go], self.turn[go], self.role[go]
        before = np.concatenate([np.full(1, "", object), role[:-1]])[: len(role)]
        before = np.where(nth == 0, self.last_role[place], before)
        repeats = (role == before) & (turn > self.first[place])
        self.breaks = self.breaks + np.bincount(place, repeats, len(self.conv)).astype(np.int64)
        many = np.bincount(place, minlength=len(self.conv))
        self.next = self.next + many
        ends = np.flatnonzero(np.append(place[1:] != place[:-1], True))[: len(place)]
        self.last_role = self.last_role.copy()
        self.last_role[place[ends]] = role[ends]
        self.owner, self.turn, self.role, self.text = (x[~go] for x in (self.owner, self.turn, self.role, self.text))
        return out

    def _close(self, batch: int, everything: bool) -> pd.DataFrame:
        place, _ = self._places()
        goes = np.full(len(self.conv), True) if everything else self.seen <= batch - SILENCE
        many = np.bincount(place, minlength=len(self.conv))
        stops = np.cumsum(many)
        largest = np.where(many > 0, np.append(self.turn, 0)[stops - 1], self.next - 1)
        missing = largest - self.next + 1 - many
        follows = (self.owner[1:] == self.owner[:-1]) & (self.turn[1:] == self.turn[:-1] + 1) & (self.role[1:] == self.role[:-1])
        breaks = self.breaks + np.bincount(place[1:], follows, len(self.conv)).astype(np.int64)
        which = np.flatnonzero(goes)
        nothing = np.full(len(which), None, object)
        out = event("close", self.conv[which], np.full(len(which), -1), batch, nothing, nothing)
        out["waiting"] = pd.Series([self.turn[stops[i] - many[i] : stops[i]] for i in which], dtype=object)
        out["n_missing"], out["n_breaks"] = pd.array(missing[which], "Int64"), pd.array(breaks[which], "Int64")
        self.closed = np.union1d(self.closed, self.conv[which])
        stays = ~goes[place]
        for name in self.WAITING:
            setattr(self, name, getattr(self, name)[stays])
        for name in self.OPEN:
            setattr(self, name, getattr(self, name)[~goes])
        return out


def event(kind: str, conv: np.ndarray, turn: np.ndarray, batch: int, role: np.ndarray, text: np.ndarray) -> pd.DataFrame:
    none = pd.array([pd.NA] * len(conv), "Int64")
    return pd.DataFrame({"event": kind, "conv_id": conv, "turn": turn, "batch": batch, "role": role, "text": text, "waiting": pd.Series([None] * len(conv), dtype=object), "n_missing": none, "n_breaks": none})


def least_payloads(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each turn; where several arrive at once, that whose payload has the smallest bytes."""
    if rows.duplicated(["conv_id", "turn"]).any():
        payload = [f"{r}|{t}".encode() for r, t in zip(rows["role"], rows["text"])]
        rows = rows.assign(payload=payload, cut=rows["role"].str.len()).sort_values(["payload", "cut"], kind="stable").drop_duplicates(["conv_id", "turn"])
    return rows


def stepper(end: int):
    """The function of applyInPandasWithState: a bucket takes in the batches that have come, in their order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames, ignore_index=True)
        bucket = Bucket.load(state.get[0]) if state.exists else Bucket()
        for batch, part in rows.groupby("batch", sort=True):
            out = bucket.advance(int(batch), part[part["conv_id"].notna()], end)
            if len(out):
                yield out
        state.update((bucket.dump(),))

    return step


def reassembled(spark: SparkSession, staged: str, batches: int = BATCHES) -> DataFrame:
    """Events (EVENT) of the feeds that lie under `staged` in folders batch=0 to batch=`batches`: one streaming query, started
    anew for each of them on one checkpoint.  A start that failed can be repeated; its batch is then taken in again as a whole."""
    small_batches(spark)
    base = new_path(spark, "turns", keep=True)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{base}/in"))
    for batch in range(batches + 1):
        if not fs.rename(path(f"{staged}/batch={batch}"), path(f"{base}/in/batch={batch}")):
            raise FileNotFoundError(f"{staged}/batch={batch}")
        events = spark.readStream.schema(ARRIVAL).parquet(f"{base}/in").groupBy("bucket").applyInPandasWithState(stepper(batches), EVENT, "block binary", "append", GroupStateTimeout.NoTimeout)
        query = events.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(EVENT).parquet(f"{base}/out")


def turn_events(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Releases, rejections and closings of all conversations, with texts and waiting turns; an empty table gives none."""
    spark = conversations.sparkSession
    staged = new_path(spark, "arrivals")
    rows = feeds(arrivals(conversations, batches), n := buckets_for(conversations), batches)
    files = max(spark.sparkContext.defaultParallelism, n * BUCKET_ROWS // FILE_ROWS)
    rows.coalesce(files).write.partitionBy("batch").parquet(staged)
    return reassembled(spark, staged, batches)


def digest(conversations: DataFrame) -> DataFrame:
    """event, conv_id, turn, batch, sha256, n_missing, n_breaks; what odd rows give is told at `arrivals`."""
    told = F.when(F.col("event") == "close", F.array_join("waiting", ",")).otherwise(F.concat("role", F.lit("|"), "text"))
    return turn_events(conversations).select("event", "conv_id", "turn", "batch", F.sha2(told.cast("binary"), 256).alias("sha256"), "n_missing", "n_breaks")
