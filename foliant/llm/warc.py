"""WARC archives: writing, reading, and transaction assembly through concurrent-to identifiers.

Each capture is three records: the response (or a revisit that refers to an earlier response with an equal
payload), its request and its metadata.  Files are written by Spark's text writer: a record is header, block and
two line ends, and those two line ends are the writer's separator, so a part file is a plain WARC file, committed
by Spark's own protocol.  Reading goes by Content-Length, never by looking for separators in payloads.
"""

from __future__ import annotations

import gzip
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

EOL = "\r\n"
GZIP = b"\x1f\x8b"
REVISIT_FROM = 100  # payloads shorter than this are never revisits
RECORDS_PER_FILE = 2000
FILE_BYTES = 64 << 20  # payload in a file, of which readers hold one at a time, unless a single page has more
SMALL = 32 << 10  # pages of up to this many bytes share files; larger ones are written apart, by size
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, html (null: empty), digest, size and first_id, first_url: the smallest page_id with an equal payload of
    at least `revisit_from` bytes and the smallest url of it, null otherwise.

    The smallest id of each digest is found by partial aggregation over (digest, id); the join back has one row a
    digest on the small side, so adaptive execution may split a hot digest."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    firsts = (
        rows.where(F.col("size") >= revisit_from)
        .groupBy(F.col("digest").alias("known"))
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("known", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    return rows.join(firsts, F.col("digest") == F.col("known"), "left").drop("known")


def urn(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    """A record id that follows from the kind and the page's row, so that a task run again writes the same bytes."""
    h = F.md5(F.concat(F.lit(kind + ":"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), digest, F.lit(":"), url).cast("binary"))
    parts = [F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(kind: Column, ident: Column, uri: Column, headers: list[Column], content_type: str, block: Column) -> Column:
    """One WARC record without its closing line ends, as a string that holds the block's bytes unchanged."""
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(EOL, *head), F.lit(EOL + EOL), block)


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Writes three records a page.  A null url or html counts as empty; only rows that repeat id, url and html get equal
    record ids; a page with a null id is a response unless its payload is known.  An empty table gives an empty folder.

    Files are bounded by records and by bytes: pages are written by classes of size, each a fourth of the next, with as many
    records to a file as FILE_BYTES allows.  Equal payloads have equal sizes, so a class knows all its revisits."""
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    level = F.when(size <= SMALL, 0).otherwise(F.ceil(F.log(size / F.lit(float(SMALL))) / float(math.log(4)) - 1e-9)).cast("int")
    found = sorted(r[0] for r in pages.select(level).distinct().collect()) or [0]  # a dozen at most
    for i in found:
        most = max(1, min(records_per_file, 3 * (FILE_BYTES // (SMALL << 2 * i))))
        write_class(pages.where(level == i) if len(found) > 1 else pages, path, most, compression)


def write_class(pages: DataFrame, path: str, records_per_file: int, compression: str) -> None:
    p = plan(pages)
    i, uri = F.col("page_id"), F.regexp_replace("url", r"[\r\n]", " ")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(i)
    answer, ask, note = (urn(kind, i, F.col("url"), F.col("digest")) for kind in ("response", "request", "metadata"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ")
    http = F.concat(status, F.col("size").cast("string"), F.lit(EOL + EOL))
    page = F.concat(F.lit("Page-ID: "), F.coalesce(i.cast("string"), F.lit("none")))
    refers = F.when(revisit, F.concat_ws(EOL, F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), urn("response", F.col("first_id"), F.col("first_url"), F.col("digest"))), F.concat(F.lit("Refers-To-Page-ID: "), F.col("first_id").cast("string"))))
    made = F.array(
        record(F.when(revisit, "revisit").otherwise("response"), answer, uri, [digest, page, refers], "application/http; msgtype=response", F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))),
        record(F.lit("request"), ask, uri, [F.concat(F.lit("WARC-Concurrent-To: "), answer)], "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n"))),
        record(F.lit("metadata"), note, uri, [F.concat(F.lit("WARC-Concurrent-To: "), answer)], "application/warc-fields", F.concat(F.lit("payload-bytes: "), F.col("size").cast("string"), F.lit(EOL))),
    )
    out = p.select(F.explode(made).alias("value"))
    out.write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", records_per_file).option("compression", compression).mode("append").text(path)


FIELDS = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_head", pa.binary()), ("payload", pa.binary())])
RECORDS = "record_type string, record_id string, uri string, concurrent_to array<string>, refers_to string, headers map<string,string>, http_head binary, payload binary"


def parse(raw: bytes) -> Iterator[tuple]:
    """The records of one archive.  Concurrent-to may stand several times in a record; other names are kept once."""
    at, size = 0, len(raw)
    while at < size:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        headers: dict[str, str] = {}
        concurrent = []
        for line in raw[at:end].decode().split(EOL)[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                concurrent.append(value)
            headers[name] = value
        start = end + 4
        stop = start + int(headers["content-length"])
        if stop > size:
            raise ValueError(f"the record at byte {at} is cut off")
        block = raw[start:stop]
        http, payload = b"", block
        if headers.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            http, payload = (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (block, b"")
        yield headers["warc-type"], headers["warc-record-id"], headers.get("warc-target-uri"), concurrent, headers.get("warc-refers-to"), list(headers.items()), http, payload
        at = stop + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives under path, which may lie anywhere that Spark can read.  A record that is malformed or
    cut off raises, with its place.

    The writer bounds the size of a file, and a task reads files one by one and hands on small batches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                raw = content.as_py()
                for row in parse(gzip.decompress(raw) if raw[:2] == GZIP else raw):
                    rows.append(row)
                    held += len(row[-1])
                    if len(rows) >= 500 or held > 1 << 23:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    return files.mapInArrow(run, RECORDS)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), FIELDS)], schema=FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: response (or revisit), request and metadata, joined through concurrent-to ids.

    The link may stand in either record, and a metadata record may point at the request instead of the response.
    A capture without a request or metadata record has null there; of several with one capture the one with the
    smallest record id stays.  Requests that lead to no capture give no row.  Captures with equal record ids stay
    apart; each gets the same companions.  The nested records hold whatever columns records has besides type and links."""
    nested = records.select("record_type", "record_id", "concurrent_to", F.struct(*[c for c in records.columns if c not in ("record_type", "concurrent_to")]).alias("r"))
    anchors = nested.where(F.col("record_type").isin("response", "revisit"))
    others = nested.where(~F.col("record_type").isin("response", "revisit"))
    ids = anchors.select(F.col("record_id").alias("target"), F.lit(1).alias("is_capture")).distinct()
    said = others.select("record_type", "r", F.explode_outer("concurrent_to").alias("target"))
    backward = anchors.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("target"))
    direct = said.join(ids, "target", "left")
    hit = direct.where("is_capture = 1").select("record_type", "r", F.col("target").alias("capture"))
    by_capture = others.join(backward, F.col("record_id") == F.col("target")).select("record_type", "r", "capture")
    loose = direct.where("is_capture is null and target is not null")
    via = hit.unionByName(by_capture).where("record_type = 'request'").select("capture", F.col("r.record_id").alias("request_id"))
    second = loose.join(via, F.col("target") == F.col("request_id")).select("record_type", "r", "capture")
    members = hit.unionByName(by_capture).unionByName(second)
    pick = lambda kind: F.min_by(F.when(F.col("record_type") == kind, F.col("r")), F.when(F.col("record_type") == kind, F.col("r.record_id")))
    grouped = members.groupBy("capture").agg(pick("request").alias("request"), pick("metadata").alias("metadata"))
    return anchors.join(grouped, F.col("record_id") == F.col("capture"), "left").select("record_id", "record_type", F.col("r").alias("response"), "request", "metadata")


def captures(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives of pages, reads them back and assembles the transactions."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path)
    return assemble(read(spark, path))


def facts(records: DataFrame) -> DataFrame:
    """What digest() needs of each record: its payload only as size and digest, and as the number that metadata states."""
    number = lambda name: F.expr(f"try_cast(headers['{name}'] as bigint)")
    stated = F.regexp_extract(F.decode("payload", "utf-8"), r"(?m)^payload-bytes:\s*(\d+)", 1)
    return records.select(
        "record_type", "record_id", "concurrent_to", "uri", "refers_to", number("page-id").alias("page_id"), number("refers-to-page-id").alias("refers_to_page"), F.octet_length("payload").cast("long").alias("bytes"),
        F.when(F.col("record_type") == "response", F.sha2("payload", 256)).alias("sha"), F.when(F.col("record_type") == "metadata", stated).alias("stated"),
    )


def digest_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each transaction of facts().

    A revisit's payload is that of the response it refers to.  payload_bytes is what the capture's metadata record states;
    it and payload_digest are null unless that is the payload's size and the capture has a request, both with its address, so
    a transaction with a lost or wrongly linked record has neither."""
    got = written(assemble(records), "transactions")
    originals = got.where("record_type = 'response'").groupBy(F.col("record_id").alias("original")).agg(F.first("response.bytes").alias("bytes"), F.first("response.sha").alias("sha"))
    rows = got.where("record_type = 'response'").select("*", F.col("response.bytes").alias("bytes"), F.col("response.sha").alias("sha"))
    revisits = got.where("record_type = 'revisit'").join(originals, F.col("response.refers_to") == F.col("original"), "left").drop("original")
    stated = F.col("metadata.stated").try_cast("bigint")
    whole = (stated == F.col("bytes")) & (F.col("request.uri") == F.col("response.uri")) & (F.col("metadata.uri") == F.col("response.uri"))
    return rows.unionByName(revisits).select(F.col("response.page_id").alias("page_id"), F.when(whole, stated).alias("payload_bytes"), F.when(whole, F.col("sha")).alias("payload_digest"), "record_type", F.col("response.refers_to_page").alias("refers_to"))


def digest(pages: DataFrame) -> DataFrame:
    """The digests of each page's transaction as written to archives, read back and assembled."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    # archives are parsed once: the assembly reads records several times
    return digest_of(written(facts(read(spark, path)), "records"))
