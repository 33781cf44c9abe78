"""XML read back to rows of nodes, signatures of trees, and where two trees first differ.

A signature is a digest of a node and all that is below it: of the places and contents of its subtree as seen from it.  Every
node adds its digest to each node above, so signatures of all subtrees come from one aggregation, and trees compare by theirs
without either being put together anywhere."""

from __future__ import annotations

from base64 import b64decode
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.nodes import ancestry

CHUNK, ROWS = 1 << 20, 20_000
NODE = "path array<int>, tag string, attributes array<struct<name: string, value: string>>, text string"
_nodes = pa.schema([("path", pa.list_(pa.int32())), ("tag", pa.string()), ("attributes", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("text", pa.string())])


class Reader:
    """Rows of a document from expat's events: a node when its first child begins or it ends, a text where it stands."""

    def __init__(self, leaf: str):
        self.leaf, self.rows = leaf, []
        self.path: list[int] = []  # of the node that is open
        self.counts = [0]  # how many children each open node has so far
        self.parts: list[str] = []
        self.coded = False
        self.parser = expat.ParserCreate()
        self.parser.ordered_attributes = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.parts.append

    def place(self) -> list[int]:
        """The next child's path."""
        self.counts[-1] += 1
        return [*self.path, self.counts[-1] - 1]

    def flush(self) -> None:
        """Text among other nodes is a node of its own; white space there only lays the document out."""
        text = "".join(self.parts)
        self.parts.clear()
        if text.strip():
            self.rows.append((self.place(), None, [], text))

    def start(self, tag: str, attributes: list[str]) -> None:
        self.flush()
        named = dict(zip(attributes[::2], attributes[1::2]))
        self.path = self.place()
        self.counts.append(0)
        if tag == self.leaf:
            self.coded = named.pop("encoding", None) == "base64"
        told = [{"name": n.removesuffix("-base64"), "value": b64decode(v).decode() if n.endswith("-base64") else v} for n, v in named.items()]
        self.rows.append((self.path, tag, told, None))

    def end(self, tag: str) -> None:
        if tag == self.leaf:
            text = "".join(self.parts)
            self.parts.clear()
            path, _, told, _ = self.rows.pop()
            self.rows.append((path, tag, told, b64decode(text).decode() if self.coded else text))
            self.coded = False
        else:
            self.flush()
        self.path = self.path[:-1]
        self.counts.pop()

    def read(self, xml: str) -> Iterator[list[tuple]]:
        """The rows, ROWS or somewhat more at a time."""
        raw = xml.encode()
        for at in range(0, len(raw), CHUNK):
            self.parser.Parse(raw[at : at + CHUNK])
            if len(self.rows) > ROWS:
                yield self.rows[:-1]  # the last may be a leaf that is still open
                self.rows = self.rows[-1:]
        self.parser.Parse(b"", True)
        yield self.rows


def xml_nodes(documents: DataFrame, keys: list[str], leaf: str = "text") -> DataFrame:
    """keys, path, tag, attributes, text of every node of each document's xml, and its fault if it cannot be read.

    The root has the path [].  A leaf holds its text as it is, decoded where it was told in base64; text among other nodes has
    a row without a tag.  A leaf must not hold nodes.  A document with a fault, or null, has one row: path, tag and text null."""
    rows = documents.select(*keys, "xml")
    from pyspark.sql.pandas.types import to_arrow_schema

    head = to_arrow_schema(rows.select(*keys).schema)
    schema = pa.schema([*head, *_nodes, pa.field("fault", pa.string())])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + f", {NODE}, fault string"

    def batch_of(owner: dict, found: list[tuple], fault: str | None) -> pa.RecordBatch:
        columns = [[owner[k]] * len(found) for k in head.names]
        columns += [[p[1:] if p else None for p, *_ in found], *([r[i] for r in found] for i in (1, 2, 3)), [fault] * len(found)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts: list[list[tuple]] = []
                try:
                    if row["xml"] is None:
                        raise ValueError("null")
                    parts = list(Reader(leaf).read(row["xml"]))
                    told = None
                except (expat.ExpatError, ValueError) as e:
                    parts, told = [[(None, None, None, None)]], str(e)
                for part in parts:
                    yield batch_of(row, part, told)

    return rows.mapInArrow(run, kinds)


def content_digests(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, _a, _b: two digests of what a node itself holds; attributes in any order, those without a value left out."""
    attributes = F.array_sort(F.filter(F.coalesce("attributes", F.array().cast(nodes.schema["attributes"].dataType)), lambda a: a["value"].isNotNull()))
    told = F.to_json(F.struct(F.col("tag"), attributes.alias("attributes"), F.col("text")), {"ignoreNullFields": "false"})
    return nodes.select(*keys, "path", *[F.xxhash64(told, F.lit(i)).alias(c) for i, c in enumerate(("_a", "_b"))])


def signatures(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, signature, n_nodes for each node: equal where the subtrees are.  nodes: path, tag, attributes, text.

    A tree needs no root row; its own signature is at the path [].  Places count, so a node moved among its siblings changes
    those above."""
    own = content_digests(nodes, keys).withColumn("_up", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))))
    below = F.slice("path", F.size("_up") + 1, F.size("path"))
    bits = [F.bit_xor(F.xxhash64(below, F.col(c), F.lit(i))).alias(f"_{i}") for i, c in enumerate(("_a", "_b"))]
    g = own.groupBy(*keys, F.col("_up").alias("path")).agg(*bits, F.count("*").alias("n_nodes"))
    return g.select(*keys, "path", F.concat_ws("-", F.hex("_0"), F.hex("_1"), F.col("n_nodes").cast("string")).alias("signature"), "n_nodes")


def same_trees(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, signature: one row a tree; whether two trees are the same is whether these are."""
    bits = [F.bit_xor(F.xxhash64("path", F.col(c), F.lit(i))).alias(f"_{i}") for i, c in enumerate(("_a", "_b"))]
    g = content_digests(nodes, keys).groupBy(*keys).agg(*bits, F.count("*").alias("_n"))
    return g.select(*keys, F.concat_ws("-", F.hex("_0"), F.hex("_1"), F.col("_n").cast("string")).alias("signature"))


def first_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, kind of the first node, in document order, in which the trees of two tables differ: missing (from the
    second), extra (in it) or changed (tag, attributes or text).  Trees that are the same are told apart by their signatures
    first and go no further."""
    one, two = (same_trees(t, keys).withColumnRenamed("signature", c) for t, c in ((a, "_one"), (b, "_two")))
    differ = one.join(two, keys, "full").where(~F.col("_one").eqNullSafe(F.col("_two"))).select(*keys)
    left, right = (content_digests(t.join(differ, keys, "left_semi"), keys).withColumn("_x", F.struct("_a", "_b")).drop("_a", "_b") for t in (a, b))
    both = left.join(right.withColumnRenamed("_x", "_y"), [*keys, "path"], "full").where(~F.col("_x").eqNullSafe(F.col("_y")))
    kind: Column = F.when(F.col("_y").isNull(), "missing").when(F.col("_x").isNull(), "extra").otherwise("changed")
    first = both.select(*keys, F.struct("path", kind.alias("kind")).alias("f")).groupBy(*keys).agg(F.min("f").alias("f"))
    return first.select(*keys, "f.path", "f.kind")


def told_nodes(nodes: DataFrame, fragments: DataFrame, keys: list[str], leaf: str = "text", root: str = "document") -> DataFrame:
    """The rows that xml_nodes() gives for what sinks.xml_documents() tells of nodes and fragments whose paths have no gaps."""
    kind = nodes.schema["attributes"].dataType
    none = F.array().cast(kind)
    inner = nodes.select(*keys, "path", "tag", F.filter("attributes", lambda a: a["value"].isNotNull()).alias("attributes"), F.lit(None).cast("string").alias("text"))
    leaves = fragments.select(*keys, "path", F.lit(leaf).alias("tag"), none.alias("attributes"), "text")
    tops = inner.select(*keys).unionByName(leaves.select(*keys)).distinct().select(*keys, F.array().cast("array<int>").alias("path"), F.lit(root).alias("tag"), none.alias("attributes"), F.lit(None).cast("string").alias("text"))
    return inner.unionByName(leaves).unionByName(tops)


def reads_back(nodes: DataFrame, fragments: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """keys, same: whether each document's XML, read back, is the tree that it was told from."""
    want, got = same_trees(told_nodes(nodes, fragments, keys), keys), same_trees(xml_nodes(documents, keys), keys)
    both = want.join(got.withColumnRenamed("signature", "_got"), keys, "full")
    return both.select(*keys, F.col("signature").eqNullSafe(F.col("_got")).alias("same"))
