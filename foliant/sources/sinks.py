"""Sinks: Markdown documents and tables, XML, lossless text, JSON, and writing that is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T


def markdown_line(kind: Column, line: Column) -> Column:
    safe = T.escaped(line)
    bare = lambda pattern: F.regexp_replace(line, pattern, "")
    return (
        F.when(kind == "heading", F.concat(F.lit("## "), safe)).when(kind == "bullet", F.concat(F.lit("- "), T.escaped(bare(r"^[•–-]\s*"))))
        .when(kind == "list_item", F.concat(F.lit("- "), T.escaped(bare(r"^\*\s*")))).when(kind == "warning", F.concat(F.lit("> "), safe)).otherwise(safe)
    )


def markdown(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown: a document's lines (ord, kind, line) in order, blank ones as they are.

    A document is one row of the result, as its file will be."""
    parts = F.array_sort(F.collect_list(F.struct("ord", markdown_line(F.col("kind"), F.col("line")).alias("md"))))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["md"]), "\n").alias("markdown"))


def encoded(x: Column) -> Column:
    """(text, base64): a text that XML 1.0 can hold as it is; any other as base64 of its bytes.  Null stays null."""
    plain = T.forbidden_characters(x) == 0
    return F.struct(F.when(plain, x).alias("text"), F.when(~plain, F.base64(F.encode(x, "UTF-8"))).alias("base64"))


def decoded(e: Column) -> Column:
    return F.coalesce(e["text"], F.decode(F.unbase64(e["base64"]), "UTF-8"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, with copies counted, and the side they are from."""
    columns = a.columns
    rows = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    n = rows.groupBy(*columns).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")
    return n.withColumn("side", F.when(F.col("surplus") > 0, "first").otherwise("second"))


def same_letters(a: Column, b: Column) -> Column:
    """Whether two texts are made of the same characters, each as often."""
    letters = lambda x: F.array_sort(F.split(x, ""))
    return letters(a) == letters(b)


def write_verified(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Writes df, reads it back and compares both as bags of rows; raises if they differ.  Returns what was read.

    df has to give the same rows each time.  Spark's committer leaves no half-written table under `path`."""
    df.write.format(fmt).save(path)
    back = df.sparkSession.read.schema(df.schema).format(fmt).load(path)
    if not differences(df, back).isEmpty():
        raise ValueError(f"what {path} holds differs from what was written")
    return back


def long_fields(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, value: all other columns in long form; their types have to agree."""
    return rows.unpivot(keys, [c for c in rows.columns if c not in keys], "field", "value")


LAST = 2**31 - 1  # a place behind all children


def xml_text(x: Column) -> Column:
    """A text as XML content: marks are escaped, as are line ends that a reader would change."""
    out = x
    for mark, told in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(mark), F.lit(told))
    return out


def xml_attribute(x: Column) -> Column:
    """A text as the value of an attribute, in double quotes."""
    out = xml_text(x)
    for mark, told in (('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(mark), F.lit(told))
    return out


def xml_attributes(pairs: Column) -> Column:
    """Attributes (an array of name and value) as they stand in a tag, those without a value left out.  A value that XML
    cannot hold is told in base64 under its name with -base64 behind it."""

    def one(a: Column) -> Column:
        e = encoded(a["value"])
        plain = F.concat(F.lit(" "), a["name"], F.lit('="'), xml_attribute(e["text"]), F.lit('"'))
        return F.when(e["base64"].isNotNull(), F.concat(F.lit(" "), a["name"], F.lit('-base64="'), e["base64"], F.lit('"'))).otherwise(plain)

    return F.array_join(F.transform(F.filter(pairs, lambda a: a["value"].isNotNull()), one), "")


def xml_documents(nodes: DataFrame, fragments: DataFrame, keys: list[str], root: str = "document", leaf: str = "text") -> DataFrame:
    """keys, xml: each document's tree as XML.  nodes: path, tag, attributes (array of name, value); fragments: path, text.

    Tags open at a node's path and close at its path with the last place of all behind it, so the order of paths is the
    order of the document and no tree is built.  A fragment that XML cannot hold is told in base64."""
    open_ = F.concat(F.lit("<"), "tag", xml_attributes(F.col("attributes")), F.lit(">"))
    tags = nodes.select(*keys, "path", open_.alias("x")).unionByName(nodes.select(*keys, F.array_append("path", F.lit(LAST)).alias("path"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("x")))
    e = encoded(F.col("text"))
    told = F.when(e["base64"].isNotNull(), F.concat(F.lit(f'<{leaf} encoding="base64">'), e["base64"])).otherwise(F.concat(F.lit(f"<{leaf}>"), xml_text(e["text"])))
    parts = tags.unionByName(fragments.select(*keys, "path", F.concat(told, F.lit(f"</{leaf}>")).alias("x")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "x"))), lambda p: p["x"]), "")
    return parts.groupBy(*keys).agg(F.concat(F.lit(f"<{root}>"), body, F.lit(f"</{root}>")).alias("xml"))


def with_hints(nodes: DataFrame, hints: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with the attributes of their hints (path, name, value) behind their own, by name.

    checks.completeness() tells which hints name no node, or name one twice."""
    own = hints.groupBy(*keys, "path").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("_hints"))
    out = nodes.join(own, [*keys, "path"], "left")
    return out.withColumn("attributes", F.concat("attributes", F.coalesce("_hints", F.array().cast(nodes.schema["attributes"].dataType)))).drop("_hints")


def xml_texts(documents: DataFrame, keys: list[str], leaf: str = "text") -> DataFrame:
    """keys, nth, text: what xml_documents() told of fragments, read back from the XML."""
    found = F.regexp_extract_all("xml", F.lit(rf'<{leaf}(?: encoding="base64")?>[^<]*</{leaf}>'), 0)
    rows = documents.select(*keys, F.posexplode(found).alias("nth", "x"))
    body = F.regexp_extract("x", ">([^<]*)<", 1)
    plain = body
    for mark, told in (("\r", "&#13;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        plain = F.replace(plain, F.lit(told), F.lit(mark))
    text = F.when(F.col("x").contains('encoding="base64"'), F.decode(F.unbase64(body), "UTF-8")).otherwise(plain)
    return rows.select(*keys, "nth", text.alias("text"))


def markdown_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown: a table's cells (row, column, text) as a Markdown table; the first row heads it, cells that are not
    there are empty, marks are escaped and line ends become breaks."""
    shown = F.replace(T.escaped(F.col("text")), F.lit("\n"), F.lit("<br>"))
    width = cells.groupBy(*keys).agg(F.max("column").alias("_w"))
    rows = cells.select(*keys, "row", "column", shown.alias("t")).groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "t"))).alias("_m")).join(width, keys)
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), "_w"), lambda c: F.coalesce(F.col("_m")[c], F.lit(""))), " | "), F.lit(" |"))
    head = F.concat(F.lit("\n| "), F.array_join(F.transform(F.sequence(F.lit(1), "_w"), lambda c: F.lit("---")), " | "), F.lit(" |"))
    lines = rows.select(*keys, "row", line.alias("_line"), head.alias("_head"))
    parts = F.array_sort(F.collect_list(F.struct("row", "_line")))
    told = lambda p, i, h: F.when(i == 0, F.concat(p["_line"], h)).otherwise(p["_line"])
    g = lines.groupBy(*keys).agg(parts.alias("_p"), F.first("_head").alias("_h"))
    return g.select(*keys, F.array_join(F.transform("_p", lambda p, i: told(p, i, F.col("_h"))), "\n").alias("markdown"))


def json_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, json: each row as JSON with its fields by name; null fields are kept, numbers that are none become null."""
    fields = sorted(c for c in df.columns if c not in keys)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    told = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in fields]
    return df.select(*keys, F.to_json(F.struct(*told), {"ignoreNullFields": "false"}).alias("json"))


def output_paths(root: str, code: Column, token: Column, language: Column, stamp: Column) -> Column:
    """Where the review of a manual is written: its folder, JSON, Markdown, workbook (stamped) and pictures."""
    folder = F.concat(F.lit(root.rstrip("/") + "/"), code, F.lit("/"), token, F.lit("_"), language)
    under = lambda name: F.concat(folder, F.lit("/" + name))
    book = F.concat(folder, F.lit("/"), F.concat_ws("_", code, token, language, stamp), F.lit("_content_review.xlsx"))
    return F.struct(folder.alias("root"), under("content_poc.json").alias("json"), under("content_blocks.md").alias("markdown"), book.alias("workbook"), under("crops").alias("crops"))


def run_stamp(at: Column) -> Column:
    return F.date_format(at, "yyMMdd_HHmm")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(df: DataFrame) -> str:
    """A digest of a table as a bag of rows, whatever their order."""
    h = [F.xxhash64(*df.columns, F.lit(i)) for i in range(2)]
    got = df.agg(F.count("*"), *[F.coalesce(F.bit_xor(x), F.lit(0)) for x in h], *[F.coalesce(F.sum(F.pmod(x, F.lit(1_000_003))), F.lit(0)) for x in h]).first()
    return "-".join(map(str, got))


def write_bundle(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Writes several tables as one: all are staged beside `path`, read back and compared, and only then moved there at once.

    This needs a file system that renames folders at once; bundles.publish() does not, and keeps versions.

    Returns their fingerprints, which a last file, _COMMITTED, holds as well.  If anything fails nothing is published and
    what was staged goes; a bundle that is there already is not touched."""
    spark = next(iter(tables.values())).sparkSession
    fs, target = _files(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        prints = {}
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
            back = spark.read.schema(df.schema).parquet(f"{staging}/{name}")
            prints[name] = fingerprint(back)
            if prints[name] != fingerprint(df):
                raise ValueError(f"what was written of {name} differs")
        rows = spark.createDataFrame(sorted(prints.items()), "name string, fingerprint string").coalesce(1)
        rows.write.json(f"{staging}/_COMMITTED")
        if not fs.rename(_files(spark, staging)[1], target):
            raise OSError(f"{path} could not be published")
    except BaseException:
        fs.delete(_files(spark, staging)[1], True)
        raise
    return prints


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a published bundle, held against the fingerprints that it was committed with."""
    marks = {r.name: r.fingerprint for r in spark.read.schema("name string, fingerprint string").json(f"{path.rstrip('/')}/_COMMITTED").collect()}
    tables = {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in marks}
    for name, df in tables.items():
        if fingerprint(df) != marks[name]:
            raise ValueError(f"{name} is not what was committed")
    return tables
