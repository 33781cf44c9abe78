"""Lines of a text put together to review items: bullets, menu paths, labels, warnings, notes, headings, body.

Whether a line goes into the item before it depends on what that item is, and so on all lines above: an automaton.  Classes
and lengths of lines are built-in expressions on the text's own array of lines; only the walk over the classes of one text is
Python, in Arrow batches.  Nothing is shuffled but the styled spans, if there are any."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.spans import GAP_SHARE, PROMINENT_SIZE, SIZE_STEP, SMALL_SIZE

HEADING_CHARS = 80
QUOTES = ('"', "'", "“", "”")
SPAN = "text string, size double, strong boolean, y0 double, y1 double"


def stripped(raw: Column) -> Column:
    """A line's collapsed text and its length as it stands, without white space at its ends."""
    return F.struct(T.collapsed(raw).alias("text"), F.length(F.regexp_replace(raw, rf"^{T.WHITE}+|{T.WHITE}+$", "")).alias("chars"))


def classed(line: Column) -> Column:
    """A stripped line with each class on its own, whichever claims it first, and what else the walk asks of it."""
    x = line["text"]
    return F.struct(
        x.alias("text"), line["chars"].alias("chars"), T.is_bullet(x).alias("bullet"), T.is_navigation(x).alias("navigation"), T.is_ui_label(x).alias("ui_label"), T.is_warning(x).alias("warning"),
        T.is_list_item(x).alias("list_item"), T.is_titled(x).alias("heading"), x.startswith(T.NOTE_START).alias("note"), x.startswith(T.PARTED_ITEM).alias("parted"), x.substr(1, 1).isin(*QUOTES).alias("quoted"),
    )


CLASSES = ("navigation", "ui_label", "warning", "list_item", "bullet", "heading")


def told(line: dict) -> dict:
    """The line with its kind, the first class that claims it, and whether it is plain or a heading."""
    claims = [c for c in CLASSES if line[c]]
    mark = line["text"] == T.STANDALONE_BULLET
    heads = line["heading"] and not mark and not any(line[c] for c in CLASSES[:4])
    return line | {"kind": "bullet" if mark else claims[0] if claims else "body", "plain": not claims, "heads": heads}


def line_styles(lines: list[dict], spans: list[dict]) -> list[dict | None]:
    """Each line's span: the next one of equal text.  A line without one uses up all the rest, and lines below have none."""
    rest = iter(spans)
    return [next((s for s in rest if s["text"] == line["text"]), None) for line in lines]


def style_groups(styles: list[dict | None]) -> dict[int, int]:
    """First line and length of each run of prominent lines whose sizes and distances agree."""
    groups, start, before = {}, 0, None
    for i, span in enumerate(styles):
        strong = span is not None and span["strong"] and span["size"] >= PROMINENT_SIZE
        if strong:
            near = before is not None and abs(before["size"] - span["size"]) <= SIZE_STEP and span["y0"] - before["y1"] <= max(before["size"], span["size"]) * GAP_SHARE
            start = start if near else i
            groups[start] = i - start + 1
        before = span if strong else None
    return groups


#: Whether a line goes into an item of this sort: (line, line before it, whether a group of styled headings begins here).
CARRIES_ON = {
    "mark": lambda line, before, styled: line["plain"] and not styled,
    "body": lambda line, before, styled: line["plain"] and not styled,
    "bullet": lambda line, before, styled: line["plain"],
    "navigation": lambda line, before, styled: line["navigation"],
    "ui_label": lambda line, before, styled: line["ui_label"],
    "warning": lambda line, before, styled: line["warning"],
    "list_item": lambda line, before, styled: line["plain"] if before["note"] else before["parted"] and line["note"],
    "heading": lambda line, before, styled: line["heads"] and not styled and before["chars"] + line["chars"] <= HEADING_CHARS,
}


def walk(lines: list[dict], spans: list[dict]) -> Iterator[tuple[str, list[str]]]:
    """The items of a text's lines (none blank): kind and the lines' texts."""
    lines = [told(line) for line in lines]
    styles = line_styles(lines, spans)
    groups = style_groups(styles)
    sort, parts, owed = "", [], 0
    for i, line in enumerate(lines):
        if owed:
            owed -= 1
            parts.append(line["text"])
        elif sort in CARRIES_ON and CARRIES_ON[sort](line, lines[i - 1], i in groups):
            parts.append(line["text"])
        else:
            if parts:
                yield "bullet" if sort == "mark" else "heading" if sort == "styled" else sort, parts
            sort, parts, owed = line["kind"], [line["text"]], 0
            if i in groups:
                sort, owed = "styled", groups[i] - 1
            elif line["text"] == T.STANDALONE_BULLET:
                sort, parts = "mark", []
            elif sort == "heading" and styles[i] is not None and (styles[i]["size"] <= SMALL_SIZE or line["quoted"]):
                sort = "body"
    if parts:
        yield "bullet" if sort == "mark" else "heading" if sort == "styled" else sort, parts


def review_items(docs: DataFrame, english: Column, spans: DataFrame | None = None) -> DataFrame:
    """doc_id, item_order (from 1), kind, text, sentences (none for headings).

    `english` says which texts are read line by line; any other is one body item.  spans: doc_id, ord, text, size, bold,
    underline, y0, y1 (y downwards) of the texts' styled lines in their order.  Blank lines are left out, and so is a bullet
    mark without text; a null or blank text has no items.  Rows of docs that share a doc_id have items each, of their own."""
    lines = F.transform(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), T.LINE_END), stripped), lambda s: s["text"] != ""), classed)
    rows = docs.select("doc_id", F.coalesce(english, F.lit(False)).alias("english"), lines.alias("lines"), T.collapsed(F.coalesce("text", F.lit(""))).alias("whole"))
    rows = rows.withColumn("lines", F.when(F.col("english"), F.col("lines")).otherwise(F.array()))
    none = F.lit(None).cast(f"array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")
    if spans is None:
        rows = rows.withColumn("spans", none)
    else:
        span = F.struct("ord", T.collapsed(F.col("text")).alias("text"), F.col("size").cast("double").alias("size"), F.coalesce(F.col("bold") | F.col("underline"), F.lit(False)).alias("strong"), F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1"))
        of_doc = spans.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(span)), lambda s: F.struct(*[s[c].alias(c) for c in ("text", "size", "strong", "y0", "y1")])).alias("spans"))
        rows = rows.join(of_doc, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "item_order": [], "kind": [], "text": [], "english": []}
            for row in batch.to_pylist():
                found = walk(row["lines"], row["spans"] or []) if row["english"] else [("body", [row["whole"]])] if row["whole"] else []
                for order, (kind, parts) in enumerate(found, 1):
                    for name, value in zip(out, (row["doc_id"], order, kind, " ".join(parts), row["english"])):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("item_order", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("english", pa.bool_())]))

    items = rows.mapInArrow(run, "doc_id long, item_order int, kind string, text string, english boolean")
    sentences = F.when(F.col("kind") == "heading", F.array().cast("array<string>")).otherwise(T.split_sentences(F.col("text"), F.col("english")))
    return items.select("doc_id", "item_order", "kind", "text", sentences.alias("sentences"))
