"""Ordered lines of documents: runs, headings filled forward, sections.  Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, ord, line (collapsed) of each line of each document."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "raw")).select("doc_id", "ord", T.collapsed(F.col("raw")).alias("line"))


def kinds(docs: DataFrame) -> DataFrame:
    return lines(docs).withColumn("kind", T.line_kind(F.col("line")))


def islands(rows: DataFrame, keys: list[str], order: str, same: list[str]) -> DataFrame:
    """Adds `island`: the running number of maximal runs of rows that agree in `same`."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("_new", (new | F.lag(order).over(w).isNull()).cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new")


def runs(docs: DataFrame) -> DataFrame:
    """Consecutive lines of one kind as one item, text joined in order."""
    rows = islands(kinds(docs), ["doc_id"], "ord", ["kind"])
    return rows.groupBy("doc_id", "island", "kind").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"]), " ").alias("item"))


def sections(docs: DataFrame) -> DataFrame:
    """Each line with its section: number (1 before the first heading too) and heading filled forward."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    h = F.col("kind") == "heading"
    return kinds(docs).withColumns({"section": F.greatest(F.sum(h.cast("int")).over(w), F.lit(1)), "heading": F.coalesce(F.last(F.when(h, F.col("line")), ignorenulls=True).over(w), F.lit("UNSECTIONED"))})


def section_rollup(docs: DataFrame) -> DataFrame:
    """Lines, characters and lines for review of each (section, heading)."""
    review = F.col("kind").isin("warning", "navigation", "ui_label")
    return sections(docs).groupBy("doc_id", "section", "heading").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.count_if(review).alias("n_review"), F.min("ord").alias("first_ord"))


def text_quality(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the texts' number, characters, characters that XML does not allow, and short texts."""
    return docs.groupBy(*keys).agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.sum(T.forbidden_characters(F.col("text"))).alias("n_forbidden"), F.count_if(F.length("text") < 200).alias("n_short"))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each different value of the keys once, with the place where it comes first."""
    return rows.groupBy(*keys).agg(F.min(order).alias(f"first_{order}"))


def in_first_seen_order(rows: DataFrame, keys: list[str], value: str, order: str, when: Column) -> DataFrame:
    """keys, found: the different values of rows for which `when` holds, in the order in which they come first."""
    once = rows.where(when).groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("found"))
