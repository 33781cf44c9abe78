"""Saved reviews: a JSON file of a document's pages, cells and items as flat tables; page texts as one baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<item_order: int, kind: string, text: string>"
CELL = f"struct<row: int, column: int, role: string, reading_order: int, text: string, review_items: array<{ITEM}>>"
PAGE = f"struct<page_number: int, review_order: int, language: string, page_role: string, cells: array<{CELL}>>"
SCHEMA = f"file_name string, source_token string, language string, doc_type string, pages array<{PAGE}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a saved review (a JSON document a file), with its pages nested."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def cells(reviews: DataFrame) -> DataFrame:
    """A row for each cell of each page."""
    p = reviews.select("file_name", F.explode("pages").alias("p"))
    c = p.select("file_name", "p.page_number", "p.review_order", "p.language", "p.page_role", F.explode("p.cells").alias("c"))
    return c.select("file_name", "page_number", "review_order", "language", "page_role", "c.*")


def items(reviews: DataFrame) -> DataFrame:
    """A row for each item of each cell; items without a number, as other languages' have, are numbered by place."""
    c = cells(reviews).select("file_name", "page_number", "review_order", "row", "column", "role", "reading_order", F.posexplode("review_items").alias("_at", "i"))
    at = F.coalesce("i.item_order", F.col("_at") + 1)
    return c.select("file_name", "page_number", "review_order", "row", "column", F.col("role").alias("cell_role"), F.col("reading_order").alias("cell_order"), at.alias("item_order"), "i.kind", "i.text")


def baselines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the texts of a document's pages (page, text) in order, a line end between two; null pages are empty."""
    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))
