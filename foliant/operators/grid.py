"""Spans on a page: grid cells, reading order, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T


def binned(spans: DataFrame, width: float, height: float, rows: int, columns: int) -> DataFrame:
    """Adds row and col (from 1) of the cell in which a span's middle lies, clamped to the grid."""
    at = lambda low, high, size, n: F.least(F.floor((F.col(low) + F.col(high)) / 2 / (size / n)) + 1, F.lit(n)).cast("int")
    return spans.withColumns({"row": at("y0", "y1", height, rows), "col": at("x0", "x1", width, columns)})


def reading_order(row: Column, col: Column, columns: int, right_to_left: Column) -> Column:
    return ((row - 1) * columns + F.when(right_to_left, columns - col + 1).otherwise(col)).cast("int")


def cells(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell: spans, union of the boxes, text in span order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda s: s["text"]), "\n")
    return spans.groupBy(*keys).agg(F.count("*").alias("n_spans"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"))


# Where a page's language label stands, in points.
LABEL_TOP, LABEL_SIDE = 50.0, 80.0


def corner_labels(spans: DataFrame, keys: list[str], order: str, width: float) -> DataFrame:
    """keys, label: the last language label in a page's upper left corner, else the last in the upper right one.

    spans: text (trimmed), x0, x1, y0.  Pages without such a label have no row."""
    label = spans.where((F.col("text") != "") & (F.col("y0") < LABEL_TOP) & T.is_language_label(F.col("text")))
    left = F.col("x0") < LABEL_SIDE
    last = lambda when: F.max(F.when(when, F.struct(order, "text")))["text"]
    return label.groupBy(*keys).agg(F.coalesce(last(left), last(~left & (F.col("x1") > width - LABEL_SIDE))).alias("label"))
