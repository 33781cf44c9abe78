"""Ordered sequences: series audits, intervals, contiguity, adjacent duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_audit(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Whether a key's labels are 1..n without gaps or repeats (two at least)."""
    w = Window.partitionBy(*keys).orderBy(label)
    ranked = rows.select(*keys, label, F.row_number().over(w).alias("expected"))
    good = F.every(F.col(label) == F.col("expected")) & (F.count("*") >= 2)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), good.alias("valid"), F.min(F.when(F.col(label) != F.col("expected"), F.col("expected"))).alias("first_gap"))


def split_series(rows: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """Adds `series`, which rises at each row that starts one; rows before the first are series 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("series", F.sum(starts.cast("int")).over(w))


def bounds(starts: DataFrame, keys: list[str], start: str, last: Column) -> DataFrame:
    """Each interval ends before the next one starts, the last at `last`; none ends before it starts."""
    w = Window.partitionBy(*keys).orderBy(start)
    return starts.withColumn("end", F.greatest(F.col(start), F.coalesce(F.lead(start).over(w) - 1, last)))


def ordered_without_overlap(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(start)
    fine = F.coalesce(F.col(start) > F.lag(end).over(w), F.lit(True))
    return intervals.withColumn("_fine", fine).groupBy(*keys).agg(F.every("_fine").alias("ordered"), F.count("*").alias("n"))


def contiguous(rows: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Per key and label: whether the label is one unbroken run, and its bounds."""
    from foliant.operators.lines import islands

    marked = islands(rows.select(*keys, order, label), keys, order, [label])
    return marked.groupBy(*keys, label).agg(F.count_distinct("island").alias("n_runs"), F.min(order).alias("first"), F.max(order).alias("last")).withColumn("contiguous", F.col("n_runs") == 1)


def without_adjacent_copies(rows: DataFrame, keys: list[str], order: str, same: list[str]) -> DataFrame:
    """Drops a row that equals its predecessor in all of `same`."""
    w = Window.partitionBy(*keys).orderBy(order)
    now = F.struct(*same)
    return rows.withColumn("_was", F.lag(now).over(w)).where(F.col("_was").isNull() | (F.col("_was") != now)).drop("_was")


def confirmed_runs(rows: DataFrame, keys: list[str], ts: str, flag: str, cadence: Column, least: int) -> DataFrame:
    """Runs of at least `least` true rows at the exact cadence: key, start, confirmed (the least-th row), length."""
    w = Window.partitionBy(*keys).orderBy(ts)
    linked = F.coalesce(F.col(flag) & F.lag(flag).over(w) & (F.col(ts) - F.lag(ts).over(w) == cadence), F.lit(False))
    marked = rows.withColumn("_new", (~linked).cast("int")).withColumn("_run", F.sum("_new").over(w)).where(flag)
    return (
        marked.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(ts)))
        .groupBy(*keys, "_run").agg(F.min(ts).alias("start"), F.min(F.when(F.col("_at") == least, F.col(ts))).alias("confirmed"), F.count("*").alias("length"))
        .where(F.col("length") >= least).drop("_run")
    )


def membership(rows: DataFrame, keys: list[str], order: str, starts: Column) -> DataFrame:
    """rows with interval: the start (a place in order) of the interval that a row lies in; null before the first.

    Intervals tile the order from each row that starts one, so a window finds them without a range join."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("interval", F.last(F.when(starts, F.col(order)), ignorenulls=True).over(w))


def set_membership(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys, interval: the one interval that all rows of a key lie in; null if they lie in several, or one in none."""
    one = (F.count("*") == F.count(member)) & (F.min(member) == F.max(member))
    return rows.groupBy(*keys).agg(F.when(one, F.min(member)).alias("interval"))


def spans(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, n_intervals, longest."""
    return intervals.groupBy(*keys).agg(F.count("*").alias("n_intervals"), F.max(F.col(end) - F.col(start)).alias("longest"))


def beside(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with before and after: the value of the siblings on either side."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({"before": F.lag(value).over(w), "after": F.lead(value).over(w)})
