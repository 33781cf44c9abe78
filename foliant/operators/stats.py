"""Weighted and robust medians."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.places import written


def at_ranks(rows: DataFrame, keys: list[str], value: str, weight: str | None, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys and, for each rank (a function of the total weight), the smallest value at which the cumulative weight reaches it.

    Weights are summed for each value, and the sums dealt by ranges of key and value, so that a key with very many values is
    ordered in many tasks.  The ranges' totals, a row for each key and range, tell which range a rank lies in and what comes
    before it; only there values are counted through.  Null values and weights are left out; null keys are a key."""
    w = F.lit(1) if weight is None else F.col(weight)
    summed = rows.select(*keys, F.col(value).alias("_v"), w.alias("_w")).where("_v is not null and _w is not null").groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"))
    dealt = written(summed.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranks")
    own = Window.partitionBy(*keys)
    totals = dealt.groupBy(*keys, "_part").agg(F.sum("_w").alias("_n")).withColumns({"_upto": F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(own)})
    asked = totals.withColumn("_r", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), rank(F.col("_all")).cast("double").alias("rank")) for n, rank in ranks.items()])))
    asked = asked.where("_upto < _r.rank and _r.rank <= _upto + _n")
    match = [F.col(f"d.{k}").eqNullSafe(F.col(f"a.{k}")) for k in (*keys, "_part")]
    near = dealt.alias("d").join(asked.alias("a"), match).select(*[f"d.{k}" for k in keys], "d._part", "_v", "_w", "_upto", "_r")
    reached = F.col("_upto") + F.sum("_w").over(Window.partitionBy(*keys, "_part", "_r").orderBy("_v"))
    hit = near.withColumn("_reached", reached).where("_reached >= _r.rank")
    return hit.groupBy(*keys).agg(*[F.min(F.when(F.col("_r.name") == n, F.col("_v"))).alias(n) for n in ranks])


def weighted_median_lower(rows: DataFrame, keys: list[str], value: str, weight: str, bounded: bool = False) -> DataFrame:
    """The smallest value at which the cumulative weight reaches half of the total.

    `bounded` states that a key never has more different values than one task can order, as those of one paragraph; then they
    are ordered by a window, within the plan.  Any others go by at_ranks()."""
    if not bounded:
        return at_ranks(rows, keys, value, weight, {"median": lambda n: n / 2})
    summed = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(value)
    marked = summed.withColumns({"_cum": F.sum("_w").over(w), "_all": F.sum("_w").over(Window.partitionBy(*keys))})
    return marked.where(F.col("_cum") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias("median"))


def weighted_median_mid(rows: DataFrame, keys: list[str], value: str, weight: str | None, bounded: bool = False) -> DataFrame:
    """The mean of the two middle ranks (integer weights; without weights each value counts once)."""
    if bounded:
        middle = F.median(value) if weight is None else F.percentile(value, 0.5, F.col(weight).cast("long"))
        return rows.groupBy(*keys).agg(middle.alias("median"))
    counted = rows if weight is None else rows.withColumn("_weight", F.col(weight).cast("long"))
    both = at_ranks(counted, keys, value, weight and "_weight", {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1})
    return both.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def robust_median(rows: DataFrame, keys: list[str], value: str, weight: str, limit: float = 3 * 1.4826, distinct: bool = True, bounded: bool = False) -> DataFrame:
    """The mid weighted median of values whose log lies within `limit` median absolute deviations of the log median.

    Medians of the logs are over distinct values, or over all samples; without any deviation only the median itself stays."""
    if bounded:
        return _robust_within(rows, keys, value, weight, limit, distinct)
    logs = rows.select(*keys, F.ln(value).alias("_l"))
    logs = logs.distinct() if distinct else logs
    centre = written(weighted_median_mid(logs, keys, "_l", None).withColumnRenamed("median", "_c"), "centres")  # a row a key, which three steps read
    away_ = logs.join(centre, keys).select(*keys, F.abs(F.col("_l") - F.col("_c")).alias("_d"))
    spread = written(weighted_median_mid(away_, keys, "_d", None).withColumnRenamed("median", "_m").join(centre, keys), "spreads")
    away = F.abs(F.ln(value) - F.col("_c"))
    near = F.when(F.col("_m") < 1e-12, away < 1e-12).otherwise(away <= limit * F.col("_m"))
    marked = rows.join(spread, keys).withColumn("_near", near)
    some = marked.groupBy(*keys).agg(F.bool_or("_near").alias("_some"))
    return weighted_median_mid(marked.join(some, keys).where(F.col("_near") | ~F.col("_some")), keys, value, weight)


def _robust_within(rows: DataFrame, keys: list[str], value: str, weight: str, limit: float, distinct: bool) -> DataFrame:
    """robust_median() of keys that one task can order: windows over a key's rows, which are dealt once, and no join."""
    own = Window.partitionBy(*keys)
    first = F.row_number().over(Window.partitionBy(*keys, "_l").orderBy("_l")) == 1
    logs = rows.withColumn("_l", F.ln(value))
    logs = logs.withColumn("_s", F.when(first, F.col("_l")) if distinct else F.col("_l"))
    spread = logs.withColumn("_c", F.median("_s").over(own)).withColumn("_m", F.median(F.abs(F.col("_s") - F.col("_c"))).over(own))
    away = F.abs(F.col("_l") - F.col("_c"))
    near = F.when(F.col("_m") < 1e-12, away < 1e-12).otherwise(away <= limit * F.col("_m"))
    marked = spread.withColumn("_near", near).withColumn("_some", F.bool_or("_near").over(own))
    return weighted_median_mid(marked.where(F.col("_near") | ~F.col("_some")), keys, value, weight, bounded=True)


def robust_range(rows: DataFrame, keys: list[str], value: str, width: float = 3 * 1.4826, bounded: bool = False) -> DataFrame:
    """keys, centre (the median), mad (the median distance from it), low and high."""
    centre = weighted_median_mid(rows, keys, value, None, bounded).withColumnRenamed("median", "centre")
    centre = centre if bounded else written(centre, "centres")
    away = rows.join(centre, keys).select(*keys, F.abs(F.col(value) - F.col("centre")).alias("_d"))
    dev = weighted_median_mid(away, keys, "_d", None, bounded).withColumnRenamed("median", "mad").join(centre, keys)
    return dev.withColumns({"low": F.col("centre") - width * F.col("mad"), "high": F.col("centre") + width * F.col("mad")})


def cadence(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The most frequent positive gap (smallest, if tied)."""
    w = Window.partitionBy(*keys).orderBy(ts)
    gaps = rows.select(*keys, (F.col(ts) - F.lag(ts).over(w)).alias("gap")).where("gap > 0").groupBy(*keys, "gap").agg(F.count("*").alias("c"))
    return gaps.groupBy(*keys).agg(F.min_by("gap", F.struct((-F.col("c")).alias("c"), F.col("gap"))).alias("cadence"))
