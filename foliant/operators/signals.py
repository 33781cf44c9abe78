"""Two time series: alignment, rolling measures, decoupling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """series, hour (of the epoch), v: mean value of each event type and hour."""
    return events.groupBy(F.col("event_type").alias("series"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("hour")).agg(F.avg("value").alias("v"))


def aligned(rows: DataFrame, first: str, second: str) -> DataFrame:
    a, b = (rows.where(F.col("series") == s).select("hour", F.col("v").alias(n)) for s, n in ((first, "a"), (second, "b")))
    return a.join(b, "hour")


def rolling(pair: DataFrame, size: int) -> DataFrame:
    """Mean, population deviation and correlation of the last `size` rows; null until the window is full.

    One series pair is one ordered sequence, hourly, so it is small whatever the events."""
    w = Window.partitionBy(F.lit(1)).orderBy("hour").rowsBetween(1 - size, 0)
    full = F.count("*").over(w) == size
    return pair.withColumns({"mean_a": F.when(full, F.avg("a").over(w)), "sd_a": F.when(full, F.stddev_pop("a").over(w)), "corr_ab": F.when(full & (F.stddev_pop("a").over(w) > 0) & (F.stddev_pop("b").over(w) > 0), F.corr("a", "b").over(w))})


def decoupled(pair: DataFrame, size: int, below: float) -> DataFrame:
    return rolling(pair, size).withColumn("decoupled", F.coalesce(F.col("corr_ab") < below, F.lit(False)))


def best_lag(pair: DataFrame, most: int) -> DataFrame:
    """The lag at which the series correlate most; ties: smaller absolute lag, then the positive one."""
    lags = pair.select("hour", "a", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag")).withColumn("other", F.col("hour") + F.col("lag"))
    both = lags.join(pair.select(F.col("hour").alias("other"), "b"), "other").groupBy("lag").agg(F.count("*").alias("n"), F.corr("a", "b").alias("corr")).where("n >= 3 and corr is not null")
    return both.orderBy(F.desc("corr"), F.abs("lag"), F.desc("lag")).limit(1)


def sign_changes(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with diff, the step from the row before, and crossed: whether the step's sign is the other one than the last's."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = rows.withColumn("diff", F.col(value) - F.lag(value).over(w))
    return out.withColumn("crossed", F.coalesce(F.signum("diff") * F.signum(F.lag("diff").over(w)) < 0, F.lit(False)))
