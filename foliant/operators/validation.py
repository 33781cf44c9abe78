"""Stored display hints held against the document and against a second, independent detection.

Everything is told as rows of faults; a document without any is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.nodes import ancestry

#: Kinds of hints that make a block of what they name: no two of them may lie on, above or below one another.
BLOCK_KINDS = ("subtitle", "section_heading", "strong_label", "promoted_heading")
TOLERANCE = 1e-6


def overlapping(hints: DataFrame, keys: list[str], kinds: tuple[str, ...] = BLOCK_KINDS) -> DataFrame:
    """Hints that make blocks and have another such hint above them, or one of another kind at their own path."""
    own = hints.where(F.col("kind").isin(*kinds)).dropna(subset=keys).select(*keys, "kind", "path").distinct()
    at = Window.partitionBy(*keys, "_up")
    here = F.when(F.size("_up") == F.size("path"), F.col("kind"))
    rows = ancestry(own, keys, "kind").withColumns({"_least": F.min(here).over(at), "_most": F.max(here).over(at)})
    hit = rows.where(F.col("_least").isNotNull() & ((F.size("_up") < F.size("path")) | (F.col("_least") != F.col("kind")) | (F.col("_most") != F.col("kind"))))
    return hit.select(*keys, "kind", "path", F.lit("overlap").alias("fault")).distinct()


def told_faults(hints: DataFrame, detected: DataFrame, targets: DataFrame, keys: list[str], numbers: list[str], exact: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """What kind and path tell of hints.  unresolved: the path names nothing of the kind (targets) that they are about; repeated:
    they are there twice or more; missing: detected and not stored; extra: stored and not detected; and, for what is both, each
    column of evidence that differs between any two of them, numbers by more than the tolerance.

    All tables go under one another and are grouped once, as joins would send each around and pair repeated hints."""
    place, columns = [*keys, "kind", "path"], [*numbers, *exact]
    stored, found = F.col("_side") == "s", F.col("_side") == "d"
    side = lambda df, mark, *more: df.select(*place, F.lit(mark).alias("_side"), *more)
    rows = side(hints, "s", *columns).unionByName(side(detected, "d", *columns)).unionByName(side(targets, "t"), allowMissingColumns=True)
    told = [F.count_if(stored).alias("_n"), F.bool_or(found).alias("_d"), F.bool_or(F.col("_side") == "t").alias("_t")]
    for c in columns:
        for mark, own in (("s", stored), ("d", found)):
            told += [F.min(F.when(own, F.col(c))).alias(f"_min_{mark}_{c}"), F.max(F.when(own, F.col(c))).alias(f"_max_{mark}_{c}"), F.coalesce(F.bool_or(F.when(own, F.col(c).isNull())), F.lit(False)).alias(f"_null_{mark}_{c}")]
    one = rows.groupBy(*place).agg(*told)
    matches = F.lit(True)  # as in a join, what is null is like nothing else
    for k in place:
        matches = matches & F.col(k).isNotNull()
    is_stored, is_found, is_target = F.col("_n") > 0, F.col("_d"), F.col("_t") & matches

    def differs(c: str) -> Column:
        low, high = {m: F.col(f"_min_{m}_{c}") for m in "sd"}, {m: F.col(f"_max_{m}_{c}") for m in "sd"}
        null = {m: F.col(f"_null_{m}_{c}") for m in "sd"}
        unknown = (null["s"] & low["d"].isNotNull()) | (null["d"] & low["s"].isNotNull())
        same = (F.least(low["s"], low["d"]) == F.greatest(high["s"], high["d"])) | F.coalesce(*low.values()).isNull()
        apart = (high["s"] - low["d"] > tolerance) | (high["d"] - low["s"] > tolerance) if c in numbers else F.lit(True)
        return unknown | (~same & F.coalesce(apart, F.lit(False)))

    both = is_stored & is_found & matches
    faults = [(is_stored & ~is_target, "unresolved"), (F.col("_n") > 1, "repeated"), (is_found & ~(is_stored & matches), "missing"), (is_stored & ~(is_found & matches), "extra"), *[(both & differs(c), f"evidence:{c}") for c in columns]]
    return one.select(*place, F.explode(F.array_compact(F.array(*[F.when(when, fault) for when, fault in faults]))).alias("fault"))


def hint_faults(hints: DataFrame, detected: DataFrame, targets: DataFrame, keys: list[str], numbers: list[str], exact: list[str]) -> DataFrame:
    """keys, kind, path, fault: all that is wrong with stored hints (kind, path and columns of evidence), each fault once.

    detected: the same columns, found anew; targets: kind, path of what hints of each kind may name."""
    return told_faults(hints, detected, targets, keys, numbers, exact).unionByName(overlapping(hints, keys))
