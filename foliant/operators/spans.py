"""Styled spans: heading groups, matching spans to lines, typography, label groups, physical starts of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import stats

# Limits in points, or as a share of the font size.
PROMINENT_SIZE = 9.0
SIZE_STEP = 0.75
GAP_SHARE = 0.75
SMALL_SIZE = 7.25


def heading_groups(spans: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adjacent prominent spans (bold or underlined, large enough) whose size and line distance agree, as one heading each.  The
    distance is measured against the larger of both sizes.

    spans: text, size, bold, underline, y0, y1 (y downwards).  Gives keys, grp, n_spans, size, text."""
    w = Window.partitionBy(*keys).orderBy(order)
    strong = F.coalesce((F.col("size") >= PROMINENT_SIZE) & (F.col("bold") | F.col("underline")), F.lit(False))
    rows = spans.withColumn("_strong", strong)
    on = F.lag("_strong").over(w) & (F.abs(F.col("size") - F.lag("size").over(w)) <= SIZE_STEP) & (F.col("y0") - F.lag("y1").over(w) <= F.greatest("size", F.lag("size").over(w)) * GAP_SHARE)
    rows = rows.withColumn("_new", (~F.coalesce(F.col("_strong") & on, F.lit(False))).cast("int")).withColumn("grp", F.sum("_new").over(w)).where("_strong")
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return rows.groupBy(*keys, "grp").agg(F.count("*").alias("n_spans"), F.max("size").alias("size"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def matched(lines: DataFrame, spans: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each line with the columns of the span of equal text: the n-th line of a text takes its n-th span.

    A line without such a span has nulls; it does not keep later lines from theirs."""
    nth = F.row_number().over(Window.partitionBy(*keys, "text").orderBy(order))
    right = spans.withColumn("_nth", nth).select(*keys, "text", "_nth", *columns)
    return lines.withColumn("_nth", nth).join(right, [*keys, "text", "_nth"], "left").drop("_nth")


def typography(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, valid, weight, size, lines of a node: medians weighted by visible characters (lower rank).

    fragments: text, weight, size, page, mcid.  A visible fragment without weight or size makes the node invalid, and
    its medians null."""
    seen = fragments.withColumn("_n", F.length(F.regexp_replace("text", r"\s+", ""))).where("_n > 0")
    base = seen.groupBy(*keys).agg(F.every(F.col("weight").isNotNull() & F.col("size").isNotNull()).alias("valid"), F.count_distinct("page", "mcid").alias("lines"))
    medians = base
    for what in ("weight", "size"):
        m = stats.weighted_median_lower(seen.where(F.col(what).isNotNull()), keys, what, "_n", bounded=True).withColumnRenamed("median", what)
        medians = medians.join(m, keys, "left")
    return medians.select(*keys, "valid", *[F.when(F.col("valid"), F.col(c)).alias(c) for c in ("weight", "size")], "lines")


def label_groups(rows: DataFrame, keys: list[str], order: str, tier: str, label: Column) -> DataFrame:
    """Labels and the weaker rows behind each, up to the next label of the same tier or a row that is not weaker.

    tier is higher for stronger rows.  Gives keys, label_ord, tier, n_details."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_label", F.coalesce(label, F.lit(False)))
    marked = marked.withColumns({"label_ord": F.last(F.when(F.col("_label"), F.col(order)), ignorenulls=True).over(w), "_tier": F.last(F.when(F.col("_label"), F.col(tier)), ignorenulls=True).over(w)})
    group = Window.partitionBy(*keys, "label_ord").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weaker = F.col("_label") | F.coalesce(F.col(tier) < F.col("_tier"), F.lit(False))
    kept = marked.where("label_ord is not null").withColumn("_unbroken", F.every(weaker).over(group)).where("_unbroken")
    return kept.groupBy(*keys, "label_ord").agg(F.max("_tier").alias("tier"), F.count_if(~F.col("_label")).alias("n_details"))


def physical_starts(bookmarks: DataFrame, pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Each bookmark's start, moved back to the first page behind the previous bookmark that shows its script.

    bookmarks: doc, ordinal, start.  pages: doc, page, shows (boolean).  Pages are assigned to the gap that they lie in
    by one union and one window."""
    w = Window.partitionBy(doc).orderBy("ordinal")
    b = bookmarks.select(doc, "ordinal", "start", F.lag("start").over(w).alias("_before"))
    ends = b.select(doc, F.col("start").alias("_at"), "ordinal", F.lit(1).alias("_rank"))
    shown = pages.where("shows").select(doc, F.col(page).alias("_at"), F.lit(None).cast(b.schema["ordinal"].dataType).alias("ordinal"), F.lit(0).alias("_rank"))
    ahead = Window.partitionBy(doc).orderBy("_at", "_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = ends.unionByName(shown).withColumn("ordinal", F.first("ordinal", ignorenulls=True).over(ahead)).where("_rank = 0 and ordinal is not null")
    joined = b.join(placed.select(doc, "ordinal", "_at"), [doc, "ordinal"], "left")
    first = F.min(F.when(F.col("_before").isNull() | (F.col("_at") > F.col("_before")), F.col("_at")))
    out = joined.groupBy(doc, "ordinal", "start").agg(first.alias("_first"))
    return out.select(doc, "ordinal", "start", F.coalesce(F.least("_first", "start"), F.col("start")).alias("physical_start"))
