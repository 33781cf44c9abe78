"""Numbered chapters and list continuations: candidates, series, typography, promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import stats
from foliant.operators.sequences import split_series

# The policy's limits.
LABEL = r"^(?:0[1-9]|[1-9][0-9])$"
MAX_SIZE_DIFFERENCE = 0.10
MIN_HEADING_RATIO = 1.5
TOLERANCE = 1e-12
LEFT_SHARE, GAP_SHARE, GAP_LOCAL, BLOCK_GAP = 0.25, 0.25, 0.5, 1.0
LETTER_OR_ROMAN = r"(?:[a-z]|(?=[ivx])x{0,2}(?:ix|iv|v?i{0,3}))"
VISIBLE_MARKER = (
    r"(?i)^\s*(?:[-*+](?=\s|$)|[•◦▪▫‣⁃●○■□]|#{1,6}(?=\s)|\d{1,3}(?=\s)|\(?\d{1,3}(?:[.)]|(?:\.\d+)+)"
    rf"|(?:\({LETTER_OR_ROMAN}\)|{LETTER_OR_ROMAN}[.)])(?=\s|$))"
)


def same(a: Column, b: float) -> Column:
    return F.abs(a - b) <= TOLERANCE * F.greatest(F.abs(a), F.lit(abs(b)))


def candidates(children: DataFrame, keys: list[str]) -> DataFrame:
    """List items with exactly one label and one body (children: keys, role, text, size): keys, label, title and sizes."""
    of = lambda role, what: F.max(F.when(F.col("role") == role, F.col(what)))
    one = children.groupBy(*keys).agg(
        F.count_if(F.col("role") == "label").alias("_labels"), F.count_if(F.col("role") == "list_body").alias("_bodies"),
        of("label", "text").alias("label"), of("list_body", "text").alias("title"), of("label", "size").alias("label_size"), of("list_body", "size").alias("title_size"),
    )
    return one.where("_labels = 1 and _bodies = 1").where(F.col("label").rlike(LABEL) & (F.col("title") != "")).drop("_labels", "_bodies")


def with_series(found: DataFrame, doc: str, order: str) -> DataFrame:
    """Adds series: it rises at each label 01; labels before the first 01 form a series of their own.  Counts from 0."""
    s = split_series(found, [doc], order, F.col("label") == "01")
    return s.withColumn("series", (F.col("series") - F.min("series").over(Window.partitionBy(doc))).cast("int"))


def audit(series: DataFrame, doc: str, order: str) -> DataFrame:
    """doc, series, n, first and next start, and whether the labels are 01..n with two at least."""
    w = Window.partitionBy(doc, "series").orderBy(order)
    marked = series.withColumn("_good", F.col("label") == F.lpad(F.row_number().over(w).cast("string"), 2, "0"))
    a = marked.groupBy(doc, "series").agg(F.count("*").alias("n"), F.min(order).alias("start"), (F.every("_good") & (F.count("*") >= 2)).alias("valid"))
    return a.withColumn("next_start", F.lead("start").over(Window.partitionBy(doc).orderBy("series")))


def consistency(audits: DataFrame, doc: str) -> DataFrame:
    """doc, consistent: whether valid series are equally long; null below two of them."""
    n = F.when(F.col("valid"), F.col("n"))
    return audits.groupBy(doc).agg(F.when(F.count(n) >= 2, F.count_distinct(n) == 1).alias("consistent"))


def outcome(label_size: Column, title_size: Column, body_size: Column) -> Column:
    """promoted, or the diagnostic that says why not."""
    difference = F.abs(label_size - title_size) / F.greatest(label_size, title_size)
    ratio = F.least(label_size, title_size) / body_size
    missing = label_size.isNull() | title_size.isNull() | body_size.isNull()
    return (
        F.when(missing, "typography_insufficient")
        .when((difference > MAX_SIZE_DIFFERENCE) & ~same(difference, MAX_SIZE_DIFFERENCE), "label_body_size_mismatch")
        .when((ratio < MIN_HEADING_RATIO) & ~same(ratio, MIN_HEADING_RATIO), "font_ratio_below_threshold").otherwise("promoted")
    )


def promotions(found: DataFrame, body: DataFrame, doc: str, order: str) -> DataFrame:
    """Each candidate with series, body_size (lower weighted median of the body samples in the series' extent) and outcome.

    body has doc, order, size, weight, without the candidates' own samples.  A sample belongs to the last series that
    starts at or before it: one union and one window instead of a range join."""
    series = with_series(found, doc, order)
    audits = audit(series, doc, order)
    starts = audits.select(doc, F.col("start").alias(order), "series", F.lit(0).alias("_rank"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("long").alias("weight"))
    samples = body.select(doc, order, F.lit(None).cast("int").alias("series"), F.lit(1).alias("_rank"), F.col("size").cast("double"), F.col("weight").cast("long"))
    w = Window.partitionBy(doc).orderBy(order, "_rank")
    placed = starts.unionByName(samples).withColumn("series", F.last("series", ignorenulls=True).over(w)).where("_rank = 1 and series is not null and size is not null")
    sizes = stats.weighted_median_lower(placed, [doc, "series"], "size", "weight", bounded=True).withColumnRenamed("median", "body_size")
    full = series.join(audits.select(doc, "series", "valid"), [doc, "series"]).join(sizes, [doc, "series"], "left")
    verdict = F.when(~F.col("valid"), "sequence_invalid").otherwise(outcome(F.col("label_size"), F.col("title_size"), F.col("body_size")))
    return full.withColumn("outcome", verdict)


def continuations(siblings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Paragraphs between two lists that carry on the item before them.

    siblings: role, text, page, language, size, weight, x0, y0, y1 (y upwards), and of a list its last item's body
    (body_x0, body_y0, spacing) and marker (marker_x0).  Blank siblings do not count.  The three share page and
    language; size and weight equal the item's; the left edge is the body's and not the marker's; the gap below the
    item is close to its line spacing and less than a line of its own."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = siblings.where(F.coalesce(F.btrim("text") != "", F.lit(False)))
    before = lambda c: F.lag(c).over(w)
    after = lambda c: F.lead(c).over(w)
    names = ("role", "page", "language", "size", "weight", "body_x0", "body_y0", "spacing", "marker_x0")
    rows = rows.withColumns({f"_b_{c}": before(c) for c in names} | {f"_a_{c}": after(c) for c in ("role", "page", "language")})
    c = F.col
    left, gap = c("x0") - c("_b_body_x0"), c("_b_body_y0") - c("y1")
    shape = (c("_b_role") == "list") & (c("role") == "paragraph") & (c("_a_role") == "list") & ~c("text").rlike(VISIBLE_MARKER)
    place = (c("_b_page") == c("page")) & (c("_a_page") == c("page")) & (c("_b_language") == c("language")) & (c("_a_language") == c("language"))
    kind = (c("_b_size") == c("size")) & (c("_b_weight") == c("weight"))
    edge = (F.abs(left) <= c("size") * LEFT_SHARE) & (F.abs(c("x0") - c("_b_marker_x0")) > c("size") * LEFT_SHARE)
    near = (gap >= 0) & (F.abs(gap - c("_b_spacing")) <= F.greatest(c("size") * GAP_SHARE, c("_b_spacing") * GAP_LOCAL)) & (gap < c("size") * BLOCK_GAP)
    hit = rows.where(shape & place & kind & edge & near)
    return hit.select(*keys, order, left.alias("left_delta"), gap.alias("vertical_gap"))


def review_order(pages: DataFrame, doc: str, page: str, section: str, backwards: Column) -> DataFrame:
    """Adds review_order (from 1) and page_role: pages before the sections, each section (backwards: from its last page),
    pages behind, then pages between sections that belong to none.  section is null for such pages."""
    all_pages = Window.partitionBy(doc)
    inside = F.when(F.col(section).isNotNull(), F.col(page))
    rows = pages.withColumns({"_low": F.min(inside).over(all_pages), "_high": F.max(inside).over(all_pages)})
    own = F.col(section).isNotNull()
    bucket = F.when(own, 1).when(F.col("_low").isNull() | (F.col(page) < F.col("_low")), 0).when(F.col(page) > F.col("_high"), 2).otherwise(3)
    along = F.when(own & backwards, -F.col(page)).otherwise(F.col(page))
    rows = rows.withColumns({"_bucket": bucket, "_along": along})
    order = Window.partitionBy(doc).orderBy("_bucket", F.when(own, F.col(section)), "_along")
    part = Window.partitionBy(doc, section).orderBy("_along")
    first, last = F.row_number().over(part) == 1, F.lead(page).over(part).isNull()
    role = F.when(~own, "book_unassigned").when(first, "section_front_cover").when(last, "section_back_cover").otherwise("content")
    return rows.withColumns({"review_order": F.row_number().over(order), "page_role": role}).drop("_low", "_high", "_bucket", "_along")
