"""Document trees as node tables: sections from outlines, fragments, inherited and subtree values, paragraph rules, geometry,
siblings, intervals of languages, and hints.

A node has keys (of its document) and path, an array of places from the root; a fragment's path ends in its own place.  Arrays
compare place by place, so ordering by path is document order, and a prefix is an ancestor."""

from __future__ import annotations

from heapq import heappop, heappush
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from foliant.functions import text as T
from foliant.operators.tree import is_under
from foliant.sources.places import written

# Languages by the titles of their bookmarks, and those written from right to left.
BOOKMARK_LANGUAGES = {
    "English": "ENG", "Français": "FRA", "Español": "SPA", "Português": "POR", "العربية": "ARA", "Русский": "RUS", "Қазақ": "KAZ", "Монгол": "MON", "Кыргызча": "KYR", "Deutsch": "DEU", "Svenska": "SWE", "Dansk": "DAN",
    "Norsk": "NOR", "Suomi": "FIN", "Català": "CAT", "Galego": "GLG", "Euskara": "EUS", "Magyar": "HUN", "Polski": "POL", "Ελληνικά": "GRE", "Български": "BUL", "Hrvatski": "CRO", "Čeština": "CZE", "Slovenčina": "SLK",
    "Română": "ROM", "Srpski": "SER", "Shqip": "ALB", "Македонски": "MKD", "Slovenščina": "SLV", "Latviešu": "LAT", "Lietuvių kalba": "LTU", "Eesti": "EST", "Italiano": "ITA", "Nederlands": "DUT",
}
RTL_LANGUAGES = ("ARA", "HEB")
INLINE_ROLES = ("span", "link")
FLOW_CONTAINERS, FLOW_BARRIERS = ("list_body", "table_cell"), ("list", "table", "heading", "caption", "label", "figure")
DISPLAY_ROLES = ("subtitle", "strong_label", "strong-label", "section_heading", "section-heading")


def prefixes(path: Column, least: int = 1, below: int = 0) -> Column:
    """The prefixes of a path from length `least` up to its own less `below`."""
    n = F.size(path) - below
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), F.greatest(n, F.lit(least))), lambda i: F.slice(path, F.lit(1), i))).otherwise(F.array().cast("array<array<int>>"))


def ancestry(rows: DataFrame, keys: list[str], *columns: str, below: int = 0) -> DataFrame:
    """A row for each node at or above each row: keys, _up (its path), path and the columns."""
    return rows.select(*keys, "path", *columns, F.explode(prefixes(F.col("path"), below=below)).alias("_up"))


def outline_sections(toc: DataFrame, lengths: DataFrame, doc: str, languages: dict[str, str] = BOOKMARK_LANGUAGES, physical: DataFrame | None = None) -> DataFrame:
    """doc, reading_order, level, title, language, start_page, end_page, direction, bookmark_page of each bookmark's section.

    toc: doc, ordinal, level, title, page; blank titles and pages below 1 are left out.  A section ends before the next
    begins, the last with the document (lengths: doc, page_count).  physical (doc, reading_order, start) moves starts."""
    title = F.btrim("title")
    rows = toc.where((title != "") & (F.col("page") > 0)).withColumn("title", title)
    w = Window.partitionBy(doc).orderBy("ordinal")
    rows = rows.withColumn("reading_order", F.row_number().over(w)).join(lengths, doc)
    told = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    start = F.col("page")
    if physical is not None:
        rows = rows.join(physical.select(doc, "reading_order", F.col("start").alias("_moved")), [doc, "reading_order"], "left")
        start = F.coalesce("_moved", "page")
    rows = rows.withColumns({"start_page": start, "language": F.coalesce(told[F.col("title")], F.col("title"))})
    after = Window.partitionBy(doc).orderBy("reading_order")
    end = F.greatest(F.col("start_page"), F.coalesce(F.lead("start_page").over(after) - 1, F.col("page_count")))
    direction = F.when(F.col("language").isin(*RTL_LANGUAGES), "rtl").otherwise("ltr")
    return rows.select(doc, "reading_order", "level", "title", "language", "start_page", end.cast("int").alias("end_page"), direction.alias("direction"), F.col("page").alias("bookmark_page"))


def page_owners(spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first, last, place) of the stretches of pages that spans (two pages, both included) hold, each with the last span, by
    its place in the list, that holds it.  A sweep over the pages at which spans begin and end."""
    begins = sorted((min(s), -i) for i, s in enumerate(spans))
    ends = [max(s) for s in spans]
    edges = sorted({a for a, _ in begins} | {e + 1 for e in ends})
    out: list[tuple[int, int, int]] = []
    open_: list[int] = []  # places, negated: the last is on top
    at = 0
    for page, behind in pairwise(edges):
        while at < len(begins) and begins[at][0] <= page:
            heappush(open_, begins[at][1])
            at += 1
        while open_ and ends[-open_[0]] < page:
            heappop(open_)
        if open_:
            out.append((page, behind - 1, -open_[0]))
    return out


OWNERS = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("place", IntegerType())]))


@pandas_udf(OWNERS)
def owners_of_pages(spans: pd.Series) -> pd.Series:
    return pd.Series([[{"first": a, "last": b, "place": i} for a, b, i in page_owners([(s["a"], s["b"]) for s in x])] for x in spans], dtype=object)


PAGE_BLOCK = 256  # pages that the rows of many documents repeat in turn: a file's page of 20,000 rows then holds them some 80 times
PAGES_A_TASK = 1 << 22


def section_of_pages(sections: DataFrame, doc: str) -> DataFrame:
    """doc, page, reading_order, language: the section of each page; of several that hold a page the last counts.

    Which section counts is decided for stretches of pages, from a document's sections in one array; they are written, and
    their pages counted.  Single pages are made last, so that none is sorted or sent anywhere.  There may be thousands for each
    section, so stretches are cut into blocks and go by block, then document: as a file, rows in which all other columns stay
    and equal runs of pages return pack into a small part of what a document's pages in a row take."""
    known = sections.where("start_page is not null and end_page is not null")
    own = known.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("reading_order", "start_page", "end_page", "language"))).alias("_s"))
    spans = F.transform("_s", lambda s: F.struct(s["start_page"].cast("int").alias("a"), s["end_page"].cast("int").alias("b")))
    # no document is without stretches; as an outer one, this does not have Spark look for such with a second call of the function
    parts = own.withColumn("_o", owners_of_pages(spans)).select(doc, "_s", F.explode_outer("_o").alias("_o"))
    told = written(parts.select(doc, F.get("_s", F.col("_o.place")).alias("_s"), F.col("_o.first").alias("_a"), F.col("_o.last").alias("_b")).select(doc, "_a", "_b", "_s.reading_order", "_s.language"), "page-stretches")
    block = lambda c: F.floor(F.col(c) / PAGE_BLOCK)
    cut = told.select("*", F.explode(F.sequence(block("_a"), block("_b"))).alias("_block"))
    n = told.agg(F.coalesce(F.sum(F.col("_b").cast("long") - F.col("_a") + 1), F.lit(0))).first()[0]
    dealt = cut.repartitionByRange(max(int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PAGES_A_TASK)), "_block", doc, "_a").sortWithinPartitions("_block", doc, "_a")
    first, last = F.greatest(F.col("_a"), F.col("_block") * PAGE_BLOCK), F.least(F.col("_b"), F.col("_block") * PAGE_BLOCK + PAGE_BLOCK - 1)
    pages = dealt.select(doc, F.explode(F.sequence(first, last)).alias("page"), "reading_order", "language")
    return pages.withColumn("page", F.col("page").cast(sections.schema["start_page"].dataType))


def resolved_fragments(references: DataFrame, texts: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """References (keys, path, page, mcid) with the parts that their page holds for their id, and how that went: found,
    empty (the page has the id, without text) or unresolved, which is a diagnostic.

    texts: keys, page, mcid, parts; seen: keys, page, mcid, of which each is one row an id."""
    at = [*keys, "page", "mcid"]
    out = references.join(texts.select(*at, "parts"), at, "left").join(seen.select(*at).distinct().withColumn("_seen", F.lit(True)), at, "left")
    how = F.when(F.col("parts").isNotNull(), "found").when(F.coalesce("_seen", F.lit(False)), "empty").otherwise("unresolved")
    return out.select(*keys, "path", "page", "mcid", F.coalesce("parts", F.array().cast("array<string>")).alias("parts"), how.alias("resolution"))


def parted(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each part of a fragment with its style and box: keys, path, part, text, and those of the arrays sizes, boxes.

    An array that is neither empty nor as long as the parts makes the fragment invalid: its rows have null there and
    valid is false."""
    n = F.size("parts")
    fits = lambda c: (F.size(c) == n) | (F.size(c) == 0)
    rows = fragments.select(*keys, "path", (fits("sizes") & fits("boxes")).alias("valid"), "sizes", "boxes", F.posexplode("parts").alias("part", "text"))
    at = lambda c: F.when(F.col("valid"), F.get(F.col(c), F.col("part")))
    return rows.select(*keys, "path", "part", "text", "valid", at("sizes").alias("size"), at("boxes").alias("box"))


def visited(nodes: DataFrame, keys: list[str], *inherit: str) -> DataFrame:
    """nodes with visit_index (document order, from 0) and, for each column to inherit, the value of the nearest node at or
    above that has one, as inherited_<column>."""
    out = nodes.withColumn("visit_index", F.row_number().over(Window.partitionBy(*keys).orderBy("path")) - 1)
    for c in inherit:
        known = nodes.where(F.col(c).isNotNull()).select(*keys, F.col("path").alias("_up"), F.col(c).alias("_value"))
        found = ancestry(nodes, keys).join(known, [*keys, "_up"]).groupBy(*keys, "path").agg(F.max_by("_value", F.size("_up")).alias(f"inherited_{c}"))
        out = out.join(found, [*keys, "path"], "left")
    return out


def single_values(nodes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, path, single: the one value that a node and all below it have, inherited ones counted; null if they have
    several, or one of them has none."""
    value = visited(nodes, keys, column).select(*keys, "path", F.col(f"inherited_{column}").alias("_v"))
    up = ancestry(value, keys, "_v")
    one = F.every(F.col("_v").isNotNull()) & (F.min("_v") == F.max("_v"))
    return up.groupBy(*keys, F.col("_up").alias("path")).agg(F.when(one, F.min("_v")).alias("single")).join(nodes.select(*keys, "path"), [*keys, "path"], "left_semi")


def subtree_pages(nodes: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, pages (sorted), page: the pages that a node and all below it claim, and the page if it is one.

    nodes: path, page (may be null); fragments: path, page."""
    claims = nodes.where("page is not null").select(*keys, "path", "page").unionByName(fragments.select(*keys, F.expr("slice(path, 1, size(path) - 1)").alias("path"), "page"))
    got = ancestry(claims, keys, "page").groupBy(*keys, F.col("_up").alias("path")).agg(F.array_sort(F.collect_set("page")).alias("pages"))
    out = nodes.select(*keys, "path").join(got, [*keys, "path"], "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<int>")))
    return out.withColumn("page", F.when(F.size("pages") == 1, F.get("pages", F.lit(0))))


def in_path_intervals(nodes: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with the ordinal of the interval that holds their path, from its start to its end or anything below its end;
    null outside.

    intervals: keys, ordinal, start_path, end_path, which do not overlap.  The last interval that starts at or before a path
    is the only one that can hold it: a union and a window, in which nodes keep their columns, instead of a range join."""
    starts = intervals.select(*keys, F.col("start_path").alias("path"), F.lit(0).alias("_rank"), F.struct("ordinal", "end_path").alias("_i"))
    w = Window.partitionBy(*keys).orderBy("path", "_rank")
    both = nodes.withColumn("_rank", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    placed = both.withColumn("_i", F.last("_i", ignorenulls=True).over(w)).where("_rank = 1")
    inside = (F.col("path") <= F.col("_i.end_path")) | is_under(F.col("path"), F.col("_i.end_path"))
    return placed.select(*nodes.columns, F.when(inside, F.col("_i.ordinal")).alias("ordinal"))


def inline_paragraphs(nodes: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path of the paragraphs that hold text through inline wrappers only.

    nodes: path, role, actual_text; fragments: path, text."""
    own = nodes.where("role = 'paragraph'").dropna(subset=[*keys, "path"]).select(*keys, F.col("path").alias("_up"), F.lit(True).alias("_own"))
    below = ancestry(nodes, keys, "role", "actual_text").where(F.size("path") > F.size("_up")).select(*keys, "_up", F.col("role").isin(*INLINE_ROLES).alias("_inline"), visible(F.col("actual_text")).alias("_said"))
    shown = ancestry(fragments, keys, "text", below=1).select(*keys, "_up", visible(F.col("text")).alias("_shown"))
    # one grouping, summed before it is sent anywhere; joins would send every node and fragment once for each above it
    rows = own.unionByName(below, allowMissingColumns=True).unionByName(shown, allowMissingColumns=True)
    out = rows.groupBy(*keys, F.col("_up").alias("path")).agg(F.bool_or("_own").alias("_own"), F.every("_inline").alias("_inline"), F.bool_or("_said").alias("_said"), F.bool_or("_shown").alias("_shown"))
    no = F.lit(False)
    return out.where(F.col("_own") & F.coalesce("_inline", F.lit(True)) & (F.coalesce("_said", no) | F.coalesce("_shown", no))).select(*keys, "path")


def visible(x: Column) -> Column:
    """Whether a text has anything but white space; false for null."""
    return F.coalesce(F.regexp_replace(x, T.WHITE + "+", "") != "", F.lit(False))


def heading_conflict(role: Column, source_role: Column, display_role: Column, promoted: Column) -> Column:
    """What makes a node a heading: promoted_heading, source_heading, or its display role; null if nothing does."""
    source = (role == "heading") | F.coalesce(T.is_heading_candidate(source_role), F.lit(False))
    return F.when(promoted, "promoted_heading").when(F.coalesce(source, F.lit(False)), "source_heading").when(display_role.isin(*DISPLAY_ROLES), display_role)


def sentence_paragraphs(nodes: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path of the paragraphs that sentence breaks may be put into: inline paragraphs that are no headings and below
    none, whose nearest container or barrier is a container.

    nodes: path, role, source_role, display_role, actual_text."""
    leaf = inline_paragraphs(nodes, fragments, keys)
    own = nodes.join(leaf, [*keys, "path"], "left_semi").where(heading_conflict(F.col("role"), F.col("source_role"), F.col("display_role"), F.lit(False)).isNull()).select(*keys, "path")
    up = ancestry(own, keys, below=1).join(nodes.select(*keys, F.col("path").alias("_up"), "role", "source_role"), [*keys, "_up"])
    decides = F.col("role").isin(*FLOW_CONTAINERS, *FLOW_BARRIERS)
    told = up.groupBy(*keys, "path").agg(F.bool_or(T.is_heading_candidate(F.col("source_role"))).alias("_headed"), F.max_by(F.when(decides, F.col("role")), F.when(decides, F.size("_up"))).alias("_nearest"))
    out = own.join(told, [*keys, "path"], "left")
    return out.where(~F.coalesce("_headed", F.lit(False)) & (F.col("_nearest").isNull() | F.col("_nearest").isin(*FLOW_CONTAINERS))).select(*keys, "path")


def subtitle_rejections(targets: DataFrame, nodes: DataFrame, promoted: DataFrame, keys: list[str]) -> DataFrame:
    """targets (keys, path, role, source_role) with the reason why one cannot be a subtitle; null if it can."""
    below = ancestry(nodes, keys, "role").where((F.size("path") > F.size("_up")) & ~F.col("role").isin(*INLINE_ROLES)).select(*keys, F.col("_up").alias("path")).distinct().withColumn("_block", F.lit(True))
    out = targets.join(below, [*keys, "path"], "left").join(promoted.select(*keys, "path").distinct().withColumn("_promoted", F.lit(True)), [*keys, "path"], "left")
    reason = (
        F.when((F.col("role") != "paragraph") | F.coalesce("_promoted", F.lit(False)), "not_unpromoted_paragraph").when(T.is_heading_candidate(F.col("source_role")), "source_role_heading_candidate")
        .when(F.coalesce("_block", F.lit(False)), "block_descendant")
    )
    return out.withColumn("rejection", reason).drop("_block", "_promoted")


def is_box(box: Column) -> Column:
    """Whether (x0, y0, x1, y1) is a box: finite, and wider and higher than nothing."""
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    at = lambda i: F.get(box, F.lit(i))
    return F.coalesce((F.size(box) == 4) & finite & (at(2) > at(0)) & (at(3) > at(1)), F.lit(False))


def positive_number(x: Column) -> Column:
    """A text as a positive finite number; null for anything else."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), v)


def parsed_box(x: Column) -> Column:
    """A box written as four numbers in brackets or parentheses; null if it is not one."""
    form = r"^\s*[\[(]\s*[-+0-9.eE]+\s*(?:,\s*[-+0-9.eE]+\s*){3},?\s*[\])]\s*$"
    numbers = F.transform(F.split(F.regexp_replace(x, r"^\s*[\[(]\s*|\s*,?\s*[\])]\s*$", ""), r"\s*,\s*"), lambda v: v.try_cast("double"))
    return F.when(x.rlike(form) & is_box(numbers), numbers)


def agreed_box(attributes: Column) -> Column:
    """The box that all attributes (name, value) named bbox state; null if there is none, or they differ or are no boxes."""
    stated = F.transform(F.filter(attributes, lambda a: F.lower(a["name"]).isin("bbox", "/bbox")), lambda a: parsed_box(a["value"]))
    return F.when((F.size(stated) > 0) & F.forall(stated, lambda b: b.isNotNull()) & (F.size(F.array_distinct(stated)) == 1), F.get(stated, F.lit(0)))


def attribute(attributes: Column, name: str) -> Column:
    """The value of an attribute (name, value); of several with one name the last; null without one."""
    own = F.transform(F.filter(attributes, lambda a: a["name"] == name), lambda a: a["value"])
    return F.get(own, F.size(own) - 1)


def line_geometry(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, x0, y0, x1, y1, n_lines, spacing of a node: its box, its lines (one an id), and the median gap between
    lines from the top down (y upwards); spacing is null below two lines or where lines overlap.

    parts: keys, page, mcid, text, box.  A node whose visible parts lack an id or a box, or lie on several pages, has no row."""
    shown = parts.where(visible(F.col("text")))
    fine = shown.groupBy(*keys).agg(F.every(is_box(F.col("box")) & F.col("mcid").isNotNull() & F.coalesce(F.col("page") >= 0, F.lit(False))).alias("_fine"), F.min("page").alias("_p"), F.max("page").alias("_q"))
    pages = parts.groupBy(*keys).agg(F.min("page").alias("_lo"), F.max("page").alias("_hi"))
    good = fine.where("_fine and _p = _q").join(pages.where("_lo = _hi"), keys).select(*keys)
    at = lambda i: F.get("box", F.lit(i))
    box = [F.min(at(0)).alias("x0"), F.min(at(1)).alias("y0"), F.max(at(2)).alias("x1"), F.max(at(3)).alias("y1")]
    lines = shown.join(good, keys, "left_semi").groupBy(*keys, "page", "mcid").agg(*box, F.max(at(1)).alias("_top"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_top"), "mcid")
    gaps = lines.withColumn("_gap", F.lag("y0").over(w) - F.col("y1"))
    spacing = F.when((F.count("_gap") > 0) & F.every(F.coalesce(F.col("_gap") >= 0, F.lit(True))), F.median("_gap"))
    return gaps.groupBy(*keys).agg(F.min("page").alias("page"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n_lines"), spacing.alias("spacing"))


def beside_figures(flow: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Figures of a flow with the nearest visible text on either side; null where another figure, or nothing, comes first.

    flow: keys, order, text, which is null for a figure."""
    counts = F.col("text").isNull() | visible(F.col("text"))
    mark = F.when(counts, F.struct(F.col("text").alias("t")))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    rows = flow.withColumn("_m", mark).withColumns({"text_before": F.last("_m", ignorenulls=True).over(before)["t"], "text_behind": F.first("_m", ignorenulls=True).over(behind)["t"]})
    return rows.where(F.col("text").isNull()).select(*keys, order, "text_before", "text_behind")


def segments(rows: DataFrame, keys: list[str], order: str, boundary: Column) -> DataFrame:
    """rows without the boundary ones, with segment: the running number of the stretch between boundaries that a row is in;
    empty stretches do not count."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_b", F.coalesce(boundary, F.lit(False))).withColumn("_n", F.sum(F.col("_b").cast("int")).over(w))
    return marked.where(~F.col("_b")).withColumn("segment", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_n"))).drop("_b", "_n")


def page_segments(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with segment: the running number of the stretch of rows on one page."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = ~F.col("page").eqNullSafe(F.lag("page").over(w)) | F.lag(order).over(w).isNull()
    return rows.withColumn("_new", new.cast("int")).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def contiguous_bounds(members: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, valid and, per expected ordinal, start_path and end_path of its members, where each ordinal's members are one
    unbroken run and the runs come in order; otherwise one row with the first ordinal that breaks this.

    members: keys, path, ordinal (null ones do not count); expected: keys, ordinal."""
    rows = members.where("ordinal is not null")
    w = Window.partitionBy(*keys).orderBy("path")
    rows = rows.withColumns({"_pos": F.row_number().over(w), "_new": (~F.col("ordinal").eqNullSafe(F.lag("ordinal").over(w))).cast("int")})
    own = rows.groupBy(*keys, "ordinal").agg(F.sum("_new").alias("_runs"), F.min("_pos").alias("_first"), F.max("_pos").alias("_last"), F.min("path").alias("start_path"), F.max("path").alias("end_path"))
    told = expected.select(*keys, "ordinal").join(own, [*keys, "ordinal"], "left")
    v = Window.partitionBy(*keys).orderBy("ordinal")
    ok = F.coalesce((F.col("_runs") == 1) & (F.coalesce(F.lag("_last").over(v), F.lit(0)) < F.col("_first")), F.lit(False))
    told = told.withColumn("_ok", ok).withColumn("_bad", F.min(F.when(~F.col("_ok"), F.col("ordinal"))).over(Window.partitionBy(*keys)))
    good = F.col("_bad").isNull()
    kept = told.where(good | (F.col("ordinal") == F.col("_bad")))
    return kept.select(*keys, "ordinal", good.alias("valid"), F.when(good, F.col("start_path")).alias("start_path"), F.when(good, F.col("end_path")).alias("end_path"))


def language_intervals(profiles: DataFrame, headings: DataFrame, pages: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ordinal, language, start_page, end_page, start_path, end_path and code of each language's interval.

    profiles: keys, doc_type, languages; headings: keys, path, pages (promoted ones too); pages: keys, path, pages of every
    element; bounds: keys, ordinal, start_page, end_page of bookmarks.  Books are split by bookmarks, sheets by the pages of
    their headings.  A document that cannot be resolved has one row, of which code says why; one language needs no interval."""
    many = profiles.where(F.size("languages") > 1)
    p = many.select(*keys, "doc_type", "languages", F.size("languages").alias("_count"))
    w = Window.partitionBy(*keys).orderBy("ordinal")
    checked = bounds.withColumns({"_at": F.row_number().over(w), "_before": F.lag("end_page").over(w)})
    b = checked.groupBy(*keys).agg(F.count("*").alias("_bounds"), F.every((F.col("ordinal") == F.col("_at")) & F.coalesce(F.col("_before") < F.col("start_page"), F.lit(True))).alias("_ordered"))
    h = headings.withColumn("_n", F.size("pages")).groupBy(*keys).agg(F.count("*").alias("_headings"), F.min_by(F.when(F.col("_n") == 0, "missing").when(F.col("_n") > 1, "ambiguous"), F.when(F.col("_n") != 1, F.col("path"))).alias("_fault"), F.array_sort(F.collect_set(F.when(F.col("_n") == 1, F.get("pages", F.lit(0))))).alias("_pages"))
    single = headings.where(F.size("pages") == 1).select(*keys, F.get("pages", F.lit(0)).alias("page")).distinct()
    inside = single.join(bounds.select(*keys, "start_page", "end_page"), keys).groupBy(*keys, "page").agg(F.count_if(F.col("page").between(F.col("start_page"), F.col("end_page"))).alias("_in"))
    outside = inside.where("_in <> 1").select(*keys).distinct().withColumn("_outside", F.lit(True))
    d = p.join(b, keys, "left").join(h, keys, "left").join(outside, keys, "left")
    book = F.col("doc_type") == "BOOK"
    n = lambda c: F.coalesce(c, F.lit(0))
    code = (
        F.when(book & (n("_bounds") == 0), "bookmark_bounds_missing").when(book & (F.col("_bounds") != F.col("_count")), "bookmark_count_mismatch").when(book & ~F.col("_ordered"), "bookmark_order_invalid")
        .when(F.col("_fault") == "missing", "heading_page_evidence_missing").when(F.col("_fault") == "ambiguous", "heading_page_evidence_ambiguous").when(n("_headings") == 0, "heading_page_evidence_missing")
        .when(book & F.coalesce("_outside", F.lit(False)), "heading_outside_bounds").when(~book & (F.size("_pages") != F.col("_count")), "heading_page_count_mismatch")
    )
    d = d.withColumn("code", code)
    sheet = d.where(F.col("code").isNull() & ~book).select(*keys, "languages", F.posexplode("_pages").alias("_i", "start_page")).withColumns({"ordinal": F.col("_i") + 1, "end_page": F.col("start_page")}).drop("_i")
    books = d.where(F.col("code").isNull() & book).select(*keys, "languages").join(bounds.select(*keys, "ordinal", "start_page", "end_page"), keys)
    spans = sheet.unionByName(books.select(*sheet.columns))
    claimed = pages.select(*keys, "path", "pages", F.explode("pages").alias("_page")).join(spans.select(*keys, "ordinal", "start_page", "end_page"), keys).where(F.col("_page").between(F.col("start_page"), F.col("end_page")))
    one = claimed.groupBy(*keys, "path").agg(F.count_distinct("ordinal").alias("_o"), F.min("ordinal").alias("ordinal"), F.count_distinct("_page").alias("_hit"), F.max(F.size("pages")).alias("_all"))
    members = one.select(*keys, "path", F.when((F.col("_o") == 1) & (F.col("_hit") == F.col("_all")), F.col("ordinal")).alias("ordinal"))
    proven = contiguous_bounds(members, spans.select(*keys, "ordinal"), keys)
    good = proven.where("valid").join(spans, [*keys, "ordinal"])
    done = good.select(*keys, "ordinal", F.get("languages", F.col("ordinal") - 1).alias("language"), "start_page", "end_page", "start_path", "end_path", F.lit(None).cast("string").alias("code"))
    fails = d.where("code is not null").select(*keys, "code").unionByName(proven.where("not valid").select(*keys, F.lit("structure_ranges_invalid").alias("code")))
    none = {c: F.lit(None).cast(done.schema[c].dataType) for c in ("ordinal", "language", "start_page", "end_page", "start_path", "end_path")}
    return done.unionByName(fails.withColumns(none).select(*done.columns))


BCP47 = r"^[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*$"


def marker_faults(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, marker, reason of the first language marker in an interval that does not fit the others.

    nodes: keys (document and interval), path, marker, expected (the interval's language), known (the document's languages).
    An interval's markers are all its own language, or all one marker of the BCP 47 kind."""
    w = Window.partitionBy(*keys).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    m = F.col("marker")
    canonical = F.array_contains("known", m)
    own = canonical & (m == F.col("expected"))
    fits = m.rlike(BCP47)
    rows = nodes.where("marker is not null").withColumns({"_own": own, "_foreign": canonical & ~own, "_kind": F.when(~canonical & fits, F.lower(m)), "_bad": ~canonical & ~fits})
    rows = rows.withColumns({"_seen_own": F.coalesce(F.bool_or("_own").over(w), F.lit(False)), "_seen": F.first("_kind", ignorenulls=True).over(w)})
    reason = (
        F.when(F.col("_own") & F.col("_seen").isNotNull(), "mixed_language_marker_schemes").when(F.col("_foreign"), "conflicting_canonical_language").when(F.col("_bad"), "malformed_language_marker")
        .when(F.col("_kind").isNotNull() & F.col("_seen_own"), "mixed_language_marker_schemes").when(F.col("_kind").isNotNull() & (F.col("_seen") != F.col("_kind")), "conflicting_language_markers")
    )
    faults = rows.withColumn("reason", reason).where("reason is not null")
    return faults.groupBy(*keys).agg(F.min("path").alias("path"), F.min_by("marker", "path").alias("marker"), F.min_by("reason", "path").alias("reason"))


def unclaimed(hints: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Hints whose path is not taken."""
    return hints.join(taken.select(*keys, "path").distinct(), [*keys, "path"], "left_anti")


def joined_paths(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys, nth, path: the paths of several tables, each once, numbered in document order."""
    every = parts[0].select(*keys, "path")
    for p in parts[1:]:
        every = every.unionByName(p.select(*keys, "path"))
    return every.distinct().select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("path")).alias("nth"), "path")


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side of the keys that only one table has: missing from the second, or extra in it."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = x.join(y, keys, "full")
    return both.where("_a is null or _b is null").select(*keys, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("side"))


def reversed_block(nodes: DataFrame, keys: list[str], order: str, inside: Column) -> DataFrame:
    """nodes with new_order: those inside change places among themselves, last first; the others keep theirs.

    contiguous tells whether the block has no other node between its own, which a reversal of pages needs."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = nodes.withColumns({"_in": F.coalesce(inside, F.lit(False)), "_pos": F.row_number().over(w)})
    block = Window.partitionBy(*keys, "_in")
    rows = rows.withColumns({"_lo": F.min("_pos").over(block), "_hi": F.max("_pos").over(block), "_n": F.count("*").over(block)})
    whole = F.every(~F.col("_in") | (F.col("_hi") - F.col("_lo") + 1 == F.col("_n"))).over(Window.partitionBy(*keys))
    ranked = rows.withColumn("contiguous", whole).withColumn("_rank", F.row_number().over(block.orderBy(order)))
    # each takes the place of the one that is as far from the other end
    places = ranked.where("_in").select(*keys, F.lit(True).alias("_in"), (F.col("_n") + 1 - F.col("_rank")).alias("_rank"), F.col("_pos").alias("_mirror"))
    out = ranked.join(places, [*keys, "_in", "_rank"], "left").withColumn("new_order", F.coalesce("_mirror", "_pos"))
    return out.drop("_in", "_pos", "_lo", "_hi", "_n", "_rank", "_mirror")


def permuted(nodes: DataFrame, permutation: DataFrame, keys: list[str], order: str) -> DataFrame:
    """nodes with new_order by a reviewed table (keys, order, place), which is small and has one row a node; nodes that it
    does not name keep their place.  valid tells whether the table names places that its nodes had."""
    p = permutation.select(*keys, order, F.col("place").alias("_place"))
    rows = nodes.join(p, [*keys, order], "left")
    named = rows.where("_place is not null")
    sides = named.select(*keys, F.col(order).cast("long").alias("_x"), F.lit(1).alias("_s")).unionByName(named.select(*keys, F.col("_place").cast("long").alias("_x"), F.lit(-1).alias("_s")))
    odd = sides.groupBy(*keys, "_x").agg(F.sum("_s").alias("_s")).where("_s <> 0").select(*keys).distinct().withColumn("_odd", F.lit(True))
    out = rows.join(odd, keys, "left")
    return out.withColumns({"valid": F.col("_odd").isNull(), "new_order": F.coalesce("_place", order)}).drop("_place", "_odd")


def matrix(cells: DataFrame, keys: list[str], order: str, rows: int, columns: int, tolerance: float = 1.0) -> DataFrame:
    """Nodes that a page lists column by column as a matrix: row, column (from 0) and aligned, which holds for a whole matrix
    of the right size whose columns share their left edge, whose rows share their height (y upwards) and which go right and
    down.  cells: keys, order, x0, y0."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = F.row_number().over(w) - 1
    c = cells.withColumn("_at", at).withColumns({"row": F.pmod("_at", F.lit(rows)), "column": F.floor(F.col("_at") / rows).cast("int")})
    col, row = Window.partitionBy(*keys, "column").orderBy("row"), Window.partitionBy(*keys, "row").orderBy("column")
    left, top = F.first("x0").over(col), F.first("y0").over(row)
    down = F.coalesce(F.lag("y0").over(col) > F.col("y0"), F.lit(True))
    right = F.when(F.col("row") == 0, F.coalesce(F.lag("x0").over(row) < F.col("x0"), F.lit(True))).otherwise(True)
    fine = (F.abs(F.col("x0") - left) <= tolerance) & (F.abs(F.col("y0") - top) <= tolerance) & down & right
    every = Window.partitionBy(*keys)
    c = c.withColumn("_fine", fine).withColumn("aligned", F.every("_fine").over(every) & (F.count("*").over(every) == rows * columns))
    return c.drop("_at", "_fine")


def first_trigger(x: Column, triggers: dict[str, str]) -> Column:
    """(at, trigger, heading) of the trigger that occurs first in a text outside quotes; null without one."""
    found = []
    for trigger, heading in triggers.items():
        outside = F.regexp_replace(x, '"[^"]*(?:"|$)|“[^”]*(?:”|$)', "")
        at = F.instr(outside, trigger)
        found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(trigger).alias("trigger"), F.lit(heading).alias("heading"))))
    return F.array_min(F.array_compact(F.array(*found)))


def ordered_events(events: DataFrame, keys: list[str], time: str, kind: str, ranks: tuple[str, ...]) -> DataFrame:
    """events with nth: by time, at one time by the rank of their kind; kinds without a rank come last, by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ranks)), F.col(kind)), F.lit(0))
    place = F.when(rank == 0, len(ranks) + 1).otherwise(rank)
    return events.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(time, place, kind)))


def language_statistics(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, language, headings, tables, figures, paragraphs: what each language of a document has."""
    of = lambda r: F.count_if(F.col("role") == r)
    return nodes.where("language is not null").groupBy(*keys, "language").agg(of("heading").alias("headings"), of("table").alias("tables"), of("figure").alias("figures"), of("paragraph").alias("paragraphs"), F.count("*").alias("n"))


def owned_texts(runs: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """fragments with the glyphs of all runs that share their page and id, in order, and whether both are the same
    characters, white space aside.  runs: keys, page, mcid, ord, glyphs; fragments: keys, page, mcid, text."""
    at = [*keys, "page", "mcid"]
    source = runs.groupBy(*at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "glyphs"))), lambda r: r["glyphs"]), "").alias("source"), F.count("*").alias("n_runs"))
    out = fragments.join(source, at, "left")
    letters = lambda x: F.array_sort(F.split(F.regexp_replace(F.coalesce(x, F.lit("")), T.WHITE + "+", ""), ""))
    return out.withColumns({"n_runs": F.coalesce("n_runs", F.lit(0)), "proven": letters(F.col("source")) == letters(F.col("text"))})
