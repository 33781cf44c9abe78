"""Repairs of extracted trees from reviewed tables, and orders that geometry proves.

A repair names what it expects to find; where the document differs nothing is changed, and the row says so.  Repairs are
small reviewed tables with one row a target, so they are joined to the document's rows and never looped over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.nodes import prefixes
from foliant.sources.places import written

BASELINE = 0.05  # points by which texts of one line may differ
RTL_LETTERS = r"\p{InArabic}\p{InArabicSupplement}\p{InHebrew}"
RTL_MARKS = r".،؛!؟:\-"


def letters(x: Column) -> Column:
    """The characters of a text without white space, sorted: equal for texts that only order them otherwise."""
    return F.array_sort(F.split(F.regexp_replace(x, T.WHITE + "+", ""), ""))


def replaced(fragments: DataFrame, repairs: DataFrame, keys: list[str], same_letters: bool = True) -> DataFrame:
    """fragments (keys, page, mcid, text) with the text that a repair (keys, page, mcid, before, after) puts in its place, and
    outcome: kept (no repair), applied, not_found (the text is not the one expected) or letters_differ."""
    r = repairs.select(*keys, "page", "mcid", "before", "after")
    out = fragments.join(r, [*keys, "page", "mcid"], "left")
    equal = letters(F.col("before")) == letters(F.col("after")) if same_letters else F.lit(True)
    outcome = F.when(F.col("before").isNull(), "kept").when(F.col("text") != F.col("before"), "not_found").when(~equal, "letters_differ").otherwise("applied")
    return out.withColumn("outcome", outcome).withColumn("text", F.when(F.col("outcome") == "applied", F.col("after")).otherwise(F.col("text"))).drop("before", "after")


def transferred(fragments: DataFrame, transfers: DataFrame, keys: list[str]) -> DataFrame:
    """fragments with the texts of transfers between owners: rows (keys, transfer, page, mcid, before, after) of one transfer
    are applied together, if all are found and their letters together are the same before and after.

    outcome as in replaced()."""
    found = transfers.join(fragments.select(*keys, "page", "mcid", F.col("text").alias("_text")), [*keys, "page", "mcid"], "left")
    every = F.array_sort(F.flatten(F.collect_list(letters(F.col("before")))))
    after = F.array_sort(F.flatten(F.collect_list(letters(F.col("after")))))
    blank = lambda x: F.filter(x, lambda c: c != "")
    whole = found.groupBy(*keys, "transfer").agg(F.every(F.coalesce(F.col("_text") == F.col("before"), F.lit(False))).alias("_found"), (blank(every) == blank(after)).alias("_same"))
    r = transfers.join(whole, [*keys, "transfer"]).select(*keys, "page", "mcid", "after", "_found", "_same")
    out = fragments.join(r, [*keys, "page", "mcid"], "left")
    outcome = F.when(F.col("_found").isNull(), "kept").when(~F.col("_found"), "not_found").when(~F.col("_same"), "letters_differ").otherwise("applied")
    return out.withColumn("outcome", outcome).withColumn("text", F.when(F.col("outcome") == "applied", F.col("after")).otherwise(F.col("text"))).drop("after", "_found", "_same")


def reparented(nodes: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with new_path: a moved node (moves: keys, path, new_path) and all below it go to its new place, if the node is
    there; the nearest moved node at or above decides."""
    known = moves.join(nodes.select(*keys, "path"), [*keys, "path"], "left_semi")
    up = nodes.select(*keys, "path", F.explode(prefixes(F.col("path"))).alias("_up"))
    hit = up.join(known.select(*keys, F.col("path").alias("_up"), "new_path"), [*keys, "_up"])
    best = hit.groupBy(*keys, "path").agg(F.max_by(F.struct("_up", "new_path"), F.size("_up")).alias("_b"))
    told = F.concat(F.col("_b.new_path"), F.slice("path", F.size("_b._up") + 1, F.greatest(F.size("path") - F.size("_b._up"), F.lit(0))))
    return nodes.join(best, [*keys, "path"], "left").withColumn("new_path", F.coalesce(told, "path")).drop("_b")


def wrapped(children: DataFrame, groups: DataFrame, keys: list[str], order: str) -> DataFrame:
    """children with wrapper, the name of the new parent that takes a run of siblings in: groups (keys, wrapper, first, last)
    name the run's ends.  A group whose ends are not there, or that overlaps another, wraps nothing."""
    w = Window.partitionBy(*keys).orderBy("first")
    g = groups.withColumns({"_end": F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.lead("first").over(w)})
    g = g.where((F.coalesce(F.col("_end") < F.col("first"), F.lit(True))) & F.coalesce(F.col("_next") > F.col("last"), F.lit(True)) & (F.col("first") <= F.col("last")))
    ends = children.select(*keys, F.col(order).alias("_o"))
    g = g.join(ends.withColumnRenamed("_o", "first"), [*keys, "first"], "left_semi").join(ends.withColumnRenamed("_o", "last"), [*keys, "last"], "left_semi")
    starts = g.select(*keys, F.col("first").alias("_at"), F.lit(0).alias("_rank"), F.struct("wrapper", "last").alias("_g"))
    rows = children.select(*keys, F.col(order).alias("_at"), F.lit(1).alias("_rank"), F.lit(None).cast(starts.schema["_g"].dataType).alias("_g"))
    along = Window.partitionBy(*keys).orderBy("_at", "_rank")
    placed = starts.unionByName(rows).withColumn("_g", F.last("_g", ignorenulls=True).over(along)).where("_rank = 1")
    told = placed.select(*keys, F.col("_at").alias(order), F.when(F.col("_at") <= F.col("_g.last"), F.col("_g.wrapper")).alias("wrapper"))
    return children.join(told, [*keys, order], "left")


def inline_order(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """pieces with new_order, the order of reading in a paragraph that runs from right to left.

    pieces: keys, ord, baseline, x0, x1, height, ltr (whether it may belong to an island that runs from left to right) and
    latin.  Lines go from the top (y upwards); in a line islands of neighbouring ltr pieces go from the right, and an island
    with latin letters keeps its pieces from the left."""
    w = Window.partitionBy(*keys).orderBy(F.desc("baseline"), "ord")
    rows = pieces.withColumn("_new", (~F.coalesce(F.abs(F.lag("baseline").over(w) - F.col("baseline")) <= BASELINE, F.lit(False))).cast("int"))
    rows = rows.withColumn("_line", F.sum("_new").over(w))
    line = Window.partitionBy(*keys, "_line").orderBy("x0", "ord")
    close = F.lag("ltr").over(line) & F.col("ltr") & (F.col("x0") - F.lag("x1").over(line) <= F.max("height").over(Window.partitionBy(*keys, "_line")))
    rows = rows.withColumn("_at", F.row_number().over(line)).withColumn("_cut", (~F.coalesce(close, F.lit(False))).cast("int"))
    rows = rows.withColumn("_group", F.sum("_cut").over(Window.partitionBy(*keys, "_line").orderBy("_at")))
    rows = rows.withColumn("_latin", F.bool_or("latin").over(Window.partitionBy(*keys, "_line", "_group")))
    along = F.when(F.col("_latin"), F.col("_at")).otherwise(-F.col("_at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_line", F.desc("_group"), along))
    return rows.withColumn("new_order", place).drop("_new", "_line", "_at", "_cut", "_group", "_latin")


def text_direction(x: Column) -> Column:
    """rtl for a text of right-to-left letters, marks and signs alone; ltr for the head of an address; null for others."""
    rtl = x.rlike(rf"[{RTL_LETTERS}&&[\p{{L}}]]") & x.rlike(rf"^[{RTL_LETTERS}\p{{Mn}}\s{RTL_MARKS}&&[^\p{{Nd}}]]+$")
    return F.when(x.isin("http://", "https://"), "ltr").when(rtl, "rtl")


def inclusive_bounds(bounds: DataFrame, last_pages: DataFrame, keys: list[str], excluded: DataFrame) -> DataFrame:
    """Intervals of languages (keys, ordinal, start_page, end_page) that take in the covers: the first begins with the
    document and each ends before the next begins, the last with the document, less excluded pages (keys, page) at its end.

    last_pages: keys, last_page."""
    w = Window.partitionBy(*keys).orderBy("ordinal")
    b = bounds.join(last_pages, keys)
    start = F.when(F.row_number().over(w) == 1, 0).otherwise(F.col("start_page"))
    b = b.withColumn("start_page", start).withColumn("_next", F.lead("start_page").over(w))
    out = excluded.groupBy(*keys).agg(F.array_sort(F.collect_set("page")).alias("_out"))
    b = b.join(out, keys, "left")
    last = F.aggregate(F.reverse(F.coalesce("_out", F.array().cast("array<int>"))), F.col("last_page"), lambda at, p: F.when(p == at, at - 1).otherwise(at))
    return b.select(*keys, "ordinal", "start_page", F.coalesce(F.col("_next") - 1, F.greatest(last, F.col("start_page"))).alias("end_page"))


def walked(edges: DataFrame, roots: DataFrame, keys: list[str], most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Nodes (keys, path, ref, page) of trees that are stored as references, and diagnostics (keys, path, ref, code).

    edges: keys, ref, ord, child, page; a child without a page has its parent's.  roots: keys, ref, page.  A reference that
    leads back to a node above is a cycle: it is told and not followed.  Each level of the tree is one join, and is written, so that
    none is worked out again for those below it."""
    level = roots.select(*keys, F.array(F.lit(0)).alias("path"), "ref", "page", F.array("ref").alias("_above"))
    found, faults = level.drop("_above"), None
    for _ in range(most):
        e = edges.select(*keys, "ref", "ord", "child", F.col("page").alias("_page"))
        below = level.join(e, [*keys, "ref"]).select(*keys, F.array_append("path", F.col("ord").cast("int")).alias("path"), F.col("child").alias("ref"), F.coalesce("_page", "page").alias("page"), "_above")
        bad = F.array_contains("_above", F.col("ref"))
        told = below.where(bad).select(*keys, "path", "ref", F.lit("structure_cycle").alias("code"))
        faults = told if faults is None else faults.unionByName(told)
        level = written(below.where(~bad).withColumn("_above", F.array_append("_above", F.col("ref"))), "tree-level")
        if level.isEmpty():
            return found, faults
        found = found.unionByName(level.drop("_above"))
    raise ValueError(f"a tree is deeper than {most} levels")
