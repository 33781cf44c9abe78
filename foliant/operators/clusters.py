"""Clusters of a form: a section whose title is set stronger than all else in it, with labels of one size and weight above
weaker details, among its own paragraphs and in its tables.

Nodes, paragraphs and cells are rows; what lies in what is found by prefixes of paths.  A section is looked at once for each
tier (weight and size) that its short paragraphs have, so the work grows with the number of tiers of a section.  Tables that
several steps read are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.nodes import ancestry, inline_paragraphs
from foliant.operators.spans import typography
from foliant.sources.places import written

# What a short paragraph has at most, how many labels there have to be, and the reasons told.
MOST_CHARACTERS, MOST_LINES = 160, 2
DIRECT_LABELS, TABLE_LABELS = 3, 2
TITLE_REASON, LABEL_REASON = "form_cluster_unique_strongest_title", "form_cluster_middle_tier_with_weaker_detail"


def parent(path: str = "path") -> Column:
    return F.expr(f"slice({path}, 1, size({path}) - 1)")


def owners(rows: DataFrame, holders: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows (keys, path) with the path of the nearest of the holders above each; rows below none are left out."""
    above = ancestry(rows.select(*keys, "path"), keys, below=1).join(holders.select(*keys, F.col("path").alias("_up")), [*keys, "_up"])
    nearest = above.groupBy(*keys, "path").agg(F.max_by("_up", F.size("_up")).alias(name))
    return rows.join(nearest, [*keys, "path"])


def paragraph_records(nodes: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, told, weight, size, short of the inline paragraphs: told says whether it has text of its own; weight and
    size are null unless every visible text of it has a weight, a size, a page and an id."""
    leaf = written(inline_paragraphs(nodes, fragments, keys), "inline-paragraphs")
    sited = (F.col("page") >= 0) & F.col("mcid").isNotNull()
    inside = ancestry(fragments, keys, "text", "page", "mcid", F.when(sited, F.col("weight")).alias("weight"), F.when(F.col("size") > 0, F.col("size")).alias("size"), below=1)
    inside = inside.withColumnRenamed("path", "_at").withColumnRenamed("_up", "path").join(leaf, [*keys, "path"], "left_semi")
    inside = written(inside, "paragraph-texts")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "")
    body = inside.groupBy(*keys, "path").agg(T.collapsed(texts).alias("_text"))
    style = typography(inside.select(*keys, "path", "text", "weight", "size", "page", "mcid"), [*keys, "path"])
    out = leaf.join(body, [*keys, "path"], "left").join(style, [*keys, "path"], "left")
    n = F.length(F.coalesce("_text", F.lit("")))
    return out.select(*keys, "path", (n > 0).alias("told"), "weight", "size", ((n <= MOST_CHARACTERS) & (F.col("lines") <= MOST_LINES)).alias("short"))


def titles(nodes: DataFrame, fragments: DataFrame, sections: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, path, weight, size of the sections whose first child with text is a short, fully known paragraph that
    nothing makes a heading."""
    shown = ancestry(fragments.where(T.collapsed(F.coalesce("text", F.lit(""))) != ""), keys, below=1).select(*keys, F.col("_up").alias("path")).distinct()
    child = shown.where("size(path) > 1").withColumn("section", parent()).join(sections.select(*keys, F.col("path").alias("section")), [*keys, "section"])
    first = child.groupBy(*keys, "section").agg(F.min("path").alias("path"))
    fit = first.join(records.where("short and weight is not null"), [*keys, "path"])
    return fit.join(headings(nodes, keys), [*keys, "path"], "left_anti").select(*keys, "section", "path", "weight", "size")


def headings(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path of the nodes that their role or source role makes a heading."""
    return nodes.where((F.col("role") == "heading") | F.coalesce(T.is_heading_candidate(F.col("source_role")), F.lit(False))).select(*keys, "path")


WEAKER = "weight < t_weight and size < t_size"


def direct_groups(children: DataFrame, tiers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, t_weight, t_size, path of each label, n and the largest weight and size of its details.

    children: keys, section, path, paragraph, weight, size, short of all children of a section but its title.  A label's
    details reach to the next row of its tier or the next that is no paragraph; all have to be weaker than it."""
    rows = children.join(tiers, [*keys, "section"])
    same = F.coalesce((F.col("weight") == F.col("t_weight")) & (F.col("size") == F.col("t_size")), F.lit(False))
    per_tier = [*keys, "section", "t_weight", "t_size"]
    rows = rows.withColumn("_same", F.col("paragraph") & same).withColumn("_head", F.col("_same") | ~F.col("paragraph"))
    rows = rows.withColumn("_grp", F.sum(F.col("_head").cast("int")).over(Window.partitionBy(*per_tier).orderBy("path")))
    detail = ~F.col("_head")
    g = rows.groupBy(*per_tier, "_grp").agg(
        F.max(F.when(F.col("_same") & F.col("short"), F.col("path"))).alias("path"), F.count_if(detail).alias("n"), F.every(F.when(detail, F.coalesce(F.expr(WEAKER), F.lit(False)))).alias("_weaker"),
        F.max(F.when(detail, F.col("weight"))).alias("b_weight"), F.max(F.when(detail, F.col("size"))).alias("b_size"),
    )
    return g.where("path is not null and n > 0 and _weaker").drop("_grp", "_weaker")


def cell_groups(nodes: DataFrame, records: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, t_weight, t_size, path, b_weight, b_size of the labels in tables, once for each table around the cell
    that has as many of the tier as it takes: the first paragraph of a cell whose others are all weaker."""
    cells = owners(nodes.where("role = 'table_cell'").select(*keys, "path"), sections, keys, "section").withColumnRenamed("path", "cell")
    own = records.where("told and size(path) > 1").withColumn("cell", parent()).join(cells, [*keys, "cell"])
    g = own.groupBy(*keys, "section", "cell").agg(F.every(F.col("weight").isNotNull()).alias("_known"), F.min(F.struct("path", "weight", "size", "short")).alias("l"), F.collect_list(F.struct("path", "weight", "size")).alias("_all"))
    g = g.where("_known and l.short").withColumn("_details", F.filter("_all", lambda r: r["path"] != F.col("l.path")))
    weaker = F.forall("_details", lambda r: (r["weight"] < F.col("l.weight")) & (r["size"] < F.col("l.size")))
    labels = g.where((F.size("_details") > 0) & weaker).select(*keys, "section", F.col("cell").alias("path"), F.col("l.path").alias("label"), F.col("l.weight").alias("t_weight"), F.col("l.size").alias("t_size"), F.array_max(F.transform("_details", lambda r: r["weight"])).alias("b_weight"), F.array_max(F.transform("_details", lambda r: r["size"])).alias("b_size"))
    tables = owners(nodes.where("role = 'table'").select(*keys, "path"), sections, keys, "section").withColumnRenamed("path", "_up")
    inside = ancestry(labels, keys, "section", "label", "t_weight", "t_size", "b_weight", "b_size", below=1).join(tables, [*keys, "section", "_up"])
    many = F.count("*").over(Window.partitionBy(*keys, "section", "_up", "t_weight", "t_size"))
    return inside.withColumn("_n", many).where(F.col("_n") >= TABLE_LABELS).select(*keys, "section", "t_weight", "t_size", F.col("label").alias("path"), "b_weight", "b_size")


def form_clusters(nodes: DataFrame, fragments: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, display_role, weight, size, body_weight, body_size, reason: the title (section_heading) and the labels
    (strong_label) of each section that is a form.

    nodes: path, role, source_role, actual_text; fragments: path, text, weight, size, page, mcid; taken: path, of what is a
    heading or subtitle already.  A section is a form if its title is stronger in weight and size than every other paragraph
    that belongs to it, and exactly one tier has three labels among its paragraphs and two in a table; if one of them is a
    heading, lies above or below what is taken, or counts twice, the section has none."""
    nodes, fragments = written(nodes, "cluster-nodes"), written(fragments, "cluster-fragments")
    sections = nodes.where("role = 'section'").select(*keys, "path")
    records = written(paragraph_records(nodes, fragments, keys), "paragraphs")
    title = titles(nodes, fragments, sections, records, keys)
    owned = owners(records.where("told"), sections, keys, "section")
    of_title = title.select(*keys, "section", F.col("path").alias("_title"), F.col("weight").alias("_w"), F.col("size").alias("_s"))
    below = F.coalesce((F.col("weight") < F.col("_w")) & (F.col("size") < F.col("_s")), F.lit(False))
    strongest = owned.join(of_title, [*keys, "section"]).groupBy(*keys, "section", "_title", "_w", "_s").agg(F.every((F.col("path") == F.col("_title")) | below).alias("_ok"))
    strongest = written(strongest.where("_ok").drop("_ok"), "strongest-titles")
    # all children of these sections but the title; what is no inline paragraph ends a label's details
    kids = nodes.select(*keys, "path").unionByName(fragments.select(*keys, "path")).where("size(path) > 1").withColumn("section", parent()).join(strongest.select(*keys, "section", "_title"), [*keys, "section"]).where("path <> _title")
    kids = kids.join(records.withColumn("paragraph", F.lit(True)), [*keys, "path"], "left").withColumn("paragraph", F.coalesce("paragraph", F.lit(False)))
    kids = written(kids, "section-children")
    tiers = kids.where("told and short and weight is not null").select(*keys, "section", F.col("weight").alias("t_weight"), F.col("size").alias("t_size")).distinct()
    per_tier = [*keys, "section", "t_weight", "t_size"]
    direct = direct_groups(kids, tiers, keys).drop("n").withColumn("_direct", F.lit(1))
    both = written(direct.unionByName(cell_groups(nodes, records, sections, keys).withColumn("_direct", F.lit(0))), "labels")
    counts = both.groupBy(*per_tier).agg(F.sum("_direct").alias("_d"), F.count_if(F.col("_direct") == 0).alias("_t"), F.max("b_weight").alias("body_weight"), F.max("b_size").alias("body_size"))
    fit = counts.where((F.col("_d") >= DIRECT_LABELS) & (F.col("_t") >= TABLE_LABELS)).withColumn("_tiers", F.count("*").over(Window.partitionBy(*keys, "section"))).where("_tiers = 1")
    fit = written(fit.join(strongest, [*keys, "section"]), "accepted-tiers")
    labels = both.join(fit.select(*per_tier, "body_weight", "body_size"), per_tier).select(*keys, "section", "path", F.lit("strong_label").alias("display_role"), F.col("t_weight").alias("weight"), F.col("t_size").alias("size"), "body_weight", "body_size", F.lit(LABEL_REASON).alias("reason"))
    heads = fit.select(*keys, "section", F.col("_title").alias("path"), F.lit("section_heading").alias("display_role"), F.col("_w").alias("weight"), F.col("_s").alias("size"), "body_weight", "body_size", F.lit(TITLE_REASON).alias("reason"))
    found = written(heads.unionByName(labels), "targets")
    # a section with a target that is a heading, in the way of something taken, or there twice has no hints at all
    twice = found.groupBy(*keys, "section", "path").agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, "section")
    is_heading = found.join(headings(nodes, keys), [*keys, "path"], "left_semi").select(*keys, "section")
    at = taken.select(*keys, "path").distinct()
    under = ancestry(found, keys, "section").join(at.withColumnRenamed("path", "_up"), [*keys, "_up"], "left_semi").select(*keys, "section")
    over = ancestry(at, keys).drop("path").withColumnRenamed("_up", "path").distinct()
    over = found.join(over, [*keys, "path"], "left_semi").select(*keys, "section")
    bad = twice.unionByName(is_heading).unionByName(under).unionByName(over).distinct()
    return found.join(bad, [*keys, "section"], "left_anti").drop("section")
