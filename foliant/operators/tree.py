"""Trees as node tables keyed by path: ancestors, overlaps, HTML pages as nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

BLOCK_TAGS = ("h1", "p", "ul", "li", "nav", "div", "article", "footer")
#: The structure role of each block tag.
TAG_ROLES = {"h1": "H1", "p": "P", "ul": "L", "li": "LI", "nav": "Sect", "div": "Div", "article": "Art", "footer": "Part"}


def page_tags(pages: DataFrame) -> DataFrame:
    """page_id, ord, tag of each opening block tag, in document order."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"<(h1|p|ul|li|nav|div|article|footer)[ >]"), 1)
    return pages.select("page_id", F.posexplode(found).alias("ord", "tag"))


def is_under(path: Column, top: Column) -> Column:
    """path equals top or lies below it."""
    return (F.size(top) <= F.size(path)) & (F.slice(path, F.lit(1), F.greatest(F.size(top), F.lit(1))) == top)


def ancestors(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each node and each of its prefixes: turns a prefix join into an equi join."""
    return nodes.select(*keys, "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("prefix"))


def outside(nodes: DataFrame, barred: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes that are neither at nor below a barred path."""
    up = ancestors(nodes, keys)
    hit = up.join(barred.select(*keys, F.col("path").alias("prefix")), [*keys, "prefix"], "left_semi").select(*keys, "path").distinct()
    return nodes.join(hit, [*keys, "path"], "left_anti")


def node_roles(pages: DataFrame) -> DataFrame:
    """page_id, semantic_role, level, n: how often a page has each role."""
    roles = F.create_map(*[F.lit(x) for kv in TAG_ROLES.items() for x in kv])
    r = page_tags(pages).select("page_id", roles[F.col("tag")].alias("role"))
    return r.groupBy("page_id", T.semantic_role(F.col("role")).alias("semantic_role"), T.heading_level(F.col("role")).alias("level")).agg(F.count("*").alias("n"))


def part_summary(nodes: DataFrame) -> DataFrame:
    """page_id, part and its nodes, first and last place, and whether it has a heading."""
    return nodes.groupBy("page_id", "part").agg(F.count("*").alias("n_nodes"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.bool_or(F.col("tag") == "h1").alias("has_heading"))
