"""Registered queries of XML read back and of tree signatures, over made trees, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans import evaluation as E
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.outputs import NAMES, _tree
from foliant.plans.registry import query
from foliant.sources import bundles, sinks, trees
from foliant.sources.places import shared_folder

KEYS = ["doc"]
_title = chosen_sql(NAMES, "l_partkey % 6")
_shown = lambda: F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path")
_pairs = lambda: F.array_join(F.array_sort(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"]))), "|").alias("attributes")
#: The made trees with their places as a reader counts them.
TREES = f"""{E.TREE}, al AS (SELECT doc, path, {chosen_sql(E.ROLES, 'l_partkey % 8')} AS tag, 'n=' || n || coalesce('|title=' || {_title}, '') AS attributes, NULL AS text FROM li
  UNION ALL SELECT DISTINCT doc, path[1:1], 'section', 'n=0', NULL FROM li UNION ALL SELECT doc, path, 'text', '', text FROM fr),
dn AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY path[1]) - 1 AS a, dense_rank() OVER (PARTITION BY doc, path[1] ORDER BY path[2]) - 1 AS b, dense_rank() OVER (PARTITION BY doc, path[1], path[2] ORDER BY path[3]) - 1 AS c FROM al)"""


@query(f"""WITH {TREES} SELECT doc, CAST(a AS VARCHAR) || CASE WHEN len(path) > 1 THEN '.' || b ELSE '' END || CASE WHEN len(path) > 2 THEN '.' || c ELSE '' END AS path, tag, attributes, text FROM dn
UNION ALL SELECT DISTINCT doc, '', 'document', '', NULL FROM dn""")
def xml_nodes(t) -> DataFrame:
    """The made trees, told as XML and read back."""
    back = trees.xml_nodes(sinks.xml_documents(*_tree(t), KEYS), KEYS)
    return back.select("doc", _shown(), "tag", _pairs(), "text")


#: Trees of few kinds of nodes, so that many are the same.
_few = "n <= 2 + doc % 2"


def _small(t) -> DataFrame:
    li = E._lines(t).where(_few)
    return li.select("doc", "path", chosen(("a", "b"), "l_partkey % 2").alias("tag"), F.array(F.struct(F.lit("k").alias("name"), chosen(("x", None), "l_suppkey % 2").alias("value"))).alias("attributes"), chosen((None, "t"), "l_partkey % 4 div 2").alias("text"))


SMALL = f"{E.LINES}, sm AS (SELECT doc, path, {chosen_sql(('a', 'b'), 'l_partkey % 2')} AS tag, {chosen_sql(('x', None), 'l_suppkey % 2')} AS k, {chosen_sql((None, 't'), 'l_partkey % 4 // 2')} AS text FROM li WHERE {_few})"


@query(f"""WITH {SMALL}, g AS (SELECT doc, string_agg(array_to_string(path, '.') || ':' || tag || ':' || coalesce(k, '-') || ':' || coalesce(text, '-'), ';' ORDER BY path) AS told, count(*) AS n FROM sm GROUP BY 1)
SELECT doc, min(doc) OVER (PARTITION BY told) AS first_doc, n AS n_nodes FROM g""")
def same_trees(t) -> DataFrame:
    """Each tree with the first one that is the same."""
    nodes = _small(t)
    s = trees.signatures(nodes, KEYS).where("size(path) = 0")
    firsts = s.groupBy("signature").agg(F.min("doc").alias("first_doc"))
    return s.join(firsts, "signature").select("doc", "first_doc", "n_nodes")


@query(f"""WITH {SMALL}, h AS (SELECT doc, path, tag || ':' || coalesce(k, '-') || ':' || coalesce(text, '-') AS told FROM sm), s AS (SELECT u.doc, u.p AS path, string_agg(array_to_string(u.path[len(u.p) + 1:], '.') || '=' || u.told, ';' ORDER BY u.path) AS told, count(*) AS n FROM (SELECT *, path[1:unnest(range(0, len(path) + 1))] AS p FROM h) u GROUP BY 1, 2)
SELECT told_len, n_nodes, count(*) AS n_subtrees, count(DISTINCT told) AS n_kinds FROM (SELECT told, n AS n_nodes, len(path) AS told_len FROM s) GROUP BY 1, 2""")
def subtree_kinds(t) -> DataFrame:
    """How many subtrees there are at each depth and size, and how many different ones."""
    s = trees.signatures(_small(t), KEYS).withColumn("told_len", F.size("path").cast("long"))
    return s.groupBy("told_len", "n_nodes").agg(F.count("*").alias("n_subtrees"), F.count_distinct("signature").alias("n_kinds"))


@query(f"""WITH {SMALL}, p AS (SELECT doc // 2 AS pair, doc % 2 AS side, path, tag || ':' || coalesce(k, '-') || ':' || coalesce(text, '-') AS told FROM sm),
d AS (SELECT coalesce(x.pair, y.pair) AS pair, coalesce(x.path, y.path) AS path, CASE WHEN y.told IS NULL THEN 'missing' WHEN x.told IS NULL THEN 'extra' ELSE 'changed' END AS kind FROM (SELECT * FROM p WHERE side = 0) x FULL JOIN (SELECT * FROM p WHERE side = 1) y ON x.pair = y.pair AND x.path = y.path WHERE x.told IS DISTINCT FROM y.told),
n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY path) AS i FROM d) SELECT pair, array_to_string(path, '.') AS path, kind FROM n WHERE i = 1""")
def tree_differences(t) -> DataFrame:
    """Where an even order's tree first differs from that of the odd one behind it."""
    nodes = _small(t).withColumn("pair", F.expr("doc div 2"))
    d = trees.first_differences(nodes.where("doc % 2 = 0").drop("doc"), nodes.where("doc % 2 = 1").drop("doc"), ["pair"])
    return d.select("pair", _shown(), "kind")


@query(f"WITH {E.LINES} SELECT doc, NOT (doc % 5 = 0 AND bool_or(l_partkey % 3 = 1)) AS same FROM li GROUP BY 1")
def xml_read_back(t) -> DataFrame:
    """Whether documents read back as they were told; some have had an attribute changed in between."""
    li = E._lines(t).withColumn("i", F.row_number().over(Window.partitionBy("doc").orderBy("n")) - 1)
    path = F.array((F.col("i") / 2).cast("int"), F.col("i") % 2)
    nodes = li.select("doc", path.alias("path"), F.lit("p").alias("tag"), F.array(F.struct(F.lit("k").alias("name"), (F.col("l_partkey") % 3).cast("string").alias("value"))).alias("attributes"))
    tops = li.where("i % 2 = 0").select("doc", F.array((F.col("i") / 2).cast("int")).alias("path"), F.lit("section").alias("tag"), F.array().cast(nodes.schema["attributes"].dataType).alias("attributes"))
    nodes = nodes.unionByName(tops)
    fragments = li.select("doc", F.concat(path, F.array(F.lit(0))).alias("path"), chosen(E.TEXTS, "l_suppkey % 9").alias("text"))
    xml = sinks.xml_documents(nodes, fragments, KEYS).withColumn("xml", F.when(F.col("doc") % 5 == 0, F.replace("xml", F.lit('k="1"'), F.lit('k="9"'))).otherwise(F.col("xml")))
    return trees.reads_back(nodes, fragments, xml, KEYS)


@query("SELECT c_custkey, c_name, n_orders, 1 AS n_superseded FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_nationkey > 3")
def published_tables(t) -> DataFrame:
    """Two tables published together, and once more without some nations; what readers then see."""
    c = t("customer").select("c_custkey", "c_name", "c_nationkey")
    orders = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    spark = c.sparkSession
    root = f"{shared_folder(spark)}/foliant-bundles/{uuid.uuid4().hex}"
    first = bundles.publish({"customers": c, "orders": orders}, root)
    bundles.publish({"customers": c.where("c_nationkey > 3"), "orders": orders}, root, overwrite=True)
    seen = bundles.read(spark, root)
    gone = int(bundles.state_of(spark, root, first) is bundles.State.SUPERSEDED)
    return seen["customers"].join(seen["orders"], F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "n_orders", F.lit(gone).alias("n_superseded"))
