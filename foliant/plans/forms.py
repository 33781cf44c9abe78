"""The registered query of form clusters, over sections made of order lines, with SQL that knows how they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import clusters
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.registry import query
from foliant.plans.structure import NODES
from foliant.sources.places import dealt, written

KEYS = ["doc"]
#: Weights and sizes by which a section's lines are set: titles, labels, details, between both, heavier but smaller.
STYLES = ((600, 12.0), (600, 12.0), (400, 10.0), (400, 10.0), (400, 10.0), (300, 9.0), (400, 10.0), (600, 12.0), (500, 11.0), (400, 10.0), (400, 10.0), (700, 9.0), (400, 10.0), (600, 12.0), (400, 10.0), (300, 9.0), (400, 10.0))
TITLES = ((800, 16.0), (800, 16.0), (800, 16.0), (600, 16.0), (800, 16.0), (800, 12.0), (800, 16.0))
_style, _top = "CASE WHEN l_quantity >= 20 THEN (l_partkey * 7 + l_linenumber * 5 + l_orderkey) % 17 WHEN l_linenumber <= 3 THEN l_partkey % 5 % 2 * 5 ELSE 2 END", "l_orderkey div 16 % 7"
_in_table = "l_quantity < 20"
LONG = "so long that it is no label " * 6


def _paragraphs(t) -> DataFrame:
    """doc, path, role, source_role, text, weight, size, page, mcid, taken: a section's title, lines and cells, a fragment in each."""
    table = t("lineitem")
    lines = table.select(F.expr("l_orderkey div 16").cast("long").alias("doc"), "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_partkey")
    n = dealt(lines, "doc", table=table, once=True).groupBy("doc", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"), F.min("l_partkey").alias("l_partkey"))
    n = n.withColumns({"at": F.expr("int(l_orderkey % 16 * 10 + l_linenumber)"), "tab": F.expr(_in_table)})
    n = n.withColumns({"weight": chosen([w for w, _ in STYLES], _style), "size": chosen([s for _, s in STYLES], _style)})
    cell = Window.partitionBy("doc", "tab", F.floor(F.col("at") / 10)).orderBy("at")
    path = F.when(F.col("tab"), F.array(F.lit(0), F.lit(500), (F.col("at") / 10).cast("int"), F.row_number().over(cell) - 1)).otherwise(F.array(F.lit(0), F.col("at")))
    text = F.when(F.expr("l_partkey % 29 = 0"), LONG).when(F.expr("l_partkey % 31 = 0"), " ").otherwise(F.concat(F.lit("text "), "l_returnflag"))
    rows = n.select("doc", path.alias("path"), F.when(F.expr("l_partkey % 23 = 0 and not tab"), "list").otherwise("paragraph").alias("role"), F.when(F.expr("l_partkey % 37 = 0"), "Heading2").otherwise("Para").alias("source_role"), text.alias("text"), F.when(F.expr("l_partkey % 199 > 0"), F.col("weight")).alias("weight"), "size", F.lit(0).alias("page"), F.col("at").alias("mcid"), F.expr("l_partkey % 41 = 0").alias("taken"))
    top = n.groupBy("doc").agg(F.min("l_orderkey").alias("l_orderkey")).select("doc", F.array(F.lit(0), F.lit(0)).alias("path"), F.lit("paragraph").alias("role"), F.lit("Para").alias("source_role"), F.lit("Title").alias("text"), chosen([w for w, _ in TITLES], _top).alias("weight"), chosen([s for _, s in TITLES], _top).alias("size"), F.lit(0).alias("page"), F.lit(0).alias("mcid"), F.lit(False).alias("taken"))
    return rows.unionByName(top)


CLUSTERS = f"""{NODES}, ln AS (SELECT l_orderkey // 16 AS doc, CAST(l_orderkey % 16 * 10 + l_linenumber AS INTEGER) AS pos, {_in_table} AS tab, {chosen_sql([w for w, _ in STYLES], _style)} AS w, {chosen_sql([s for _, s in STYLES], _style)} AS s, l_partkey % 23 = 0 AND NOT ({_in_table}) AS no_paragraph, l_partkey % 37 = 0 AS heading, l_partkey % 29 <> 0 AS short, l_partkey % 31 <> 0 OR l_partkey % 29 = 0 AS told, l_partkey % 199 > 0 AS known, l_partkey % 41 = 0 AS taken FROM nodes),
tt AS (SELECT DISTINCT doc, {chosen_sql([w for w, _ in TITLES], 'doc % 7')} AS w, {chosen_sql([s for _, s in TITLES], 'doc % 7')} AS s FROM ln),
ok AS (SELECT tt.doc, any_value(tt.w) AS w, any_value(tt.s) AS s FROM tt JOIN ln USING (doc) GROUP BY 1 HAVING bool_and(no_paragraph OR NOT told OR (known AND ln.w < tt.w AND ln.s < tt.s))),
rc AS (SELECT ln.doc, pos, CAST(pos // 10 AS INTEGER) AS cell, tab, ln.w, ln.s, NOT no_paragraph AND told AS para, short, heading, taken FROM ln JOIN ok USING (doc)),
ts AS (SELECT DISTINCT doc, w AS tw, s AS ts FROM rc WHERE NOT tab AND para AND short),
dr AS (SELECT rc.*, tw, ts, para AND w = tw AND s = ts AS same FROM rc JOIN ts USING (doc) WHERE NOT tab UNION ALL SELECT doc, 500, NULL, false, NULL, NULL, false, NULL, false, false, tw, ts, false FROM ts),
dg AS (SELECT *, sum(CASE WHEN same OR NOT para THEN 1 ELSE 0 END) OVER (PARTITION BY doc, tw, ts ORDER BY pos) AS g FROM dr),
dl AS (SELECT doc, tw, ts, max(pos) FILTER (same AND short) AS pos, max(w) FILTER (NOT same) AS bw, max(s) FILTER (NOT same) AS bs FROM dg GROUP BY doc, tw, ts, g HAVING bool_or(same AND short) AND count(*) FILTER (NOT same) > 0 AND bool_and(same OR (para AND w < tw AND s < ts))),
cp AS (SELECT *, row_number() OVER (PARTITION BY doc, cell ORDER BY pos) AS k FROM rc WHERE tab AND para),
cl AS (SELECT doc, cell, max(w) FILTER (k = 1) AS tw, max(s) FILTER (k = 1) AS ts, max(pos) FILTER (k = 1) AS pos, max(w) FILTER (k > 1) AS bw, max(s) FILTER (k > 1) AS bs FROM cp GROUP BY 1, 2 HAVING bool_or(k = 1 AND short) AND count(*) > 1),
cg AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc, tw, ts) AS n FROM cl WHERE bw < tw AND bs < ts) WHERE n >= 2),
lb AS (SELECT doc, tw, ts, pos, bw, bs, 1 AS direct FROM dl UNION ALL SELECT doc, tw, ts, pos, bw, bs, 0 FROM cg),
ft AS (SELECT doc, tw, ts, max(bw) AS bw, max(bs) AS bs FROM lb GROUP BY 1, 2, 3 HAVING sum(direct) >= 3 AND count(*) FILTER (direct = 0) >= 2),
f1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM ft) WHERE n = 1),
fl AS (SELECT lb.doc, lb.pos, f1.tw, f1.ts, f1.bw, f1.bs FROM lb JOIN f1 USING (doc, tw, ts)),
nb AS (SELECT doc FROM fl JOIN rc USING (doc, pos) GROUP BY 1 HAVING NOT bool_or(heading OR taken))"""


@query(f"""WITH {CLUSTERS} SELECT doc, pos, 'strong_label' AS display_role, tw AS weight, ts AS size, bw AS body_weight, bs AS body_size FROM fl JOIN nb USING (doc)
UNION ALL SELECT doc, 0, 'section_heading', ok.w, ok.s, bw, bs FROM f1 JOIN ok USING (doc) JOIN nb USING (doc)""")
def form_clusters(t) -> DataFrame:
    """Titles and labels by the numbers of their lines."""
    p = written(_paragraphs(t), "form-paragraphs")  # nodes, fragments and what is taken would each work them out
    own = p.select("doc", "path", "role", "source_role", F.lit(None).cast("string").alias("actual_text"))
    box = lambda path, role: p.select("doc", path.alias("path"), F.lit(role).alias("role"), F.lit(role).alias("source_role"), F.lit(None).cast("string").alias("actual_text")).distinct()
    inner = p.where("size(path) = 4")
    cells = inner.select("doc", F.slice("path", 1, 3).alias("path"), F.lit("table_cell").alias("role"), F.lit("TD").alias("source_role"), F.lit(None).cast("string").alias("actual_text")).distinct()
    nodes = own.unionByName(cells).unionByName(box(F.array(F.lit(0)), "section")).unionByName(box(F.array(F.lit(0), F.lit(500)), "table"))
    fragments = p.select("doc", F.concat("path", F.array(F.lit(0))).alias("path"), "text", "weight", "size", "page", "mcid")
    taken = p.where("taken").select("doc", "path")
    found = clusters.form_clusters(nodes, fragments, taken, KEYS)
    at = p.select("doc", "path", F.col("mcid").alias("pos"))
    return found.join(at, ["doc", "path"]).select("doc", "pos", "display_role", "weight", "size", "body_weight", "body_size")
