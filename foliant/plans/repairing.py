"""Registered queries of repairs over made trees, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import repairs, sequences
from foliant.plans import evaluation as E
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.registry import query

KEYS = ["doc"]
BEFORE, AFTER = ("ab c", "x", "dé", "12"), ("c ab", "xy", "éd", "21")


def _fragments(t) -> DataFrame:
    return E._lines(t).select("doc", F.lit(0).alias("page"), F.col("n").alias("mcid"), chosen(BEFORE, "l_partkey % 4").alias("text"), "l_partkey", "l_suppkey", "l_tax")


_fr = f"fr AS (SELECT doc, 0 AS page, n AS mcid, {chosen_sql(BEFORE, 'l_partkey % 4')} AS text, l_partkey, l_suppkey, l_tax FROM li)"
_letters = lambda x: f"list_sort(string_split(replace({x}, ' ', ''), ''))"


@query(f"""WITH {E.LINES}, {_fr}, r AS (SELECT doc, page, mcid, {chosen_sql(BEFORE, 'l_suppkey % 4')} AS before, {chosen_sql(AFTER, 'l_suppkey % 4')} AS after FROM fr WHERE l_tax > 0.03)
SELECT fr.doc, fr.page, fr.mcid, CASE WHEN before IS NOT NULL AND text = before AND {_letters('before')} = {_letters('after')} THEN after ELSE text END AS text, CASE WHEN before IS NULL THEN 'kept' WHEN text <> before THEN 'not_found' WHEN {_letters('before')} <> {_letters('after')} THEN 'letters_differ' ELSE 'applied' END AS outcome FROM fr LEFT JOIN r USING (doc, page, mcid)""")
def replaced_texts(t) -> DataFrame:
    f = _fragments(t)
    r = f.where("l_tax > 0.03").select("doc", "page", "mcid", chosen(BEFORE, "l_suppkey % 4").alias("before"), chosen(AFTER, "l_suppkey % 4").alias("after"))
    return repairs.replaced(f.select("doc", "page", "mcid", "text"), r, KEYS)


@query(f"""WITH {E.LINES}, {_fr}, r AS (SELECT doc, page, mcid, mcid // 2 AS transfer, CASE WHEN l_suppkey % 9 = 0 THEN 'other' ELSE text END AS before, CASE WHEN mcid % 2 = 0 THEN text || '*' WHEN l_suppkey % 4 = 0 THEN text ELSE text END AS after0 FROM fr WHERE l_tax > 0.02),
q AS (SELECT doc, page, mcid, transfer, CASE WHEN mcid % 2 = 1 THEN before || '*' ELSE before END AS before, after0 AS after FROM r), j AS (SELECT q.*, fr.text FROM q LEFT JOIN fr USING (doc, page, mcid)),
g AS (SELECT doc, transfer, bool_and(coalesce(text = before, false)) AS found, list_sort(string_split(string_agg(replace(before, ' ', ''), ''), '')) = list_sort(string_split(string_agg(replace(after, ' ', ''), ''), '')) AS same FROM j GROUP BY 1, 2)
SELECT fr.doc, fr.page, fr.mcid, CASE WHEN found AND same THEN after ELSE fr.text END AS text, CASE WHEN found IS NULL THEN 'kept' WHEN NOT found THEN 'not_found' WHEN NOT same THEN 'letters_differ' ELSE 'applied' END AS outcome FROM fr LEFT JOIN q ON q.doc = fr.doc AND q.mcid = fr.mcid LEFT JOIN g ON g.doc = q.doc AND g.transfer = q.transfer""")
def transferred_texts(t) -> DataFrame:
    f = _fragments(t)
    c = F.col
    base = F.when(c("l_suppkey") % 9 == 0, "other").otherwise(c("text"))
    before = F.when(c("mcid") % 2 == 1, F.concat(base, F.lit("*"))).otherwise(base)
    after = F.when(c("mcid") % 2 == 0, F.concat("text", F.lit("*"))).otherwise(c("text"))
    r = f.where("l_tax > 0.02").select("doc", "page", "mcid", F.floor(c("mcid") / 2).alias("transfer"), before.alias("before"), after.alias("after"))
    return repairs.transferred(f.select("doc", "page", "mcid", "text"), r, KEYS)


@query(f"""WITH {E.LINES}, nd AS (SELECT doc, path FROM li UNION SELECT doc, path[1:1] FROM li), mv AS (SELECT doc, path, [9, CAST(n AS INTEGER)] AS np FROM li WHERE l_tax > 0.05 UNION ALL SELECT DISTINCT doc, [1], [8, 8] FROM li WHERE l_discount > 0.05), k AS (SELECT mv.* FROM mv SEMI JOIN nd USING (doc, path)),
b AS (SELECT nd.doc, nd.path, arg_max(struct_pack(u := k.path, p := k.np), len(k.path)) AS b FROM nd JOIN k ON k.doc = nd.doc AND nd.path[1:len(k.path)] = k.path GROUP BY 1, 2)
SELECT nd.doc, array_to_string(nd.path, '.') AS path, array_to_string(CASE WHEN b IS NULL THEN nd.path ELSE list_concat(b.p, nd.path[len(b.u) + 1:]) END, '.') AS new_path FROM nd LEFT JOIN b USING (doc, path)""")
def reparented_nodes(t) -> DataFrame:
    li = E._lines(t)
    n = li.select("doc", "path").unionByName(li.select("doc", F.slice("path", 1, 1).alias("path"))).distinct()
    moves = li.where("l_tax > 0.05").select("doc", "path", F.array(F.lit(9), F.col("n")).alias("new_path")).unionByName(li.where("l_discount > 0.05").select("doc").distinct().select("doc", F.array(F.lit(1)).alias("path"), F.array(F.lit(8), F.lit(8)).alias("new_path")))
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".")
    return repairs.reparented(n, moves, KEYS).select("doc", told("path").alias("path"), told("new_path").alias("new_path"))


@query(f"""WITH {E.LINES}, g AS (SELECT doc, 'w' || n AS wrapper, n AS first, n + 1 + CAST(l_suppkey % 2 AS INTEGER) AS last FROM li WHERE l_tax > 0.05), v AS (SELECT *, max(last) OVER (PARTITION BY doc ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, lead(first) OVER (PARTITION BY doc ORDER BY first) AS nx FROM g),
k AS (SELECT * FROM v WHERE coalesce(e < first, true) AND coalesce(nx > last, true) AND EXISTS (SELECT 1 FROM li WHERE li.doc = v.doc AND li.n = v.last)) SELECT li.doc, li.n, wrapper FROM li LEFT JOIN k ON k.doc = li.doc AND li.n BETWEEN first AND last""")
def wrapped_children(t) -> DataFrame:
    li = E._lines(t)
    g = li.where("l_tax > 0.05").select("doc", F.concat(F.lit("w"), F.col("n").cast("string")).alias("wrapper"), F.col("n").alias("first"), (F.col("n") + 1 + (F.col("l_suppkey") % 2).cast("int")).alias("last"))
    return repairs.wrapped(li.select("doc", "n"), g, KEYS, "n")


@query(f"""WITH {E.LINES}, p AS (SELECT doc, n AS ord, 100 - (n // 3) * 12 + CASE WHEN l_suppkey % 3 = 0 THEN 0.02 ELSE 0 END AS baseline, l_quantity * 4 AS x0, l_quantity * 4 + 10 AS x1, 9.0 AS height, l_partkey % 3 > 0 AS ltr, l_partkey % 3 = 1 AS latin FROM li),
l AS (SELECT *, round(baseline / 12) AS ln FROM p), a AS (SELECT *, row_number() OVER v AS pos, CASE WHEN lag(ltr) OVER v AND ltr AND x0 - lag(x1) OVER v <= 9.0 THEN 0 ELSE 1 END AS cut FROM l WINDOW v AS (PARTITION BY doc, ln ORDER BY x0, ord)),
g AS (SELECT *, sum(cut) OVER (PARTITION BY doc, ln ORDER BY pos) AS grp FROM a), h AS (SELECT *, bool_or(latin) OVER (PARTITION BY doc, ln, grp) AS lat FROM g)
SELECT doc, ord, CAST(row_number() OVER (PARTITION BY doc ORDER BY ln DESC, grp DESC, CASE WHEN lat THEN pos ELSE -pos END) AS INTEGER) AS new_order FROM h""")
def right_to_left_order(t) -> DataFrame:
    c = F.col
    x = c("l_quantity") * 4
    baseline = 100 - F.floor(c("n") / 3) * 12 + F.when(c("l_suppkey") % 3 == 0, 0.02).otherwise(0.0)
    p = E._lines(t).select("doc", c("n").alias("ord"), baseline.alias("baseline"), x.alias("x0"), (x + 10).alias("x1"), F.lit(9.0).alias("height"), (c("l_partkey") % 3 > 0).alias("ltr"), (c("l_partkey") % 3 == 1).alias("latin"))
    return repairs.inline_order(p, KEYS).select("doc", "ord", "new_order")


DIRECTED = ("سلام", "سلام!", "سلام 5", "abc", "https://", "؟", "שלום עולם", "سلام abc", "", "سَلام.")


@query(f"SELECT p_partkey, {chosen_sql(('rtl', 'rtl', None, None, 'ltr', None, 'rtl', None, None, 'rtl'), 'p_partkey % 10')} AS direction FROM part")
def text_directions(t) -> DataFrame:
    return t("part").select("p_partkey", repairs.text_direction(chosen(DIRECTED, "p_partkey % 10")).alias("direction"))


@query("""WITH b AS (SELECT o_orderkey AS doc, unnest([1, 2, 3]) AS ordinal FROM orders), s AS (SELECT doc, ordinal, CASE WHEN ordinal = 1 THEN 0 ELSE ordinal * 4 + doc % 2 END AS start_page, 14 + doc % 3 AS last, CASE WHEN doc % 4 = 0 THEN 14 + doc % 3 - 2 WHEN doc % 4 = 1 THEN 14 + doc % 3 - 1 ELSE 14 + doc % 3 END AS cut FROM b)
SELECT doc, ordinal, CAST(start_page AS INTEGER) AS start_page, CAST(coalesce(lead(start_page) OVER (PARTITION BY doc ORDER BY ordinal) - 1, greatest(cut, start_page)) AS INTEGER) AS end_page FROM s""")
def cover_inclusive_bounds(t) -> DataFrame:
    d = t("orders").select(F.col("o_orderkey").alias("doc"))
    k = F.col("doc")
    b = d.select("doc", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ordinal")).select("doc", "ordinal", (F.col("ordinal") * 4 + k % 2).cast("int").alias("start_page"), (F.col("ordinal") * 4 + 1).alias("end_page"))
    last = (14 + k % 3).cast("int")
    out = d.where("doc % 4 < 2").select("doc", last.alias("page")).unionByName(d.where("doc % 4 = 0").select("doc", (last - 1).alias("page"))).unionByName(d.where("doc % 4 = 2").select("doc", (last - 1).alias("page")))
    r = repairs.inclusive_bounds(b, d.select("doc", last.alias("last_page")), KEYS, out)
    return r.select("doc", "ordinal", F.col("start_page").cast("int").alias("start_page"), F.col("end_page").cast("int").alias("end_page"))


@query("""WITH e AS (SELECT DISTINCT s_suppkey AS doc, i AS ref, i * 2 + j AS child, j AS ord FROM supplier, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([0, 1]) AS j)), b AS (SELECT doc, 5 AS ref, CASE WHEN doc % 3 = 0 THEN 2 ELSE 50 END AS child, 0 AS ord FROM (SELECT DISTINCT s_suppkey AS doc FROM supplier))
SELECT doc, path, ref, page FROM (SELECT DISTINCT s_suppkey AS doc FROM supplier), (VALUES ('0', 1, 7), ('0.0', 2, 0), ('0.1', 3, 7), ('0.0.0', 4, 0), ('0.0.1', 5, 0), ('0.1.0', 6, 7), ('0.1.1', 7, 7)) AS v(path, ref, page)
UNION ALL SELECT doc, '0.0.1.0', 50, 0 FROM b WHERE doc % 3 <> 0""")
def walked_nodes(t) -> DataFrame:
    found, _ = repairs.walked(*_references(t), KEYS)
    return found.select("doc", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "ref", "page")


def _references(t) -> tuple[DataFrame, DataFrame]:
    """A tree of seven nodes; in every third document the fifth leads back to the second."""
    d = t("supplier").select(F.col("s_suppkey").alias("doc"))
    i, j = F.col("ref"), F.col("ord")
    e = d.select("doc", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ref")).select("doc", "ref", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).select("doc", "ref", "ord", (i * 2 + j).alias("child"), F.when((i == 1) & (j == 0), 0).alias("page"))
    back = d.select("doc", F.lit(5).alias("ref"), F.lit(0).alias("ord"), F.when(F.col("doc") % 3 == 0, 2).otherwise(50).alias("child"), F.lit(None).cast("int").alias("page"))
    return e.unionByName(back), d.select("doc", F.lit(1).alias("ref"), F.lit(7).alias("page"))


@query("SELECT DISTINCT s_suppkey AS doc, '0.0.1.0' AS path, 2 AS ref, 'structure_cycle' AS code FROM supplier WHERE s_suppkey % 3 = 0")
def structure_cycles(t) -> DataFrame:
    _, faults = repairs.walked(*_references(t), KEYS)
    return faults.select("doc", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), "ref", "code")


@query("""WITH m AS (SELECT *, lag(l_quantity) OVER w = l_quantity AND lag(l_returnflag) OVER w = l_returnflag AND lag(l_linestatus) OVER w = l_linestatus AS again FROM (SELECT l_orderkey, l_linenumber, floor(max(l_quantity) / 10) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, l_linenumber FROM m WHERE NOT coalesce(again, false)""")
def overprints_removed(t) -> DataFrame:
    n = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.floor(F.max("l_quantity") / 10).alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    return sequences.without_adjacent_copies(n, ["l_orderkey"], "l_linenumber", ["l_quantity", "l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber")
