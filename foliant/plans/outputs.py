"""Registered queries of sinks and scopes over made trees, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import align, checks
from foliant.plans import evaluation as E
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.registry import query
from foliant.sources import sinks

KEYS = ["doc"]
NAMES = ("a < b & c", 'say "x"', None, "bell \x07", "line\nend\ttab", "plain")


def _tree(t) -> tuple[DataFrame, DataFrame]:
    li = E._lines(t)
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    leaf = li.select("doc", "path", chosen(E.ROLES, "l_partkey % 8").alias("tag"), F.array(pair("title", chosen(NAMES, "l_partkey % 6")), pair("n", F.col("n").cast("string"))).alias("attributes"))
    top = li.select("doc", F.slice("path", 1, 1).alias("path")).distinct().select("doc", "path", F.lit("section").alias("tag"), F.array(pair("n", F.lit("0"))).alias("attributes"))
    return leaf.unionByName(top), E._fragments(t).select("doc", "path", "text")


_esc = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;')"
_att = lambda x: f"replace(replace(replace({_esc(x)}, '\"', '&quot;'), chr(10), '&#10;'), chr(9), '&#9;')"
_odd = lambda x: f"({E._bad(x)} > 0)"
_title = chosen_sql(NAMES, "l_partkey % 6")
XML = f"""{E.TREE}, ta AS (SELECT doc, path, {chosen_sql(E.ROLES, 'l_partkey % 8')} AS tag, coalesce(CASE WHEN {_odd(_title)} THEN ' title-base64="' || base64(encode({_title})) || '"' ELSE ' title="' || {_att(_title)} || '"' END, '') || ' n="' || n || '"' AS attrs, n FROM li
  UNION ALL SELECT DISTINCT doc, path[1:1], 'section', ' n="0"', 0 FROM li)"""
_events = """ev AS (SELECT doc, path, '<' || tag || attrs || '>' AS x FROM ta UNION ALL SELECT doc, list_append(path, 2147483647), '</' || tag || '>' FROM ta
  UNION ALL SELECT doc, path, CASE WHEN {odd} THEN '<text encoding="base64">' || base64(encode(text)) ELSE '<text>' || {esc} END || '</text>' FROM fr)""".replace("{odd}", _odd("text")).replace("{esc}", _esc("text"))


@query(f"WITH {XML}, {_events} SELECT doc, '<document>' || string_agg(x, '' ORDER BY path) || '</document>' AS xml FROM ev GROUP BY 1")
def xml_documents(t) -> DataFrame:
    return sinks.xml_documents(*_tree(t), KEYS)


@query(f"""WITH {XML}, hn AS (SELECT doc, path, string_agg(' ' || name || '="' || value || '"', '' ORDER BY name) AS more FROM (SELECT doc, path, 'display-role' AS name, 'subtitle' AS value FROM li WHERE l_discount > 0.07 UNION ALL SELECT doc, path, 'continues', '1' FROM li WHERE l_tax > 0.05) GROUP BY 1, 2),
a2 AS (SELECT ta.doc, ta.path, tag, attrs || coalesce(more, '') AS attrs FROM ta LEFT JOIN hn USING (doc, path)), {_events.replace('FROM ta', 'FROM a2')} SELECT doc, '<document>' || string_agg(x, '' ORDER BY path) || '</document>' AS xml FROM ev GROUP BY 1""")
def semantic_xml(t) -> DataFrame:
    nodes, fragments = _tree(t)
    li = E._lines(t)
    hints = li.where("l_discount > 0.07").select("doc", "path", F.lit("display-role").alias("name"), F.lit("subtitle").alias("value")).unionByName(li.where("l_tax > 0.05").select("doc", "path", F.lit("continues").alias("name"), F.lit("1").alias("value")))
    return sinks.xml_documents(sinks.with_hints(nodes, hints, KEYS), fragments, KEYS)


@query(f"WITH {E.TREE} SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS INTEGER) AS nth, text FROM fr")
def xml_round_trip(t) -> DataFrame:
    return sinks.xml_texts(sinks.xml_documents(*_tree(t), KEYS), KEYS)


CELLS = ("a|b", "*x*", "two\nlines", "", "1. one", "plain", "#")


@query(rf"""WITH c AS (SELECT l_orderkey AS doc, CAST(l_linenumber // 2 AS INTEGER) AS r, CAST(l_linenumber % 2 + 1 AS INTEGER) AS c, max(l_partkey) AS k FROM lineitem GROUP BY 1, 2, 3), e AS (SELECT doc, r, c, replace(regexp_replace(regexp_replace(regexp_replace({chosen_sql(CELLS, 'k % 7')}, '([\\`*_\[\]<>|])', '\\\1', 'g'), '^(#{{1,6}}|[-+])(\s|$)', '\\\1\2'), '^(\d{{1,9}})([.)])(\s|$)', '\1\\\2\3'), chr(10), '<br>') AS t FROM c),
w AS (SELECT doc, max(c) AS w FROM c GROUP BY 1), l AS (SELECT doc, r, '| ' || string_agg(coalesce(t, ''), ' | ' ORDER BY c) || ' |' AS line FROM (SELECT x.doc, x.r, x.c, e.t FROM (SELECT DISTINCT c.doc, c.r, i AS c FROM c JOIN w USING (doc), (SELECT unnest([1, 2]) AS i) WHERE i <= w) x LEFT JOIN e ON e.doc = x.doc AND e.r = x.r AND e.c = x.c) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY r) AS i FROM l) SELECT doc, string_agg(line || CASE WHEN i = 1 THEN chr(10) || '|' || repeat(' --- |', w) ELSE '' END, chr(10) ORDER BY i) AS markdown FROM n JOIN w USING (doc) GROUP BY 1""")
def markdown_tables(t) -> DataFrame:
    c = F.col
    cells = t("lineitem").groupBy(c("l_orderkey").alias("doc"), F.floor(c("l_linenumber") / 2).cast("int").alias("row"), (c("l_linenumber") % 2 + 1).cast("int").alias("column")).agg(F.max("l_partkey").alias("k"))
    return sinks.markdown_tables(cells.select("doc", "row", "column", chosen(CELLS, "k % 7").alias("text")), KEYS)


@query("""SELECT c_custkey, CAST(to_json(struct_pack(c_mktsegment := c_mktsegment, c_name := CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END, c_nationkey := c_nationkey)) AS VARCHAR) AS json FROM customer""")
def json_rows(t) -> DataFrame:
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("c_name"), "c_nationkey", "c_mktsegment")
    return sinks.json_lines(c, ["c_custkey"])


@query("""WITH p AS (SELECT o_orderkey, 'out/' || o_orderpriority || '/' || o_orderstatus || '_' || 'ENG' AS root, strftime(o_orderdate, '%y%m%d_%H%M') AS stamp, o_orderpriority, o_orderstatus FROM orders)
SELECT o_orderkey, root, root || '/content_poc.json' AS json, root || '/content_blocks.md' AS markdown, root || '/' || o_orderpriority || '_' || o_orderstatus || '_ENG_' || stamp || '_content_review.xlsx' AS workbook, root || '/crops' AS crops FROM p""")
def output_paths(t) -> DataFrame:
    p = sinks.output_paths("out", F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit("ENG"), sinks.run_stamp(F.col("o_orderdate")))
    return t("orders").select("o_orderkey", p.alias("p")).select("o_orderkey", "p.*")


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) WHEN doc_id % 3 = 1 THEN upper(sha256(text || 'x')) END AS pin, text FROM documents) SELECT doc_id, CASE WHEN pin IS NULL THEN 'unknown' WHEN lower(pin) = sha256(text) THEN 'ok' ELSE 'changed' END AS pin FROM p""")
def pinned_documents(t) -> DataFrame:
    d = t("documents").select("doc_id", "text")
    pins = d.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise(F.upper(F.sha2(F.concat("text", F.lit("x")), 256))).alias("sha256"))
    return checks.pinned(d, pins, "doc_id", "text").select("doc_id", "pin")


SCOPES = (("one", "za_l02", "BOOK", ("ENG", "FRA")), ("two", "ZB_ENG", None, None), ("three", "ZC", "A2", None))


@query("""WITH p AS (SELECT c_custkey, ['ZA_L02', 'zb_eng', 'ZC', 'ZD'][CAST(c_custkey % 4 AS INTEGER) + 1] AS token, ['BOOK', 'A2', 'A3'][CAST(c_custkey % 3 AS INTEGER) + 1] AS ty, CASE WHEN c_custkey % 5 = 0 THEN ['FRA', 'ENG'] ELSE ['ENG', 'FRA'] END AS langs FROM customer)
SELECT c_custkey, CASE WHEN lower(token) = 'za_l02' AND ty = 'BOOK' AND langs = ['ENG', 'FRA'] THEN 'one' WHEN lower(token) = 'zb_eng' THEN 'two' WHEN token = 'ZC' AND ty = 'A2' THEN 'three' END AS scope FROM p""")
def profile_scopes(t) -> DataFrame:
    langs = lambda *x: F.array(*map(F.lit, x))
    p = t("customer").select("c_custkey", chosen(("ZA_L02", "zb_eng", "ZC", "ZD"), "c_custkey % 4").alias("source_token"), chosen(("BOOK", "A2", "A3"), "c_custkey % 3").alias("doc_type"), F.when(F.col("c_custkey") % 5 == 0, langs("FRA", "ENG")).otherwise(langs("ENG", "FRA")).alias("languages"))
    scopes = p.sparkSession.createDataFrame(SCOPES, "name string, source_token string, doc_type string, languages array<string>")
    return checks.in_scope(p, scopes).select("c_custkey", "scope")


DECIMALS = (("5 .5 GHz", "5.5 GHz"), ("1 ,000 and 2 .5", "1,000 and 2.5"), ("1 ,000", "1 ,000"), ("a .5", "a.5"), (" 3 .1 ", "3.1"), ("plain", "plain"))


@query(rf"""WITH d AS (SELECT p_partkey, {chosen_sql([a for a, _ in DECIMALS], 'p_partkey % 6')} AS x, {chosen_sql([b for _, b in DECIMALS], 'p_partkey % 6')} AS s FROM part), f AS (SELECT *, regexp_replace(x, '(\d)[ \t]+([.,]\d)', '\1\2', 'g') AS fixed FROM d)
SELECT p_partkey, CASE WHEN fixed <> x AND trim(fixed) = trim(s) THEN fixed ELSE x END AS told, regexp_replace(x, '[\s\x{{200e}}\x{{200f}}]', '', 'g') AS key FROM f""")
def proven_decimals(t) -> DataFrame:
    x, s = chosen([a for a, _ in DECIMALS], "p_partkey % 6"), chosen([b for _, b in DECIMALS], "p_partkey % 6")
    return t("part").select("p_partkey", T.proven_decimals(x, s).alias("told"), T.condition_key(x).alias("key"))


PIECES = (("ab", "c"), ("a ", " b"), ("日", "本"), ("x", ""), ("(", "y"), ("z)", "(w"), ("", " q"), ("end.", "Next"), ("3", "日"))


@query(r"""WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS n, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2), p AS (SELECT doc, list({a} ORDER BY n) AS a FROM c GROUP BY 1),
j AS (SELECT doc, list_reduce(list_transform(a, lambda y: {'t': y, 's': ''}), lambda x, y: {'t': CASE WHEN regexp_matches(x.t, '\s$') THEN rtrim(x.t) || ' ' || ltrim(y.t) WHEN regexp_matches(y.t, '^\s') THEN x.t || ' ' || ltrim(y.t)
  WHEN regexp_matches(x.t, '[\p{L}\p{N}_)\]}]$') AND regexp_matches(y.t, '^[\p{L}\p{N}_(\[{]') AND NOT (regexp_matches(x.t, '\p{Han}$') AND regexp_matches(y.t, '^\p{Han}')) THEN x.t || ' ' || y.t ELSE x.t || y.t END,
  's': x.s || CASE WHEN regexp_matches(x.t, '\s$') THEN 'n' WHEN regexp_matches(y.t, '^\s') THEN 't' WHEN regexp_matches(x.t, '[\p{L}\p{N}_)\]}]$') AND regexp_matches(y.t, '^[\p{L}\p{N}_(\[{]') AND NOT (regexp_matches(x.t, '\p{Han}$') AND regexp_matches(y.t, '^\p{Han}')) THEN 'i' ELSE 'k' END}) AS r FROM p)
SELECT doc, r.t AS joined, r.s AS actions FROM j""".replace("{a}", chosen_sql([p[0] for p in PIECES] + [p[1] for p in PIECES], "l_partkey % 18")))
def joined_parts(t) -> DataFrame:
    li = E._lines(t).select("doc", "n", chosen([p[0] for p in PIECES] + [p[1] for p in PIECES], "l_partkey % 18").alias("x"))
    g = li.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("parts"))
    j = g.select("doc", align.join_parts("parts").alias("j"))
    return j.select("doc", "j.joined", F.array_join(F.transform("j.actions", lambda a: F.substring(a["action"], 1, 1)), "").alias("actions"))
