"""Registered queries of tables whose cells span, over cells made of order lines, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import tables
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.registry import query
from foliant.plans.structure import NODES
from foliant.sources.places import dealt

KEYS = ["doc"]
#: Spans as attributes tell them; None where a cell has no such attribute.
DOWN = (None, None, None, "1", None, "2", None, "3", " 2 ", "0", None, "x", "1001", None, "", None, "4")
ACROSS = (None, None, "2", None, None, "1", None, None, "3", None, "-1", None, None)
TEXTS = ("one", "a|b", "<b> & \"c\" 'd'", "two\nlines", "", None, "*x*", "plain text")
_down, _across, _text, _head = "(l_partkey + l_linenumber) % 17", "(l_partkey * 3 + l_linenumber) % 13", "(l_partkey + l_orderkey) % 8", "l_orderkey % 6 = 0 AND l_orderkey % 4 <> 2"


def _raw(t) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    told = lambda n, values, i: F.when(chosen(values, i).isNotNull(), F.array(pair(n, chosen(values, i)))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    li = dealt(t("lineitem").select(F.expr("l_orderkey div 6").cast("long").alias("doc"), "l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), "doc")
    n = li.groupBy("doc", "l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.min("l_partkey").alias("l_partkey"))
    return n.select("doc", F.expr("int(l_orderkey % 6)").alias("row"), F.col("l_linenumber").cast("int").alias("ord"), F.concat(told("/RowSpan", DOWN, _down), told("colspan", ACROSS, _across)).alias("attributes"), chosen(TEXTS, _text).alias("text"), F.expr(_head).alias("header"), F.expr("l_quantity > 49").alias("blocks"))


def _cells(t) -> DataFrame:
    return _raw(t).withColumns({"row_span": tables.span(F.col("attributes"), "rowspan")["value"], "col_span": tables.span(F.col("attributes"), "colspan")["value"]})


def _grid(t) -> DataFrame:
    """Placed cells, dealt once more: Python steps forget how their rows were dealt."""
    return dealt(tables.placed(_cells(t).drop("attributes", "header", "blocks"), KEYS), *KEYS, read=False)


_good = lambda x: f"CASE WHEN regexp_matches(trim({x}), '^\\d+$') AND length(trim({x})) < 10 AND CAST(trim({x}) AS BIGINT) BETWEEN 1 AND 1000 THEN CAST(trim({x}) AS INTEGER) ELSE 1 END"
CELLS = f"""{NODES}, rw AS (SELECT l_orderkey // 6 AS doc, CAST(l_orderkey % 6 AS INTEGER) AS row, CAST(l_linenumber AS INTEGER) AS ord, {chosen_sql(DOWN, _down)} AS down, {chosen_sql(ACROSS, _across)} AS across, {chosen_sql(TEXTS, _text)} AS text, {_head} AS header, l_quantity > 49 AS blocks FROM nodes),
ce AS (SELECT *, CASE WHEN down IS NULL THEN 1 ELSE {_good('down')} END AS row_span, CASE WHEN across IS NULL THEN 1 ELSE {_good('across')} END AS col_span FROM rw)"""
#: The fold as a recursion from cell to cell, with the first free row of each of 40 columns.
GRID = f"""{CELLS}, nm AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY row, ord) AS i FROM ce),
fd AS (SELECT doc, i, row, ord, row_span, col_span, 1 AS col, false AS clash, list_transform(range(1, 41), lambda c: CASE WHEN c <= col_span THEN row + row_span ELSE 0 END) AS taken, 1 + col_span AS at FROM nm WHERE i = 1
  UNION ALL SELECT doc, i, row, ord, row_span, col_span, col, len(list_filter(taken[col:col + col_span - 1], lambda x: x > row)) > 0, list_transform(range(1, 41), lambda c: CASE WHEN c >= col AND c < col + col_span THEN greatest(taken[c], row + row_span) ELSE taken[c] END), col + col_span
  FROM (SELECT nm.doc, nm.i, nm.row, nm.ord, nm.row_span, nm.col_span, fd.taken, list_filter(range(CASE WHEN nm.row = fd.row THEN fd.at ELSE 1 END, 41), lambda c: fd.taken[c] <= nm.row)[1] AS col FROM fd JOIN nm ON nm.doc = fd.doc AND nm.i = fd.i + 1)),
gr AS (SELECT ce.*, CAST(col - 1 AS INTEGER) AS "column", clash FROM ce JOIN fd USING (doc, row, ord)),
sl AS (SELECT doc, row AS cell_row, ord, unnest(range(row, least(row + row_span - 1, last) + 1)) AS r, "column" AS c0, col_span FROM (SELECT *, max(row) OVER (PARTITION BY doc) AS last FROM gr)),
slots AS (SELECT doc, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS "column", cell_row, ord, r = cell_row AND c = c0 AS origin FROM (SELECT *, unnest(range(c0, c0 + col_span)) AS c FROM sl))"""


@query(f"WITH {CELLS} SELECT doc, row, ord, row_span, col_span, down IS NOT NULL AND NOT (regexp_matches(trim(down), '^\\d+$') AND length(trim(down)) < 10 AND coalesce(try_cast(trim(down) AS BIGINT), 0) BETWEEN 1 AND 1000) AS row_fault, across IS NOT NULL AND across NOT IN ('1', '2', '3') AS col_fault FROM ce")
def cell_spans(t) -> DataFrame:
    r, c = (tables.span(F.col("attributes"), n) for n in ("rowspan", "colspan"))
    return _raw(t).select("doc", "row", "ord", r["value"].alias("row_span"), c["value"].alias("col_span"), r["fault"].alias("row_fault"), c["fault"].alias("col_fault"))


@query(f'WITH RECURSIVE {GRID} SELECT doc, row, ord, "column", clash, row_span, col_span FROM gr')
def placed_cells(t) -> DataFrame:
    return tables.placed(_cells(t), KEYS).select("doc", "row", "ord", "column", "clash", "row_span", "col_span")


@query(f"""WITH RECURSIVE {GRID}, w AS (SELECT doc, row, count(DISTINCT "column") AS n FROM slots GROUP BY 1, 2)
SELECT doc, row, ord, 'overlap' AS fault FROM gr WHERE clash UNION ALL SELECT doc, row, ord, 'overrun' FROM (SELECT *, max(row) OVER (PARTITION BY doc) AS last FROM gr) WHERE row + row_span - 1 > last
UNION ALL SELECT doc, row, NULL, 'gap' FROM (SELECT *, max(n) OVER (PARTITION BY doc) AS most FROM w) WHERE n < most""")
def table_faults(t) -> DataFrame:
    return tables.faults(_grid(t), KEYS)


@query(f"""WITH {CELLS}, r AS (SELECT doc, row, count(*) AS n, bool_and(header) AS heads, bool_and(NOT header) AS plain, bool_or(blocks) AS blocks, bool_or(row_span > 1 OR col_span > 1) AS spans, row_number() OVER (PARTITION BY doc ORDER BY row) = 1 AS first FROM ce GROUP BY 1, 2),
g AS (SELECT doc, count(*) >= 2 AND min(n) = max(n) AND bool_and(CASE WHEN first THEN heads ELSE plain END) AS fit, bool_or(blocks) AS blocks, bool_or(spans) AS spans FROM r GROUP BY 1)
SELECT doc, CASE WHEN fit AND NOT blocks AND NOT spans THEN 'pipe' WHEN spans AND NOT blocks THEN 'html' ELSE 'list' END AS form FROM g""")
def table_forms(t) -> DataFrame:
    return tables.forms(_cells(t), KEYS)


_html = "coalesce(text, '')"
for _mark, _told in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _html = f"replace({_html}, '{_mark}', '{_told}')"


@query(f"""WITH {CELLS}, x AS (SELECT doc, row, string_agg('<' || CASE WHEN header THEN 'th' ELSE 'td' END || CASE WHEN row_span > 1 THEN ' rowspan="' || row_span || '"' ELSE '' END || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END || '>' || replace({_html}, chr(10), '<br>') || '</' || CASE WHEN header THEN 'th' ELSE 'td' END || '>', chr(10) ORDER BY ord) AS told FROM ce GROUP BY 1, 2)
SELECT doc, '<table>' || chr(10) || string_agg('<tr>' || chr(10) || told || chr(10) || '</tr>', chr(10) ORDER BY row) || chr(10) || '</table>' AS html FROM x GROUP BY 1""")
def html_tables(t) -> DataFrame:
    return tables.html(_cells(t), KEYS)


_escaped = rf"""regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([\\`*_\[\]<>|])', '\\\1', 'g'), '^(#{{1,6}}|[-+])(\s|$)', '\\\1\2'), '^(\d{{1,9}})([.)])(\s|$)', '\1\\\2\3')"""


@query(f"""WITH RECURSIVE {GRID}, p AS (SELECT s.doc, s.row, s."column" AS c, arg_min(CASE WHEN origin THEN replace({_escaped}, chr(10), '<br>') ELSE '' END, s.cell_row * 100 + s.ord) AS told FROM slots s JOIN gr g ON g.doc = s.doc AND g.row = s.cell_row AND g.ord = s.ord GROUP BY 1, 2, 3),
w AS (SELECT doc, max(c) AS w, min(row) AS first FROM p GROUP BY 1), a AS (SELECT r.doc, r.row, i AS c, w, first FROM (SELECT DISTINCT doc, row FROM p) r JOIN w USING (doc), (SELECT unnest(range(40)) AS i) WHERE i <= w),
l AS (SELECT a.doc, a.row, any_value(w) AS w, any_value(first) AS first, '| ' || string_agg(coalesce(told, ''), ' | ' ORDER BY a.c) || ' |' AS line FROM a LEFT JOIN p ON p.doc = a.doc AND p.row = a.row AND p.c = a.c GROUP BY 1, 2)
SELECT doc, string_agg(line || CASE WHEN row = first THEN chr(10) || '|' || repeat(' --- |', w + 1) ELSE '' END, chr(10) ORDER BY row) AS markdown FROM l GROUP BY 1""")
def spanned_markdown(t) -> DataFrame:
    return tables.pipes(_grid(t), KEYS)


@query(f"""WITH {CELLS}, x AS (SELECT *, count(*) OVER (PARTITION BY doc, row) AS n, dense_rank() OVER (PARTITION BY doc ORDER BY row) AS r, row_number() OVER (PARTITION BY doc, row ORDER BY ord) AS o FROM ce),
y AS (SELECT doc, r, o, CASE WHEN n > 1 THEN '  - {tables.COLUMN_WORD} ' || o || ':' || chr(10) ELSE '' END || array_to_string(list_transform(string_split(CASE WHEN coalesce(text, '') = '' THEN '{tables.EMPTY_CELL}' ELSE {_escaped} END, chr(10)), lambda z: CASE WHEN z = '' THEN '' WHEN n > 1 THEN '    ' || z ELSE '  ' || z END), chr(10)) AS told FROM x),
z AS (SELECT doc, r, string_agg(told, chr(10) ORDER BY o) AS told FROM y GROUP BY 1, 2) SELECT doc, string_agg('- {tables.ROW_WORD} ' || r || ':' || chr(10) || told, chr(10) ORDER BY r) AS markdown FROM z GROUP BY 1""")
def listed_tables(t) -> DataFrame:
    return tables.listing(_cells(t), KEYS)
