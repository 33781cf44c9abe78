"""Registered queries of review items, over the documents and over texts made of order lines, with the SQL for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import items
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.registry import FLAGS, HEADS, KIND, collapse_sql, query
from foliant.plans.structure import NODES, _nodes

#: The automaton as a recursion from line to line.  Needs lines(doc_id, ord, line, chars) and styles(doc_id, i, size, group_lines),
#: i being a line's number among those that are not blank.
WALK = f"""{FLAGS},
seq AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i, line, chars, navigation, ui_label, warning, {HEADS} AS heads, {KIND} AS kind,
  NOT (bullet OR navigation OR ui_label OR warning OR list_item OR titled) AS plain, starts_with(line, '*:') AS note, starts_with(line, '*Wireless One Connect Box') AS parted FROM titles WHERE line <> ''),
sq AS (SELECT seq.*, size, group_lines, lag(note) OVER w AS after_note, lag(parted) OVER w AS after_parted, lag(chars) OVER w AS chars_before FROM seq LEFT JOIN styles USING (doc_id, i) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
op AS (SELECT *, CASE WHEN group_lines IS NOT NULL THEN 'styled' WHEN line = '•' THEN 'mark' WHEN kind = 'heading' AND (size <= 7.25 OR (size IS NOT NULL AND left(line, 1) IN ('"', '''', '“', '”'))) THEN 'body' ELSE kind END AS opens FROM sq),
st AS (SELECT doc_id, i, 1 AS item, opens AS sort, coalesce(group_lines, 1) - 1 AS owed FROM op WHERE i = 1
  UNION ALL SELECT doc_id, i, CASE WHEN goes THEN item ELSE item + 1 END, CASE WHEN goes THEN sort ELSE opens END, CASE WHEN owed > 0 THEN owed - 1 WHEN goes THEN 0 ELSE coalesce(group_lines, 1) - 1 END
  FROM (SELECT op.doc_id, op.i, st.item, st.sort, st.owed, op.opens, op.group_lines, st.owed > 0 OR CASE st.sort
      WHEN 'mark' THEN plain AND group_lines IS NULL WHEN 'body' THEN plain AND group_lines IS NULL WHEN 'bullet' THEN plain WHEN 'navigation' THEN navigation WHEN 'ui_label' THEN ui_label WHEN 'warning' THEN warning
      WHEN 'list_item' THEN CASE WHEN after_note THEN plain ELSE after_parted AND note END WHEN 'heading' THEN heads AND group_lines IS NULL AND chars_before + chars <= 80 ELSE false END AS goes
    FROM st JOIN op ON op.doc_id = st.doc_id AND op.i = st.i + 1)),
it AS (SELECT doc_id, item, CASE sort WHEN 'mark' THEN 'bullet' WHEN 'styled' THEN 'heading' ELSE sort END AS kind, string_agg(line, ' ' ORDER BY i) FILTER (line <> '•' OR sort <> 'mark') AS text FROM st JOIN op USING (doc_id, i) GROUP BY 1, 2, sort)"""
ITEMS = "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY item) AS INTEGER) AS item_order, kind, text FROM it WHERE text IS NOT NULL"


def _lines_sql(text: str, table: str) -> str:
    return rf"""lines AS (SELECT doc_id, ord, {collapse_sql('raw')} AS line, length(regexp_replace(raw, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(range(len(parts))) AS ord, unnest(parts) AS raw FROM (SELECT doc_id, regexp_split_to_array({text}, '{T.LINE_END}') AS parts FROM {table})))"""


@query(f"""WITH RECURSIVE {_lines_sql("coalesce(text, '')", "documents WHERE lang = 'en'")}, styles AS (SELECT 0::BIGINT AS doc_id, 0::BIGINT AS i, NULL::DOUBLE AS size, NULL::BIGINT AS group_lines WHERE false),{WALK}
{ITEMS} UNION ALL SELECT doc_id, 1, 'body', {collapse_sql("text")} FROM documents WHERE (lang <> 'en' OR lang IS NULL) AND {collapse_sql("text")} <> ''""")
def review_items(t) -> DataFrame:
    return items.review_items(t("documents"), F.col("lang") == "en").drop("sentences")


#: Lines of every class, and of both sides of the rules that carry a line on.
PHRASES = (
    "•", "• Look at the cable first", "- Keep it dry", "2. Press any key", "3) Turning Parts Around", "Settings", ">", "Open it > Next >", "Sound >", "Software Update", "Power button", "Motion sensor", "> Side button",
    "CAUTION: this side is hot", "KEEP AWAY FROM OPEN FIRE AND WATER", "*: Only with some of the models", "*Wireless One Connect Box (sold apart)", "*Batteries", "x 2", "Power Cord", "Getting Started",
    "Before You Begin With This Remarkable Apparatus", "Connecting Things", '"Quick Help"', "it shows a list of all parts that are there", "and then the screen goes dark.", "", "   ", "Plug  it in", "Ready?",
    "01 First Steps", "(The Frame only)", "www.example.org", "for all others see below",
)
_choice = f"(l_partkey + l_linenumber * 7) % {len(PHRASES)}"
_pages_sql = f"""{NODES}, made AS (SELECT l_orderkey // 8 AS doc_id, (l_orderkey % 8) * 10 + l_linenumber AS ord, {chosen_sql(PHRASES, _choice)} AS raw, l_discount * 100 AS step, l_quantity, l_tax > 0.03 AS bold FROM nodes),
texts AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY ord) AS text FROM made GROUP BY 1),
made_spans AS (SELECT doc_id, ord, {collapse_sql('raw')} AS text, 6.5 + step * 0.5 AS size, bold, ord * 14.0::DOUBLE AS y0, ord * 14.0::DOUBLE + 7 AS y1 FROM made WHERE l_quantity < 50 - 10 * (doc_id % 2))"""


@query(rf"""WITH RECURSIVE {_pages_sql}, {_lines_sql("text", "texts")},
ln AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i, line FROM lines WHERE line <> ''),
sp AS (SELECT doc_id, list({{'text': text, 'size': size, 'bold': bold, 'y0': y0, 'y1': y1}} ORDER BY ord) AS spans, list(text ORDER BY ord) AS names FROM made_spans GROUP BY 1),
pt AS (SELECT doc_id, i, nullif(list_position(names, line), 0) AS p FROM ln JOIN sp USING (doc_id) WHERE i = 1
  UNION ALL SELECT ln.doc_id, ln.i, pt.p + nullif(list_position(sp.names[pt.p + 1:], ln.line), 0) FROM pt JOIN ln ON ln.doc_id = pt.doc_id AND ln.i = pt.i + 1 JOIN sp ON sp.doc_id = ln.doc_id),
ms AS (SELECT doc_id, i, spans[p].size AS size, spans[p].size >= 9 AND spans[p].bold AS strong, spans[p].y0 AS y0, spans[p].y1 AS y1 FROM pt JOIN sp USING (doc_id) WHERE p IS NOT NULL),
mn AS (SELECT *, CASE WHEN strong AND lag(strong) OVER w AND lag(i) OVER w = i - 1 AND abs(size - lag(size) OVER w) <= 0.75 AND y0 - lag(y1) OVER w <= greatest(size, lag(size) OVER w) * 0.75 THEN 0 ELSE 1 END AS new FROM ms WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
mg AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM mn),
styles AS (SELECT doc_id, i, size, CASE WHEN strong AND new = 1 THEN count(*) OVER (PARTITION BY doc_id, grp) END AS group_lines FROM mg),{WALK}
{ITEMS}""")
def styled_review_items(t) -> DataFrame:
    """Review items of texts made of order lines, with a span for most lines."""
    c = F.col
    made = _nodes(t).select(F.expr("l_orderkey div 8").alias("doc_id"), F.expr("(l_orderkey % 8) * 10 + l_linenumber").alias("ord"), chosen(PHRASES, _choice).alias("text"), (6.5 + c("l_discount") * 100 * 0.5).alias("size"), (c("l_tax") > 0.03).alias("bold"), "l_quantity")
    texts = made.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    spans = made.where("l_quantity < 50 - 10 * (doc_id % 2)").withColumns({"underline": F.lit(False), "y0": c("ord") * F.lit(14.0), "y1": c("ord") * F.lit(14.0) + 7})
    return items.review_items(texts, F.lit(True), spans).drop("sentences")
