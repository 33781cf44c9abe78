"""Registered queries of content blocks and review views over made items, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import review as R
from foliant.functions import text as T
from foliant.operators import blocks
from foliant.plans import scalars
from foliant.plans.made import chosen, chosen_sql, literal
from foliant.plans.registry import collapse_sql, query, quoted
from foliant.plans.rewriting import english_
from foliant.sources.places import dealt

H, B, W, N, U, X = "heading", "body", "warning", "navigation", "ui_label", "bullet"
#: One item a line of an order: kind and text.
ITEMS = (
    (H, "Getting Started"), (B, "Plain text. It goes on."), (W, "CAUTION RISK OF ELECTRIC SHOCK. DO NOT OPEN"), (H, R.SAFETY_SECTION), (B, "Caution. Consult instructions for use: read them. Well."), (N, "> All Settings"), (U, "Update Now"),
    (H, "Notes"), (B, "Notes"), (B, "–"), (X, "use."), (B, "CAUTION: press {btn_power} and {icn_a}"), (X, "• one. Two"), (H, "Display Resolution"), (B, "AB1: 1920 x 1080 CD: 3840 x 2160"), (H, "Operating Humidity"), (B, "10 % to 80 %"), (H, "Sound (Output) AB1: 20 W"),
    (B, "CD2: 30 W"), (B, "5 Storage Humidity"), (H, blocks.COMPOUND), (H, blocks.STAND_CUT), (B, scalars.NOTES[0]), (B, "* Shielded Twisted Pair"), (B, scalars.NOTES[1]), (B, scalars.SAFETY[0]), ("item_list", "Cable\nStand"), ("model_condition", "This function is supported only in AB1."),
    ("figure_action_labels", "Bending\nPulling"), (H, "Storage Temperature"), (B, "- 20 °C"), (H, "Sound (Output)"), (W, "CAUTION: hot"), (B, ""), (X, "WARNING - sharp"),
)
PICK = f"l_partkey % {len(ITEMS)}"


def _items(t) -> DataFrame:
    """Items of documents: an order a document, its lines in two cells a page."""
    c = F.col
    ord_ = c("l_linenumber") * 1_000_000 + c("l_suppkey") * 1000 + c("l_partkey") % 1000
    table = t("lineitem")
    li = dealt(table.withColumn("doc", (c("l_orderkey") / 4).cast("long")).select("doc", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), "doc", table=table)
    return li.groupBy("doc", (c("l_orderkey") % 4).cast("int").alias("page"), (c("l_linenumber") % 2).alias("cell_order"), ord_.alias("ord")).agg(F.max("l_partkey").alias("l_partkey")).select("doc", "page", "cell_order", "ord", chosen([k for k, _ in ITEMS], PICK).alias("kind"), chosen([x for _, x in ITEMS], PICK).alias("text"))


ITEMS_SQL = f"""items AS (SELECT doc, page, cell_order, ord, {chosen_sql([k for k, _ in ITEMS], PICK)} AS kind, {chosen_sql([x for _, x in ITEMS], PICK)} AS text FROM (SELECT l_orderkey // 4 AS doc, CAST(l_orderkey % 4 AS INTEGER) AS page, l_linenumber % 2 AS cell_order,
  l_linenumber * 1000000 + l_suppkey * 1000 + l_partkey % 1000 AS ord, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2, 3, 4))"""

_fields = quoted(blocks.COMMON_FIELDS)
_plain = {x: scalars._notes(x, False) for x in (scalars.NOTES[0], scalars.NOTES[1])}
_with = scalars._notes(scalars.NOTES[0], True)


def _noted(told: str) -> str:
    """A list of structs: the notes that plain Python made of a text."""
    parts = [n.split("=") for n in told.split("|")]
    return "[" + ", ".join(f"{{'kind': 'regulatory_note', 'text': {literal(x)}, 'topic_id': {literal(k)}, 'spec_field': NULL, 'spec_category': NULL, 'lines': {literal(li)}}}" for k, x, li in parts) + "]"


_one = lambda kind, text, field="NULL", category="NULL": f"{{'kind': {kind}, 'text': {text}, 'topic_id': NULL, 'spec_field': {field}, 'spec_category': {category}, 'lines': NULL}}"
#: The items walked one by one: what stands behind, and whether the item before has taken this one; sound takes a whole run.
EXPANDED = f"""{ITEMS_SQL}, cell AS (SELECT *, row_number() OVER v AS n FROM items WINDOW v AS (PARTITION BY doc, page, cell_order ORDER BY ord)),
fl AS (SELECT *, kind = 'heading' AND (text = 'Sound (Output)' OR starts_with(text, 'Sound (Output) ')) AS sound, kind = 'heading' AND text IN ({_fields}, 'Notes') AS stop, regexp_extract(text, ' ({'|'.join(blocks.COMMON_FIELDS)})$', 1) AS tail FROM cell),
wk AS (SELECT doc, page, cell_order, n, sound AS inside, false AS val FROM fl WHERE n = 1
  UNION ALL SELECT f.doc, f.page, f.cell_order, f.n, CASE WHEN w.inside AND NOT f.stop AND f.tail = '' THEN true ELSE f.sound END, w.inside AND NOT f.stop FROM wk w JOIN fl f ON f.doc = w.doc AND f.page = w.page AND f.cell_order = w.cell_order AND f.n = w.n + 1),
pc AS (SELECT f.doc, f.page, f.cell_order, f.n * 2 + i AS n, kind, CASE WHEN val AND tail <> '' THEN CASE WHEN i = 0 THEN trim(substr(text, 1, length(text) - length(tail))) ELSE tail END ELSE text END AS text, val AND (i = 0) AND NOT (tail <> '' AND trim(substr(text, 1, length(text) - length(tail))) = '' ) AS val,
  val AND i = 0 AND (tail <> '' AND trim(substr(text, 1, length(text) - length(tail))) = '') AS gone FROM fl f JOIN wk USING (doc, page, cell_order, n) JOIN (SELECT unnest([0, 1]) AS i) ON i = 0 OR (val AND tail <> '')),
p1 AS (SELECT * FROM pc WHERE NOT gone AND NOT (val AND text = '')),
rn AS (SELECT *, sum(CASE WHEN val THEN 0 ELSE 1 END) OVER (PARTITION BY doc, page, cell_order ORDER BY n) AS run FROM p1),
gr AS (SELECT doc, page, cell_order, run, min(n) AS n, arg_min(kind, n) AS kind, arg_min(text, n) AS head, string_agg(text, ' ' ORDER BY n) FILTER (val) AS vals FROM rn GROUP BY 1, 2, 3, 4),
sd AS (SELECT doc, page, cell_order, n, CASE WHEN kind = 'heading' AND (head = 'Sound (Output)' OR starts_with(head, 'Sound (Output) ')) THEN 'sound' ELSE kind END AS kind,
  CASE WHEN kind = 'heading' AND (head = 'Sound (Output)' OR starts_with(head, 'Sound (Output) ')) THEN trim(concat_ws(' ', trim(substr(head, 15)), vals)) ELSE head END AS text FROM gr),
nx AS (SELECT *, lead(text) OVER v AS nxt, lead(kind) OVER v AS nk, row_number() OVER v AS i FROM sd WINDOW v AS (PARTITION BY doc, page, cell_order ORDER BY n)),
tk AS (SELECT *, nxt IS NOT NULL AND ((kind = 'heading' AND (text = {literal(blocks.COMPOUND)} OR text = 'Display Resolution' OR text IN ({_fields}))) OR (kind <> 'sound' AND contains(text, {literal(R.CLASS_NOTE)}) AND nxt = '* Shielded Twisted Pair')) AS takes FROM nx),
wa AS (SELECT doc, page, cell_order, i, takes AS active, false AS taken FROM tk WHERE i = 1
  UNION ALL SELECT t.doc, t.page, t.cell_order, t.i, t.takes AND NOT w.active, w.active FROM wa w JOIN tk t ON t.doc = w.doc AND t.page = w.page AND t.cell_order = w.cell_order AND t.i = w.i + 1),
ex AS (SELECT doc, page, cell_order, i, CASE WHEN kind = 'heading' AND text = {literal(blocks.COMPOUND)} THEN [{_one("'heading'", literal(blocks.COMPOUND_PARTS[0]))}, {_one("'heading'", literal(blocks.COMPOUND_PARTS[1]))}, {_one("'spec_table'", collapse_sql("('Display Resolution ' || CASE WHEN nk <> 'heading' THEN nxt ELSE '' END)"), "'Display Resolution'", "'model_spec'")}]
  WHEN kind = 'heading' AND text = {literal(blocks.STAND_CUT)} THEN [{_one("'heading'", literal(blocks.STAND))}] WHEN kind = 'body' AND text = 'Notes' THEN [{_one("'heading'", "'Notes'")}]
  WHEN kind = 'sound' THEN [{_one("'heading'", "'Sound (Output)'")}, {_one("'spec_table'", collapse_sql("('Sound (Output) ' || text)"), "'Sound (Output)'", "'model_spec'")}]
  WHEN text = {literal(scalars.NOTES[0])} THEN CASE WHEN coalesce(nxt = '* Shielded Twisted Pair', false) THEN {_noted(_with)} ELSE {_noted(_plain[scalars.NOTES[0]])} END WHEN text = {literal(scalars.NOTES[1])} THEN {_noted(_plain[scalars.NOTES[1]])}
  WHEN kind = 'heading' AND active AND text = 'Display Resolution' THEN [{_one('kind', 'text')}, {_one("'spec_table'", collapse_sql("(text || ' ' || nxt)"), 'text', "'model_spec'")}] WHEN kind = 'heading' AND active AND text IN ({_fields}) THEN [{_one('kind', 'text')}, {_one("'spec_table'", collapse_sql("(text || ' ' || nxt)"), 'text', "'common_required_spec'")}]
  ELSE [{_one('kind', 'text')}] END AS ps FROM tk JOIN wa USING (doc, page, cell_order, i) WHERE NOT taken),
eu AS (SELECT doc, page, cell_order, i, unnest(ps) AS p, unnest(range(len(ps))) AS j FROM ex),
xp AS (SELECT doc, page, cell_order, row_number() OVER (PARTITION BY doc, page, cell_order ORDER BY i, j) - 1 AS ord, p.kind AS kind, p.text AS text, p.topic_id AS topic_id, p.spec_field AS spec_field, p.spec_category AS spec_category, p.lines AS nlines FROM eu)"""


@query(f"WITH RECURSIVE {EXPANDED} SELECT doc, page, cell_order, CAST(ord AS INTEGER) AS ord, kind, text, topic_id, spec_field, spec_category FROM xp")
def expanded_items(t) -> DataFrame:
    return blocks.expanded(_items(t))


_safe = " + ".join(f"CAST(contains(text, '{m}') AS INTEGER)" for m in T.SAFETY_MARKERS) + " >= 3"
_abbreviated = lambda x: english_(f"replace(replace({x}, 'Fig.', 'Fig__'), 'No.', 'No__')")
_restored = lambda x: f"list_transform({_abbreviated(x)}, lambda y: replace(replace(y, 'Fig__', 'Fig.'), 'No__', 'No.'))"
BLOCKS = f"""{EXPANDED}, hd AS (SELECT *, kind = 'heading' AND NOT ({_safe}) AS heads FROM xp), sx AS (SELECT *, coalesce(last_value(CASE WHEN heads THEN text END IGNORE NULLS) OVER v, 'UNSECTIONED') AS sec, greatest(sum(CAST(heads AS INTEGER)) OVER v, 1) AS sno FROM hd WINDOW v AS (PARTITION BY doc ORDER BY page, cell_order, ord)),
kp AS (SELECT * FROM sx WHERE NOT (sec = 'Notes' AND {collapse_sql('text')} IN ({quoted(R.NOTE_NOISE)}))),
bt AS (SELECT *, CASE WHEN kind IN ({quoted(blocks.OWN_TYPES)}) THEN kind WHEN (sec = {literal(R.SAFETY_SECTION)} AND ((kind = 'warning' AND contains(text, 'CAUTION') AND contains(text, 'RISK OF ELECTRIC SHOCK')) OR (kind = 'body' AND starts_with(text, {literal(R.CONSULT)})))) OR ({_safe}) THEN 'safety_symbol_table'
  WHEN kind IN ('navigation', 'ui_label') THEN 'navigation_ui' ELSE kind END AS ty FROM kp),
ss AS (SELECT *, CASE WHEN kind = 'heading' THEN [] WHEN kind IN ({quoted(blocks.LISTED)}) THEN string_split(text, chr(10)) WHEN kind IN ('regulatory_note', 'spec_table', 'figure_legend', 'model_condition', 'condition_label') THEN [text] ELSE {_restored('text')} END AS sents FROM bt),
bl AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page, cell_order, ord) AS block_order, sno, sec, ty, text, sents, topic_id, spec_field, spec_category, page, cell_order, ty IN ({quoted(blocks.RISKY)}) OR starts_with(text, 'CAUTION:') OR starts_with(text, 'WARNING -') AS manual,
  CASE WHEN kind IN ({quoted(blocks.LISTED)}) THEN text WHEN kind = 'regulatory_note' THEN replace(nlines, '¦', chr(10)) WHEN starts_with(text, {literal(R.CONSULT)}) THEN 'Caution.' || chr(10) || trim(substr(text, 9)) WHEN len(sents) > 0 THEN array_to_string(sents, chr(10)) ELSE text END AS lines FROM ss)"""


def _blocks(t) -> DataFrame:
    return blocks.content_blocks(blocks.expanded(_items(t)))


@query(rf"""WITH RECURSIVE {BLOCKS} SELECT doc, CAST(block_order AS INTEGER) AS block_order, CAST(sno AS BIGINT) AS section_order, sec AS section_heading, ty AS block_type, text, lines, len(sents) AS n_sentences, array_to_string(list_filter(regexp_extract_all(text, '\{{((?:btn|icn)_[a-z0-9_]+)\}}', 1), lambda y, i: list_position(regexp_extract_all(text, '\{{((?:btn|icn)_[a-z0-9_]+)\}}', 1), y) = i), ',') AS inline_tokens,
  manual AS manual_review_required, page, cell_order, topic_id, spec_field, spec_category FROM bl""")
def content_blocks(t) -> DataFrame:
    b = _blocks(t)
    return b.withColumns({"lines": F.array_join("lines", "\n"), "n_sentences": F.size("sentences").cast("long"), "inline_tokens": F.array_join("inline_tokens", ",")}).drop("sentences")


@query(f"""WITH RECURSIVE {BLOCKS} SELECT doc, count(DISTINCT page * 10 + cell_order) AS cell_count, count(*) AS block_count, count(DISTINCT sno || sec) AS section_count, count(*) FILTER (manual) AS manual_review_block_count, count(*) FILTER (ty = 'safety_symbol_table') AS safety_table_count,
  count(*) FILTER (ty = 'navigation_ui') AS navigation_ui_count, count(*) FILTER (ty = 'spec_table') AS spec_table_count, count(*) FILTER (ty = 'regulatory_note') AS regulatory_note_count FROM bl GROUP BY 1""")
def content_summary(t) -> DataFrame:
    return blocks.summary(_blocks(t))


@query(f"""WITH RECURSIVE {BLOCKS}, s AS (SELECT doc, CAST(count(*) AS VARCHAR) AS block_count, CAST(count(*) FILTER (manual) AS VARCHAR) AS manual_review_block_count, CAST(count(*) FILTER (ty = 'spec_table') AS VARCHAR) AS spec_table_count FROM bl GROUP BY 1)
UNPIVOT s ON block_count, manual_review_block_count, spec_table_count INTO NAME field VALUE value""")
def content_summary_fields(t) -> DataFrame:
    return blocks.summary_fields(blocks.summary(_blocks(t)).select("doc", "block_count", "manual_review_block_count", "spec_table_count"))


@query(f"WITH RECURSIVE {BLOCKS} SELECT doc, CAST(sno AS BIGINT) AS section_order, sec AS heading, count(*) AS block_count, count(*) FILTER (manual) AS manual_review_block_count FROM bl GROUP BY 1, 2, 3")
def content_sections(t) -> DataFrame:
    return blocks.section_summary(_blocks(t))


@query(f"WITH RECURSIVE {BLOCKS} SELECT doc, CAST(block_order AS INTEGER) AS block_order, sec AS section_heading, ty AS block_type, manual AS manual_review_required, lines AS lines_text, CAST(len(sents) AS INTEGER) AS sentence_count, page, cell_order FROM bl")
def content_review_view(t) -> DataFrame:
    return blocks.review_view(_blocks(t))


@query(f"WITH RECURSIVE {BLOCKS} SELECT doc, CAST(block_order AS INTEGER) AS block_order, sec AS section_heading, text, page, cell_order FROM bl WHERE ty = 'navigation_ui'")
def content_navigation_view(t) -> DataFrame:
    return blocks.navigation_view(_blocks(t))


@query(f"WITH RECURSIVE {BLOCKS} SELECT doc, CAST(block_order AS INTEGER) AS block_order, sec AS section_heading, topic_id, text FROM bl WHERE ty = 'regulatory_note'")
def content_note_view(t) -> DataFrame:
    return blocks.note_view(_blocks(t))


_rows = [(f"SELECT doc, block_order, sec, {i} AS row_order, '{k}' AS symbol_key, '{a.rstrip(':')}' AS label, array_to_string({scalars._english(scalars._seg('text', a, b))}, chr(10)) AS lines_text FROM bl WHERE ty = 'safety_symbol_table' AND contains(text, '{a}')") for i, (k, a, b) in enumerate(R.SAFETY_ROWS, 1)]


@query(
    f"WITH RECURSIVE {BLOCKS}, r AS ({' UNION ALL '.join(_rows)}), "
    + """c AS (SELECT doc, block_order, sec, 0 AS row_order, 'caution_warning' AS symbol_key, 'CAUTION' AS label, array_to_string(list_concat(CASE WHEN starts_with(text, 'CAUTION ') THEN ['CAUTION'] ELSE [] END,
  list_transform(list_filter(list_transform(string_split(CASE WHEN starts_with(text, 'CAUTION ') THEN substr(text, 9) ELSE text END, '.'), lambda y: trim(y)), lambda y: y <> ''), lambda y: y || '.')), chr(10)) AS lines_text
  FROM bl WHERE ty = 'safety_symbol_table' AND contains(text, 'CAUTION') AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc = bl.doc AND r.block_order = bl.block_order))
SELECT doc, CAST(block_order AS INTEGER) AS block_order, sec AS section_heading, row_order, symbol_key, label, lines_text FROM (SELECT * FROM r UNION ALL SELECT * FROM c)"""
)
def content_safety_view(t) -> DataFrame:
    return blocks.safety_view(_blocks(t))


#: What of a specification's text is told, by the rows' patterns: SQL's regular expressions cannot look ahead, so what has to follow is matched too and left for the next row.
_matched = {k: f"regexp_extract(rest, '^(.*?)({x.split('(?=')[0]})(?:{x.split('(?=')[1].removesuffix(')')})', ['pre', 'whole', 'm', 'v'])" for k, x in (("resolution", T.RESOLUTION_ROW), ("sound", T.SOUND_ROW), ("model", T.MODEL_ROW))}
_other = literal(T.OTHER_MODELS)
SPECS = f"""k AS (SELECT doc, block_order, sec, spec_category, spec_field, CASE WHEN spec_field <> '' AND starts_with(c, spec_field) THEN trim(substr(c, length(spec_field) + 1)) ELSE c END AS value FROM (SELECT *, {collapse_sql('text')} AS c FROM bl WHERE ty = 'spec_table')),
sv AS (SELECT DISTINCT spec_field, value FROM k WHERE spec_category = {literal(T.MODEL_SPEC)}),
mt AS (SELECT spec_field, value, way, 0 AS i, '' AS m, '' AS v, value AS rest FROM sv JOIN (SELECT unnest(['resolution', 'sound', 'model']) AS way) ON CASE WHEN spec_field = {literal(T.SOUND_FIELD)} THEN way = 'sound' ELSE way = 'model' OR (way = 'resolution' AND spec_field = {literal(T.RESOLUTION_FIELD)}) END
  UNION ALL SELECT spec_field, value, way, i + 1, x.m, x.v, substr(rest, length(x.pre) + length(x.whole) + 1) FROM (SELECT spec_field, value, way, i, rest, CASE way {' '.join(f"WHEN '{k}' THEN {x}" for k, x in _matched.items())} END AS x FROM mt) WHERE x.whole <> ''),
mr AS (SELECT spec_field, value, way, i, {collapse_sql('m')} AS m, regexp_replace({collapse_sql('m')}, '^[, ]+', '') AS pm, {collapse_sql('v')} AS v FROM mt WHERE i > 0),
ml AS (SELECT spec_field, value, list({{'m': m, 'v': v}} ORDER BY i) FILTER (way = 'resolution') AS display, flatten(list(CASE WHEN spec_field = {literal(T.RESOLUTION_FIELD)} AND contains(v, {_other}) THEN [{{'m': pm, 'v': trim(split_part(v, {_other}, 1))}}, {{'m': {_other}, 'v': trim(substr(v, instr(v, {_other}) + {len(T.OTHER_MODELS)}))}}] ELSE [{{'m': pm, 'v': v}}] END ORDER BY i) FILTER (way <> 'resolution')) AS plain FROM mr GROUP BY 1, 2),
u AS (SELECT k.*, unnest(rows) AS r, unnest(range(len(rows))) AS i FROM (SELECT k.*, CASE WHEN spec_category = {literal(T.MODEL_SPEC)} AND len(coalesce(display, plain)) > 0 THEN coalesce(display, plain) ELSE [{{'m': '', 'v': k.value}}] END AS rows FROM k LEFT JOIN ml USING (spec_field, value)) k)"""


@query(f"""WITH RECURSIVE {BLOCKS}, {SPECS}
SELECT doc, CAST(block_order AS INTEGER) AS block_order, sec AS section_heading, spec_category, CAST(i + 1 AS INTEGER) AS row_order, spec_field AS field, r.m AS model_pattern, {collapse_sql('r.v')} AS value,
  CASE WHEN ends_with({collapse_sql('r.v')}, 'W') THEN 'W' WHEN contains(r.v, '°F') OR contains(r.v, '°C') THEN 'temperature_range' WHEN contains(r.v, '%') THEN '%' ELSE '' END AS unit FROM u""")
def content_spec_view(t) -> DataFrame:
    return blocks.spec_view(_blocks(t))


@query(f"""WITH RECURSIVE {BLOCKS}, m AS (SELECT *, lag(sec) OVER (PARTITION BY doc ORDER BY block_order) IS DISTINCT FROM sec AS new FROM bl)
SELECT doc, string_agg(CASE WHEN new THEN '## ' || lpad(CAST(sno AS VARCHAR), 2, '0') || '. ' || sec || chr(10) || chr(10) ELSE '' END || '### Block ' || lpad(CAST(block_order AS VARCHAR), 3, '0') || ' - ' || ty || chr(10) || chr(10) || '- manual_review_required: `' || manual || '`' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY block_order) AS markdown FROM m GROUP BY 1""")
def content_markdown(t) -> DataFrame:
    return blocks.content_markdown(_blocks(t))


_clean = "x"
for _old, _new in ((" .", "."), (" ,", ","), (" :", ":"), (" ;", ";"), ("( ", "("), (" )", ")"), ('" ', '"'), ('"in', '" in'), ('"and', '" and')):
    _clean = f"replace({_clean}, {literal(_old)}, {literal(_new)})"
CELLS = f"""{ITEMS_SQL}, nt AS (SELECT doc, page, cell_order, {collapse_sql("string_agg(CASE WHEN kind = 'heading' THEN CASE WHEN text = '' OR regexp_matches(text, '[.!?]$') THEN text ELSE text || '.' END ELSE text END, ' ' ORDER BY ord) FILTER (kind <> 'navigation')")} AS x FROM items GROUP BY 1, 2, 3),
ct AS (SELECT doc, page, cell_order, coalesce({collapse_sql(_clean)}, '') AS normalized_text FROM nt)"""
KEYS = ["doc", "page", "cell_order"]


@query(f"WITH {CELLS} SELECT * FROM ct")
def normalized_cells(t) -> DataFrame:
    return blocks.cell_texts(_items(t), KEYS)


@query(f"WITH {CELLS}, s AS (SELECT doc, page, cell_order, {_restored('normalized_text')} AS p FROM ct) SELECT doc, page, cell_order, unnest(p) AS text, CAST(unnest(range(len(p))) + 1 AS INTEGER) AS sentence_order FROM s")
def sentence_rows(t) -> DataFrame:
    return blocks.sentence_view(blocks.cell_texts(_items(t), KEYS), KEYS)


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT doc, page, cell_order, string_agg(text, chr(10) ORDER BY ord) AS text FROM items GROUP BY 1, 2, 3), a AS (SELECT doc, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS cells, count(*) FILTER (trim(text, ' ' || chr(10)) = '') AS empty FROM c GROUP BY 1),
n AS (SELECT doc, CAST(sum(CASE WHEN kind = 'heading' THEN 0 ELSE len({_restored("replace(text, chr(10), ' ')")}) END) AS BIGINT) AS n FROM items GROUP BY 1)
SELECT doc, chars AS total_chars, cells AS total_cells, empty AS empty_cells, n AS total_sentences, chars < 200 OR (cells > 0 AND empty / cells > 0.8) AS ocr_recommended FROM a JOIN n USING (doc)""")
def extraction_totals(t) -> DataFrame:
    i = _items(t)
    cells = i.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return blocks.extraction_totals(cells, i, KEYS, "doc")


SECTIONS = f"""{ITEMS_SQL}, o AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER v AS n, first_value(kind) OVER v <> 'heading' AS off, row_number() OVER v AS i FROM items WINDOW v AS (PARTITION BY doc ORDER BY page, cell_order, ord)),
q AS (SELECT doc, CAST(n + CAST(off AS INTEGER) AS BIGINT) AS section_order, i, kind, text, max(CASE WHEN kind = 'heading' THEN text END) OVER (PARTITION BY doc, n + CAST(off AS INTEGER)) AS head FROM o),
sb AS (SELECT doc, section_order, coalesce(head, 'UNSECTIONED') AS heading, head IS NULL AS made, CAST(row_number() OVER (PARTITION BY doc, section_order ORDER BY i) AS INTEGER) AS block_order, CASE WHEN {_safe} THEN 'safety_symbol_table' WHEN kind IN ('navigation', 'ui_label') THEN 'navigation_ui' ELSE kind END AS block_type, text FROM q WHERE kind <> 'heading')"""


@query(f"""WITH {SECTIONS}, h AS (SELECT DISTINCT doc, section_order, coalesce(head, 'UNSECTIONED') AS heading, CASE WHEN head IS NULL THEN 'synthetic' ELSE 'heading' END AS heading_kind FROM q), b AS (SELECT doc, section_order, count(*) AS n, string_agg(block_type, ',' ORDER BY block_order) AS types FROM sb GROUP BY 1, 2)
SELECT doc, section_order, heading, heading_kind, CAST(coalesce(n, 0) AS INTEGER) AS n_blocks, coalesce(types, '') AS types FROM h LEFT JOIN b USING (doc, section_order)""")
def item_sections(t) -> DataFrame:
    s = blocks.item_sections(_items(t))
    return s.select("doc", "section_order", "heading", "heading_kind", F.size("blocks").alias("n_blocks"), F.array_join(F.transform("blocks", lambda b: b["block_type"]), ",").alias("types"))


@query(f"WITH {SECTIONS} SELECT doc, section_order, heading, block_order, block_type, text FROM sb")
def section_blocks(t) -> DataFrame:
    return blocks.section_block_view(blocks.item_sections(_items(t)))


_sect_rows = [r.replace("sec, ", "section_order, heading, ").replace("FROM bl WHERE ty", "FROM sb WHERE block_type") for r in _rows]


@query(f"WITH {SECTIONS} {' UNION ALL '.join(_sect_rows)}")
def section_safety_rows(t) -> DataFrame:
    return blocks.section_safety_view(blocks.item_sections(_items(t)))


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT DISTINCT doc, page, CASE WHEN doc % 3 = 0 THEN 'FRA' ELSE 'ENG' END AS language, 10 - page AS review_order, CASE WHEN page = 0 THEN 'section_front_cover' ELSE 'content' END AS page_role FROM items)
SELECT doc, page, review_order, page_role, cell_order, CAST(row_number() OVER (PARTITION BY doc, page, cell_order ORDER BY ord) AS INTEGER) AS item_order, kind, text FROM items JOIN p USING (doc, page) WHERE language = 'ENG'""")
def item_rows(t) -> DataFrame:
    i = _items(t)
    pages = i.select("doc", "page").distinct().select("doc", "page", F.when(F.col("doc") % 3 == 0, "FRA").otherwise("ENG").alias("language"), (10 - F.col("page")).alias("review_order"), F.when(F.col("page") == 0, "section_front_cover").otherwise("content").alias("page_role"))
    return blocks.item_view(i, pages, "ENG")


_spans_sql = """sp AS (SELECT l_orderkey // 4 AS doc, CAST(l_orderkey % 4 AS INTEGER) AS page, l_linenumber % 2 AS cell_order, ['Plain', 'text', 'Getting Started', 'zzz', '', 'Notes'][CAST(l_suppkey % 6 AS INTEGER) + 1] AS text, l_quantity AS size, l_tax > 0.04 AS bold, l_discount > 0.05 AS italic, l_returnflag = 'A' AS underline FROM lineitem WHERE l_linenumber > 2)"""


def _spans(t) -> DataFrame:
    c = F.col
    return t("lineitem").where("l_linenumber > 2").select((c("l_orderkey") / 4).cast("long").alias("doc"), (c("l_orderkey") % 4).cast("int").alias("page"), (c("l_linenumber") % 2).alias("cell_order"), chosen(("Plain", "text", "Getting Started", "zzz", "", "Notes"), "l_suppkey % 6").alias("text"), c("l_quantity").alias("size"), (c("l_tax") > 0.04).alias("bold"), (c("l_discount") > 0.05).alias("italic"), (c("l_returnflag") == "A").alias("underline"))


@query(f"WITH {_spans_sql} SELECT doc, page, cell_order, count(*) AS span_count, max(size) AS max_font_size, count(*) FILTER (bold) AS bold_span_count, count(*) FILTER (italic) AS italic_span_count, count(*) FILTER (underline) AS underline_span_count FROM sp GROUP BY 1, 2, 3")
def cell_styles(t) -> DataFrame:
    return blocks.cell_styles(_spans(t), KEYS)


@query(f"""WITH {ITEMS_SQL}, {_spans_sql}, a AS (SELECT doc, page, cell_order, count(*) AS n, max(size) AS s, bool_or(bold) AS b, bool_or(italic) AS i, bool_or(underline) AS u FROM sp GROUP BY 1, 2, 3),
h AS (SELECT doc, page, cell_order, ord, count(*) AS n, max(size) AS s, bool_or(bold) AS b, bool_or(italic) AS i, bool_or(underline) AS u FROM items JOIN sp USING (doc, page, cell_order) WHERE sp.text <> '' AND contains(items.text, sp.text) GROUP BY 1, 2, 3, 4)
SELECT doc, page, cell_order, ord, coalesce(h.n, a.n, 0) AS span_count, coalesce(h.s, a.s, 0.0) AS max_font_size, coalesce(h.b, a.b, false) AS bold, coalesce(h.i, a.i, false) AS italic, coalesce(h.u, a.u, false) AS underline FROM items LEFT JOIN h USING (doc, page, cell_order, ord) LEFT JOIN a USING (doc, page, cell_order)""")
def item_styles(t) -> DataFrame:
    return blocks.item_styles(_items(t), _spans(t), KEYS)


@query("""WITH b AS (SELECT DISTINCT l_orderkey % 5 AS page, l_linenumber AS cell_order, l_linenumber % 2 + 1 AS "row", l_linenumber + 1 AS "column" FROM lineitem WHERE l_tax > 0.02)
SELECT page, cell_order, ("column" - 1) * 800.0 / 8 AS x0, ("row" - 1) * 600.0 / 2 AS y0, "column" * 800.0 / 8 AS x1, "row" * 600.0 / 2 AS y1 FROM b""")
def cell_rects(t) -> DataFrame:
    c = F.col
    b = t("lineitem").select((c("l_orderkey") % 5).alias("page"), c("l_linenumber").alias("cell_order"), (c("l_linenumber") % 2 + 1).alias("row"), (c("l_linenumber") + 1).alias("column"), (c("l_tax") > 0.02).alias("manual_review_required"))
    r = blocks.cell_rects(b, F.lit(800.0), F.lit(600.0))
    return r
