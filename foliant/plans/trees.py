"""Registered queries of the node operators over made trees, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import nodes as N
from foliant.operators import rewrites, signals
from foliant.plans import evaluation as E
from foliant.plans.made import chosen, chosen_sql, literal
from foliant.plans.registry import query, quoted

KEYS = ["doc"]
TITLES = ("English", " Français ", "العربية", "Other", "", "Eesti", "  ")
path_text = lambda c="path": F.array_join(F.transform(c, lambda x: x.cast("string")), ".")


def _toc(t) -> DataFrame:
    c = F.col
    e = t("events").where("event_type <> 'view'")
    return e.select(c("user_id").alias("doc"), c("event_id").alias("ordinal"), (c("event_id") % 3).cast("int").alias("level"), chosen(TITLES, "event_id % 7").alias("title"), F.floor(c("event_id") / 7).cast("int").alias("page"))


TOC = f"""tc AS (SELECT user_id AS doc, event_id AS ordinal, CAST(event_id % 3 AS INTEGER) AS level, trim({chosen_sql(TITLES, 'event_id % 7')}) AS title, CAST(event_id // 7 AS INTEGER) AS page FROM events WHERE event_type <> 'view'),
ln AS (SELECT user_id AS doc, CAST(max(event_id) // 7 + 3 AS INTEGER) AS page_count FROM events GROUP BY 1), tk AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY ordinal) AS INTEGER) AS reading_order FROM tc WHERE title <> '' AND page > 0),
ts AS (SELECT doc, reading_order, level, title, coalesce(CASE title {' '.join(f'WHEN {literal(k)} THEN {literal(v)}' for k, v in N.BOOKMARK_LANGUAGES.items())} END, title) AS language, CASE WHEN reading_order % 4 = 0 THEN page - 1 ELSE page END AS start_page, page AS bookmark_page, page_count FROM tk JOIN ln USING (doc)),
se AS (SELECT doc, reading_order, level, title, language, start_page, greatest(start_page, coalesce(lead(start_page) OVER (PARTITION BY doc ORDER BY reading_order) - 1, page_count)) AS end_page, CASE WHEN language IN ('ARA', 'HEB') THEN 'rtl' ELSE 'ltr' END AS direction, bookmark_page FROM ts)"""


def _sections(t) -> DataFrame:
    toc = _toc(t)
    lengths = t("events").groupBy(F.col("user_id").alias("doc")).agg((F.floor(F.max("event_id") / 7) + 3).cast("int").alias("page_count"))
    kept = toc.where((F.btrim("title") != "") & (F.col("page") > 0)).withColumn("reading_order", F.row_number().over(Window.partitionBy("doc").orderBy("ordinal")))
    moved = kept.where("reading_order % 4 = 0").select("doc", "reading_order", (F.col("page") - 1).alias("start"))
    return N.outline_sections(toc, lengths, "doc", physical=moved)


@query(f"WITH {TOC} SELECT * FROM se")
def outline_sections(t) -> DataFrame:
    return _sections(t)


@query(f"""WITH {TOC}, p AS (SELECT doc, reading_order, language, unnest(range(start_page, end_page + 1)) AS page FROM se)
SELECT doc, CAST(page AS INTEGER) AS page, max(reading_order) AS reading_order, arg_max(language, reading_order) AS language FROM p GROUP BY 1, 2""")
def section_pages(t) -> DataFrame:
    return N.section_of_pages(_sections(t), "doc")


def _references(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    li = E._lines(t)
    mcid = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey").cast("int") % 5)
    page = (F.col("n") % 2).cast("int")
    refs = li.select("doc", "path", page.alias("page"), mcid.alias("mcid"))
    texts = li.where("l_discount > 0.03").select("doc", page.alias("page"), mcid.alias("mcid")).where("mcid is not null").distinct().select("*", F.array(F.lit("a"), F.col("mcid").cast("string")).alias("parts"))
    return refs, texts, li.where("l_tax > 0.02").select("doc", page.alias("page"), mcid.alias("mcid")).where("mcid is not null")


@query(f"""WITH {E.LINES}, r AS (SELECT doc, path, CAST(n % 2 AS INTEGER) AS page, CASE WHEN l_suppkey % 7 <> 0 THEN CAST(l_suppkey % 5 AS INTEGER) END AS mcid, l_discount, l_tax FROM li)
SELECT doc, array_to_string(path, '.') AS path, page, mcid, CASE WHEN EXISTS (SELECT 1 FROM r x WHERE x.doc = r.doc AND x.page = r.page AND x.mcid = r.mcid AND x.l_discount > 0.03) THEN 'a' || mcid ELSE '' END AS text,
  CASE WHEN EXISTS (SELECT 1 FROM r x WHERE x.doc = r.doc AND x.page = r.page AND x.mcid = r.mcid AND x.l_discount > 0.03) THEN 'found' WHEN EXISTS (SELECT 1 FROM r x WHERE x.doc = r.doc AND x.page = r.page AND x.mcid = r.mcid AND x.l_tax > 0.02) THEN 'empty' ELSE 'unresolved' END AS resolution FROM r""")
def resolved_fragments(t) -> DataFrame:
    r = N.resolved_fragments(*_references(t), KEYS)
    return r.select("doc", path_text().alias("path"), "page", "mcid", F.array_join("parts", "").alias("text"), "resolution")


@query(f"""WITH {E.LINES}, f AS (SELECT doc, path, [n, l_suppkey, 3] AS parts, CASE WHEN l_suppkey % 3 = 0 THEN [] WHEN l_suppkey % 3 = 1 THEN [1.5, 2.5, 3.5] ELSE [1.5] END AS sizes FROM li), u AS (SELECT doc, path, parts, sizes, unnest([0, 1, 2]) AS i FROM f)
SELECT doc, array_to_string(path, '.') AS path, CAST(i AS INTEGER) AS part, CAST(parts[i + 1] AS VARCHAR) AS text, len(sizes) IN (0, 3) AS valid, CASE WHEN len(sizes) = 3 THEN CAST(sizes[i + 1] AS DOUBLE) END AS size FROM u""")
def fragment_parts(t) -> DataFrame:
    some = F.when(F.col("l_suppkey") % 3 == 0, F.array().cast("array<double>")).when(F.col("l_suppkey") % 3 == 1, F.array(*map(F.lit, (1.5, 2.5, 3.5)))).otherwise(F.array(F.lit(1.5)))
    f = E._lines(t).select("doc", "path", F.array(F.col("n").cast("string"), F.col("l_suppkey").cast("string"), F.lit("3")).alias("parts"), some.alias("sizes"), F.array().cast("array<array<double>>").alias("boxes"))
    return N.parted(f, KEYS).select("doc", path_text().alias("path"), "part", "text", "valid", "size")


ROLES = ("paragraph", "section", "list_body", "span", "table_cell", "figure", "heading", "list")
SOURCES = ("P", "Sect", "LBody", "Span", "TD", "Figure", "Heading2", "my_title")
LANGUAGES = ("ENG", None, "FRA", None, None, "ENG", "en-GB", "fr")


def _tree(t) -> DataFrame:
    """Nodes on three levels: a line's node under its third's, which is under the document's."""
    c = F.col
    li = E._lines(t)
    leaf = li.select("doc", F.array(F.lit(0), c("path")[0], c("path")[1]).alias("path"), c("l_partkey").alias("k"))
    mid = li.groupBy("doc", F.array(F.lit(0), c("path")[0]).alias("path")).agg((F.max("l_suppkey") * 3).alias("k"))
    top = li.groupBy("doc").agg((F.max("l_partkey") * 5).alias("k")).select("doc", F.array(F.lit(0)).alias("path"), "k")
    n = leaf.unionByName(mid).unionByName(top)
    said = F.when(c("k") % 11 == 0, F.lit("said"))
    display = F.when(c("k") % 13 == 0, "subtitle")
    return n.select("doc", "path", chosen(ROLES, "k % 8").alias("role"), chosen(SOURCES, "k % 8").alias("source_role"), chosen(LANGUAGES, "k % 7").alias("language"), F.when(c("k") % 3 == 0, (c("k") % 4).cast("int")).alias("page"), said.alias("actual_text"), display.alias("display_role"), "k")


def _shown(t) -> DataFrame:
    return E._lines(t).where("l_tax > 0.01").select("doc", F.array(F.lit(0), F.col("path")[0], F.col("path")[1], F.lit(0)).alias("path"), (F.col("l_suppkey") % 4).cast("int").alias("page"), chosen(("text", " ", "more", ""), "l_suppkey % 4").alias("text"))


TREE = f"""{E.LINES}, tk AS (SELECT doc, [0, path[1], path[2]] AS path, l_partkey AS k FROM li UNION ALL SELECT doc, [0, path[1]], max(l_suppkey) * 3 FROM li GROUP BY 1, 2 UNION ALL SELECT doc, [0], max(l_partkey) * 5 FROM li GROUP BY 1, 2),
nd AS (SELECT doc, path, {chosen_sql(ROLES, 'k % 8')} AS role, {chosen_sql(SOURCES, 'k % 8')} AS source_role, {chosen_sql(LANGUAGES, 'k % 7')} AS language, CASE WHEN k % 3 = 0 THEN CAST(k % 4 AS INTEGER) END AS page, CASE WHEN k % 11 = 0 THEN 'said' END AS actual_text, CASE WHEN k % 13 = 0 THEN 'subtitle' END AS display_role, k FROM tk),
fr AS (SELECT doc, [0, path[1], path[2], 0] AS path, CAST(l_suppkey % 4 AS INTEGER) AS page, {chosen_sql(('text', ' ', 'more', ''), 'l_suppkey % 4')} AS text FROM li WHERE l_tax > 0.01),
an AS (SELECT a.doc, a.path, b.path AS up, b.role AS up_role, b.source_role AS up_source, b.language AS up_language, len(b.path) AS depth FROM nd a JOIN nd b ON a.doc = b.doc AND a.path[1:len(b.path)] = b.path AND len(b.path) <= len(a.path)),
inh AS (SELECT doc, path, arg_max(up_language, depth) FILTER (up_language IS NOT NULL) AS lang FROM an GROUP BY 1, 2)"""


@query(f"WITH {TREE} SELECT doc, array_to_string(path, '.') AS path, CAST(row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS INTEGER) AS visit_index, lang AS inherited_language FROM nd JOIN inh USING (doc, path)")
def visited_nodes(t) -> DataFrame:
    return N.visited(_tree(t), KEYS, "language").select("doc", path_text().alias("path"), "visit_index", "inherited_language")


@query(f"""WITH {TREE}, g AS (SELECT a.doc, a.up AS path, bool_and(lang IS NOT NULL) AS whole, count(DISTINCT lang) AS n, min(lang) AS one FROM an a JOIN inh ON inh.doc = a.doc AND inh.path = a.path GROUP BY 1, 2)
SELECT doc, array_to_string(path, '.') AS path, CASE WHEN whole AND n = 1 THEN one END AS single FROM g""")
def single_languages(t) -> DataFrame:
    return N.single_values(_tree(t), KEYS, "language").select("doc", path_text().alias("path"), "single")


PAGES = f"""{TREE}, cl AS (SELECT doc, path, page FROM nd WHERE page IS NOT NULL UNION ALL SELECT doc, path[1:3], page FROM fr),
sp AS (SELECT nd.doc, nd.path, list_sort(list_distinct(list(cl.page))) AS pages FROM nd JOIN cl ON cl.doc = nd.doc AND cl.path[1:len(nd.path)] = nd.path AND len(cl.path) >= len(nd.path) GROUP BY 1, 2),
pg AS (SELECT doc, path, coalesce(pages, []) AS pages FROM nd LEFT JOIN sp USING (doc, path))"""


@query(f"WITH {PAGES} SELECT doc, array_to_string(path, '.') AS path, array_to_string(pages, ',') AS pages, CASE WHEN len(pages) = 1 THEN pages[1] END AS page FROM pg")
def subtree_pages(t) -> DataFrame:
    p = N.subtree_pages(_tree(t), _shown(t), KEYS)
    return p.select("doc", path_text().alias("path"), F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), "page")


def _path_intervals(t) -> DataFrame:
    m = _tree(t).where("size(path) = 2")
    at = F.row_number().over(Window.partitionBy("doc").orderBy("path"))
    return m.withColumn("ordinal", at).where("ordinal % 2 = 1").select("doc", "ordinal", F.col("path").alias("start_path"), F.col("path").alias("end_path"))


@query(f"""WITH {TREE}, m AS (SELECT doc, path, row_number() OVER (PARTITION BY doc ORDER BY path) AS ordinal FROM nd WHERE len(path) = 2),
u AS (SELECT doc, path, 0 AS r, path AS ip, ordinal FROM m WHERE ordinal % 2 = 1 UNION ALL SELECT doc, path, 1, NULL, NULL FROM nd),
p AS (SELECT doc, path, r, last_value(ip IGNORE NULLS) OVER w AS ip, last_value(ordinal IGNORE NULLS) OVER w AS o FROM u WINDOW w AS (PARTITION BY doc ORDER BY path, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc, array_to_string(path, '.') AS path, CAST(CASE WHEN path <= ip OR path[1:2] = ip THEN o END AS INTEGER) AS ordinal FROM p WHERE r = 1""")
def path_intervals(t) -> DataFrame:
    return N.in_path_intervals(_tree(t), _path_intervals(t), KEYS).select("doc", path_text().alias("path"), "ordinal")


_vis = lambda x: f"coalesce(regexp_replace({x}, '{T.WHITE}+', '', 'g') <> '', false)"
INLINE = f"""{TREE}, ip AS (SELECT p.doc, p.path FROM nd p WHERE p.role = 'paragraph' AND NOT EXISTS (SELECT 1 FROM nd c WHERE c.doc = p.doc AND len(c.path) > len(p.path) AND c.path[1:len(p.path)] = p.path AND c.role NOT IN ('span', 'link'))
  AND (EXISTS (SELECT 1 FROM nd c WHERE c.doc = p.doc AND len(c.path) > len(p.path) AND c.path[1:len(p.path)] = p.path AND {_vis('c.actual_text')}) OR EXISTS (SELECT 1 FROM fr f WHERE f.doc = p.doc AND f.path[1:len(p.path)] = p.path AND {_vis('f.text')})))"""
_candidate = lambda x: f"(regexp_matches(lower({x}), 'heading([1-6]($|[^0-9])|$)') OR regexp_matches(lower({x}), '(?:^|[_-])title$'))"


@query(f"WITH {INLINE} SELECT doc, array_to_string(path, '.') AS path FROM ip")
def inline_paragraphs(t) -> DataFrame:
    return N.inline_paragraphs(_tree(t), _shown(t), KEYS).select("doc", path_text().alias("path"))


@query(f"""WITH {INLINE}, o AS (SELECT nd.doc, nd.path FROM nd JOIN ip USING (doc, path) WHERE NOT (role = 'heading' OR {_candidate('source_role')} OR coalesce(display_role IN ({quoted(N.DISPLAY_ROLES)}), false))),
a AS (SELECT o.doc, o.path, bool_or({_candidate('up_source')}) AS headed, arg_max(up_role, depth) FILTER (up_role IN ({quoted((*N.FLOW_CONTAINERS, *N.FLOW_BARRIERS))})) AS nearest FROM o JOIN an ON an.doc = o.doc AND an.path = o.path AND len(an.up) < len(o.path) GROUP BY 1, 2)
SELECT o.doc, array_to_string(o.path, '.') AS path FROM o LEFT JOIN a USING (doc, path) WHERE NOT coalesce(headed, false) AND (nearest IS NULL OR nearest IN ({quoted(N.FLOW_CONTAINERS)}))""")
def sentence_paragraphs(t) -> DataFrame:
    return N.sentence_paragraphs(_tree(t), _shown(t), KEYS).select("doc", path_text().alias("path"))


@query(f"""WITH {TREE} SELECT doc, array_to_string(path, '.') AS path, CASE WHEN role <> 'paragraph' OR k % 5 = 0 THEN 'not_unpromoted_paragraph' WHEN {_candidate('source_role')} THEN 'source_role_heading_candidate'
  WHEN EXISTS (SELECT 1 FROM nd c WHERE c.doc = nd.doc AND len(c.path) > len(nd.path) AND c.path[1:len(nd.path)] = nd.path AND c.role NOT IN ('span', 'link')) THEN 'block_descendant' END AS rejection FROM nd""")
def subtitle_rejections(t) -> DataFrame:
    n = _tree(t)
    return N.subtitle_rejections(n.select("doc", "path", "role", "source_role"), n, n.where("k % 5 = 0"), KEYS).select("doc", path_text().alias("path"), "rejection")


@query(f"""WITH {TREE} SELECT doc, array_to_string(path, '.') AS path, CASE WHEN k % 5 = 0 THEN 'promoted_heading' WHEN role = 'heading' OR {_candidate('source_role')} THEN 'source_heading' WHEN display_role IN ({quoted(N.DISPLAY_ROLES)}) THEN display_role END AS conflict FROM nd""")
def heading_conflicts(t) -> DataFrame:
    return _tree(t).select("doc", path_text().alias("path"), N.heading_conflict(F.col("role"), F.col("source_role"), F.col("display_role"), F.col("k") % 5 == 0).alias("conflict"))


BOXES = ("[1, 2, 3, 4]", "(1.5, 2, 3, 4e1)", "[3, 2, 1, 4]", "[1, 2, 3]", "1, 2, 3, 4", "[1, 2, 3, nan]", "[1, 2, 3, 4,]", "", "[-1, -2, 3, 4]")
NUMBERS = ("1.5", "-2", "0", "x", "1e3", "inf", "nan", "")
_parsed = ("[1.0, 2.0, 3.0, 4.0]", "[1.5, 2.0, 3.0, 40.0]", None, None, None, None, "[1.0, 2.0, 3.0, 4.0]", None, "[-1.0, -2.0, 3.0, 4.0]")


@query(f"""WITH p AS (SELECT p_partkey, {chosen_sql(BOXES, 'p_partkey % 9')} AS a, {chosen_sql(BOXES, 'p_partkey % 4')} AS b, {chosen_sql(_parsed, 'p_partkey % 9')} AS pa, {chosen_sql(_parsed, 'p_partkey % 4')} AS pb, {chosen_sql(NUMBERS, 'p_partkey % 8')} AS n, p_partkey % 3 AS m FROM part)
SELECT p_partkey, pa AS box, CASE WHEN m = 0 THEN pa WHEN m = 1 AND pa = pb THEN pa END AS agreed, CASE WHEN n IN ('1.5', '1e3') THEN CAST(n AS DOUBLE) END AS number, CASE WHEN m = 0 THEN a WHEN m = 1 THEN b END AS last_value FROM p""")
def boxes_and_numbers(t) -> DataFrame:
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    a, b = chosen(BOXES, "p_partkey % 9"), chosen(BOXES, "p_partkey % 4")
    m = F.col("p_partkey") % 3
    attributes = F.when(m == 0, F.array(pair("Span", F.lit("2")), pair("/BBox", a))).when(m == 1, F.array(pair("BBox", a), pair("/BBox", b))).otherwise(F.array(pair("Span", F.lit("2"))))
    told = lambda x: F.when(x.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: v.cast("string")), ", "), F.lit("]")))
    return t("part").select("p_partkey", told(N.parsed_box(a)).alias("box"), told(N.agreed_box(attributes)).alias("agreed"), N.positive_number(chosen(NUMBERS, "p_partkey % 8")).alias("number"), N.attribute(attributes, "/BBox").alias("last_value"))


def _parts(t) -> DataFrame:
    c = F.col
    y = c("l_discount") * 100
    box = F.when(c("l_tax") == 0.08, None).otherwise(F.array(c("l_quantity"), 200 - 20 * c("n") - y, c("l_quantity") + 30, 209 - 20 * c("n") - y))
    return E._lines(t).select("doc", (c("l_suppkey") % 20 == 0).cast("int").alias("page"), F.floor(c("n") / 2).cast("int").alias("mcid"), chosen(("a", "b", " ", "c"), "l_partkey % 4").alias("text"), box.alias("box"))


@query(f"""WITH {E.LINES}, p AS (SELECT doc, CAST(l_suppkey % 20 = 0 AS INTEGER) AS page, n // 2 AS mcid, {chosen_sql(('a', 'b', ' ', 'c'), 'l_partkey % 4')} AS text, l_tax = 0.08 AS none, l_quantity AS x0, 200 - 20 * n - l_discount * 100 AS y0, l_quantity + 30 AS x1, 209 - 20 * n - l_discount * 100 AS y1 FROM li),
s AS (SELECT * FROM p WHERE text <> ' '), g AS (SELECT doc FROM s GROUP BY 1 HAVING bool_and(NOT none) AND min(page) = max(page) INTERSECT SELECT doc FROM p GROUP BY 1 HAVING min(page) = max(page)),
l AS (SELECT doc, page, mcid, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(y0) AS top FROM s WHERE doc IN (SELECT doc FROM g) GROUP BY 1, 2, 3), d AS (SELECT *, lag(y0) OVER (PARTITION BY doc ORDER BY top DESC, mcid) - y1 AS gap FROM l)
SELECT doc, min(page) AS page, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1, count(*) AS n_lines, CASE WHEN count(gap) > 0 AND bool_and(coalesce(gap >= 0, true)) THEN round(median(gap), 6) END AS spacing FROM d GROUP BY 1""")
def line_geometry(t) -> DataFrame:
    return N.line_geometry(_parts(t), KEYS).withColumns({c: F.round(c, 6) for c in ("x0", "y0", "x1", "y1", "spacing")})


FLOW = ("a > b", None, "  ", "text", None, "")


def _flow(t) -> DataFrame:
    return E._lines(t).select("doc", "n", chosen(FLOW, "l_partkey % 6").alias("text"), (F.col("l_suppkey") % 2).cast("int").alias("page"))


@query(f"""WITH {E.LINES}, f AS (SELECT doc, n, {chosen_sql(FLOW, 'l_partkey % 6')} AS text FROM li), c AS (SELECT *, text IS NULL AS fig FROM f WHERE text IS NULL OR trim(text) <> ''),
w AS (SELECT *, lag(text) OVER v AS b, lead(text) OVER v AS a FROM c WINDOW v AS (PARTITION BY doc ORDER BY n)) SELECT doc, n, b AS text_before, a AS text_behind FROM w WHERE fig""")
def texts_beside_figures(t) -> DataFrame:
    return N.beside_figures(_flow(t), KEYS, "n")


@query(f"""WITH {E.LINES}, f AS (SELECT doc, n, {chosen_sql(FLOW, 'l_partkey % 6')} AS text, CAST(l_suppkey % 2 AS INTEGER) AS page FROM li), g AS (SELECT *, sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) AS s, CASE WHEN page IS DISTINCT FROM lag(page) OVER (PARTITION BY doc ORDER BY n) THEN 1 ELSE 0 END AS new FROM f),
p AS (SELECT doc, n, sum(new) OVER (PARTITION BY doc ORDER BY n) AS page_segment FROM g)
SELECT g.doc, g.n, dense_rank() OVER (PARTITION BY g.doc ORDER BY s) AS segment, page_segment FROM g JOIN p USING (doc, n) WHERE text IS NOT NULL""")
def flow_segments(t) -> DataFrame:
    f = N.page_segments(_flow(t), KEYS, "n").withColumn("page_segment", F.col("segment").cast("long")).drop("segment")
    return N.segments(f, KEYS, "n", F.col("text").isNull()).select("doc", "n", F.col("segment").cast("long").alias("segment"), "page_segment")


def _members(t) -> DataFrame:
    return E._lines(t).select("doc", "path", F.when(F.col("l_tax") > 0.01, F.floor(F.col("n") / 3).cast("int") + F.when(F.col("l_suppkey") % 9 == 0, 1).otherwise(0)).alias("ordinal"))


@query(f"""WITH {E.LINES}, m AS (SELECT doc, path, CASE WHEN l_tax > 0.01 THEN CAST(n // 3 AS INTEGER) + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END END AS ordinal FROM li), r AS (SELECT *, row_number() OVER w AS pos, CASE WHEN ordinal IS DISTINCT FROM lag(ordinal) OVER w THEN 1 ELSE 0 END AS new FROM m WHERE ordinal IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY path)),
o AS (SELECT doc, ordinal, sum(new) AS runs, min(pos) AS f, max(pos) AS l, min(path) AS s, max(path) AS e FROM r GROUP BY 1, 2), x AS (SELECT DISTINCT doc, unnest([0, 1]) AS ordinal FROM li), j AS (SELECT x.doc, x.ordinal, s, e, coalesce(runs = 1 AND coalesce(lag(l) OVER (PARTITION BY x.doc ORDER BY x.ordinal), 0) < f, false) AS ok FROM x LEFT JOIN o USING (doc, ordinal)),
b AS (SELECT *, min(CASE WHEN NOT ok THEN ordinal END) OVER (PARTITION BY doc) AS bad FROM j)
SELECT doc, CAST(ordinal AS INTEGER) AS ordinal, bad IS NULL AS valid, CASE WHEN bad IS NULL THEN array_to_string(s, '.') END AS start_path, CASE WHEN bad IS NULL THEN array_to_string(e, '.') END AS end_path FROM b WHERE bad IS NULL OR ordinal = bad""")
def contiguous_memberships(t) -> DataFrame:
    expected = E._lines(t).select("doc").distinct().select("doc", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    c = N.contiguous_bounds(_members(t), expected, KEYS)
    return c.select("doc", "ordinal", "valid", path_text("start_path").alias("start_path"), path_text("end_path").alias("end_path"))


def _headings(t) -> DataFrame:
    return E._lines(t).where("l_tax > 0.03").select("doc", "path", F.when(F.col("l_suppkey") % 23 == 0, F.array().cast("array<int>")).when(F.col("l_suppkey") % 19 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("path")[0])).alias("pages"))


def _claims(t) -> DataFrame:
    return E._lines(t).select("doc", "path", F.array(F.col("path")[0]).alias("pages"))


def _profiles(t) -> DataFrame:
    k = F.col("o_orderkey")
    return t("orders").select(k.alias("doc"), F.when(k % 2 == 0, "BOOK").otherwise("A2").alias("doc_type"), F.when(k % 7 == 0, F.array(F.lit("ENG"))).when(k % 5 == 0, F.array(F.lit("ENG"), F.lit("FRA"), F.lit("SPA"))).otherwise(F.array(F.lit("ENG"), F.lit("FRA"))).alias("languages"))


def _bounds(t) -> DataFrame:
    k = F.col("o_orderkey")
    b = t("orders").where("o_orderkey % 22 <> 0").select(k.alias("doc"), F.posexplode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("i", "start_page"))
    return b.select("doc", (F.col("i") + 1).alias("ordinal"), F.when(F.col("doc") % 26 == 0, 1).otherwise(F.col("start_page")).alias("start_page"), F.when((F.col("doc") % 5 != 0) & (F.col("i") == 1) & (F.col("doc") % 3 != 0), 2).otherwise(F.col("start_page")).alias("end_page"))


@query(f"""WITH {E.LINES}, h AS (SELECT doc, path, CASE WHEN l_suppkey % 23 = 0 THEN [] WHEN l_suppkey % 19 = 0 THEN [1, 2] ELSE [path[1]] END AS pages FROM li WHERE l_tax > 0.03), p AS (SELECT o_orderkey AS doc, o_orderkey % 2 = 0 AS book, CASE WHEN o_orderkey % 7 = 0 THEN ['ENG'] WHEN o_orderkey % 5 = 0 THEN ['ENG', 'FRA', 'SPA'] ELSE ['ENG', 'FRA'] END AS langs FROM orders),
b0 AS (SELECT o_orderkey AS doc, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [0, 1, 2] ELSE [0, 1] END) AS i FROM orders WHERE o_orderkey % 22 <> 0), b AS (SELECT doc, i + 1 AS ordinal, CASE WHEN doc % 26 = 0 THEN 1 ELSE i END AS s, CASE WHEN doc % 5 <> 0 AND i = 1 AND doc % 3 <> 0 THEN 2 ELSE CASE WHEN false THEN 0 ELSE i END END AS e0 FROM b0),
bb AS (SELECT doc, ordinal, s, CASE WHEN doc % 5 <> 0 AND ordinal = 2 AND doc % 3 <> 0 THEN 2 ELSE ordinal - 1 END AS e FROM b),
bq AS (SELECT doc, count(*) AS n, bool_and(coalesce(pe < s, true)) AS ord FROM (SELECT *, lag(e) OVER (PARTITION BY doc ORDER BY ordinal) AS pe FROM bb) GROUP BY 1),
hq AS (SELECT doc, count(*) AS n, arg_min(CASE WHEN len(pages) = 0 THEN 'missing' ELSE 'ambiguous' END, path) FILTER (len(pages) <> 1) AS fault, list_sort(list_distinct(list(pages[1]) FILTER (len(pages) = 1))) AS pgs FROM h GROUP BY 1),
ho AS (SELECT DISTINCT h.doc FROM h WHERE len(pages) = 1 AND EXISTS (SELECT 1 FROM bb WHERE bb.doc = h.doc) AND (SELECT count(*) FROM bb WHERE bb.doc = h.doc AND h.pages[1] BETWEEN s AND e) <> 1),
d AS (SELECT p.doc, book, langs, pgs, CASE WHEN book AND bq.n IS NULL THEN 'bookmark_bounds_missing' WHEN book AND bq.n <> len(langs) THEN 'bookmark_count_mismatch' WHEN book AND NOT ord THEN 'bookmark_order_invalid' WHEN fault = 'missing' THEN 'heading_page_evidence_missing' WHEN fault = 'ambiguous' THEN 'heading_page_evidence_ambiguous'
  WHEN hq.n IS NULL THEN 'heading_page_evidence_missing' WHEN book AND ho.doc IS NOT NULL THEN 'heading_outside_bounds' WHEN NOT book AND len(pgs) <> len(langs) THEN 'heading_page_count_mismatch' END AS code FROM p LEFT JOIN bq USING (doc) LEFT JOIN hq USING (doc) LEFT JOIN ho USING (doc) WHERE len(langs) > 1),
sp AS (SELECT doc, langs, i + 1 AS ordinal, pgs[i + 1] AS s, pgs[i + 1] AS e FROM (SELECT doc, langs, pgs, unnest(range(len(pgs))) AS i FROM d WHERE code IS NULL AND NOT book) UNION ALL SELECT d.doc, langs, ordinal, s, e FROM d JOIN bb USING (doc) WHERE code IS NULL AND book),
mm AS (SELECT li.doc, li.path, CASE WHEN count(*) = 1 THEN min(ordinal) END AS ordinal FROM li JOIN sp ON sp.doc = li.doc AND li.path[1] BETWEEN s AND e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS pos, CASE WHEN ordinal IS DISTINCT FROM lag(ordinal) OVER w THEN 1 ELSE 0 END AS new FROM mm WHERE ordinal IS NOT NULL WINDOW w AS (PARTITION BY doc ORDER BY path)),
o AS (SELECT doc, ordinal, sum(new) AS runs, min(pos) AS f, max(pos) AS l, min(path) AS sp, max(path) AS ep FROM r GROUP BY 1, 2), j AS (SELECT sp.doc, sp.ordinal, langs, s, e, o.sp, o.ep, coalesce(runs = 1 AND coalesce(lag(l) OVER (PARTITION BY sp.doc ORDER BY sp.ordinal), 0) < f, false) AS ok FROM sp LEFT JOIN o USING (doc, ordinal)),
k AS (SELECT *, bool_and(ok) OVER (PARTITION BY doc) AS good FROM j)
SELECT doc, CAST(ordinal AS INTEGER) AS ordinal, langs[ordinal] AS language, CAST(s AS INTEGER) AS start_page, CAST(e AS INTEGER) AS end_page, array_to_string(sp, '.') AS start_path, array_to_string(ep, '.') AS end_path, NULL AS code FROM k WHERE good
UNION ALL SELECT DISTINCT doc, NULL, NULL, NULL, NULL, NULL, NULL, 'structure_ranges_invalid' FROM k WHERE NOT good UNION ALL SELECT doc, NULL, NULL, NULL, NULL, NULL, NULL, code FROM d WHERE code IS NOT NULL""")
def language_intervals(t) -> DataFrame:
    i = N.language_intervals(_profiles(t), _headings(t), _claims(t), _bounds(t), KEYS)
    return i.select("doc", "ordinal", "language", "start_page", "end_page", path_text("start_path").alias("start_path"), path_text("end_path").alias("end_path"), "code")


MARKERS = ("ENG", "ENG", "en-GB", "EN-gb", "FRA", "x", None, "fr", "de_DE")


@query(f"""WITH {E.LINES}, m AS (SELECT doc, path, {chosen_sql(MARKERS, '(l_suppkey * l_suppkey + doc % 2) % 9')} AS marker, row_number() OVER (PARTITION BY doc ORDER BY path) AS i FROM li), k AS (SELECT *, marker IN ('ENG', 'FRA') AS canon, regexp_matches(marker, '{N.BCP47}') AS fits FROM m WHERE marker IS NOT NULL),
f AS (SELECT doc, path, marker, CASE WHEN marker = 'ENG' THEN CASE WHEN EXISTS (SELECT 1 FROM k p WHERE p.doc = k.doc AND p.i < k.i AND NOT p.canon AND p.fits) THEN 'mixed_language_marker_schemes' END WHEN canon THEN 'conflicting_canonical_language' WHEN NOT fits THEN 'malformed_language_marker'
  WHEN EXISTS (SELECT 1 FROM k p WHERE p.doc = k.doc AND p.i < k.i AND p.marker = 'ENG') THEN 'mixed_language_marker_schemes' WHEN (SELECT arg_min(lower(p.marker), p.i) FROM k p WHERE p.doc = k.doc AND p.i < k.i AND NOT p.canon AND p.fits) <> lower(marker) THEN 'conflicting_language_markers' END AS reason FROM k)
SELECT doc, array_to_string(min(path), '.') AS path, arg_min(marker, path) AS marker, arg_min(reason, path) AS reason FROM f WHERE reason IS NOT NULL GROUP BY 1""")
def language_markers(t) -> DataFrame:
    n = E._lines(t).select("doc", "path", chosen(MARKERS, "(l_suppkey * l_suppkey + doc % 2) % 9").alias("marker"), F.lit("ENG").alias("expected"), F.array(F.lit("ENG"), F.lit("FRA")).alias("known"))
    return N.marker_faults(n, KEYS).select("doc", path_text().alias("path"), "marker", "reason")


@query(f"WITH {E.LINES} SELECT doc, array_to_string(path, '.') AS path FROM li a WHERE l_tax > 0.02 AND NOT EXISTS (SELECT 1 FROM li b WHERE b.doc = a.doc AND b.path = a.path AND b.l_discount > 0.05)")
def unclaimed_hints(t) -> DataFrame:
    li = E._lines(t)
    return N.unclaimed(li.where("l_tax > 0.02").select("doc", "path"), li.where("l_discount > 0.05"), KEYS).select("doc", path_text().alias("path"))


@query(f"WITH {E.LINES}, u AS (SELECT doc, path FROM li WHERE l_tax > 0.04 UNION SELECT doc, path[1:1] FROM li WHERE l_discount > 0.05) SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY path) AS INTEGER) AS nth, array_to_string(path, '.') AS path FROM u")
def joined_paths(t) -> DataFrame:
    li = E._lines(t)
    parts = [li.where("l_tax > 0.04"), li.where("l_discount > 0.05").select("doc", F.slice("path", 1, 1).alias("path"))]
    return N.joined_paths(parts, KEYS).select("doc", "nth", path_text().alias("path"))


@query(f"""WITH {E.LINES}, a AS (SELECT DISTINCT doc, n FROM li WHERE l_tax > 0.02), b AS (SELECT DISTINCT doc, n FROM li WHERE l_discount > 0.03) SELECT doc, n, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT doc, n, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def key_differences(t) -> DataFrame:
    li = E._lines(t)
    return N.key_differences(li.where("l_tax > 0.02"), li.where("l_discount > 0.03"), ["doc", "n"])


@query(f"""WITH {E.LINES}, p AS (SELECT doc, n, l_tax > 0.03 AS inside, CAST(row_number() OVER (PARTITION BY doc ORDER BY n) AS INTEGER) AS pos FROM li), q AS (SELECT *, row_number() OVER (PARTITION BY doc, inside ORDER BY pos) AS i, row_number() OVER (PARTITION BY doc, inside ORDER BY pos DESC) AS j FROM p),
c AS (SELECT doc, coalesce(max(pos) FILTER (inside) - min(pos) FILTER (inside) + 1 = count(*) FILTER (inside), true) AS contiguous FROM p GROUP BY 1)
SELECT a.doc, a.n, c.contiguous, CASE WHEN a.inside THEN b.pos ELSE a.pos END AS new_order FROM q a LEFT JOIN q b ON b.doc = a.doc AND b.inside AND a.inside AND b.i = a.j JOIN c ON c.doc = a.doc""")
def reversed_blocks(t) -> DataFrame:
    r = N.reversed_block(E._lines(t).select("doc", "n", "l_tax"), KEYS, "n", F.col("l_tax") > 0.03)
    return r.select("doc", "n", "contiguous", F.col("new_order").cast("int").alias("new_order"))


@query(f"""WITH {E.LINES}, m AS (SELECT doc, n, CASE WHEN n IN (1, 2) AND doc % 3 <> 0 THEN 3 - n WHEN n = 3 AND doc % 5 = 0 THEN 9 END AS place FROM li), v AS (SELECT doc, coalesce(list_sort(list(n) FILTER (place IS NOT NULL)) = list_sort(list(place) FILTER (place IS NOT NULL)), true) AS valid FROM m GROUP BY 1)
SELECT doc, n, valid, CAST(coalesce(place, n) AS INTEGER) AS new_order FROM m JOIN v USING (doc)""")
def permuted_nodes(t) -> DataFrame:
    li = E._lines(t).select("doc", "n")
    swap = li.where("n in (1, 2) and doc % 3 <> 0").select("doc", "n", (3 - F.col("n")).alias("place")).unionByName(li.where("n = 3 and doc % 5 = 0").select("doc", "n", F.lit(9).alias("place")))
    return N.permuted(li, swap, KEYS, "n").select("doc", "n", "valid", F.col("new_order").cast("int").alias("new_order"))


MATRIX = """c AS (SELECT k AS doc, i AS ord, (i // 4) * 50.0 + CASE WHEN k % 5 = 0 AND i = 6 THEN 3.0 ELSE 0.5 * (k % 2) END AS x0, 100.0 - (i % 4) * 10 + CASE WHEN k % 7 = 0 AND i = 9 THEN 25.0 ELSE 0.0 END AS y0 FROM (SELECT s_suppkey AS k, unnest(range(CASE WHEN s_suppkey % 11 = 0 THEN 11 ELSE 12 END)) AS i FROM supplier))"""


@query(f"""WITH {MATRIX}, p AS (SELECT *, CAST(ord % 4 AS INTEGER) AS "row", CAST(ord // 4 AS INTEGER) AS "column" FROM c), q AS (SELECT a.*, abs(a.x0 - l.x0) <= 1 AND abs(a.y0 - t.y0) <= 1 AND (a."row" = 0 OR u.y0 > a.y0) AND (a."row" > 0 OR a."column" = 0 OR b.x0 < a.x0) AS fine FROM p a
  JOIN p l ON l.doc = a.doc AND l."column" = a."column" AND l."row" = 0 JOIN p t ON t.doc = a.doc AND t."row" = a."row" AND t."column" = 0 LEFT JOIN p u ON u.doc = a.doc AND u."column" = a."column" AND u."row" = a."row" - 1 LEFT JOIN p b ON b.doc = a.doc AND b."row" = a."row" AND b."column" = a."column" - 1)
SELECT doc, CAST(ord AS INTEGER) AS ord, "row", "column", bool_and(fine) OVER (PARTITION BY doc) AND count(*) OVER (PARTITION BY doc) = 12 AS aligned FROM q""")
def cell_matrix(t) -> DataFrame:
    k, i = F.col("doc"), F.col("ord")
    c = t("supplier").select(F.col("s_suppkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.when(F.col("s_suppkey") % 11 == 0, 10).otherwise(11))).alias("ord"))
    c = c.withColumns({"x0": F.floor(i / 4) * 50.0 + F.when((k % 5 == 0) & (i == 6), 3.0).otherwise(0.5 * (k % 2)), "y0": 100.0 - (i % 4) * 10 + F.when((k % 7 == 0) & (i == 9), 25.0).otherwise(0.0)})
    m = N.matrix(c, KEYS, "ord", 4, 3)
    return m.select("doc", "ord", F.col("row").cast("int").alias("row"), "column", "aligned")


TRIGGER_TEXTS = ("a Preventing the TV from falling b", "How to turn on and off the Microphone Preventing the TV from falling", 'see "Preventing the TV from falling"', "none", "Precautions when installing the TV with a stand")
_told = ((3, "Preventing the TV from falling"), (1, "How to turn on and off the Microphone"), (None, None), (None, None), (1, "Precautions when installing the TV with a stand"))


@query(f"SELECT p_partkey, CAST({chosen_sql([a for a, _ in _told], 'p_partkey % 5')} AS INTEGER) AS at_position, {chosen_sql([b for _, b in _told], 'p_partkey % 5')} AS heading FROM part")
def first_triggers(t) -> DataFrame:
    f = N.first_trigger(chosen(TRIGGER_TEXTS, "p_partkey % 5"), rewrites.EMBEDDED_HEADINGS)
    return t("part").select("p_partkey", f.alias("f")).select("p_partkey", F.col("f.at").alias("at_position"), "f.heading")


@query("""WITH k AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type FROM events)
SELECT user_id, day, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY day, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 4 END, event_type) AS INTEGER) AS nth FROM k""")
def ordered_events(t) -> DataFrame:
    k = t("events").select("user_id", F.floor(F.unix_timestamp("ts") / 86400).cast("long").alias("day"), "event_type").distinct()
    return N.ordered_events(k, ["user_id"], "day", "event_type", ("signup", "error", "click"))


@query(f"WITH {TREE} SELECT doc, language, count(*) FILTER (role = 'heading') AS headings, count(*) FILTER (role = 'table') AS tables, count(*) FILTER (role = 'figure') AS figures, count(*) FILTER (role = 'paragraph') AS paragraphs, count(*) AS n FROM nd WHERE language IS NOT NULL GROUP BY 1, 2")
def language_statistics(t) -> DataFrame:
    return N.language_statistics(_tree(t), KEYS)


GLYPHS = ("ab", "c ", "dé", "", "x")


@query(f"""WITH {E.LINES}, r AS (SELECT doc, CAST(n % 2 AS INTEGER) AS page, CAST(l_suppkey % 3 AS INTEGER) AS mcid, n AS ord, {chosen_sql(GLYPHS, 'l_partkey % 5')} AS glyphs FROM li), s AS (SELECT doc, page, mcid, string_agg(glyphs, '' ORDER BY ord) AS source, count(*) AS n_runs FROM r WHERE ord <> 4 GROUP BY 1, 2, 3),
f AS (SELECT doc, page, mcid, string_agg(glyphs, ' ' ORDER BY ord DESC) AS text FROM r GROUP BY 1, 2, 3)
SELECT doc, page, mcid, text, source, coalesce(n_runs, 0) AS n_runs, list_sort(string_split(regexp_replace(coalesce(source, ''), '\\s+', '', 'g'), '')) = list_sort(string_split(regexp_replace(text, '\\s+', '', 'g'), '')) AS proven FROM f LEFT JOIN s USING (doc, page, mcid)""")
def owned_texts(t) -> DataFrame:
    c = F.col
    r = E._lines(t).select("doc", (c("n") % 2).cast("int").alias("page"), (c("l_suppkey") % 3).cast("int").alias("mcid"), c("n").alias("ord"), chosen(GLYPHS, "l_partkey % 5").alias("glyphs"))
    f = r.groupBy("doc", "page", "mcid").agg(F.array_join(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("ord", "glyphs"))), lambda x: x["glyphs"])), " ").alias("text"))
    return N.owned_texts(r.where("ord <> 4"), f, KEYS)


@query("""WITH d AS (SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS diff FROM events)
SELECT event_id, round(diff, 6) AS diff, coalesce(sign(diff) * sign(lag(diff) OVER (PARTITION BY user_id ORDER BY event_id)) < 0, false) AS crossed FROM d""")
def sign_changes(t) -> DataFrame:
    s = signals.sign_changes(t("events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value")
    return s.select("event_id", F.round("diff", 6).alias("diff"), "crossed")

