"""Registered queries of the structure operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import align, blocks, checks, grid, lines, sentences, sequences, signals, stats, tree
from foliant.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **parts: str):
    """Registers a function of a table reader; `sql` may name parts in braces."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            for k, v in parts.items():
                sql_ = SQL.get(fn.__name__, sql).replace("{" + k + "}", v)
                SQL[fn.__name__] = sql_
            SQL.setdefault(fn.__name__, sql)
        return fn

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


COLLAPSE = r"trim(regexp_replace({x}, '[\s\p{Z}]+', ' ', 'g'))"
collapse_sql = lambda x: COLLAPSE.replace("{x}", x)

#: lines(doc_id, ord, line) and kinds(…, kind) as common tables for the SQL twins.
LINES = rf"""
raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, CAST(i AS INTEGER) AS ord, {collapse_sql('parts[i + 1]')} AS line
          FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM raw))"""

_words = "(CASE WHEN line = '' THEN 0 ELSE len(string_split(line, ' ')) END)"
_upper = r"(length(regexp_replace(line, '[^\p{Lu}]', '', 'g')) / nullif(length(regexp_replace(line, '[^\p{L}]', '', 'g')), 0))"
_title = r"""len(list_filter(string_split(line, ' '), lambda w:
    regexp_replace(regexp_replace(lower(w), '^[''"()\[\]:;,-]+', ''), '[''"()\[\]:;,-]+$', '') IN ({stop})
    OR regexp_matches(regexp_replace(w, '^[''"()\[\]:;,-]+', ''), '^\p{Lu}') OR (regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '[\p{Ll}\p{Lt}]'))))""".replace("{stop}", quoted(T.HEADING_STOPWORDS))
#: Each line's classes one by one, whichever claims it first, behind a table lines(…, line).
FLAGS = rf"""
flags AS (SELECT *,
  regexp_matches(line, '^[•–-]') OR regexp_matches(line, '^\d+[.)]\s+') AS bullet,
  line IN ({quoted(T.NAVIGATION_TEXTS)}) OR starts_with(line, '>') OR ends_with(line, '>') AS navigation,
  line IN ({quoted(T.UI_LABELS)}) OR ((ends_with(line, 'button') OR ends_with(line, 'sensor')) AND {_words} <= 5) AS ui_label,
  starts_with(line, '*') OR regexp_matches(line, '(?i)^x\s*\d+$') OR line IN ({quoted(T.LIST_ITEMS)}) AS list_item,
  ({' OR '.join(f"contains(line, '{t}')" for t in T.WARNING_TERMS)}) OR coalesce({_upper} > 0.85 AND length(line) > 20, false) AS warning,
  {_words} AS n_words, {_title} AS n_title FROM lines),
titles AS (SELECT *, NOT (line IN ({quoted((*T.PLAIN_LINES, *T.REJECTED_HEADINGS))}) OR regexp_matches(line, '^[.,:;/]') OR contains(line, 'www.') OR contains(line, '@') OR length(line) > 55 OR ends_with(line, '.')) AND line <> ''
   AND (regexp_matches(line, '^\d{{2}}\s+[A-Z]') OR ((ends_with(line, '!') OR ends_with(line, '?')) AND n_words <= 4) OR (n_words <= 8 AND n_title >= greatest(1, n_words - 1))) AS titled FROM flags)"""
KIND = """CASE
  WHEN line = '' THEN 'blank' WHEN line = '•' THEN 'bullet' WHEN navigation THEN 'navigation' WHEN ui_label THEN 'ui_label'
  WHEN warning THEN 'warning' WHEN list_item THEN 'list_item' WHEN bullet THEN 'bullet' WHEN titled THEN 'heading' ELSE 'body' END"""
HEADS = "titled AND NOT (line = '•' OR navigation OR ui_label OR warning OR list_item)"
KINDS = f"""{LINES},{FLAGS},
kinds AS (SELECT doc_id, ord, line, {HEADS} AS heads, {KIND} AS kind FROM titles)"""


@query(f"""WITH {KINDS},
s AS (SELECT *, greatest(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER w, 1) AS section,
  coalesce(last_value(CASE WHEN kind = 'heading' THEN line END IGNORE NULLS) OVER w, 'UNSECTIONED') AS heading
  FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, CAST(section AS BIGINT) AS section, heading, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars,
  count(*) FILTER (kind IN ('warning', 'navigation', 'ui_label')) AS n_review, min(ord) AS first_ord FROM s GROUP BY 1, 2, 3""")
def section_rollup(t) -> DataFrame:
    return lines.section_rollup(t("documents"))


@query(f"WITH {KINDS} SELECT doc_id, ord, kind FROM kinds")
def line_kinds(t) -> DataFrame:
    return lines.kinds(t("documents")).select("doc_id", "ord", "kind")


@query(f"""WITH {KINDS},
m AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) THEN 1 ELSE 0 END AS new FROM kinds),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM m)
SELECT doc_id, CAST(island AS BIGINT) AS island, kind, count(*) AS n_lines, string_agg(line, ' ' ORDER BY ord) AS item FROM g GROUP BY 1, 2, 3""")
def line_runs(t) -> DataFrame:
    return lines.runs(t("documents"))


@query(f"""WITH {LINES},
m AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY ord) AS was FROM lines)
SELECT doc_id, ord, line FROM m WHERE was IS NULL OR was <> line""")
def adjacent_copies_dropped(t) -> DataFrame:
    return sequences.without_adjacent_copies(lines.lines(t("documents")), ["doc_id"], "ord", ["line"])


def nested_replace(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_placeholders = [(a, a.replace(".", "__")) for a in T.ABBREVIATIONS]


@query(rf"""WITH l AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, list_transform(regexp_split_to_array(coalesce(text, ''), '{T.LINE_END}'), lambda y: regexp_replace(y, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')) AS lines FROM documents
), j AS (
  SELECT *, array_to_string(list_transform(lines, lambda y: CASE WHEN y = '' OR regexp_matches(y, '{T.BULLET_LINE}') THEN chr(10) || y ELSE y END), ' ') AS x FROM l
), s AS (
  SELECT doc_id, list_filter(list_transform(CASE WHEN lang = 'en' THEN string_split(regexp_replace({nested_replace('x', _placeholders)}, '([.!?]){T.WHITE}+([A-Z0-9"''(\[])', '\1' || chr(10) || '\2', 'g'), chr(10)) ELSE [text] END,
    lambda y: trim(regexp_replace(y, '{T.WHITE}+', ' ', 'g'))), lambda y: y <> '') AS raw, lang FROM j
), p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN list_transform(raw, lambda y: {nested_replace('y', [(b, a) for a, b in _placeholders])}) ELSE raw END AS parts FROM s)
SELECT doc_id, len(parts) AS n_sentences, list_max(list_transform(parts, lambda y: length(y))) AS longest, md5(array_to_string(parts, chr(10))) AS parts_md5 FROM p""")
def document_sentences(t) -> DataFrame:
    s = T.split_sentences(F.col("text"), F.col("lang") == "en")
    d = t("documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"), F.md5(F.array_join("s", "\n").cast("binary")).alias("parts_md5"))


@query(f"SELECT doc_id, {collapse_sql('text')} AS normalized FROM documents")
def normalized_text(t) -> DataFrame:
    return t("documents").select("doc_id", T.collapsed(F.col("text")).alias("normalized"))


@query(rf"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace({collapse_sql('text')}, ' .', '.'), ' ,', ','), ' :', ':'), ' ;', ';'), '( ', '('), ' )', ')'), '" ', '"'), '[\s\p{{Z}}]+', ' ', 'g')) AS tidy FROM documents""")
def tidy_joins(t) -> DataFrame:
    return t("documents").select("doc_id", T.tidy_joins(F.col("text")).alias("tidy"))


@query(r"""SELECT source, lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars,
  CAST(sum(length(regexp_replace(text, '[\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g'))) AS BIGINT) AS n_forbidden,
  count(*) FILTER (length(text) < 200) AS n_short FROM documents GROUP BY 1, 2""")
def text_quality_by_source(t) -> DataFrame:
    return lines.text_quality(t("documents"), ["source", "lang"])


@query(f"""WITH {LINES}, c AS (SELECT doc_id, sum(length(line)) AS n, count(*) FILTER (line = '') / count(*) AS blank FROM lines GROUP BY 1)
SELECT doc_id, n < 200 OR blank > 0.8 AS ocr_recommended FROM c""")
def ocr_recommended(t) -> DataFrame:
    c = lines.lines(t("documents")).groupBy("doc_id").agg(F.sum(F.length("line")).alias("n"), F.count("*").alias("cells"), F.count_if(F.col("line") == "").alias("empty"))
    return c.select("doc_id", blocks.needs_ocr(F.col("n"), F.col("cells"), F.col("empty")).alias("ocr_recommended"))


@query(r"""SELECT doc_id, list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]'))), 'string_agg', ' ') AS mails,
  len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS n_addresses FROM documents WHERE contains(text, '@')""")
def contact_tokens(t) -> DataFrame:
    x = F.col("text")
    found = t("documents").where(x.contains("@")).select("doc_id", T.mail_addresses(x).alias("mails"), F.size(T.network_addresses(x)).cast("long").alias("n_addresses"))
    return found.withColumn("mails", F.nullif(F.array_join("mails", " "), F.lit("")))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS language,
  trim(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40), '_') AS slug FROM pages""")
def url_fields(t) -> DataFrame:
    u = F.col("url")
    return t("pages").select("page_id", T.url_host(u).alias("host"), T.url_language(u).alias("language"), T.slug(u).alias("slug"))


@query(f"WITH {LINES} SELECT doc_id, line, min(ord) AS first_ord FROM lines GROUP BY 1, 2")
def dedupe_first_seen(t) -> DataFrame:
    return lines.first_seen(lines.lines(t("documents")), ["doc_id", "line"], "ord")


STARTS = """starts AS (SELECT user_id, event_id AS start FROM events WHERE event_type = 'signup'),
iv AS (SELECT user_id, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start) - 1, (SELECT max(event_id) FROM events))) AS "end" FROM starts)"""


def _intervals(t) -> DataFrame:
    e = t("events")
    last = e.agg(F.max("event_id").alias("_last"))
    s = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start")).crossJoin(F.broadcast(last))  # one row
    return sequences.bounds(s, ["user_id"], "start", F.col("_last")).drop("_last")


@query(f'WITH {STARTS} SELECT user_id, start, "end" FROM iv')
def interval_bounds(t) -> DataFrame:
    return _intervals(t)


@query(f"""WITH {STARTS} SELECT event_id, start AS interval_start FROM events LEFT JOIN iv ON events.user_id = iv.user_id AND event_id BETWEEN start AND "end" """)
def interval_membership(t) -> DataFrame:
    # the intervals of a user tile time, so membership is the last start at or before: a window instead of a range join
    return sequences.membership(t("events"), ["user_id"], "event_id", F.col("event_type") == "signup").select("event_id", F.col("interval").alias("interval_start"))


@query(f"""WITH {STARTS}, m AS (SELECT *, coalesce(start > lag("end") OVER (PARTITION BY user_id ORDER BY start), true) AS fine FROM iv)
SELECT user_id, bool_and(fine) AS ordered, count(*) AS n FROM m GROUP BY 1""")
def interval_order(t) -> DataFrame:
    return sequences.ordered_without_overlap(_intervals(t), ["user_id"], "start", "end")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS expected FROM lineitem)
SELECT l_orderkey, count(*) AS n, bool_and(l_linenumber = expected) AND count(*) >= 2 AS valid,
  CAST(min(CASE WHEN l_linenumber <> expected THEN expected END) AS INTEGER) AS first_gap FROM r GROUP BY 1""")
def series_audit(t) -> DataFrame:
    return sequences.series_audit(t("lineitem"), ["l_orderkey"], "l_linenumber")


@query("""WITH r AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS series FROM conversations)
SELECT conv_id, CAST(series AS BIGINT) AS series, count(*) AS n_turns, min(turn) AS first_turn, max(turn) AS last_turn FROM r GROUP BY 1, 2""")
def turn_series(t) -> DataFrame:
    s = sequences.split_series(t("conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return s.groupBy("conv_id", "series").agg(F.count("*").alias("n_turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
SELECT conv_id, role, count(DISTINCT island) AS n_runs, min(turn) AS first, max(turn) AS last, count(DISTINCT island) = 1 AS contiguous FROM g GROUP BY 1, 2""")
def role_contiguity(t) -> DataFrame:
    return sequences.contiguous(t("conversations"), ["conv_id"], "turn", "role")


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice AS v, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM s)
SELECT l_returnflag, min(v) AS median FROM c WHERE cum >= total / 2 GROUP BY 1""")
def weighted_median_lower(t) -> DataFrame:
    return stats.weighted_median_lower(t("lineitem").withColumn("w", F.col("l_quantity").cast("long")), ["l_returnflag"], "l_extendedprice", "w")


MID = """c AS (SELECT k, v, sum(w) OVER (PARTITION BY k ORDER BY v) AS cum, sum(w) OVER (PARTITION BY k) AS total FROM s),
mid AS (SELECT k, round((min(v) FILTER (cum >= (total + 1) // 2) + min(v) FILTER (cum >= total // 2 + 1)) / 2, 4) AS median FROM c GROUP BY 1)"""


@query(f"""WITH s AS (SELECT l_returnflag AS k, l_extendedprice AS v, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2), {MID}
SELECT k AS l_returnflag, median FROM mid""")
def weighted_median_mid(t) -> DataFrame:
    return stats.weighted_median_mid(t("lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").withColumn("median", F.round("median", 4))


@query(f"""WITH d AS (SELECT DISTINCT p_type AS k, ln(p_retailprice) AS l FROM part), m AS (SELECT k, median(l) AS c FROM d GROUP BY 1),
a AS (SELECT k, any_value(c) AS c, median(abs(l - c)) AS m FROM d JOIN m USING (k) GROUP BY 1),
s AS (SELECT p_type AS k, p_retailprice AS v, sum(p_size) AS w FROM part JOIN a ON p_type = k
      WHERE CASE WHEN m < 1e-12 THEN abs(ln(p_retailprice) - c) < 1e-12 ELSE abs(ln(p_retailprice) - c) <= 3 * 1.4826 * m END GROUP BY 1, 2), {MID}
SELECT k AS p_type, median FROM mid""")
def robust_median(t) -> DataFrame:
    return stats.robust_median(t("part"), ["p_type"], "p_retailprice", "p_size").withColumn("median", F.round("median", 4))


@query("""WITH m AS (SELECT event_type, median(value) AS c FROM events GROUP BY 1),
d AS (SELECT event_type, any_value(c) AS centre, median(abs(value - c)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, round(centre, 4) AS centre, round(mad, 4) AS mad, round(centre - 3 * 1.4826 * mad, 4) AS low, round(centre + 3 * 1.4826 * mad, 4) AS high FROM d""")
def robust_range(t) -> DataFrame:
    r = stats.robust_range(t("events"), ["event_type"], "value")
    return r.select("event_type", *[F.round(c, 4).alias(c) for c in ("centre", "mad", "low", "high")])


@query("""WITH g AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events),
c AS (SELECT user_id, gap, count(*) AS c FROM g WHERE gap > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, gap) AS i FROM c)
SELECT user_id, gap AS cadence FROM r WHERE i = 1""")
def modal_cadence(t) -> DataFrame:
    return stats.cadence(t("events"), ["user_id"], "event_id")


WORDS = r"regexp_extract_all(lower({x}), '[\p{L}]+')"


@query(f"""WITH a AS (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS.replace('{x}', 'text')}) AS w FROM documents) GROUP BY 1),
b AS (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS.replace('{x}', 'text')}) AS w FROM benchmark) GROUP BY 1)
SELECT coalesce(a.w, b.w) AS word, coalesce(a.n, 0) AS n_documents, coalesce(b.n, 0) AS n_benchmark FROM a FULL JOIN b ON a.w = b.w WHERE coalesce(b.n, 0) > coalesce(a.n, 0)""")
def multiset_diff(t) -> DataFrame:
    words = lambda name: t(name).select(F.explode(T.words(F.col("text"))).alias("word"))
    both = checks.bag_counts(words("documents"), words("benchmark"), ["word"])
    return both.select("word", F.col("n_first").alias("n_documents"), F.col("n_second").alias("n_benchmark")).where("n_benchmark > n_documents")


TAGS = r"""tags AS (SELECT page_id, CAST(i AS INTEGER) AS ord, found[i + 1] AS tag FROM (SELECT page_id, found, unnest(range(len(found))) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '<(h1|p|ul|li|nav|div|article|footer)[ >]', 1) AS found FROM pages)))"""


@query(f"WITH {TAGS} SELECT page_id, ord, tag FROM tags")
def page_nodes(t) -> DataFrame:
    return tree.page_tags(t("pages"))


_roles = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tree.TAG_ROLES.items())


@query(f"""WITH {TAGS}, r AS (SELECT page_id, CASE tag {_roles} END AS role FROM tags)
SELECT page_id, CASE WHEN regexp_matches(role, '^H[1-6]$') THEN 'heading' ELSE CASE role {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SEMANTIC_ROLES.items())} ELSE 'unknown' END END AS semantic_role,
  CAST(CASE WHEN regexp_matches(role, '^H[1-6]$') THEN substr(role, 2, 1) END AS INTEGER) AS level, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def node_roles(t) -> DataFrame:
    return tree.node_roles(t("pages"))


PATHS = f"""{TAGS}, n AS (SELECT page_id, ord, tag, CAST(sum(CASE WHEN tag IN ('nav', 'div', 'article', 'footer') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord) AS INTEGER) AS part FROM tags)"""


def _nodes(t) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("ord")
    part = F.sum(F.col("tag").isin("nav", "div", "article", "footer").cast("int")).over(w).cast("int")
    return tree.page_tags(t("pages")).withColumn("part", part).withColumn("path", F.array("part", "ord"))


@query(f"""WITH {PATHS}, barred AS (SELECT DISTINCT page_id, part FROM n WHERE tag IN ('nav', 'footer'))
SELECT page_id, ord, tag FROM n WHERE NOT EXISTS (SELECT 1 FROM barred b WHERE b.page_id = n.page_id AND b.part = n.part)""")
def path_overlap_anti(t) -> DataFrame:
    n = _nodes(t)
    barred = n.where("tag in ('nav', 'footer')").select("page_id", F.array("part").alias("path")).distinct()
    return tree.outside(n.select("page_id", "path", "ord", "tag"), barred, ["page_id"]).select("page_id", "ord", "tag")


@query(f"""WITH {PATHS} SELECT page_id, part, count(*) AS n_nodes, min(ord) AS first_ord, max(ord) AS last_ord, bool_or(tag = 'h1') AS has_heading FROM n GROUP BY 1, 2""")
def subtree_summary(t) -> DataFrame:
    return tree.part_summary(_nodes(t))


SPANS = """spans AS (SELECT l_orderkey AS page, l_linenumber AS ord, l_returnflag || l_linestatus AS text, l_quantity * 16 AS x0, l_quantity * 16 + 10 AS x1, l_discount * 8000 AS y0, l_discount * 8000 + 12 AS y1 FROM lineitem)"""


def _spans(t) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    return t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("text"), (q * 16).alias("x0"), (q * 16 + 10).alias("x1"), (d * 8000).alias("y0"), (d * 8000 + 12).alias("y1"))


GRID = """g AS (SELECT *, CAST(least(floor((y0 + y1) / 2 / (820.0::DOUBLE / 2)) + 1, 2) AS INTEGER) AS row, CAST(least(floor((x0 + x1) / 2 / (820.0::DOUBLE / 8)) + 1, 8) AS INTEGER) AS col FROM spans)"""


@query(f"""WITH {SPANS}, {GRID} SELECT row, col, count(*) AS n_spans, count(DISTINCT page) AS n_pages, round(min(x0), 2) AS x0, round(max(x1), 2) AS x1, round(min(y0), 2) AS y0, round(max(y1), 2) AS y1 FROM g GROUP BY 1, 2""")
def grid_bins(t) -> DataFrame:
    g = grid.binned(_spans(t), 820.0, 820.0, 2, 8)
    return g.groupBy("row", "col").agg(F.count("*").alias("n_spans"), F.count_distinct("page").alias("n_pages"), *[F.round(f(c), 2).alias(c) for c, f in (("x0", F.min), ("x1", F.max), ("y0", F.min), ("y1", F.max))])


@query(f"""WITH {SPANS}, {GRID} SELECT page, ord, row, col, CAST((row - 1) * 8 + col AS INTEGER) AS ltr, CAST((row - 1) * 8 + (8 - col + 1) AS INTEGER) AS rtl FROM g""")
def reading_order(t) -> DataFrame:
    g = grid.binned(_spans(t), 820.0, 820.0, 2, 8)
    r, c = F.col("row"), F.col("col")
    return g.select("page", "ord", "row", "col", grid.reading_order(r, c, 8, F.lit(False)).alias("ltr"), grid.reading_order(r, c, 8, F.lit(True)).alias("rtl"))


@query(f"""WITH {SPANS}, {GRID} SELECT page, row, col, count(*) AS n_spans, round(min(x0), 2) AS x0, round(min(y0), 2) AS y0, round(max(x1), 2) AS x1, round(max(y1), 2) AS y1,
  string_agg(text, chr(10) ORDER BY ord, text) AS text FROM g GROUP BY 1, 2, 3""")
def cell_texts(t) -> DataFrame:
    c = grid.cells(grid.binned(_spans(t), 820.0, 820.0, 2, 8), ["page", "row", "col"])
    return c.select("page", "row", "col", "n_spans", *[F.round(x, 2).alias(x) for x in ("x0", "y0", "x1", "y1")], "text")


_sizes = " ".join(f"WHEN (abs(w - {w}) <= 8 AND abs(h - {h}) <= 8) OR (abs(w - {h}) <= 8 AND abs(h - {w}) <= 8) THEN '{n}'" for n, w, h in T.PAGE_SIZES)


@query(f"""WITH d AS (SELECT p_partkey, [466.5, 1237.6, 1730.8, 888.9, 500.0][p_partkey % 5 + 1] + p_size / 5 AS w, [642.3, 888.9, 1237.6, 1237.6, 500.0][p_partkey % 5 + 1] AS h FROM part)
SELECT p_partkey, CASE {_sizes} ELSE 'UNKNOWN' END AS page_size, CASE WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation FROM d""")
def page_sizes(t) -> DataFrame:
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("p_partkey") % 5).cast("int"))
    d = t("part").select("p_partkey", (pick(466.5, 1237.6, 1730.8, 888.9, 500.0) + F.col("p_size") / 5).alias("w"), pick(642.3, 888.9, 1237.6, 1237.6, 500.0).alias("h"))
    return d.select("p_partkey", T.page_size(F.col("w"), F.col("h")).alias("page_size"), F.when(F.col("w") > F.col("h"), "landscape").otherwise("portrait").alias("orientation"))


@query("""WITH u AS (SELECT c_custkey, unnest(['name', 'segment', 'balance']) AS field, unnest([c_name, c_mktsegment, CAST(round(c_acctbal, 0)::BIGINT AS VARCHAR)]) AS value FROM customer)
SELECT c_custkey, field, value FROM u""")
def unpivot_fields(t) -> DataFrame:
    c = t("customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 0).cast("long").cast("string").alias("balance"))
    return sinks.long_fields(c, ["c_custkey"])


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(t) -> DataFrame:
    return t("events").select("event_id", T.json_number(F.col("props"), "k").alias("k"))


@query("""WITH f AS (SELECT source, lang, min(doc_id) AS first FROM documents WHERE lang <> 'es' GROUP BY 1, 2)
SELECT source, string_agg(lang, ';' ORDER BY first) AS languages, count(*) AS n_languages FROM f GROUP BY 1""")
def detected_languages(t) -> DataFrame:
    b = lines.in_first_seen_order(t("documents"), ["source"], "lang", "doc_id", F.col("lang") != "es")
    return b.select("source", F.array_join("found", ";").alias("languages"), F.size("found").cast("long").alias("n_languages"))


@query("""SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def digest_copies(t) -> DataFrame:
    return checks.copies(t("documents"), "doc_id", "text")


PAIR = """h AS (SELECT event_type AS series, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, avg(value) AS v FROM events GROUP BY 1, 2),
p AS (SELECT a.hour, a.v AS a, b.v AS b FROM h a JOIN h b ON a.hour = b.hour AND a.series = 'click' AND b.series = 'view'),
r AS (SELECT *, count(*) OVER w AS n, avg(a) OVER w AS mean_a, stddev_pop(a) OVER w AS sd_a, stddev_pop(b) OVER w AS sd_b, corr(a, b) OVER w AS c FROM p WINDOW w AS (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
k AS (SELECT hour, CASE WHEN n = 24 THEN mean_a END AS mean_a, CASE WHEN n = 24 THEN sd_a END AS sd_a, CASE WHEN n = 24 AND sd_a > 0 AND sd_b > 0 THEN c END AS corr_ab FROM r)"""


@query(f"WITH {PAIR} SELECT hour, round(mean_a, 6) AS mean_a, round(sd_a, 6) AS sd_a, round(corr_ab, 6) AS corr_ab, coalesce(corr_ab < 0, false) AS decoupled FROM k")
def decoupling_masks(t) -> DataFrame:
    m = signals.decoupled(signals.aligned(signals.hourly(t("events")), "click", "view"), 24, 0.0)
    return m.select("hour", *[F.round(c, 6).alias(c) for c in ("mean_a", "sd_a", "corr_ab")], "decoupled")


@query(f"""WITH {PAIR}, f AS (SELECT hour, coalesce(corr_ab < 0, false) AS flag FROM k),
l AS (SELECT *, CASE WHEN flag AND lag(flag) OVER (ORDER BY hour) AND hour - lag(hour) OVER (ORDER BY hour) = 1 THEN 0 ELSE 1 END AS new FROM f),
g AS (SELECT *, sum(new) OVER (ORDER BY hour) AS run FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY hour) AS i FROM g WHERE flag)
SELECT min(hour) AS start, min(CASE WHEN i = 3 THEN hour END) AS confirmed, count(*) AS length FROM n GROUP BY run HAVING count(*) >= 3""")
def decoupling_events(t) -> DataFrame:
    m = signals.decoupled(signals.aligned(signals.hourly(t("events")), "click", "view"), 24, 0.0).withColumn("one", F.lit(1))
    return sequences.confirmed_runs(m, ["one"], "hour", "decoupled", F.lit(1), 3).drop("one")


@query(f"""WITH {PAIR}, l AS (SELECT unnest(range(-12, 13)) AS lag), c AS (SELECT lag, count(*) AS n, corr(x.a, y.b) AS corr FROM p x, l, p y WHERE y.hour = x.hour + lag GROUP BY 1)
SELECT CAST(lag AS INTEGER) AS lag, n, round(corr, 9) AS corr FROM c WHERE n >= 3 AND corr IS NOT NULL ORDER BY corr DESC, abs(lag), lag DESC LIMIT 1""")
def best_lag(t) -> DataFrame:
    best = signals.best_lag(signals.aligned(signals.hourly(t("events")), "click", "view"), 12)
    return best.select("lag", "n", F.round("corr", 9).alias("corr"))


@query()
def lcs_ratio(t) -> DataFrame:
    """Each benchmark passage against its neighbour by id: bounded texts, whole."""
    b = t("benchmark")
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id").select("item_id", align.lcs_ratio("text", "other").alias("ratio"))


@query()
def sentence_offsets(t) -> DataFrame:
    return t("documents").select("doc_id", sentences.sentence_offsets("text").alias("starts"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["section_rollup"](spark, sf_dir)
