"""Registered queries of item rewrites, chapters, checks and sinks, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chapters, checks, items, lines, rewrites, sequences, spans, tree
from foliant.plans.registry import KINDS, LINES, STARTS, TAGS, _intervals, query, quoted
from foliant.sources import sinks


def _items(t) -> DataFrame:
    return lines.kinds(t("documents")).withColumnRenamed("line", "text")


@query(f"""WITH RECURSIVE {KINDS},
f AS (SELECT doc_id, ord, kind, line, kind = 'heading' AS opens, kind = 'body' AS follows, ends_with(line, '.') AND kind <> 'heading' AS ends FROM kinds),
st AS (SELECT doc_id, ord, kind, line, ends, opens AS open, ord AS run FROM f WHERE ord = 0
  UNION ALL SELECT f.doc_id, f.ord, f.kind, f.line, f.ends, CASE WHEN st.open AND NOT (st.ends AND st.run < st.ord) AND f.follows THEN true ELSE f.opens END,
    CASE WHEN st.open AND NOT (st.ends AND st.run < st.ord) AND f.follows THEN st.run ELSE f.ord END FROM st JOIN f ON f.doc_id = st.doc_id AND f.ord = st.ord + 1),
g AS (SELECT doc_id, run, arg_min(kind, ord) AS kind, string_agg(line, ' ' ORDER BY ord) AS text FROM st GROUP BY 1, 2)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS ord, kind, text FROM g""")
def joined_items(t) -> DataFrame:
    kind, text = F.col("kind"), F.col("text")
    out = rewrites.joined_runs(_items(t), ["doc_id"], kind == "heading", kind == "body", text.endswith("."), kind, lambda p: F.array_join(p, " "))
    return rewrites.renumbered(out, ["doc_id"], "ord").withColumn("ord", F.col("ord").cast("long"))


@query(rf"""WITH {KINDS},
p AS (SELECT doc_id, ord, kind, CASE WHEN kind = 'body' AND regexp_matches(line, '[.!?] +[A-Z]')
  THEN string_split(regexp_replace(line, '([.!?]) +([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) ELSE [line] END AS parts FROM kinds),
u AS (SELECT doc_id, ord, kind, parts, unnest(range(len(parts))) AS i FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, i) - 1 AS ord, CASE WHEN i > 0 THEN 'bullet' ELSE kind END AS kind, parts[i + 1] AS text FROM u""")
def split_items(t) -> DataFrame:
    text = F.col("text")
    parts = F.transform(F.split(text, r"(?<=[.!?]) +(?=[A-Z])"), lambda p, i: rewrites.piece(F.when(i == 0, F.col("kind")).otherwise("bullet"), p))
    out = rewrites.split(_items(t), ["doc_id"], (F.col("kind") == "body") & text.rlike("[.!?] +[A-Z]"), parts)
    return rewrites.renumbered(out, ["doc_id"], "ord").withColumn("ord", F.col("ord").cast("long"))


@query(f"""WITH {KINDS},
m AS (SELECT *, kind = 'heading' AND coalesce(lead(kind) OVER w = 'body', false) AS starts, lead(line) OVER w AS next FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
k AS (SELECT *, coalesce(lag(starts) OVER (PARTITION BY doc_id ORDER BY ord), false) AS taken FROM m)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, CASE WHEN starts THEN 'section' ELSE kind END AS kind, CASE WHEN starts THEN line || ': ' || next ELSE line END AS text FROM k WHERE NOT taken""")
def paired_items(t) -> DataFrame:
    out = rewrites.joined_pattern(_items(t), ["doc_id"], [F.col("kind") == "heading", F.col("kind") == "body"], F.lit("section"), lambda p: F.concat_ws(": ", *p))
    return rewrites.renumbered(out, ["doc_id"], "ord").withColumn("ord", F.col("ord").cast("long"))


@query()
def prepared_items(t) -> DataFrame:
    """The whole chain of generic rules over every document's review items."""
    found = items.review_items(t("documents"), F.col("lang") == "en")
    return rewrites.prepared(found.select("doc_id", (F.col("item_order") - 1).alias("ord"), "kind", "text"), ["doc_id"])


#: Lines of an order as nodes of a document, one a number (the table repeats numbers).
NODES = """nodes AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax,
  min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)"""


def _nodes(t) -> DataFrame:
    most, least = ("l_quantity", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus", "l_partkey")
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in most], *[F.min(c).alias(c) for c in least])


SERIES = NODES + """, f AS (SELECT o_custkey AS doc, l_orderkey * 10 + l_linenumber AS visit, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS label,
  CASE WHEN l_tax > 0.01 THEN l_quantity END AS label_size, l_quantity * (1 + 2 * l_discount) AS title_size, 10 + l_tax * 100 AS size, l_partkey % 7 + 1 AS weight FROM nodes JOIN orders ON l_orderkey = o_orderkey),
c0 AS (SELECT *, sum(CASE WHEN label = '01' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY visit) AS s FROM f),
c AS (SELECT * EXCLUDE (s), CAST(s - min(s) OVER (PARTITION BY doc) AS INTEGER) AS series FROM c0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, series ORDER BY visit) AS i FROM c),
a AS (SELECT doc, series, count(*) AS n, min(visit) AS start, bool_and(label = lpad(CAST(i AS VARCHAR), 2, '0')) AND count(*) >= 2 AS valid FROM r GROUP BY 1, 2)"""


def _candidates(t) -> DataFrame:
    q = F.col("l_quantity")
    found = _nodes(t).join(t("orders").select("o_orderkey", F.col("o_custkey").alias("doc")), F.col("l_orderkey") == F.col("o_orderkey"))
    return found.select(
        "doc", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("visit"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("label"),
        F.when(F.col("l_tax") > 0.01, q).alias("label_size"), (q * (1 + 2 * F.col("l_discount"))).alias("title_size"), (10 + F.col("l_tax") * 100).alias("size"), (F.col("l_partkey") % 7 + 1).alias("weight"),
    )


@query(f"""WITH {SERIES} SELECT doc, series, n, start, valid, lead(start) OVER (PARTITION BY doc ORDER BY series) AS next_start FROM a""")
def chapter_series(t) -> DataFrame:
    return chapters.audit(chapters.with_series(_candidates(t), "doc", "visit"), "doc", "visit")


@query(f"""WITH {SERIES} SELECT doc, CASE WHEN count(*) FILTER (valid) >= 2 THEN count(DISTINCT CASE WHEN valid THEN n END) = 1 END AS consistent FROM a GROUP BY 1""")
def series_consistency(t) -> DataFrame:
    return chapters.consistency(chapters.audit(chapters.with_series(_candidates(t), "doc", "visit"), "doc", "visit"), "doc")


@query(f"""WITH {SERIES}, s AS (SELECT doc, series, size, sum(weight) AS w FROM c GROUP BY 1, 2, 3),
cum AS (SELECT *, sum(w) OVER (PARTITION BY doc, series ORDER BY size) AS cum, sum(w) OVER (PARTITION BY doc, series) AS total FROM s),
b AS (SELECT doc, series, min(size) AS body_size FROM cum WHERE cum >= total / 2 GROUP BY 1, 2),
d AS (SELECT *, abs(label_size - title_size) / greatest(label_size, title_size) AS diff, least(label_size, title_size) / body_size AS ratio FROM c JOIN a USING (doc, series) LEFT JOIN b USING (doc, series))
SELECT doc, visit, series, label, round(body_size, 6) AS body_size, CASE WHEN NOT valid THEN 'sequence_invalid' WHEN label_size IS NULL THEN 'typography_insufficient'
  WHEN diff > 0.1 AND abs(diff - 0.1) > 1e-12 * greatest(diff, 0.1) THEN 'label_body_size_mismatch'
  WHEN ratio < 1.5 AND abs(ratio - 1.5) > 1e-12 * greatest(ratio, 1.5) THEN 'font_ratio_below_threshold' ELSE 'promoted' END AS outcome FROM d""")
def chapter_promotions(t) -> DataFrame:
    c = _candidates(t)
    p = chapters.promotions(c.drop("size", "weight"), c.select("doc", "visit", "size", "weight"), "doc", "visit")
    return p.select("doc", "visit", "series", "label", F.round("body_size", 6).alias("body_size"), "outcome")


SIBLINGS = NODES + """, s AS (SELECT l_orderkey AS parent, l_linenumber AS ord, CASE WHEN l_linestatus = 'O' THEN 'list' ELSE 'paragraph' END AS role, CASE WHEN l_tax = 0.08 THEN ' ' ELSE l_returnflag || ' text' END AS text, 1 AS page,
  'EN' AS language, 12.0::DOUBLE AS size, 400 AS weight, l_discount * 100 AS x0, l_quantity AS y0, l_quantity + 10 AS y1 FROM nodes),
b AS (SELECT * FROM s WHERE trim(text) <> ''),
w AS (SELECT *, lag(role) OVER v AS before, lead(role) OVER v AS after, lag(x0) OVER v AS bx, lag(y0) OVER v + 20 AS below FROM b WINDOW v AS (PARTITION BY parent ORDER BY ord))"""


@query(f"""WITH {SIBLINGS} SELECT parent, ord, x0 - bx AS left_delta, below - y1 AS vertical_gap FROM w WHERE before = 'list' AND role = 'paragraph' AND after = 'list'
  AND abs(x0 - bx) <= 3 AND abs(x0 - (bx - 20)) > 3 AND below - y1 >= 0 AND abs(below - y1 - 4) <= 3 AND below - y1 < 12""")
def list_continuations(t) -> DataFrame:
    c = F.col
    s = _nodes(t).select(
        c("l_orderkey").alias("parent"), c("l_linenumber").alias("ord"), F.when(c("l_linestatus") == "O", "list").otherwise("paragraph").alias("role"),
        F.when(c("l_tax") == 0.08, " ").otherwise(F.concat("l_returnflag", F.lit(" text"))).alias("text"), F.lit(1).alias("page"), F.lit("EN").alias("language"), F.lit(12.0).alias("size"), F.lit(400).alias("weight"),
        (c("l_discount") * 100).alias("x0"), c("l_quantity").alias("y0"), (c("l_quantity") + 10).alias("y1"),
    ).withColumns({"body_x0": c("x0"), "body_y0": c("y0") + 20, "marker_x0": c("x0") - 20, "spacing": F.lit(4.0)})
    return chapters.continuations(s, ["parent"], "ord")


@query(f"""WITH {NODES}, p AS (SELECT l_orderkey AS doc, l_linenumber AS page, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS section FROM nodes),
q AS (SELECT *, min(CASE WHEN section IS NOT NULL THEN page END) OVER (PARTITION BY doc) AS low, max(CASE WHEN section IS NOT NULL THEN page END) OVER (PARTITION BY doc) AS high FROM p),
o AS (SELECT *, CASE WHEN section IS NOT NULL THEN 1 WHEN low IS NULL OR page < low THEN 0 WHEN page > high THEN 2 ELSE 3 END AS b, CASE WHEN section = 'R' THEN -page ELSE page END AS along FROM q)
SELECT doc, page, section, CAST(row_number() OVER (PARTITION BY doc ORDER BY b, section, along) AS INTEGER) AS review_order, CASE WHEN section IS NULL THEN 'book_unassigned'
  WHEN along = min(along) OVER (PARTITION BY doc, section) THEN 'section_front_cover' WHEN along = max(along) OVER (PARTITION BY doc, section) THEN 'section_back_cover' ELSE 'content' END AS page_role FROM o""")
def book_review_order(t) -> DataFrame:
    flag = F.col("l_returnflag")
    pages = _nodes(t).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.when(flag != "N", flag).alias("section"))
    return chapters.review_order(pages, "doc", "page", "section", F.coalesce(F.col("section") == "R", F.lit(False)))


@query(f"""WITH {STARTS}, m AS (SELECT e.user_id, event_type, start FROM events e LEFT JOIN iv ON e.user_id = iv.user_id AND event_id BETWEEN start AND "end")
SELECT user_id, event_type, CASE WHEN count(*) = count(start) AND count(DISTINCT start) = 1 THEN min(start) END AS interval_start FROM m GROUP BY 1, 2""")
def set_membership(t) -> DataFrame:
    m = sequences.membership(t("events"), ["user_id"], "event_id", F.col("event_type") == "signup")
    return sequences.set_membership(m, ["user_id", "event_type"], "interval").withColumnRenamed("interval", "interval_start")


RULES = [checks.Phrase("has_mail", "regex", r"[a-z0-9]@[a-z0-9]", required=False), checks.Phrase("has_license", "partial", "license"), checks.Phrase("numbered", "regex", r"(?m)^\d+[.)] "), checks.Phrase("looks_right", "manual")]


@query("""WITH r AS (SELECT doc_id, unnest(['has_mail', 'has_license', 'numbered', 'looks_right']) AS rule,
  unnest([CASE WHEN NOT regexp_matches(text, '[a-z0-9]@[a-z0-9]') THEN 'PASS' ELSE 'FAIL' END, CASE WHEN contains(text, 'license') THEN 'PASS' ELSE 'FAIL' END,
    CASE WHEN regexp_matches(text, '(?m)^[0-9]+[.)] ') THEN 'PASS' ELSE 'FAIL' END, 'REVIEW_REQUIRED']) AS status FROM documents) SELECT doc_id, rule, status FROM r""")
def phrase_checks(t) -> DataFrame:
    return checks.phrases(t("documents"), RULES)


VERSIONS = """a AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2), b AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.05)"""


@query(f"""WITH {VERSIONS}, d AS (SELECT l_orderkey, l_partkey, a.v AS before, b.v AS after FROM a FULL JOIN b USING (l_orderkey, l_partkey) WHERE a.v IS DISTINCT FROM b.v)
SELECT l_orderkey, l_partkey, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change, before, after FROM d ANTI JOIN i USING (l_orderkey, l_partkey)""")
def version_changes(t) -> DataFrame:
    li, keys = t("lineitem"), ["l_orderkey", "l_partkey"]
    side = lambda cond: li.where(cond).groupBy(*keys).agg(F.max("l_quantity").alias("v"))
    return checks.changes(side("l_linestatus = 'O'"), side("l_returnflag <> 'R'"), keys, "v", li.where("l_discount > 0.05"))


@query("""WITH p AS (SELECT r_regionkey AS k, list_sort(list(n_name)) AS found FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1), w AS (SELECT *, found[1:5] AS languages, CASE WHEN k = 0 THEN 'A2' ELSE 'A3' END AS doc_type, k + 3 AS n FROM p),
r AS (SELECT k, list_filter([CASE WHEN doc_type <> 'A3' THEN 'doc_type' END, CASE WHEN n <> len(found) THEN 'language_count' END, CASE WHEN languages <> found THEN 'languages' END], lambda x: x IS NOT NULL) AS i FROM w)
SELECT k AS r_regionkey, array_to_string(i, ',') AS issues, CASE WHEN len(i) = 0 THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS status FROM r""")
def structure_validation(t) -> DataFrame:
    n = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_name")).alias("found_languages"))
    p = n.withColumns({"languages": F.slice("found_languages", 1, 5), "doc_type": F.when(F.col("r_regionkey") == 0, "A2").otherwise("A3"), "language_count": F.col("r_regionkey") + 3, "found_type": F.lit("A3")})
    return checks.structure(p).select("r_regionkey", F.array_join("issues", ",").alias("issues"), "status")


@query("""WITH h AS (SELECT l_orderkey AS o, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT o AS o_orderkey, s AS s_suppkey, n, CASE WHEN k.o_orderkey IS NULL THEN 'no_node' ELSE 'repeated' END AS problem
FROM h LEFT JOIN (SELECT o_orderkey, s_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus <> 'F' AND s_acctbal > 0 GROUP BY ALL) k ON o = k.o_orderkey AND s = k.s_suppkey WHERE k.o_orderkey IS NULL OR n > 1""")
def hint_completeness(t) -> DataFrame:
    li = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    nodes = li.join(t("orders").where("o_orderstatus <> 'F'").select("o_orderkey"), "o_orderkey").join(t("supplier").where("s_acctbal > 0").select("s_suppkey"), "s_suppkey")
    return checks.completeness(li, nodes, ["o_orderkey", "s_suppkey"])


_escaped = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '([\\`*_\[\]<>|])', '\\\1', 'g'), '^(#{{1,6}}|[-+])(\s|$)', '\\\1\2'), '^(\d{{1,9}})([.)])(\s|$)', '\1\\\2\3')"


@query(
    rf"""WITH {KINDS}, m AS (SELECT doc_id, ord, CASE kind WHEN 'heading' THEN '## ' || {_escaped('line')} WHEN 'bullet' THEN '- ' || {_escaped("regexp_replace(line, '^[•–-][ ]*', '')")}
  WHEN 'list_item' THEN '- ' || {_escaped("regexp_replace(line, '^[*][ ]*', '')")} WHEN 'warning' THEN '> ' || {_escaped('line')} ELSE {_escaped('line')} END AS md FROM kinds)
SELECT doc_id, string_agg(md, chr(10) ORDER BY ord) AS markdown FROM m GROUP BY 1"""
)
def markdown_documents(t) -> DataFrame:
    return sinks.markdown(lines.kinds(t("documents")), ["doc_id"])


@query(r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '[\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]', '', 'g')) > 0 THEN 'base64' ELSE 'text' END AS form, true AS lossless FROM documents""")
def lossless_text(t) -> DataFrame:
    d = t("documents").select("doc_id", "text", sinks.encoded(F.col("text")).alias("e"))
    return d.select("doc_id", F.when(F.col("e.base64").isNotNull(), "base64").otherwise("text").alias("form"), (sinks.decoded(F.col("e")) == F.col("text")).alias("lossless"))


@query(rf"""WITH {LINES} SELECT CASE WHEN label IN ('※', '*', 'NOTE') THEN 'note' WHEN regexp_full_match(label, '\d{{1,3}}\.') THEN 'decimal' WHEN regexp_full_match(label, '\(?\d{{1,3}}\)') THEN 'parenthesised' WHEN regexp_full_match(label, '\d{{1,3}}') THEN 'number'
  WHEN regexp_full_match(label, '\(?[ivx]{{1,5}}[.)]') THEN 'roman' WHEN regexp_full_match(label, '\(?[A-Za-z][.)]') THEN 'letter' ELSE 'none' END AS marker, count(*) AS n FROM (SELECT split_part(line, ' ', 1) AS label FROM lines) GROUP BY 1""")
def list_markers(t) -> DataFrame:
    return lines.lines(t("documents")).groupBy(T.list_marker(F.substring_index("line", " ", 1)).alias("marker")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\x{00C0}-\x{024F}]', '', 'g')) AS INTEGER) AS n_accented, length(text) - length(regexp_replace(text, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]', '', 'g')) >= 10 AS arabic FROM documents""")
def script_counts(t) -> DataFrame:
    return t("documents").select("doc_id", T.characters_in(F.col("text"), ((0x00C0, 0x024F),)).alias("n_accented"), T.has_rtl_script(F.col("text"), F.lit("ARA")).alias("arabic"))


@query("""WITH p AS (SELECT item_id, instr(text, ',') AS pos, text FROM benchmark) SELECT item_id, (length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), '"', ''))) % 2 = 1 AS quoted FROM p WHERE pos > 0""")
def quoted_commas(t) -> DataFrame:
    at = F.instr("text", ",")
    return t("benchmark").where(at > 0).select("item_id", T.inside_quotes(F.col("text"), at).alias("quoted"))


@query(f"""WITH {TAGS}, n AS (SELECT *, lag(tag) OVER w AS before, lead(tag) OVER w AS after FROM tags WINDOW w AS (PARTITION BY page_id ORDER BY ord))
SELECT page_id, ord, before, after FROM n WHERE tag = 'p' AND (before IN ({quoted(('h1', 'article'))}) OR after = 'footer')""")
def sibling_context(t) -> DataFrame:
    n = sequences.beside(tree.page_tags(t("pages")), ["page_id"], "ord", "tag")
    return n.where((F.col("tag") == "p") & (F.col("before").isin("h1", "article") | (F.col("after") == "footer"))).select("page_id", "ord", "before", "after")


@query(f"""WITH {STARTS} SELECT user_id, count(*) AS n_intervals, max("end" - start) AS longest FROM iv GROUP BY 1""")
def interval_spans(t) -> DataFrame:
    return sequences.spans(_intervals(t), ["user_id"], "start", "end")


STYLED = NODES + """, sp AS (SELECT l_orderkey AS page, l_linenumber AS ord, l_returnflag || l_linestatus AS text, 8 + l_discount * 40 AS size, l_tax > 0.02 AS bold, l_returnflag = 'A' AS underline, l_linenumber * 14.0::DOUBLE AS y0, l_linenumber * 14.0::DOUBLE + 10 AS y1, l_quantity FROM nodes)"""


def _styled(t) -> DataFrame:
    c, y = F.col, F.col("l_linenumber") * F.lit(14.0)
    return _nodes(t).select(c("l_orderkey").alias("page"), c("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("text"), (8 + c("l_discount") * 40).alias("size"), (c("l_tax") > 0.02).alias("bold"), (c("l_returnflag") == "A").alias("underline"), y.alias("y0"), (y + 10).alias("y1"), "l_quantity")


@query(f"""WITH {STYLED}, s AS (SELECT *, size >= 9 AND (bold OR underline) AS strong FROM sp),
m AS (SELECT *, CASE WHEN strong AND lag(strong) OVER w AND abs(size - lag(size) OVER w) <= 0.75 AND y0 - lag(y1) OVER w <= greatest(size, lag(size) OVER w) * 0.75 THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY page ORDER BY ord)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page ORDER BY ord) AS BIGINT) AS grp FROM m)
SELECT page, grp, count(*) AS n_spans, round(max(size), 6) AS size, string_agg(text, ' ' ORDER BY ord) AS text FROM g WHERE strong GROUP BY 1, 2""")
def style_heading_groups(t) -> DataFrame:
    return spans.heading_groups(_styled(t), ["page"], "ord").withColumn("size", F.round("size", 6))


@query(f"""WITH {STYLED}, l AS (SELECT *, row_number() OVER (PARTITION BY page, text ORDER BY ord) AS i FROM sp WHERE l_quantity > 10), r AS (SELECT *, row_number() OVER (PARTITION BY page, text ORDER BY ord) AS i FROM sp WHERE l_quantity < 40)
SELECT l.page, l.ord, l.text, round(r.size, 6) AS span_size FROM l LEFT JOIN r ON l.page = r.page AND l.text = r.text AND l.i = r.i""")
def span_matches(t) -> DataFrame:
    s = _styled(t)
    right = s.where("l_quantity < 40").select("page", "ord", "text", F.round("size", 6).alias("span_size"))
    return spans.matched(s.where("l_quantity > 10").select("page", "ord", "text"), right, ["page"], "ord", ["span_size"])


@query(f"""WITH {NODES}, m AS (SELECT l_orderkey AS doc, l_linenumber AS ord, l_quantity > 35 AS label, l_quantity AS tier FROM nodes),
f AS (SELECT *, last_value(CASE WHEN label THEN ord END IGNORE NULLS) OVER w AS label_ord, last_value(CASE WHEN label THEN tier END IGNORE NULLS) OVER w AS lt FROM m WINDOW w AS (PARTITION BY doc ORDER BY ord)),
k AS (SELECT *, bool_and(label OR tier < lt) OVER (PARTITION BY doc, label_ord ORDER BY ord) AS fine FROM f WHERE label_ord IS NOT NULL)
SELECT doc, label_ord, max(lt) AS tier, count(*) FILTER (NOT label) AS n_details FROM k WHERE fine GROUP BY 1, 2""")
def label_detail_groups(t) -> DataFrame:
    m = _nodes(t).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("tier"))
    return spans.label_groups(m, ["doc"], "ord", "tier", F.col("tier") > 35)


@query("""WITH b AS (SELECT user_id, event_id AS start, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type = 'signup')
SELECT user_id, CAST(ordinal AS INTEGER) AS ordinal, start, coalesce((SELECT min(event_id) FROM events e WHERE e.user_id = b.user_id AND e.event_type = 'error' AND event_id <= start AND (before IS NULL OR event_id > before)), start) AS physical_start FROM b""")
def physical_section_starts(t) -> DataFrame:
    e = t("events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    marks = e.where("event_type = 'signup'").select("user_id", n.alias("ordinal"), F.col("event_id").alias("start"))
    return spans.physical_starts(marks, e.select("user_id", "event_id", (F.col("event_type") == "error").alias("shows")), "user_id", "event_id")


@query(f"""WITH {NODES}, f AS (SELECT l_orderkey AS doc, l_returnflag AS text, CASE WHEN l_tax > 0 THEN CAST(l_quantity AS INTEGER) END AS weight, 8 + l_discount * 100 AS size, l_linenumber AS mcid FROM nodes),
b AS (SELECT doc, bool_and(weight IS NOT NULL) AS valid, count(DISTINCT mcid) AS lines FROM f GROUP BY 1),
w AS (SELECT doc, weight AS v, sum(count(*)) OVER (PARTITION BY doc ORDER BY weight) AS cum, sum(count(*)) OVER (PARTITION BY doc) AS total FROM f WHERE weight IS NOT NULL GROUP BY 1, 2),
s AS (SELECT doc, size AS v, sum(count(*)) OVER (PARTITION BY doc ORDER BY size) AS cum, sum(count(*)) OVER (PARTITION BY doc) AS total FROM f GROUP BY 1, 2)
SELECT doc, valid, CASE WHEN valid THEN (SELECT min(v) FROM w WHERE w.doc = b.doc AND cum >= total / 2) END AS weight, CASE WHEN valid THEN round((SELECT min(v) FROM s WHERE s.doc = b.doc AND cum >= total / 2), 6) END AS size, lines FROM b""")
def node_typography(t) -> DataFrame:
    c = F.col
    f = _nodes(t).select(c("l_orderkey").alias("doc"), c("l_returnflag").alias("text"), F.when(c("l_tax") > 0, c("l_quantity").cast("int")).alias("weight"), (8 + c("l_discount") * 100).alias("size"), F.lit(1).alias("page"), c("l_linenumber").alias("mcid"))
    return spans.typography(f, ["doc"]).withColumn("size", F.round("size", 6))
