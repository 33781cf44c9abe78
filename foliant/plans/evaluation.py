"""Registered queries of quality evaluation over made documents, each with the SQL that gives the same rows.

An order is a document; its lines are nodes on two levels and their fragments, its baseline text is a second selection of
the same phrases, and lines with certain taxes are diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import quality
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.registry import collapse_sql, query, quoted
from foliant.sources.places import dealt

KEYS = ["doc"]
ROLES = ("paragraph", "heading", "list", "unknown", "figure", "section", "table_cell", "document")
SOURCES = ("P", "H2", "L", "Heading3-x", "Figure", "Sect", "sub_title", "Document")
TEXTS = ("Press > Menu (now)", "a / b & c", "→ next [1]", "  ", "", "bell \x07 here", "é plain", "x:y", "Å text  wide")
CODES = ("unresolved_mcid", "unsupported_objr", "invalid_mcid", "typography_insufficient", "other", "unresolved_page_reference")
CONTEXTS = (("1", "2"), ("-1", "2"), (None, None), ("3", None), ("x", "1"))
STATUSES = (None, "not_applicable", "blocked_by_invalid_interval", "compared", "compared")


def _lines(t) -> DataFrame:
    c = F.col
    most = ("l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity")
    table = t("lineitem")
    n = dealt(table.select("l_orderkey", "l_linenumber", *most), "l_orderkey", table=table, once=True).groupBy("l_orderkey", "l_linenumber").agg(*[F.max(x).alias(x) for x in most])
    return n.select(c("l_orderkey").alias("doc"), c("l_linenumber").alias("n"), *most, F.array((c("l_linenumber") / 3).cast("int"), c("l_linenumber")).alias("path"))


LINES = "li AS (SELECT l_orderkey AS doc, l_linenumber AS n, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_quantity) AS l_quantity, [l_linenumber // 3, l_linenumber] AS path FROM lineitem GROUP BY 1, 2, l_linenumber)"


def _nodes(t) -> DataFrame:
    role, source, note = chosen(ROLES, "l_partkey % 8"), chosen(SOURCES, "l_partkey % 8"), chosen(("ok", "bad \x02", None), "l_suppkey % 3")
    leaf = _lines(t).select("doc", "path", role.alias("semantic_role"), source.alias("source_role"), F.array(source, note).alias("fields"))
    tops = _lines(t).select("doc", F.slice("path", 1, 1).alias("path")).distinct().select("doc", "path", F.lit("section").alias("semantic_role"), F.lit("Sect").alias("source_role"), F.array(F.lit("Sect")).alias("fields"))
    return leaf.unionByName(tops).withColumn("heading_level", F.when(F.col("semantic_role") == "heading", 2))


def _fragments(t) -> DataFrame:
    f = _lines(t).where("l_tax <> 0.01").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).where("i = 0 OR l_discount > 0.05")
    return f.select("doc", F.concat("path", F.array("i")).alias("path"), (F.col("n") % 2).alias("page"), chosen(TEXTS, "(l_suppkey + i) % 9").alias("text"))


def _promotions(t) -> DataFrame:
    return _lines(t).where("l_quantity > 45").select("doc", "path", F.lit(1).alias("level"))


TREE = f"""{LINES}, nd AS (SELECT doc, path, {chosen_sql(ROLES, 'l_partkey % 8')} AS role, {chosen_sql(SOURCES, 'l_partkey % 8')} AS source, [{chosen_sql(SOURCES, 'l_partkey % 8')}, {chosen_sql(('ok', 'bad ' + chr(2), None), 'l_suppkey % 3')}] AS fields FROM li
  UNION ALL SELECT doc, path[1:1], 'section', 'Sect', ['Sect'] FROM li GROUP BY 1, 2),
fr AS (SELECT doc, list_append(path, i) AS path, n % 2 AS page, {chosen_sql(TEXTS, '(l_suppkey + i) % 9')} AS text FROM li, (SELECT unnest([0, 1]) AS i) WHERE l_tax <> 0.01 AND (i = 0 OR l_discount > 0.05)),
pm AS (SELECT doc, path FROM li WHERE l_quantity > 45), vi AS (SELECT * FROM fr WHERE {collapse_sql('text')} <> ''),
ht AS (SELECT nd.*, EXISTS (SELECT 1 FROM vi WHERE vi.doc = nd.doc AND vi.path[1:len(nd.path)] = nd.path AND len(vi.path) > len(nd.path)) AS has, EXISTS (SELECT 1 FROM pm WHERE pm.doc = nd.doc AND pm.path = nd.path) AS prom FROM nd)"""
_bad = lambda x: rf"length(regexp_replace({x}, '[\t\n\r\x20-\x{{D7FF}}\x{{E000}}-\x{{FFFD}}\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"
_body = f"role IN ({quoted(quality.BODY_ROLES)})"
COUNTS = f"""{TREE}, ca AS (SELECT doc, count(*) AS element_count, count(*) FILTER (role = 'heading' OR prom) AS heading_count, count(*) FILTER ({_body} AND has) AS body_count, count(*) FILTER ({_body}) AS body_role_node_count, count(*) FILTER (role = 'unknown') AS unknown_role_count, count(*) FILTER (NOT has) AS empty_element_count,
  sum(list_sum(list_transform(list_filter(fields, lambda x: x IS NOT NULL), lambda x: {_bad('x')}))) AS b1, sum(len(list_filter(fields, lambda x: x IS NOT NULL AND {_bad('x')} > 0))) AS f1 FROM ht GROUP BY 1),
cb AS (SELECT doc, count(*) AS fragment_count, sum({_bad('text')}) AS b2, count(*) FILTER ({_bad('text')} > 0) AS f2 FROM fr GROUP BY 1),
cn AS (SELECT doc, element_count, coalesce(fragment_count, 0) AS fragment_count, heading_count, body_count, body_role_node_count, unknown_role_count, empty_element_count, CAST(b1 + coalesce(b2, 0) AS BIGINT) AS forbidden_xml_control_count, CAST(f1 + coalesce(f2, 0) AS BIGINT) AS forbidden_xml_control_field_count FROM ca LEFT JOIN cb USING (doc))"""


def _counts(t) -> DataFrame:
    return quality.traversal(_nodes(t), _fragments(t), _promotions(t), KEYS)


@query(f"WITH {COUNTS} SELECT * FROM cn")
def tree_counts(t) -> DataFrame:
    return _counts(t)


@query(f"WITH {TREE} SELECT doc, page, count(*) AS fragment_count, CAST(sum(length(text)) AS BIGINT) AS character_count, CAST(sum({_bad('text')}) AS BIGINT) AS forbidden_xml_control_count FROM fr GROUP BY 1, 2")
def page_text_quality(t) -> DataFrame:
    return quality.page_quality(_fragments(t), KEYS)


@query(f"WITH {TREE} SELECT doc, source AS source_role, count(*) AS n FROM nd GROUP BY 1, 2")
def source_role_counts(t) -> DataFrame:
    return quality.role_counts(_nodes(t), KEYS)


def _baseline(t) -> DataFrame:
    """The same lines' phrases by another index: some are missing, some come twice."""
    b = _lines(t).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", chosen(TEXTS, "l_suppkey * 7 % 9").alias("x")))), lambda s: s["x"]), "\n").alias("x"))
    return b.select("doc", quality.measured(F.col("x")).alias("text"))


_nfc = lambda x: collapse_sql(f"nfc_normalize({x})")
SPECIAL = f"""tg AS (SELECT doc, {_nfc("coalesce(string_agg(text, ' ' ORDER BY path) FILTER (text <> ''), '')")} AS a FROM fr GROUP BY 1), bs AS (SELECT doc, {_nfc(f"string_agg({chosen_sql(TEXTS, 'l_suppkey * 7 % 9')}, chr(10) ORDER BY n)")} AS b FROM li GROUP BY 1),
sp AS (SELECT doc, c AS character, length(coalesce(a, '')) - length(replace(coalesce(a, ''), c, '')) AS tagged, length(coalesce(b, '')) - length(replace(coalesce(b, ''), c, '')) AS baseline FROM tg FULL JOIN bs USING (doc), (SELECT unnest([{quoted(quality.SPECIAL_CHARACTERS)}]) AS c))"""


def _specials(t) -> DataFrame:
    return quality.special_characters(quality.tagged_texts(_fragments(t), KEYS), _baseline(t), KEYS)


@query(f"WITH {TREE}, {SPECIAL} SELECT doc, character, CAST(tagged AS INTEGER) AS tagged, CAST(baseline AS INTEGER) AS baseline, baseline = 0 OR tagged >= baseline AS count_preserved FROM sp")
def special_char_preservation(t) -> DataFrame:
    return _specials(t)


@query(f"""WITH {TREE}, {SPECIAL}, ad AS (SELECT doc, '>' AS character, count(*) FILTER (l_discount > 0.08) AS verified FROM li GROUP BY 1), j AS (SELECT doc, character, tagged, coalesce(verified, baseline) AS baseline FROM sp LEFT JOIN ad USING (doc, character))
SELECT doc, character, CAST(tagged AS BIGINT) AS tagged, CAST(baseline AS BIGINT) AS baseline, baseline = 0 OR tagged >= baseline AS count_preserved FROM j""")
def special_char_adjusted(t) -> DataFrame:
    adjusted = _lines(t).groupBy("doc").agg(F.count_if(F.col("l_discount") > 0.08).alias("verified")).withColumn("character", F.lit(">"))
    out = quality.special_characters(quality.tagged_texts(_fragments(t), KEYS), _baseline(t), KEYS, adjusted)
    return out.withColumns({c: F.col(c).cast("long") for c in ("tagged", "baseline")})


def _diagnostics(t) -> DataFrame:
    d = _lines(t).where("l_tax >= 0.05")
    page, mcid = chosen([a for a, _ in CONTEXTS], "l_suppkey % 5"), chosen([b for _, b in CONTEXTS], "l_suppkey % 5")
    context = F.map_filter(F.create_map(F.lit("page_index"), page, F.lit("mcid"), mcid), lambda k, v: v.isNotNull())
    return d.select("doc", chosen(CODES, "l_partkey % 6").alias("code"), context.alias("context"))


DIAGNOSTICS = f"""dg AS (SELECT doc, {chosen_sql(CODES, 'l_partkey % 6')} AS code, {chosen_sql([a for a, _ in CONTEXTS], 'l_suppkey % 5')} AS pg, {chosen_sql([b for _, b in CONTEXTS], 'l_suppkey % 5')} AS mc FROM li WHERE l_tax >= 0.05),
du AS (SELECT *, CASE WHEN code = 'unresolved_mcid' THEN coalesce(TRY_CAST(pg AS INTEGER) >= 0, false) AND coalesce(TRY_CAST(mc AS INTEGER) >= 0, false) ELSE pg IS NOT NULL OR mc IS NOT NULL END AS useful FROM dg),
dc AS (SELECT doc, {', '.join(f"count(*) FILTER (code = '{c}') AS {c}_count" for c in quality.UNRESOLVED[:3])}, count(*) FILTER (code IN ({quoted(quality.UNRESOLVED)})) AS unresolved_reference_count, count(*) FILTER (code IN ({quoted(quality.UNRESOLVED)}) AND NOT useful) AS unreported_reference_count,
  count(*) FILTER (code IN ({quoted(quality.LOSS)})) AS extraction_loss_diagnostic_total, count(*) FILTER (code IN ({quoted(quality.TYPOGRAPHY)})) AS typography_diagnostic_count FROM du GROUP BY 1)"""


@query(f"WITH {LINES}, {DIAGNOSTICS} SELECT * FROM dc")
def diagnostic_counts(t) -> DataFrame:
    return quality.diagnostic_counts(_diagnostics(t), KEYS)


def _documents(t) -> DataFrame:
    o = F.col("o_orderkey")
    flag = lambda n: (o % n != 0)
    return t("orders").select(o.alias("doc"), flag(11).alias("marked"), flag(13).alias("round_trip_ok"), chosen(STATUSES, "o_orderkey % 5").alias("audit_status"), flag(7).alias("counts_match"), flag(3).alias("levels_match"), flag(17).alias("origins_match"), flag(19).alias("labels_match"), (o % 2 == 0).alias("excused"))


def _series(t) -> DataFrame:
    return _lines(t).where("l_tax >= 0.07").select("doc", (F.col("l_partkey") % 5 != 0).alias("valid"), (F.col("n") % 2 + 2).alias("n"))


EVALUATED = f"""{COUNTS}, {SPECIAL}, {DIAGNOSTICS}, dn AS (SELECT o_orderkey AS doc, o_orderkey % 11 <> 0 AS marked, o_orderkey % 13 <> 0 AS ok, {chosen_sql(STATUSES, 'o_orderkey % 5')} AS st, o_orderkey % 7 <> 0 AS cm, o_orderkey % 3 <> 0 AS lm, o_orderkey % 17 <> 0 AS om, o_orderkey % 19 <> 0 AS bm, o_orderkey % 2 = 0 AS ex FROM orders),
se AS (SELECT doc, bool_and(valid) AS v, CASE WHEN count(*) FILTER (valid) >= 2 THEN count(DISTINCT CASE WHEN valid THEN n END) = 1 END AS c FROM (SELECT doc, l_partkey % 5 <> 0 AS valid, n % 2 + 2 AS n FROM li WHERE l_tax >= 0.07) GROUP BY 1),
sk AS (SELECT doc, bool_and(baseline = 0 OR tagged >= baseline) AS kept FROM sp GROUP BY 1),
ev AS (SELECT doc, marked AS is_marked, coalesce(element_count, 0) > 0 AS has_structure, coalesce(heading_count, 0) > 0 AS has_heading, coalesce(body_count, 0) > 0 AS has_body, ok AS xml_round_trip, coalesce(unresolved_reference_count, 0) = 0 AS resolved_references, coalesce(unreported_reference_count, 0) = 0 AS resolved_references_reported,
  coalesce(extraction_loss_diagnostic_total, 0) = 0 AS no_known_text_loss, coalesce(forbidden_xml_control_count, 0) = 0 AND coalesce(forbidden_xml_control_field_count, 0) = 0 AS no_forbidden_xml_controls, coalesce(kept, true) AS special_character_counts_preserved, coalesce(v, true) AS numbered_heading_series_valid,
  coalesce(c, true) AS numbered_heading_series_counts_consistent, coalesce(typography_diagnostic_count, 0) = 0 AS numbered_heading_typography_valid, st IS DISTINCT FROM 'blocked_by_invalid_interval' AS multilingual_interval_count_valid,
  {', '.join(f"CASE WHEN coalesce(st, 'not_configured') IN ('not_configured', 'not_applicable', 'blocked_by_invalid_interval') THEN true ELSE {x} END AS {g}" for g, x in zip(quality.MULTILINGUAL_GATES[1:], ('cm OR ex', 'lm', 'om', 'bm')))}
  FROM dn LEFT JOIN cn USING (doc) LEFT JOIN dc USING (doc) LEFT JOIN sk USING (doc) LEFT JOIN se USING (doc))"""


@query(f"WITH {EVALUATED} SELECT *, CASE WHEN {' AND '.join((*quality.GATES, *quality.MULTILINGUAL_GATES))} THEN 'pass' ELSE 'fail' END AS status FROM ev")
def hard_gates(t) -> DataFrame:
    return quality.evaluate(_documents(t), _counts(t), quality.diagnostic_counts(_diagnostics(t), KEYS), _specials(t), _series(t), KEYS)


_gates = ", ".join(f'"{g}" := {g}' for g in sorted((*quality.GATES, *quality.MULTILINGUAL_GATES)))
_metrics = ", ".join(f'"{c}" := {c}' for c in sorted(("element_count", "fragment_count", "heading_count", "body_count", "body_role_node_count", "unknown_role_count", "empty_element_count", "forbidden_xml_control_count", "forbidden_xml_control_field_count")))


@query(f"""WITH {EVALUATED} SELECT doc, CAST(to_json(struct_pack(hard_gates := struct_pack({_gates}), metrics := struct_pack({_metrics}), status := CASE WHEN {' AND '.join((*quality.GATES, *quality.MULTILINGUAL_GATES))} THEN 'pass' ELSE 'fail' END)) AS VARCHAR) AS report FROM ev LEFT JOIN cn USING (doc)""")
def quality_reports(t) -> DataFrame:
    counts = _counts(t)
    return quality.report_json(quality.evaluate(_documents(t), counts, quality.diagnostic_counts(_diagnostics(t), KEYS), _specials(t), _series(t), KEYS, metrics=True), counts, KEYS)


@query(f"""WITH {TREE}, h AS (SELECT *, regexp_extract(lower(source), 'heading([1-6])($|[^0-9])', 1) AS lv, regexp_matches(lower(source), 'heading([1-6]($|[^0-9])|$)') OR regexp_matches(lower(source), '(?:^|[_-])title$') AS cand FROM ht WHERE role = 'heading' OR prom OR regexp_matches(lower(source), 'heading([1-6]($|[^0-9])|$)') OR regexp_matches(lower(source), '(?:^|[_-])title$')),
x AS (SELECT h.doc, h.path, string_agg(fr.text, ' ' ORDER BY fr.path) AS j FROM h JOIN fr ON fr.doc = h.doc AND fr.path[1:len(h.path)] = h.path AND len(fr.path) > len(h.path) WHERE fr.text <> '' GROUP BY 1, 2)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY path) AS INTEGER) AS nth, array_to_string(path, '.') AS path, CASE WHEN role = 'heading' THEN 2 WHEN prom THEN 1 WHEN lv <> '' THEN CAST(lv AS INTEGER) END AS level,
  CASE WHEN role = 'heading' THEN 'heading' WHEN prom THEN 'numbered_chapter_promotion' ELSE 'source_role_candidate' END AS classification, coalesce(j, '') AS joined_text FROM h LEFT JOIN x USING (doc, path)""")
def heading_hierarchy(t) -> DataFrame:
    h = quality.heading_hierarchy(_nodes(t), _fragments(t), _promotions(t), KEYS)
    return h.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))


MAPS = ((), (("Body", "P"),), (("Body", "X"), ("X", "LBody")), (("A", "B"), ("B", "A"), ("Body", "A")), (("Body", "Body"),), (("P", "H2"), ("Body", "Title")))
NAMES = ("Body", "P", "A", "LBody", "Heading2", "Title", "my-title", "HEADING12", "heading", "Subheading4 x", "H3", "TH", "Zz")


def _followed(role: str, pairs) -> str:
    told, seen = dict(pairs), []
    while role in told and role not in seen:
        seen.append(role)
        role = told[role]
    return role


_ends = [[_followed(n, m) for n in NAMES] for m in MAPS]
_maps = [dict(m) for m in MAPS]
_step = "[" + ", ".join("[" + ", ".join(f"'{m.get(n, n)}'" for n in NAMES) + "]" for m in _maps) + "]"
_end = "[" + ", ".join("[" + ", ".join(f"'{e}'" for e in row) + "]" for row in _ends) + "]"


@query(f"""WITH r AS (SELECT p_partkey, {chosen_sql(NAMES, 'p_partkey % 13')} AS role, {_step}[CAST(p_partkey % 6 AS INTEGER) + 1][CAST(p_partkey % 13 AS INTEGER) + 1] AS one, {_end}[CAST(p_partkey % 6 AS INTEGER) + 1][CAST(p_partkey % 13 AS INTEGER) + 1] AS ends FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(one, '^H[1-6]?$') OR one = 'Title' THEN 'heading' ELSE CASE one {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SEMANTIC_ROLES.items())} ELSE 'unknown' END END AS semantic_role, CASE WHEN regexp_matches(one, '^H[1-6]$') THEN CAST(substr(one, 2, 1) AS INTEGER) WHEN one = 'Title' THEN 1 END AS level,
  ends = 'LBody' OR (role <> 'P' AND ends = 'P') AS list_role, TRY_CAST(regexp_extract(lower(role), 'heading([1-6])($|[^0-9])', 1) AS INTEGER) AS candidate_level, regexp_matches(lower(role), 'heading([1-6]($|[^0-9])|$)') OR regexp_matches(lower(role), '(?:^|[_-])title$') AS candidate FROM r""")
def role_maps(t) -> DataFrame:
    made = F.get(F.array(*[F.map_from_arrays(F.array(*[F.lit(k) for k in m]).cast("array<string>"), F.array(*[F.lit(v) for v in m.values()]).cast("array<string>")) for m in _maps]), F.expr("int(p_partkey % 6)"))
    d = t("part").select("p_partkey", chosen(NAMES, "p_partkey % 13").alias("role"), made.alias("m"))
    r, m = F.col("role"), F.col("m")
    d = d.select("p_partkey", T.mapped_role(r, m).alias("x"), T.is_list_role(r, m).alias("list_role"), T.candidate_level(r).alias("candidate_level"), T.is_heading_candidate(r).alias("candidate"))
    return d.select("p_partkey", "x.*", "list_role", "candidate_level", "candidate")
