"""Registered queries of cover pages over made spans, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import cover
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.registry import collapse_sql, query, quoted
from foliant.sources.places import dealt

RULES = cover.Rules("Acme", ("Acme Electronics", "Long Road", "Springfield"), ("Canada",))
TEXTS = (
    "ENG", "User  Manual", "Model Serial No.", "If you have any questions, please call us", "Figures and illustrations are", "provided for reference", "Figures and illustrations differ", "Product design and specifications may change",
    "Contact Acme world wide", "Acme Service Center", "Website", "1-800-ACME", "call 1-800-ACME 555-1234", "www.acme.example", "www.acme.example/ca (English)", "Address", "12 Long Road", "Canada", "plain body", "more body",
    "If you have questions or comments", "questions or comments to us", "© All rights reserved.", "BN68-01234A-00", "-00", "Springfield, Ontario",
)
TEXT = (TEXTS, f"l_partkey % {len(TEXTS)}")


def _spans(t) -> DataFrame:
    """Spans of cover pages: an order a page, two cells."""
    c = F.col
    y = c("l_discount") * 100 + c("l_linenumber")
    table = t("lineitem")
    li = dealt(table.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"), "l_orderkey", table=table)
    return li.select(
        c("l_orderkey").alias("page"), (c("l_linenumber") % 2).alias("cell_order"), (c("l_suppkey") * 10 + c("l_linenumber")).alias("ord"), chosen(*TEXT).alias("text"), (8 + c("l_suppkey") % 15).cast("double").alias("size"),
        (c("l_tax") > 0.04).alias("bold"), (c("l_returnflag") == "A").alias("italic"), F.lit(False).alias("underline"), c("l_quantity").alias("x0"), y.alias("y0"), (c("l_quantity") + 30).alias("x1"), (y + 9).alias("y1"),
    )


def _cells(t) -> DataFrame:
    s = _spans(t)
    return s.groupBy("page", "cell_order").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


_x = collapse_sql("text")
REGIONS = f"""sp AS (SELECT l_orderkey AS page, l_linenumber % 2 AS cell_order, l_suppkey * 10 + l_linenumber AS ord, {chosen_sql(*TEXT)} AS text, CAST(8 + l_suppkey % 15 AS DOUBLE) AS size, l_tax > 0.04 AS bold, l_returnflag = 'A' AS italic, false AS underline,
  l_quantity AS x0, l_discount * 100 + l_linenumber AS y0, l_quantity + 30 AS x1, l_discount * 100 + l_linenumber + 9 AS y1 FROM lineitem),
ty AS (SELECT *, {_x} AS x FROM sp),
tt AS (SELECT *, CASE WHEN x IN ({quoted(cover.LANGUAGE_LABELS)}) THEN 'language_label' WHEN contains(x, 'All rights reserved') THEN 'copyright' WHEN x = '-00' OR regexp_matches(x, '{cover.DOCUMENT_CODE}') THEN 'document_code' WHEN size >= 20 THEN 'title'
  WHEN contains(x, 'Contact Acme') THEN 'contact_heading' WHEN x IN ('Acme Service Center', 'Website', 'Address') THEN 'table_heading' WHEN starts_with(x, 'www.') THEN 'website' WHEN contains(x, 'If you have any questions, please call') THEN 'support_note'
  WHEN contains(x, '1-800') THEN 'contact_value' WHEN contains(x, 'Model') AND contains(x, 'Serial') THEN 'model_serial_fields' WHEN contains(x, 'Figures and illustrations') THEN 'disclaimer' WHEN contains(x, 'Product design and specifications may change') THEN 'product_note'
  WHEN contains(x, 'questions or comments') THEN 'contact_note' ELSE 'body' END AS ty FROM ty),
ru AS (SELECT *, CASE WHEN ty IN ({quoted(cover.MERGED)}) AND lag(ty) OVER w = ty THEN 0 ELSE 1 END AS new, row_number() OVER w AS pos FROM tt WINDOW w AS (PARTITION BY page, cell_order ORDER BY y0, x0, ord)),
gr AS (SELECT *, sum(new) OVER (PARTITION BY page, cell_order ORDER BY pos) AS run FROM ru),
rg AS (SELECT page, cell_order, run, ty, {collapse_sql("string_agg(text, ' ' ORDER BY pos)")} AS text, count(*) AS n_spans, max(size) AS size, bool_or(bold) AS bold, bool_or(italic) AS italic, bool_or(underline) AS underline, round(min(x0), 2) AS x0, round(min(y0), 2) AS y0, round(max(x1), 2) AS x1, round(max(y1), 2) AS y1 FROM gr GROUP BY 1, 2, 3, 4),
sq AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY cell_order, run) AS seq FROM rg),
dp AS (SELECT page, min(seq) FILTER (ty = 'disclaimer') AS d, min(seq) FILTER (ty = 'product_note') AS p FROM sq GROUP BY 1),
dd AS (SELECT a.page, a.cell_order, a.seq, a.ty, CASE WHEN n.page IS NULL THEN a.text ELSE a.text || ' ' || n.text END AS text, a.n_spans, a.size, a.bold, a.italic, a.underline, least(a.x0, coalesce(n.x0, a.x0)) AS x0, least(a.y0, coalesce(n.y0, a.y0)) AS y0, greatest(a.x1, coalesce(n.x1, a.x1)) AS x1, greatest(a.y1, coalesce(n.y1, a.y1)) AS y1
  FROM sq a JOIN dp USING (page) LEFT JOIN sq n ON n.page = a.page AND a.seq = d AND n.seq = p WHERE NOT (d IS NOT NULL AND p IS NOT NULL AND a.seq = p)),
ct AS (SELECT *, ty IN ('table_heading', 'contact_value', 'website') OR (ty = 'body' AND (contains(text, 'Acme Electronics') OR contains(text, 'Long Road') OR contains(text, 'Springfield') OR text = 'Canada')) AS contact FROM dd),
ws AS (SELECT page, string_agg(site, chr(10) ORDER BY at_) AS websites FROM (SELECT page, site, min(seq * 1000 + i) AS at_ FROM (SELECT page, seq, unnest(parts) AS site, unnest(range(len(parts))) AS i FROM
  (SELECT page, seq, list_transform(list_filter(list_transform(string_split(text, 'www.'), lambda y: trim(y)), lambda y: y <> ''), lambda y: 'www.' || y) AS parts FROM ct WHERE ty = 'website' AND contact)) GROUP BY 1, 2) GROUP BY 1),
tb AS (SELECT page, arg_min(cell_order, seq) AS cell_order, max(seq) + 1000000 AS seq, coalesce(arg_max(text, seq) FILTER (ty = 'contact_value'), '') AS service_center, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (ty = 'body'), '') AS adr,
  coalesce(bool_or(ty = 'table_heading' AND text = 'Address'), false) OR count(*) FILTER (ty = 'body') > 0 AS has_address, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ct WHERE contact GROUP BY 1),
tv AS (SELECT tb.*, coalesce(websites, '') AS websites, CASE WHEN has_address THEN adr END AS address FROM tb LEFT JOIN ws USING (page) WHERE service_center <> '' OR coalesce(websites, '') <> '' OR (has_address AND adr <> '')),
al AS (SELECT page, cell_order, seq, ty, text, n_spans, size, bold, italic, underline, x0, y0, x1, y1, NULL AS service_center, NULL AS websites, NULL AS address FROM ct WHERE NOT (contact AND page IN (SELECT page FROM tv))
  UNION ALL SELECT page, cell_order, seq, 'contact_table', {collapse_sql("concat_ws(' ', CASE WHEN service_center <> '' THEN 'Acme Service Center: ' || service_center END, CASE WHEN websites <> '' THEN 'Website: ' || websites END, CASE WHEN address <> '' THEN 'Address: ' || address END)")}, NULL, NULL, NULL, NULL, NULL, x0, y0, x1, y1, service_center, websites, address FROM tv),
rr AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY ty IN ('copyright', 'document_code'), CASE WHEN ty NOT IN ('copyright', 'document_code') THEN y0 END, x0, seq) AS INTEGER) AS region_order,
  CASE WHEN ty IN ('title', 'contact_heading', 'table_heading') THEN text WHEN ty = 'language_label' THEN 'Language' WHEN ty = 'model_serial_fields' THEN 'Model / Serial' WHEN ty = 'support_note' THEN 'Support Note' WHEN ty = 'website' THEN 'Website' WHEN ty = 'contact_value' THEN 'Acme Service Center' WHEN ty = 'contact_table' THEN 'Contact table' END AS heading,
  CASE WHEN ty = 'title' THEN '# ' || text WHEN ty IN ('contact_heading', 'table_heading') THEN '## ' || text WHEN ty = 'language_label' THEN '**Language:** ' || text WHEN ty = 'document_code' THEN '**Document code:** ' || text
    WHEN ty = 'model_serial_fields' THEN '| Field | Value |' || chr(10) || '|---|---|' || chr(10) || '| Model |  |' || chr(10) || '| Serial No. |  |' WHEN ty = 'contact_value' THEN '| Service Center | ' || text || ' |'
    WHEN ty = 'website' THEN '| Type | Value |' || chr(10) || '|---|---|' || chr(10) || array_to_string(list_transform(list_filter(list_transform(string_split(text, 'www.'), lambda y: trim(y)), lambda y: y <> ''), lambda y: '| Website | www.' || y || ' |'), chr(10))
    WHEN ty = 'contact_table' THEN '| Acme Service Center | Website' || CASE WHEN address IS NULL THEN '' ELSE ' | Address' END || ' |' || chr(10) || '| --- | ---' || CASE WHEN address IS NULL THEN '' ELSE ' | ---' END || ' |' || chr(10) || '| ' || service_center || ' | ' || replace(websites, chr(10), '<br>') || CASE WHEN address IS NULL THEN '' ELSE ' | ' || replace(address, chr(10), '<br>') END || ' |'
    ELSE text END AS markdown FROM al)"""


@query(f"WITH {REGIONS} SELECT page, region_order, ty AS region_type, heading, text, round(x0, 2) AS x0, round(y0, 2) AS y0, round(x1, 2) AS x1, round(y1, 2) AS y1, cell_order, n_spans, size, bold, italic, underline, markdown, service_center, websites, address FROM rr")
def cover_regions(t) -> DataFrame:
    return cover.regions(_spans(t), RULES)


@query(f"WITH {REGIONS} SELECT page, string_agg(markdown, chr(10) || chr(10) ORDER BY region_order) AS markdown FROM rr WHERE markdown <> '' GROUP BY 1")
def cover_markdown(t) -> DataFrame:
    return cover.cover_markdown(cover.regions(_spans(t), RULES))


@query(rf"""WITH {REGIONS}, l AS (SELECT page, region_order, service_center, list_filter(list_transform(string_split(websites, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS sites, list_filter(list_transform(string_split(coalesce(address, ''), chr(10)), lambda y: trim(y)), lambda y: y <> '') AS lines FROM rr WHERE ty = 'contact_table'),
f AS (SELECT page, region_order, 'service_center' AS field_name, service_center AS field_value, '' AS label FROM l WHERE service_center <> ''
  UNION SELECT page, region_order, 'service_phone_numbers', unnest(regexp_extract_all(service_center, '{T.PHONE}')), '' FROM l
  UNION SELECT page, region_order, 'websites', CASE WHEN regexp_matches(s, '{T.WEBSITE}') THEN regexp_extract(s, '{T.WEBSITE}', 1) ELSE s END, CASE WHEN regexp_matches(s, '{T.WEBSITE}') THEN regexp_extract(s, '{T.WEBSITE}', 2) ELSE '' END FROM (SELECT page, region_order, unnest(sites) AS s FROM l)
  UNION SELECT page, region_order, 'address', unnest(lines), '' FROM l)
SELECT * FROM f""")
def contact_fields(t) -> DataFrame:
    return cover.contact_fields(cover.regions(_spans(t), RULES)).drop("nth")


@query(f"""WITH {REGIONS}, c AS (SELECT page, string_agg(ct, ' ' ORDER BY cell_order) AS x FROM (SELECT page, cell_order, string_agg(text, chr(10) ORDER BY ord) AS ct FROM sp GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT page, contains(x, '1-800-ACME') AND (contains(x, 'Contact Acme world wide') OR contains(x, 'Acme Service Center') OR contains(x, 'Comment contacter Acme')) AS own FROM c), p AS (SELECT page, list(ty) AS present FROM rr GROUP BY 1),
m AS (SELECT page, own, list_sort(list_filter(CASE WHEN own THEN [{quoted(cover.REQUIRED)}] ELSE [] END, lambda y: NOT list_contains(present, y))) AS missing FROM s JOIN p USING (page))
SELECT page, CASE WHEN own THEN 'contact_cover' ELSE 'generic_cover' END AS schema_id, CASE WHEN len(missing) = 0 THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS status, array_to_string(missing, ';') AS missing FROM m""")
def cover_schemas(t) -> DataFrame:
    checked = cover.schema_checks(_cells(t), cover.regions(_spans(t), RULES), RULES)
    return checked.withColumn("missing", F.array_join("missing", ";"))


@query(rf"""WITH {REGIONS}, r AS (SELECT *, ty IN ({quoted(cover.MANUAL)}) AS manual, coalesce(nullif(heading, ''), nullif(text, ''), ty) AS label FROM rr),
s AS (SELECT *, trim(substr(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40), '_') AS slug FROM r)
SELECT page, region_order, ty AS region_type, manual AS manual_review_required, 'region_' || lpad(CAST(region_order AS VARCHAR), 2, '0') || '_' || ty || '_' || CASE WHEN slug = '' THEN 'region' ELSE slug END AS slug,
  round(greatest(x0 - 3, 0), 2) AS clip_x0, round(greatest(y0 - 3, 0), 2) AS clip_y0, round(least(x1 + 3, 60), 2) AS clip_x1, round(least(y1 + 3, 20), 2) AS clip_y1 FROM s""")
def cover_review(t) -> DataFrame:
    rows = cover.clipped(cover.reviewed(cover.regions(_spans(t), RULES)), F.lit(60.0), F.lit(20.0))
    return rows.select("page", "region_order", "region_type", "manual_review_required", "slug", *[F.round(c, 2).alias(c) for c in ("clip_x0", "clip_y0", "clip_x1", "clip_y1")])


@query(f"WITH {REGIONS} SELECT page, count(*) AS region_count, count(*) FILTER (ty IN ({quoted(cover.MANUAL)})) AS manual_review_region_count, count(*) FILTER (ty = 'contact_table') AS table_region_count FROM rr GROUP BY 1")
def cover_summaries(t) -> DataFrame:
    return cover.cover_summary(cover.reviewed(cover.regions(_spans(t), RULES)))
