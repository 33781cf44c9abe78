"""Registered queries of file names and profiles, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.plans.made import chosen, chosen_sql, literal
from foliant.plans.registry import query, quoted
from foliant.sources import profiles as P

NAMES = ("AB12-1_QSG_TV-01_EU_ENG_240101.0.pdf", "AB12-2_QSG_TV-02_ZG XN_ZT_L05_240102.pdf", "short_name.pdf", "AB12-3_QSG_TV_ZC_C-FRA_1.PDF", "a_b_c__e_f.0", "x_y_z_w_v", "_ _ _B_L02_ 7.pdf")
NAME = (NAMES, "p_partkey % 7")


@query(f"""WITH n AS (SELECT p_partkey, p_brand || '/' || {chosen_sql(*NAME)} AS path FROM part), f AS (SELECT p_partkey, regexp_extract(path, '[^/]*$') AS name FROM n),
s AS (SELECT *, string_split(regexp_replace(regexp_replace(name, '\\.pdf$', ''), '\\.0$', ''), '_') AS parts FROM f), k AS (SELECT *, len(parts) AS n FROM s)
SELECT p_partkey, name AS file_name, CASE WHEN n >= 6 THEN trim(parts[1]) END AS code, CASE WHEN n >= 6 THEN trim(parts[2]) END AS kind, CASE WHEN n >= 6 THEN trim(parts[3]) END AS model,
  CASE WHEN n >= 6 THEN trim(array_to_string(parts[4:n - 2], '_')) END AS buyer, CASE WHEN n >= 6 THEN trim(parts[n - 1]) END AS language, CASE WHEN n >= 6 THEN trim(parts[n]) END AS date_code,
  CASE WHEN n >= 6 THEN trim(array_to_string(parts[4:n - 2], '_')) || '_' || trim(parts[n - 1]) END AS source_token,
  CASE WHEN n < 6 THEN 'too_few_parts' WHEN trim(array_to_string(parts[4:n - 2], '_')) = '' OR trim(parts[n - 1]) = '' THEN 'token_missing' END AS error FROM k""")
def file_fields(t) -> DataFrame:
    d = t("part").select("p_partkey", F.concat("p_brand", F.lit("/"), chosen(*NAME)).alias("path"))
    return d.select("p_partkey", T.file_fields(F.col("path")).alias("f")).select("p_partkey", "f.*")


STRICT = ("BN68-01234A-00_SUG_TV X ALL_ZG XN ZT_L05_240101.0.pdf", "bn68-99999z-12_sug_a ALL_ZA_ENG_000000.12.PDF", "BN68-01234A-00_SUG_TV ALL_ ZA_240101.0.pdf", "BN68-0123A-00_SUG_TV ALL_ZA_240101.0.pdf", "BN68-01234A-00_SUG_TV ALL_ZA_24010.0.pdf")


@query(rf"""WITH n AS (SELECT p_partkey, {chosen_sql(STRICT, 'p_partkey % 5')} AS name FROM part), x AS (SELECT *, regexp_extract(name, '{P.STRICT_NAME}', 1) AS token FROM n)
SELECT p_partkey, CASE WHEN token <> '' AND token = trim(token) THEN token END AS token FROM x""")
def strict_tokens(t) -> DataFrame:
    return t("part").select("p_partkey", P.strict_token(chosen(STRICT, "p_partkey % 5")).alias("token"))


#: Profile rows of customers: tokens, lists, types and counts by key, right and wrong in all ways.
TOKENS = ("ZA_L02", "ZB XN_ENG", " ZC_ENG", "ZD_LXX", "ZE_MENA", "zf_L02", "ZG_C-FRA", "ZH_L00", "ZI_L03", "ZK_MENA", "")
LISTS = ("ENG;FRA", "ENG", "ENG;eng", "ENG;;FRA", "C-FRA", "ENG;ESP;DEU", "english", " ENG ; FRA ", "")
TYPES, COUNTS = ("A2", "A3", "BOOK", "A9"), (1, 2, 3, 0, -1)
PICKED = {"source_token": (TOKENS, "c_custkey % 11"), "languages": (LISTS, "c_custkey % 9"), "doc_type": (TYPES, "c_custkey % 4"), "language_count": (COUNTS, "c_custkey % 5")}


def _listed(t) -> DataFrame:
    c = t("customer").select("c_custkey", *[chosen(*v).alias(k) for k, v in PICKED.items()])
    token = F.when(F.col("c_custkey") % 3 == 0, F.col("source_token")).otherwise(F.concat(F.lit("Q"), F.col("c_custkey").cast("string"), F.col("source_token")))
    return c.withColumn("source_token", token).withColumn("languages", P.items(F.col("languages")))


LISTED = f"""l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN {chosen_sql(*PICKED['source_token'])} ELSE 'Q' || c_custkey || {chosen_sql(*PICKED['source_token'])} END AS source_token,
  list_filter(list_transform(string_split({chosen_sql(*PICKED['languages'])}, ';'), lambda x: trim(x)), lambda x: x <> '') AS languages, {chosen_sql(*PICKED['doc_type'])} AS doc_type, {chosen_sql(*PICKED['language_count'])} AS language_count FROM customer)"""


@query(f"""WITH {LISTED}, r AS (SELECT c_custkey, list_filter([CASE WHEN trim(source_token) = '' THEN 'token_missing' END, CASE WHEN trim(source_token) <> source_token THEN 'token_untrimmed' END,
  CASE WHEN count(*) OVER (PARTITION BY lower(source_token)) > 1 THEN 'token_repeated' END, CASE WHEN len(languages) < 1 THEN 'languages_missing' END,
  CASE WHEN len(list_distinct(list_transform(languages, lambda x: lower(x)))) < len(languages) THEN 'languages_repeated' END, CASE WHEN len(list_filter(languages, lambda x: NOT regexp_matches(x, '{P.LANGUAGE}'))) > 0 THEN 'language_shape' END,
  CASE WHEN language_count <> len(languages) THEN 'count_differs' END, CASE WHEN doc_type NOT IN ({quoted(P.DOCUMENT_TYPES)}) THEN 'type_unknown' END], lambda x: x IS NOT NULL) AS e FROM l)
SELECT c_custkey, array_to_string(e, ',') AS errors FROM r""")
def profile_errors(t) -> DataFrame:
    return P.errors(_listed(t)).select("c_custkey", F.array_join("errors", ",").alias("errors"))


JSON_ROWS = (
    '{"source_token": "%s", "languages": "ENG;FRA", "doc_type": "BOOK", "language_count": 2}', '{"source_token": "%s", "languages": "ENG", "doc_type": "A2", "language_count": 1, "region": "EU"}',
    '{"source_token": "%s", "languages": "ENG", "doc_type": "A2"}', '{"source_token": "%s", "languages": "ENG;ENG", "doc_type": "A4", "language_count": "2", "colour": 1}',
    '["%s"]', '{"source_token": "%s", "languages": " ENG", "doc_type": "A3", "language_count": true, "region": 5}', '{"source_token": "%s", "languages": "ENG;;FRA", "doc_type": "A3", "language_count": 3}',
    '{"source_token": "%s", "languages": "FRA;ENG", "doc_type": "BOOK", "language_count": 2, "buyer_codes": ""}',
)
ROW_TOKENS = ("ZA%_L02", "Z%_ENG", "Z%_MENA", "z_%", "Z %_L02", "ZZ_L02", "zz_L02", "Z%_MENA", "Z%_LXX", "Z%_FRA", "Z%_L01")


def _json_rows(t) -> DataFrame:
    token = F.replace(chosen(ROW_TOKENS, "c_custkey % 11"), F.lit("%"), F.col("c_custkey").cast("string"))
    return t("customer").select(F.col("c_custkey").alias("row_index"), F.replace(chosen(JSON_ROWS, "c_custkey % 8"), F.lit("%s"), token).alias("row"))


_part = "regexp_extract(tok, '[^_]*$')"
_class = rf"CASE WHEN {_part} IN ('LXX', 'L00') THEN 'invalid' WHEN regexp_matches({_part}, '^L\d{{2}}$') THEN 'numbered' WHEN regexp_matches({_part}, '{P.LANGUAGE}') THEN 'single' WHEN regexp_matches({_part}, '^[A-Z]{{4,}}$') THEN 'named' ELSE 'invalid' END"
_bad = lambda c: f"coalesce(CASE WHEN json_type(row, '$.{c}') = 'VARCHAR' THEN json_extract_string(row, '$.{c}') = '' OR regexp_matches(json_extract_string(row, '$.{c}'), '^\\s|\\s$') END, true)"
_has = lambda c: f"list_contains(k, '{c}')"
_rules = [
    ("not_an_object", "NOT obj"), ("field_missing", " OR ".join(f"NOT {_has(c)}" for c in P.REQUIRED)), ("field_unexpected", f"len(list_filter(k, lambda x: x NOT IN ({quoted(P.ALLOWED)}))) > 0"),
    ("region_not_text", f"{_has('region')} AND {_bad('region')}"), ("buyer_codes_not_text", f"{_has('buyer_codes')} AND {_bad('buyer_codes')}"), ("token_not_text", f"{_has('source_token')} AND {_bad('source_token')}"),
    ("token_shape", f"NOT regexp_matches(tok, '{P.TOKEN}') OR cls = 'invalid'"), ("languages_not_text", f"{_has('languages')} AND {_bad('languages')}"), ("type_not_text", f"{_has('doc_type')} AND {_bad('doc_type')}"),
    ("count_not_a_number", f"{_has('language_count')} AND n IS NULL"), ("count_not_positive", "n <= 0"), ("language_empty", "list_contains(langs, '')"),
    ("language_shape", f"len(list_filter(langs, lambda x: x <> '' AND NOT regexp_matches(x, '{P.LANGUAGE}'))) > 0"), ("language_repeated", "len(list_distinct(list_transform(langs, lambda x: lower(x)))) < len(langs)"),
    ("count_differs", "n <> len(langs)"), ("type_unknown", f"ty NOT IN ({quoted(P.DOCUMENT_TYPES)})"),
    ("token_contradicts", f"CASE cls WHEN 'numbered' THEN CAST(substr({_part}, 2, 2) AS INTEGER) <> len(langs) WHEN 'named' THEN len(langs) < 2 WHEN 'single' THEN langs <> [{_part}] ELSE false END"),
    ("token_repeated", "tok IS NOT NULL AND nth > 1"), ("combination_differs", "cls = 'named' AND first_langs <> langs"),
]


@query(rf"""WITH j AS (SELECT c_custkey AS row_index, CAST(replace({chosen_sql(JSON_ROWS, 'c_custkey % 8')}, '%s', replace({chosen_sql(ROW_TOKENS, 'c_custkey % 11')}, '%', CAST(c_custkey AS VARCHAR))) AS JSON) AS row FROM customer),
a AS (SELECT *, json_type(row) = 'OBJECT' AS obj, CASE WHEN json_type(row) = 'OBJECT' THEN json_keys(row) ELSE [] END AS k, CASE WHEN json_type(row, '$.source_token') = 'VARCHAR' THEN json_extract_string(row, '$.source_token') END AS tok,
  string_split(CASE WHEN json_type(row, '$.languages') = 'VARCHAR' THEN json_extract_string(row, '$.languages') END, ';') AS langs, CASE WHEN json_type(row, '$.doc_type') = 'VARCHAR' THEN json_extract_string(row, '$.doc_type') END AS ty,
  CASE WHEN json_type(row, '$.language_count') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(row, '$.language_count') AS BIGINT) END AS n FROM j),
b AS (SELECT *, {_class} AS cls FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY lower(tok) ORDER BY row_index) AS nth, first_value(langs) OVER (PARTITION BY CASE WHEN cls = 'named' THEN {_part} END ORDER BY row_index) AS first_langs FROM b),
e AS (SELECT row_index, tok, list_filter([{', '.join(f"CASE WHEN coalesce({rule}, false) THEN '{name}' END" for name, rule in _rules)}], lambda x: x IS NOT NULL) AS e FROM c)
SELECT row_index, tok AS source_token, array_to_string(e, ',') AS errors, len(e) = 0 AS accepted FROM e""")
def strict_profiles(t) -> DataFrame:
    return P.strict_errors(_json_rows(t)).select("row_index", "source_token", F.array_join("errors", ",").alias("errors"), "accepted")


@query(f"""WITH r AS (SELECT {chosen_sql(TOKENS, 'c_custkey % 11')} AS source_token, c_custkey, c_name FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY source_token ORDER BY c_custkey DESC) AS i FROM r)
SELECT source_token, c_custkey, c_name FROM n WHERE i = 1""")
def profiles_last_wins(t) -> DataFrame:
    rows = t("customer").select(chosen(TOKENS, "c_custkey % 11").alias("source_token"), "c_custkey", "c_name")
    return P.last_of_each(rows, "source_token", "c_custkey")


LANGUAGE_TOKENS = ("L05", "LXX", "ENG", "C-FRA", "MENA", "L00", "x", "L5", "ENGL1", "EN")


@query(rf"""WITH x AS (SELECT c_custkey, 'Z_' || {chosen_sql(LANGUAGE_TOKENS, 'c_custkey % 10')} AS tok, string_split({chosen_sql(LISTS[:6], 'c_custkey % 6')}, ';') AS langs FROM customer), y AS (SELECT *, {_class} AS cls FROM x)
SELECT c_custkey, cls AS token_class, CASE cls WHEN 'numbered' THEN CAST(substr({_part}, 2, 2) AS INTEGER) <> len(langs) WHEN 'named' THEN len(langs) < 2 WHEN 'single' THEN langs <> [{_part}] ELSE false END AS contradicts FROM y""")
def language_tokens(t) -> DataFrame:
    token = F.concat(F.lit("Z_"), chosen(LANGUAGE_TOKENS, "c_custkey % 10"))
    langs = F.split(chosen(LISTS[:6], "c_custkey % 6"), ";")
    return t("customer").select("c_custkey", P.language_token(P.token_part(token)).alias("token_class"), P.inconsistent(token, langs).alias("contradicts"))


def _files(t) -> DataFrame:
    key = F.col("o_custkey").cast("string")
    return t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("zq_"), key)).otherwise(F.concat(F.lit("ZQ_"), key)).alias("source_token"))


def _known(t) -> DataFrame:
    return t("customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("ZQ_"), F.col("c_custkey").cast("string")).alias("source_token"), "c_name")


_files_sql = "f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'zq_' ELSE 'ZQ_' END || o_custkey AS source_token FROM orders), p AS (SELECT 'ZQ_' || c_custkey AS source_token, c_name FROM customer WHERE c_custkey % 5 <> 0)"


@query(f"WITH {_files_sql} SELECT o_orderkey, f.source_token, c_name, p.source_token IS NOT NULL AS found FROM f LEFT JOIN p ON f.source_token = p.source_token")
def profile_lookup(t) -> DataFrame:
    return P.lookup(_files(t), _known(t), fold=False)


@query(f"WITH {_files_sql} SELECT o_orderkey, f.source_token, c_name, p.source_token IS NOT NULL AS found FROM f LEFT JOIN p ON lower(f.source_token) = lower(p.source_token)")
def profile_lookup_folded(t) -> DataFrame:
    return P.lookup(_files(t), _known(t))


@query(f"WITH {_files_sql} SELECT o_orderkey, source_token FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source_token = f.source_token)")
def profile_lookup_miss(t) -> DataFrame:
    return P.misses(_files(t), _known(t), fold=False)


@query("""WITH o AS (SELECT s_suppkey AS k, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0), r AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 3 = 0)
SELECT k, name, false AS conflict FROM r UNION ALL SELECT k, name, k IN (SELECT k FROM r) FROM o""")
def profile_overlay(t) -> DataFrame:
    rows = t("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return P.overlaid(rows, t("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), "k")


KINDS_OF_EVENTS = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH p AS (SELECT user_id, list_distinct(list(event_type)) AS present FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_filter([{', '.join(map(literal, KINDS_OF_EVENTS))}], lambda x: NOT list_contains(present, x))), ',') AS missing FROM p""")
def required_except_present(t) -> DataFrame:
    present = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("present"))
    return present.select("user_id", F.array_join(P.missing_of(F.array(*map(F.lit, KINDS_OF_EVENTS)), F.col("present")), ",").alias("missing"))
