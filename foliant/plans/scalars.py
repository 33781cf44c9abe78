"""Registered queries of the functions on one string, each with the SQL that gives the same rows.

The driver's texts hold none of the wordings that these functions look for, so each part chooses a phrase from a list by its
key, and a second one by another remainder; the lists cover every branch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import review as R
from foliant.functions import text as T
from foliant.operators import checks, grid
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.registry import KINDS, LINES, collapse_sql, query, quoted
from foliant.sources import sinks

LINE_TEXTS = (
    "Getting Started", "01 Connect the TV", "• one", "•", "- Dash Title", "2) two", "> Menu", "All Settings >", "Update Now", "power button", "one two three four five button", "* note", "*: a note", "*Wireless One Connect Box (2)",
    "x 2", "X  12", "CAUTION: hot", "KEEP THIS AWAY FROM WATER AND FIRE", "KEEP AWAY", "this is plain running text.", "Yes", "on", "or", "3D 4K", "4K viewing of it", "Do Not Touch", "Do Not Touch!", "Website", "-00", ", and so on", "Really?",
    "is it really so now?", "www.example.org", "me@example.org", "The Quick Brown Fox Jumps Over The Lazy Dog Again", "A Title of the Thing", "(The Frame only)", "\"Quoted Title\"", "", "User Manual", "Settings", "/", "button /", "see (", "ends with \"",
    "Ärger Über Öl", "ſtrange Letters", "1. First", "10 x 20",
)
LINE, BEFORE = (LINE_TEXTS, f"p_partkey % {len(LINE_TEXTS)}"), (LINE_TEXTS, f"(p_partkey * 7 + 3) % {len(LINE_TEXTS)}")
_made_lines = f"lines AS (SELECT p_partkey AS doc_id, 0 AS ord, {collapse_sql(chosen_sql(*LINE))} AS line FROM part)"
MADE_KINDS = KINDS.replace(LINES, _made_lines)
assert MADE_KINDS != KINDS


def part(t, **columns: Column) -> DataFrame:
    return t("part").select("p_partkey", *[c.alias(n) for n, c in columns.items()])


@query(f"WITH {MADE_KINDS} SELECT doc_id AS p_partkey, line, kind FROM kinds")
def phrase_kinds(t) -> DataFrame:
    d = part(t, line=T.collapsed(chosen(*LINE)))
    return d.select("p_partkey", "line", T.line_kind(F.col("line")).alias("kind"))


@query(f"""WITH {MADE_KINDS}, b AS (SELECT p_partkey, {collapse_sql(chosen_sql(*BEFORE))} AS before FROM part)
SELECT p_partkey, kind IN ('body', 'blank') AS continues, heads AND length(before) + length(line) <= 80 AS heading_continues,
  CASE WHEN starts_with(before, '*:') THEN kind IN ('body', 'blank') ELSE starts_with(before, '*Wireless One Connect Box') AND starts_with(line, '*:') END AS list_continues
FROM kinds JOIN b ON doc_id = p_partkey""")
def line_continuations(t) -> DataFrame:
    d = part(t, x=T.collapsed(chosen(*LINE)), b=T.collapsed(chosen(*BEFORE)))
    x, b = F.col("x"), F.col("b")
    return d.select("p_partkey", T.continues_run(x).alias("continues"), T.heading_continues(b, x).alias("heading_continues"), T.list_continues(b, x).alias("list_continues"))


@query(f"""WITH l AS (SELECT p_partkey, {collapse_sql(chosen_sql(*LINE))} AS x FROM part)
SELECT p_partkey, x <> '' AND (x IN ('or', '/', 'button /', ')', '(') OR regexp_matches(x, '^[.,:;/)]') OR regexp_matches(x, '[(/"]$') OR (len(string_split(x, ' ')) <= 3 AND NOT regexp_matches(x, '[.!?]$'))) AS fragment,
  CASE WHEN x = '' OR regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END AS ended FROM l""")
def fragment_texts(t) -> DataFrame:
    d = part(t, x=T.collapsed(chosen(*LINE)))
    return d.select("p_partkey", T.is_fragment(F.col("x")).alias("fragment"), T.ended(F.col("x")).alias("ended"))


SAFETY = (
    "This symbol indicates that high voltage is present inside. Do not open. This symbol indicates that this product has included literature. Class II product: no earth. AC voltage: alternating. DC voltage: direct. Caution. Consult instructions for use: see the manual. It helps.",
    "CAUTION RISK OF ELECTRIC SHOCK. DO NOT OPEN. See Fig. 2", "AC voltage: one. DC voltage: two. Class II product: three", "CAUTION: a lone one", "nothing to see", "DC voltage: Caution. Consult instructions for use:", "",
)
_seg = lambda x, a, b: (
    f"CASE WHEN instr({x}, '{a}') = 0 THEN '' ELSE " + collapse_sql(f"(CASE WHEN {'true' if b is None else f'''instr(substr({x}, instr({x}, '{a}') + {len(a)}), '{b}') = 0'''} THEN substr({x}, instr({x}, '{a}')) ELSE substr({x}, instr({x}, '{a}'), {len(a)} + instr(substr({x}, instr({x}, '{a}') + {len(a)}), '{b}') - 1) END)") + " END"
)
_english = lambda x: (
    f"list_filter(list_transform(string_split(regexp_replace(replace(replace({x}, 'Fig.', 'Fig__'), 'No.', 'No__'), '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda y: trim(replace(replace(y, 'Fig__', 'Fig.'), 'No__', 'No.'))), lambda y: y <> '')"
)


@query(
    f"WITH s AS (SELECT p_partkey, {chosen_sql(SAFETY, 'p_partkey % 7')} AS x FROM part), "
    + "r AS ("
    + " UNION ALL ".join(f"SELECT p_partkey, {i} AS row_order, '{k}' AS symbol_key, '{a.rstrip(':')}' AS label, {_english(_seg('x', a, b))} AS lines FROM s WHERE contains(x, '{a}')" for i, (k, a, b) in enumerate(R.SAFETY_ROWS, 1))
    + """), c AS (SELECT p_partkey, 0 AS row_order, 'caution_warning' AS symbol_key, 'CAUTION' AS label,
  list_concat(CASE WHEN starts_with(x, 'CAUTION ') THEN ['CAUTION'] ELSE [] END, list_transform(list_filter(list_transform(string_split(CASE WHEN starts_with(x, 'CAUTION ') THEN substr(x, 9) ELSE x END, '.'), lambda y: trim(y)), lambda y: y <> ''), lambda y: y || '.')) AS lines
  FROM s WHERE contains(x, 'CAUTION') AND p_partkey NOT IN (SELECT p_partkey FROM r))
SELECT p_partkey, row_order, symbol_key, label, array_to_string(lines, chr(10)) AS lines FROM (SELECT * FROM r UNION ALL SELECT * FROM c)"""
)
def safety_rows(t) -> DataFrame:
    d = part(t, r=F.explode(R.block_rows(chosen(SAFETY, "p_partkey % 7"))))
    return d.select("p_partkey", "r.row_order", "r.symbol_key", "r.label", F.array_join("r.lines", "\n").alias("lines"))


@query(f"SELECT p_partkey, {' + '.join(f'CAST(contains(x, {chr(39)}{m}{chr(39)}) AS INTEGER)' for m in T.SAFETY_MARKERS)} >= 3 AS safety_table FROM (SELECT p_partkey, {chosen_sql(SAFETY, 'p_partkey % 7')} AS x FROM part)")
def safety_tables(t) -> DataFrame:
    return part(t, safety_table=T.is_safety_table(chosen(SAFETY, "p_partkey % 7")))


SEGMENTS = ("a [b] c [d]", "a [b", "a", "]x[y]", "[ two  words ]", "[]", "")


@query(f"SELECT p_partkey, {_seg('x', '[', ']')} AS upto, {_seg('x', '[', None)} AS rest FROM (SELECT p_partkey, {chosen_sql(SEGMENTS, 'p_partkey % 7')} AS x FROM part)")
def text_segments(t) -> DataFrame:
    x = chosen(SEGMENTS, "p_partkey % 7")
    return part(t, upto=T.segment(x, "[", "]"), rest=T.segment(x, "[", None))


STEP_TEXTS = ("zero One a. Two b. Three c", "One Two Three", "Two One Three", "One x One y Two Three z", "none at all", "Three Two", "OneTwoThree")
STEPS = ("One", "Two", "Three")


@query(f"""WITH s AS (SELECT p_partkey, {chosen_sql(STEP_TEXTS, 'p_partkey % 7')} AS x FROM part), p AS (SELECT *, instr(x, 'One') AS a, instr(x, 'Two') AS b, instr(x, 'Three') AS c FROM s)
SELECT p_partkey, array_to_string(CASE WHEN regexp_matches(x, 'One|Two|Three') THEN list_filter(list_transform(string_split(regexp_replace(x, '(One|Two|Three)', chr(1) || '\\1', 'g'), chr(1))[2:], lambda y: trim(y)), lambda y: y <> '') ELSE [x] END, '|') AS pieces,
  CASE WHEN a > 0 AND a <= b AND b <= c THEN trim(substr(x, a, b - a)) || '|' || trim(substr(x, b, c - b)) || '|' || trim(substr(x, c)) ELSE '' END AS steps FROM p""")
def texts_at_starts(t) -> DataFrame:
    x = chosen(STEP_TEXTS, "p_partkey % 7")
    return part(t, pieces=F.array_join(T.pieces_from(x, STEPS), "|"), steps=F.array_join(T.steps(x, STEPS), "|"))


CONDITIONS = (
    "(QX12 only) Hold it.", "(QX12 only)", "(see (a) below) text", "(except for The Frame) Use (it).", "(a (QX1 only) b) tail", "x CLASS 1 LASER PRODUCT (QX12 (a) models) y", "CLASS 1 LASER PRODUCT (none) z", "CLASS1 LASER PRODUCT  (Supported Model)",
    "(open QX1 only", "plain", "(QX12) text", "(only) text", "CLASS 1 LASER PRODUCT (QX1",
)


def _condition(x: str) -> str:
    """Plain Python for one of the phrases above, so that SQL can look its parts up."""
    import re

    token, scope = re.compile(R.MODEL_TOKEN), re.compile(R.MODEL_SCOPE)

    def close(at: int) -> int:
        depth = 0
        for i in range(at, len(x)):
            depth += (x[i] == "(") - (x[i] == ")")
            if depth == 0:
                return i
        return -1

    scoped = lambda s: s[:1] == "(" and s[-1:] == ")" and bool(token.search(s) and scope.search(s))
    if scoped(x):
        return f"condition_label:{x}"
    if x.startswith("(") and (end := close(0)) >= 0 and x[end + 1 :].strip() and scoped(x[: end + 1]):
        return f"condition_label:{x[:end + 1]}|body:{x[end + 1:].strip()}"
    if (m := re.search(R.LASER, x)) and (end := close(m.end() - 1)) >= 0 and token.search(x[m.start() : end + 1]):
        parts = (("body", x[: m.start()].strip()), ("condition_label", x[m.start() : end + 1].strip()), ("body", x[end + 1 :].strip()))
        return "|".join(f"{k}:{p}" for k, p in parts if p)
    return ""


@query(f"SELECT p_partkey, {chosen_sql([_condition(x) for x in CONDITIONS], 'p_partkey % 13')} AS parts FROM part")
def condition_parts(t) -> DataFrame:
    parts = F.transform(R.condition_parts(chosen(CONDITIONS, "p_partkey % 13")), lambda p: F.concat(p["kind"], F.lit(":"), p["text"]))
    return part(t, parts=F.coalesce(F.array_join(parts, "|"), F.lit("")))


CONTACTS = ("1-800-ACME", "call 1-800-acme or 555-1234", "1-888-ABC or 1-877-XYZ", "none", "www.example.org (Help  desk)", "www.example.org", "www.example.org/path (a) b", "see www.example.org", " www.a.b  (x) ", "www.a.b(c)")


@query(rf"""WITH c AS (SELECT p_partkey, {chosen_sql(CONTACTS, 'p_partkey % 10')} AS x FROM part), d AS (SELECT *, {collapse_sql('x')} AS y FROM c)
SELECT p_partkey, array_to_string(regexp_extract_all(x, '{T.PHONE}'), '|') AS phones, CASE WHEN regexp_matches(y, '{T.WEBSITE}') THEN regexp_extract(y, '{T.WEBSITE}', 1) ELSE y END AS url,
  CASE WHEN regexp_matches(y, '{T.WEBSITE}') THEN regexp_extract(y, '{T.WEBSITE}', 2) ELSE '' END AS label FROM d""")
def contact_values(t) -> DataFrame:
    x = chosen(CONTACTS, "p_partkey % 10")
    return part(t, phones=F.array_join(T.phone_tokens(x), "|"), w=T.website(x)).select("p_partkey", "phones", "w.url", "w.label")


PARTED = ("www.a.b www.c.d", "x", "", "www.", "www.a.b\n www.c.d \n\nz", "one\r\ntwo\n \nthree")


@query(rf"""WITH c AS (SELECT p_partkey, {chosen_sql(PARTED, 'p_partkey % 6')} AS x FROM part), d AS (SELECT *, list_filter(list_transform(string_split(x, 'www.'), lambda y: trim(y)), lambda y: trim(y, ' ' || chr(10)) <> '') AS p FROM c)
SELECT p_partkey, array_to_string(CASE WHEN len(p) > 0 THEN list_transform(p, lambda y: 'www.' || y) ELSE [x] END, '|') AS prefixed,
  array_to_string(list_filter(list_transform(regexp_split_to_array(x, '{T.LINE_END}'), lambda y: {collapse_sql('y')}), lambda y: y <> ''), '|') AS lines FROM d""")
def value_lines(t) -> DataFrame:
    x = chosen(PARTED, "p_partkey % 6")
    return part(t, prefixed=F.array_join(T.prefixed_parts(x, "www."), "|"), lines=F.array_join(T.text_lines(x), "|"))


TOKENS = ("press {btn_power} and {icn_home} or {btn_power}", "{btn_}", "{btn_A} {icn_1_b}", "none", "{btn_a}{btn_b}{btn_a}")


@query(r"""WITH c AS (SELECT p_partkey, {x} AS x FROM part), d AS (SELECT p_partkey, regexp_extract_all(x, '\{((?:btn|icn)_[a-z0-9_]+)\}', 1) AS a FROM c)
SELECT p_partkey, array_to_string(list_filter(a, lambda y, i: list_position(a, y) = i), '|') AS tokens FROM d""".replace("{x}", chosen_sql(TOKENS, "p_partkey % 5")))
def inline_tokens(t) -> DataFrame:
    return part(t, tokens=F.array_join(T.inline_tokens(chosen(TOKENS, "p_partkey % 5")), "|"))


SPECS = (
    ("Display Resolution", "Display Resolution AB1: 1920 x 1080 CD: 3840 x 2160", "model_spec"), ("Display Resolution", "AB1: 3840 x 2160 Other models 1920 x 1080", "model_spec"), ("Sound (Output)", "Sound (Output) AB1: 20 W, CD2: 2 x 10 W", "model_spec"),
    ("Sound (Output)", "AB: 10 W", "model_spec"), ("Operating Temperature", "Operating Temperature 50 °F to 104 °F (10 °C to 40 °C)", "common_required_spec"), ("Operating Humidity", "10 % to 80 %", "common_required_spec"), ("", "just text", "model_spec"), ("Display Resolution", "8K", "model_spec"),
)


def _spec(field: str, text: str, category: str) -> str:
    """Plain Python for one of the specifications above: model=value=unit of each row."""
    import re

    unit = lambda v: "W" if v.endswith("W") else "temperature_range" if "°F" in v or "°C" in v else "%" if "%" in v else ""
    value = text.removeprefix(field).strip() if field else text
    rows = []
    if category == "model_spec":
        if field == "Display Resolution":
            rows = [(m[1], m[2]) for m in re.finditer(T.RESOLUTION_ROW, value)]
        if not rows:
            for m in re.finditer(T.SOUND_ROW if field == "Sound (Output)" else T.MODEL_ROW, value):
                v = m[2].strip()
                both = field == "Display Resolution" and "Other models" in v
                rows += [(m[1].strip().lstrip(", "), v.split("Other models")[0].strip()), ("Other models", v.split("Other models", 1)[1].strip())] if both else [(m[1].strip().lstrip(", "), v)]
    return "|".join(f"{m.strip()}={v}={unit(v)}" for m, v in rows or [("", value)])


@query(f"SELECT p_partkey, {chosen_sql([_spec(*s) for s in SPECS], 'p_partkey % 8')} AS rows FROM part")
def spec_rows(t) -> DataFrame:
    field, text, category = (chosen([s[i] for s in SPECS], "p_partkey % 8") for i in range(3))
    rows = F.transform(T.spec_rows(field, text, category), lambda r: F.concat_ws("=", r["model_pattern"], r["value"], r["unit"]))
    return part(t, rows=F.array_join(rows, "|"))


UNITS = ("10 W", "5 °C", "7 %", "x", "20 W ", "50 °F W", "")


@query(f"""WITH c AS (SELECT p_partkey, {collapse_sql(chosen_sql(UNITS, 'p_partkey % 7'))} AS y FROM part)
SELECT p_partkey, CASE WHEN ends_with(y, 'W') THEN 'W' WHEN contains(y, '°F') OR contains(y, '°C') THEN 'temperature_range' WHEN contains(y, '%') THEN '%' ELSE '' END AS unit FROM c""")
def spec_units(t) -> DataFrame:
    return part(t, unit=T.unit_of(chosen(UNITS, "p_partkey % 7")))


MENUS = ("A>B  > C", "Software Update > Update", "A > Software Update>Update", "one", "> x >", "a > b (c)", ")", "). More", ") more", ").")
MODELS = ("AB1/CD2/The/Frame.", "AB1//CD2", "AB1..", "", "/", "The/Frame")


@query(rf"""WITH c AS (SELECT p_partkey, {chosen_sql(MENUS, 'p_partkey % 10')} AS x, {chosen_sql(MODELS, 'p_partkey % 6')} AS m FROM part),
d AS (SELECT *, {collapse_sql(r"regexp_replace(x, '\s*>\s*', ' > ', 'g')")} AS y, replace(regexp_replace({collapse_sql('m')}, '\.+$', ''), '/The/Frame', '/The Frame') AS n FROM c)
SELECT p_partkey, '(' || regexp_replace(y, 'Software Update > Update$', 'Software Update > Auto Update') || ')' AS path, {collapse_sql(r"regexp_replace(" + collapse_sql('x') + r", '^\)\.?\s*', '')")} AS behind,
  array_to_string(list_filter(string_split(n, '/'), lambda z: z <> ''), '|') AS models FROM d""")
def menus_and_models(t) -> DataFrame:
    x = chosen(MENUS, "p_partkey % 10")
    return part(t, path=T.navigation_path(x), behind=T.after_parenthesis(x), models=F.array_join(T.model_list(chosen(MODELS, "p_partkey % 6")), "|"))


PACKAGE = (("list_item", "* Cable *: not everywhere"), ("list_item", "*: only here"), ("list_item", "**: and there"), ("list_item", "Stand"), ("bullet", "Simple User Guide"), ("bullet", "Warranty Card / Regulatory Guide (x)"), ("bullet", "other"), ("body", "depending on it"), ("body", "ongoing"), ("body", "on it"), ("list_item", "**Two  Stars"))


@query(rf"""WITH c AS (SELECT p_partkey, {chosen_sql([k for k, _ in PACKAGE], 'p_partkey % 11')} AS kind, {collapse_sql(chosen_sql([x for _, x in PACKAGE], 'p_partkey % 11'))} AS x FROM part), d AS (SELECT *, kind = 'list_item' AND regexp_matches(x, '^\*{{1,2}}:') AS note FROM c)
SELECT p_partkey, ((kind = 'list_item' AND starts_with(x, '*')) OR (kind = 'bullet' AND (x = 'Simple User Guide' OR starts_with(x, 'Warranty Card / Regulatory Guide')))) AND NOT note AS item, note, kind = 'body' AND regexp_matches(x, '^(on|depending)\b') AS more,
  trim(regexp_replace(CASE WHEN contains(x, ' *:') THEN split_part(x, ' *:', 1) ELSE x END, '^\*+', '')) AS item_text, CASE WHEN contains(x, ' *:') THEN '*: ' || trim(substr(x, instr(x, ' *:') + 3)) ELSE '' END AS item_note FROM d""")
def package_parts(t) -> DataFrame:
    d = part(t, kind=chosen([k for k, _ in PACKAGE], "p_partkey % 11"), x=T.collapsed(chosen([x for _, x in PACKAGE], "p_partkey % 11")))
    k, x = F.col("kind"), F.col("x")
    d = d.select("p_partkey", R.is_package_item(k, x).alias("item"), R.is_package_note(k, x).alias("note"), R.is_package_note_more(k, x).alias("more"), R.package_item(x).alias("i"))
    return d.select("p_partkey", "item", "note", "more", F.col("i.text").alias("item_text"), F.col("i.note").alias("item_note"))


NOISE = ("–", " - ", "use.", "only.", "ft).", "used.", "", "This function is supported", "AB1/CD2*", "AB (x)", "The", "Frame.")


@query(f"""WITH c AS (SELECT p_partkey, {chosen_sql(NOISE, 'p_partkey % 12')} AS x FROM part)
SELECT p_partkey, {collapse_sql('x')} IN ({quoted(R.NOTE_NOISE)}) AS noise, regexp_matches(x, '^[A-Za-z0-9*/._ -]+(?:/[A-Za-z0-9*/._ -]+)*\\.?$') AS more_models FROM c""")
def note_noise(t) -> DataFrame:
    x = chosen(NOISE, "p_partkey % 12")
    return part(t, noise=R.is_note_noise(x), more_models=R.is_model_more(x))


NOTES = (
    "This device is a Class B digital apparatus. It is. For information about the power supply, see the label. (It is inside.) On One Connect Box models, look there. To connect a LAN cable, use CAT 7 (100/10 Mbps) cable. Not less.",
    "The images and specifications of the Unpacking and Installation Guide may differ from the actual product. Operation in the band 5150 - 5250 MHz is for indoor use. [Operation in the band 5925 - 7125 MHz] Operation of this product shall be limited to indoor use Operation of this product is not above 3 km (10,000",
    "This device is a Class B digital apparatus. To connect a LAN cable", "nothing of this", "The Unpacking and Installation Guide may differ. [Operation in the band 5925 - 7125 MHz", "* Shielded Twisted Pair",
)


def _notes(x: str, cable: bool) -> str:
    """Plain Python for one of the notes above: topic=text=lines."""
    import re

    def cut(start: str, end: str | None) -> str:
        at = x.find(start)
        stop = x.find(end, at + len(start)) if end and at >= 0 else -1
        return "" if at < 0 else " ".join(x[at : stop if stop >= 0 else len(x)].split())

    sentences = lambda s: [p for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])", s) if p]
    device, wireless = R.CLASS_NOTE in x, R.WIRELESS_NOTE in x
    out = []
    for topic, start, end in R.DEVICE_TOPICS if device else R.WIRELESS_TOPICS if wireless else ():
        text = cut(start, end)
        if topic == "REG_LAN_CABLE_STP" and cable:
            text = (text + " * Shielded Twisted Pair").strip()
        if topic == "REG_6GHZ_BAND_OPERATION" and text.endswith("(10,000"):
            text += " ft)."
        if topic == "REG_POWER_LABEL":
            lines = [s for p in re.sub(R.BOX_MODELS, ".)\n\\1", text).split("\n") for s in sentences(p)]
        elif topic == "REG_LAN_CABLE_STP":
            main = text.split(" * Shielded Twisted Pair")[0]
            lines = sentences(main.replace(" (100/10 Mbps)", "")) + ["(100/10 Mbps)"] * (" (100/10 Mbps)" in main) + ["* Shielded Twisted Pair"] * ("* Shielded Twisted Pair" in text)
        elif topic == "REG_6GHZ_BAND_OPERATION":
            head = re.match(r"^(\[[^\]]+\])\s*(.*)$", text)
            lines = ([head[1]] if head else []) + sentences((head[2] if head else text).replace(R.UNPARTED, R.PARTED))
        else:
            lines = sentences(text)
        out.append(f"{topic}={text}={'¦'.join(lines)}")
    return "|".join(out)


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN {chosen_sql([_notes(x, True) for x in NOTES], 'p_partkey % 6')} ELSE {chosen_sql([_notes(x, False) for x in NOTES], 'p_partkey % 6')} END AS notes FROM part")
def regulatory_notes(t) -> DataFrame:
    notes = R.regulatory_notes(chosen(NOTES, "p_partkey % 6"), F.col("p_partkey") % 4 == 0)
    return part(t, notes=F.array_join(F.transform(notes, lambda n: F.concat_ws("=", n["topic_id"], n["text"], F.array_join(n["lines"], "¦"))), "|"))


FONTS = ("ABC+Sans-700", "Sans-Bold", "Sans SemiBold", "Sans", "", "Sans-SemiBold", "Sans_light", "Sans-BoldItalic", "Heavy-Oblique", "Sans-600x", "Sans-599", "Sans_650 Italic", "XYZ+Serif-Black", "Sans-1000")
_weights = " ".join(f"WHEN regexp_matches(n, '(?:^|[-_\\s]){k}$') THEN {w}" for k, w in T.FONT_WEIGHTS)


@query(rf"""WITH f AS (SELECT p_partkey, {chosen_sql(FONTS, 'p_partkey % 14')} AS font FROM part), n AS (SELECT *, lower(trim(string_split(font, '+')[-1])) AS n, lower(font) AS l FROM f)
SELECT p_partkey, CASE WHEN regexp_matches(n, '(?:^|[-_\s])[1-9]00$') THEN CAST(regexp_extract(n, '(?:^|[-_\s])([1-9]00)$', 1) AS INTEGER) {_weights} END AS weight,
  regexp_matches(l, 'bold|black|heavy') OR coalesce(TRY_CAST(regexp_extract(l, '[-_](\d{{3}})(?:\D|$)', 1) AS INTEGER) >= 600, false) AS bold, regexp_matches(l, 'italic|oblique') AS italic FROM n""")
def font_names(t) -> DataFrame:
    f = chosen(FONTS, "p_partkey % 14")
    return part(t, weight=T.font_weight(f), bold=T.is_bold_font(f), italic=T.is_italic_font(f))


SHEETS, TURNS = ("A2", "A3", "A5", "UNKNOWN"), ("landscape", "portrait")


@query(f"""WITH p AS (SELECT p_partkey, {chosen_sql(SHEETS, 'p_partkey % 4')} AS size, {chosen_sql(TURNS, 'p_partkey % 3 % 2')} AS turn, p_partkey % 5 AS page, p_partkey % 7 % 3 + 1 AS r, p_partkey % 11 % 4 + 1 AS c FROM part)
SELECT p_partkey, CASE WHEN size = 'A2' AND turn = 'landscape' THEN 2 WHEN size = 'A3' AND turn = 'portrait' THEN 2 ELSE 1 END AS rows,
  CASE WHEN size = 'A2' AND turn = 'landscape' THEN 8 WHEN size = 'A3' AND turn = 'portrait' THEN 4 WHEN size = 'A5' AND turn = 'portrait' THEN 2 ELSE 1 END AS columns,
  (size = 'A2' AND turn = 'landscape') OR (size = 'A3' AND turn = 'portrait' AND page = 1) AS has_cover,
  CASE WHEN size = 'A5' AND turn = 'portrait' THEN 'section' WHEN r = 1 AND c <= 2 AND ((size = 'A2' AND turn = 'landscape') OR (size = 'A3' AND turn = 'portrait' AND page = 1)) THEN 'cover' ELSE 'content' END AS role FROM p""")
def page_layouts(t) -> DataFrame:
    size, turn = chosen(SHEETS, "p_partkey % 4"), chosen(TURNS, "p_partkey % 3 % 2")
    k = F.col("p_partkey")
    page, r, c = k % 5, k % 7 % 3 + 1, k % 11 % 4 + 1
    d = part(t, layout=T.layout(size, turn, page), role=T.cell_role(size, turn, page, r, c, F.lit("section")))
    return d.select("p_partkey", "layout.*", "role")


LABELS = ("ENG", "C-FRA", "eng", "A-B-C", " KOR ", "TOO LONG", "")


@query(rf"""WITH s AS (SELECT l_orderkey AS page, l_linenumber AS ord, trim({chosen_sql(LABELS, 'l_partkey % 7')}) AS text, l_quantity * 16 AS x0, l_quantity * 16 + 10 AS x1, l_discount * 800 AS y0 FROM lineitem),
f AS (SELECT * FROM s WHERE text <> '' AND y0 < 50 AND regexp_matches(text, '^[A-Z]+(-[A-Z]+)?$'))
SELECT page, coalesce(max(struct_pack(o := ord, t := text)) FILTER (x0 < 80), max(struct_pack(o := ord, t := text)) FILTER (NOT x0 < 80 AND x1 > 740)).t AS label FROM f GROUP BY 1""")
def corner_labels(t) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    s = t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.btrim(chosen(LABELS, "l_partkey % 7")).alias("text"), (q * 16).alias("x0"), (q * 16 + 10).alias("x1"), (d * 800).alias("y0"))
    return grid.corner_labels(s, ["page"], "ord", 820.0)


@query("""WITH s AS (SELECT c_nationkey AS doc, ['A5', 'A3', 'A5', 'A2', 'A5'][c_nationkey % 5 + 1] AS size FROM customer WHERE c_nationkey % 5 <> 3 UNION ALL SELECT s_nationkey, CASE WHEN s_nationkey % 3 = 0 THEN 'A2' ELSE 'A5' END FROM supplier)
SELECT doc, CASE WHEN bool_and(size = 'A5') THEN 'BOOK' WHEN bool_or(size = 'A2') THEN 'A2' WHEN bool_or(size = 'A3') THEN 'A3' ELSE 'UNKNOWN' END AS doc_type FROM s GROUP BY 1""")
def document_types(t) -> DataFrame:
    a = t("customer").where("c_nationkey % 5 <> 3").select(F.col("c_nationkey").alias("doc"), chosen(("A5", "A3", "A5", "A2", "A5"), "c_nationkey % 5").alias("size"))
    b = t("supplier").select(F.col("s_nationkey").alias("doc"), F.when(F.col("s_nationkey") % 3 == 0, "A2").otherwise("A5").alias("size"))
    return a.unionByName(b).groupBy("doc").agg(checks.document_type(F.collect_set("size")).alias("doc_type"))


@query("""WITH a AS (SELECT l_orderkey, l_partkey % 3 AS k, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT l_orderkey, l_partkey % 3 AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag <> 'A'),
x AS (SELECT l_orderkey, k, n, count(*) AS c FROM a GROUP BY ALL), y AS (SELECT l_orderkey, k, n, count(*) AS c FROM b GROUP BY ALL),
d AS (SELECT l_orderkey, k, n, coalesce(x.c, 0) - coalesce(y.c, 0) AS s FROM x FULL JOIN y USING (l_orderkey, k, n)) SELECT l_orderkey, k, n, s AS surplus, CASE WHEN s > 0 THEN 'first' ELSE 'second' END AS side FROM d WHERE s <> 0""")
def bag_differences(t) -> DataFrame:
    rows = lambda cond: t("lineitem").where(cond).select("l_orderkey", (F.col("l_partkey") % 3).alias("k"), F.col("l_linenumber").alias("n"))
    return sinks.differences(rows("l_linestatus = 'O'"), rows("l_returnflag <> 'A'"))


LETTERS = ("listen", "silent", "enlist", "tinsel", "list", "aab", "aba", "é日", "日é", "")


@query(f"""WITH p AS (SELECT p_partkey, {chosen_sql(LETTERS, 'p_partkey % 10')} AS a, {chosen_sql(LETTERS, 'p_partkey % 7')} AS b FROM part) SELECT p_partkey, list_sort(string_split(a, '')) = list_sort(string_split(b, '')) AS same_letters FROM p""")
def letter_bags(t) -> DataFrame:
    return part(t, same_letters=sinks.same_letters(chosen(LETTERS, "p_partkey % 10"), chosen(LETTERS, "p_partkey % 7")))
