"""Column functions on one string: normalisation, line classification, extraction (pure expressions, no Python UDF)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and patterns that results depend on.
STANDALONE_BULLET = "•"
NAVIGATION_TEXTS = (">", "(", ")", "Settings", "Support", "Tips", "and User Guides", "Open User Guide", "left directional button")
UI_LABELS = (
    "TV Controller", "Control menu", "Control menu . The Control menu", "Remote control sensor", "Remote Control Sensor",
    "Microphone switch", "Motion Sensor", "Update Now", "Auto Update", "Auto", "Update", "Software Update", "All Settings",
    "General & Privacy", "Power and", "Energy Saving", "Power and Energy Saving", "Brightness Optimization",
    "Troubleshooting", "button / Remote control sensor /", "button / Remote Control Sensor /",
    "button / Remote control sensor", "button / Remote Control Sensor",
)
LIST_ITEMS = ("Warranty Card / Regulatory Guide (Not available in some locations)", "User Manual", "Power Cord")
WARNING_TERMS = ("CAUTION", "RISK OF ELECTRIC SHOCK", "DO NOT OPEN", "DO NOT REMOVE COVER", "NO USER SERVICEABLE PARTS", "SERVICING TO QUALIFIED PERSONNEL")
SAFETY_MARKERS = ("This symbol indicates", "Class II product", "AC voltage", "DC voltage", "Consult instructions for use")
REJECTED_HEADINGS = ("on", "or", "Yes", "Simple User Guide", "Do Not Touch This Screen!", "Do Not Touch", "This Screen!", "(The Frame only)")
PLAIN_LINES = ("ENG", "Website", "-00", "Caution")
BULLET_START = r"^[•–-]"
NUMBERED_START = r"^\d+[.)]\s+"
COUNTED_ITEM = r"(?i)^x\s*\d+$"
NUMBERED_TITLE = r"^\d{2}\s+[A-Z]"
BROKEN_START = r"^[.,:;/]"
TITLE_MARKS = r"[\"'()\[\]:;,-]"
HEADING_STOPWORDS = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with")
FONT_WEIGHTS = (("black", 900), ("extrabold", 800), ("semibold", 600), ("demibold", 600), ("bold", 700), ("medium", 500), ("regular", 400), ("normal", 400), ("light", 300))
SEMANTIC_ROLES = {
    "Document": "document", "Part": "part", "Art": "article", "Sect": "section", "Div": "division", "P": "paragraph",
    "L": "list", "LI": "list_item", "Lbl": "label", "LBody": "list_body", "Table": "table", "TR": "table_row",
    "TH": "table_header", "TD": "table_cell", "Figure": "figure", "Caption": "caption", "Span": "span", "Link": "link",
}
PAGE_SIZES = (("A5", 466.5, 642.3), ("A3", 888.9, 1237.6), ("A2", 1730.8, 1237.6))
ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "No.", "Fig.", "Mr.", "Ms.", "Dr.")  # in their order of protection
WHITE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"  # what Python's str.strip() takes
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"  # those of Python's str.splitlines()
BULLET_LINE = rf"^(?:[•–-]|\p{{Nd}}+[.)]{WHITE})"


def collapsed(x: Column) -> Column:
    """White space, Unicode's too, collapsed to single spaces and trimmed."""
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "))


def word_count(x: Column) -> Column:
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def any_of(x: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | x.contains(p)
    return out


def uppercase_share(x: Column) -> Column:
    """Upper-case letters over letters; null without letters."""
    return F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) / F.nullif(F.length(F.regexp_replace(x, r"[^\p{L}]", "")), F.lit(0))


def is_bullet(x: Column) -> Column:
    return x.rlike(BULLET_START) | x.rlike(NUMBERED_START)


def is_navigation(x: Column) -> Column:
    return x.isin(*NAVIGATION_TEXTS) | x.startswith(">") | x.endswith(">")


def is_ui_label(x: Column) -> Column:
    return x.isin(*UI_LABELS) | ((x.endswith("button") | x.endswith("sensor")) & (word_count(x) <= 5))


def is_list_item(x: Column) -> Column:
    return x.startswith("*") | x.rlike(COUNTED_ITEM) | x.isin(*LIST_ITEMS)


def is_warning(x: Column) -> Column:
    return any_of(x, WARNING_TERMS) | F.coalesce((uppercase_share(x) > 0.85) & (F.length(x) > 20), F.lit(False))


def title_words(x: Column) -> Column:
    """Words that look like a title's: stopwords, and words that, behind marks, begin with an upper-case letter or have no
    lower-case one."""
    bare = lambda w: F.regexp_replace(w, f"^{TITLE_MARKS}+", "")
    low = lambda w: F.regexp_replace(F.lower(bare(w)), f"{TITLE_MARKS}+$", "")
    upper = lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"[\p{Ll}\p{Lt}]")
    return F.size(F.filter(F.split(x, " "), lambda w: low(w).isin(*HEADING_STOPWORDS) | bare(w).rlike(r"^\p{Lu}") | upper(w)))


def is_titled(x: Column) -> Column:
    """Whether a line that no other class claims is set like a title."""
    # cheap tests first: most lines of running text fail them, and the rest is then not evaluated
    barred = (F.length(x) > 55) | (x == "") | x.endswith(".") | x.isin(*PLAIN_LINES, *REJECTED_HEADINGS) | x.rlike(BROKEN_START) | x.contains("www.") | x.contains("@")
    n = word_count(x)
    shaped = x.rlike(NUMBERED_TITLE) | ((x.endswith("!") | x.endswith("?")) & (n <= 4)) | ((n <= 8) & (title_words(x) >= F.greatest(F.lit(1), n - 1)))
    return ~barred & shaped


def is_heading(x: Column) -> Column:
    """A short line set like a title that is no bullet mark, menu part, label, list item or warning."""
    return is_titled(x) & ~((x == STANDALONE_BULLET) | is_navigation(x) | is_ui_label(x) | is_list_item(x) | is_warning(x))


def line_kind(x: Column) -> Column:
    """The first class that claims a collapsed line."""
    return (
        F.when(x == "", "blank").when(x == STANDALONE_BULLET, "bullet").when(is_navigation(x), "navigation").when(is_ui_label(x), "ui_label")
        .when(is_warning(x), "warning").when(is_list_item(x), "list_item").when(is_bullet(x), "bullet").when(is_titled(x), "heading").otherwise("body")
    )


def continues_run(x: Column) -> Column:
    """Whether a line carries on the running text before it: no class but body claims it."""
    return ~(is_bullet(x) | is_navigation(x) | is_ui_label(x) | is_warning(x) | is_list_item(x) | is_titled(x))


def heading_continues(before: Column, x: Column, most: int = 80) -> Column:
    """Whether a heading line carries on the heading line before it: both together are short enough."""
    return is_heading(x) & (F.length(before) + F.length(x) <= most)


# How list items go on.
NOTE_START, PARTED_ITEM = "*:", "*Wireless One Connect Box"


def list_continues(before: Column, x: Column) -> Column:
    """Whether a line carries on the list line before it: running text behind a note, or a note behind the parted item."""
    return F.when(before.startswith(NOTE_START), continues_run(x)).otherwise(before.startswith(PARTED_ITEM) & x.startswith(NOTE_START))


def is_fragment(x: Column) -> Column:
    closed = x.endswith(".") | x.endswith("!") | x.endswith("?")
    return (x != "") & (x.isin("or", "/", "button /", ")", "(") | x.rlike(r'^[.,:;/)]|[(/"]$') | ((word_count(x) <= 3) & ~closed))


def is_safety_table(x: Column) -> Column:
    return sum((x.contains(m).cast("int") for m in SAFETY_MARKERS), F.lit(0)) >= 3


def split_sentences(x: Column, english: Column) -> Column:
    """Sentences of a text, none empty: in English, a blank line, a bullet or a sentence's end parts them, and known
    abbreviations end none; a text in any other language is one sentence.  A null text has none."""
    normal = lambda s: F.btrim(F.regexp_replace(s, WHITE + "+", " "))
    lines = F.transform(F.split(F.coalesce(x, F.lit("")), LINE_END), lambda s: F.regexp_replace(s, rf"^{WHITE}+|{WHITE}+$", ""))
    # lines hold no line feeds, so these may mark where a paragraph ends
    parts = F.array_join(F.transform(lines, lambda s: F.when(s == "", "\n").when(s.rlike(BULLET_LINE), F.concat(F.lit("\n"), s)).otherwise(s)), " ")
    for a in ABBREVIATIONS:
        parts = F.replace(parts, F.lit(a), F.lit(a.replace(".", "__")))
    found = F.split(parts, rf"\n|(?<=[.!?]){WHITE}+(?=[A-Z0-9\"'(\[])")

    def restored(s: Column) -> Column:
        s = normal(s)
        for a in ABBREVIATIONS:
            s = F.replace(s, F.lit(a.replace(".", "__")), F.lit(a))
        return s

    whole = F.array(normal(F.coalesce(x, F.lit(""))))
    return F.filter(F.when(F.coalesce(english, F.lit(False)), F.transform(found, restored)).otherwise(whole), lambda s: s != "")


def forbidden_characters(x: Column) -> Column:
    """Characters that XML 1.0 does not allow."""
    return F.length(F.regexp_replace(x, r"[\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", ""))


def occurrences(x: Column, what: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(what), F.lit("")))


def segment(x: Column, start: str, end: str | None) -> Column:
    """A text from the first start mark, mark included, up to the next end mark (without one, to its end), collapsed;
    empty without a start mark."""
    at = F.instr(x, start)
    tail = F.substring(x, at + len(start), F.length(x))
    head = F.lit(start)
    if end is None:
        found = F.concat(head, tail)
    else:
        found = F.when(F.instr(tail, end) == 0, F.concat(head, tail)).otherwise(F.concat(head, F.substring(tail, F.lit(1), F.instr(tail, end) - 1)))
    return F.when(at == 0, "").otherwise(collapsed(found))


def ended(x: Column) -> Column:
    """A text with a full stop behind it, unless it ends a sentence already or is empty."""
    c = collapsed(x)
    return F.when((c == "") | c.rlike("[.!?]$"), c).otherwise(F.concat(c, F.lit(".")))


def tidy_joins(x: Column) -> Column:
    """Spaces that joining left before or inside marks are taken out."""
    out = collapsed(x)
    for old, new in ((" .", "."), (" ,", ","), (" :", ":"), (" ;", ";"), ("( ", "("), (" )", ")"), ('" ', '"')):
        out = F.replace(out, F.lit(old), F.lit(new))
    return collapsed(out)


def inline_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\{((?:btn|icn)_[a-z0-9_]+)\}"), 1))


def unit_of(x: Column) -> Column:
    c = collapsed(x)
    return F.when(c.endswith("W"), "W").when(c.contains("°F") | c.contains("°C"), "temperature_range").when(c.contains("%"), "%").otherwise("")


def slug(x: Column, size: int = 40) -> Column:
    return F.btrim(F.substring(F.btrim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), F.lit("_")), 1, size), F.lit("_"))


def font_weight(name: Column) -> Column:
    """Numeric weight at the end of a font name, else that of its last keyword; a subset prefix is dropped."""
    n = F.lower(F.btrim(F.substring_index(name, "+", -1)))
    number = F.regexp_extract(n, r"(?:^|[-_\s])([1-9]00)$", 1)
    out = F.when(number != "", number.cast("int"))
    for keyword, weight in FONT_WEIGHTS:
        out = out.when(n.rlike(rf"(?:^|[-_\s]){keyword}$"), weight)
    return out


def semantic_role(role: Column) -> Column:
    out = F.when(role == "H", "heading").when(role.rlike("^H[1-6]$"), "heading").when(role == "Title", "heading")
    for source, target in SEMANTIC_ROLES.items():
        out = out.when(role == source, target)
    return out.otherwise("unknown")


def heading_level(role: Column) -> Column:
    return F.when(role.rlike("^H[1-6]$"), F.substring(role, 2, 1).cast("int")).when(role == "Title", 1)


def mapped_role(role: Column, role_map: Column) -> Column:
    """(semantic_role, level) of a source role by way of a document's role map, of which one step is taken."""
    resolved = F.coalesce(role_map[role], role)
    return F.struct(semantic_role(resolved).alias("semantic_role"), heading_level(resolved).alias("level"))


def followed_role(role: Column, role_map: Column) -> Column:
    """Where a role leads through a role map, step by step, up to a role that has none or was passed."""
    start = F.struct(role.alias("at"), F.array().cast("array<string>").alias("seen"))

    def step(s: Column, _: Column) -> Column:
        on = role_map[s["at"]].isNotNull() & ~F.array_contains(s["seen"], s["at"])
        return F.struct(F.when(on, role_map[s["at"]]).otherwise(s["at"]).alias("at"), F.when(on, F.array_append(s["seen"], s["at"])).otherwise(s["seen"]).alias("seen"))

    return F.aggregate(F.sequence(F.lit(0), F.size(role_map)), start, step, lambda s: s["at"])


def is_list_role(role: Column, role_map: Column) -> Column:
    """Whether a role leads to a list's body, or, not being a paragraph's, to a paragraph."""
    end = followed_role(role, role_map)
    return (end == "LBody") | ((role != "P") & (end == "P"))


# Names of roles that a heading may hide behind.
HEADING_CANDIDATE, TITLE_CANDIDATE = r"(?i)heading(?:([1-6])(?=$|\D)|$)", r"(?i)(?:^|[_-])title$"


def candidate_level(role: Column) -> Column:
    return F.regexp_extract(role, HEADING_CANDIDATE, 1).try_cast("int")


def is_heading_candidate(role: Column) -> Column:
    return role.rlike(HEADING_CANDIDATE) | role.rlike(TITLE_CANDIDATE)


def page_size(width: Column, height: Column, tolerance: float = 8.0) -> Column:
    """The first known size that fits in either orientation."""
    near = lambda v, x: F.abs(v - x) <= tolerance
    out = None
    for name, w, h in PAGE_SIZES:
        fits = (near(width, w) & near(height, h)) | (near(width, h) & near(height, w))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("UNKNOWN")


def file_fields(path: Column) -> Column:
    """Fields of a manual's file name, and `error` where it has none: parts by underscore; from the fourth to the third last
    they are the buyer."""
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.pdf$", ""), r"\.0$", "")
    parts = F.split(stem, "_")
    n = F.size(parts)
    at = lambda i: F.when(n >= 6, F.btrim(F.get(parts, i if isinstance(i, Column) else F.lit(i))))
    buyer = F.when(n >= 6, F.btrim(F.array_join(F.slice(parts, F.lit(4), F.greatest(n - 5, F.lit(1))), "_")))
    token = F.when(n >= 6, F.concat(buyer, F.lit("_"), at(n - 2)))
    error = F.when(n < 6, "too_few_parts").when((buyer == "") | (at(n - 2) == ""), "token_missing")
    return F.struct(
        name.alias("file_name"), at(0).alias("code"), at(1).alias("kind"), at(2).alias("model"), buyer.alias("buyer"), at(n - 2).alias("language"), at(n - 1).alias("date_code"),
        token.alias("source_token"), error.alias("error"),
    )


def pieces_at(x: Column, starts: tuple[str, ...]) -> Column:
    """The text cut in front of each of the literal starts, collapsed, empty pieces left out; whole if none occurs."""
    names = "|".join(re.escape(s) for s in sorted(starts, key=len, reverse=True))
    return F.filter(F.transform(F.split(F.regexp_replace(x, f"({names})", "\x01$1"), "\x01"), collapsed), lambda p: p != "")


def navigation_path(x: Column) -> Column:
    """A menu path with spaced separators, in parentheses."""
    spaced = collapsed(F.regexp_replace(x, r"\s*>\s*", " > "))
    return F.concat(F.lit("("), F.regexp_replace(spaced, "Software Update > Update$", "Software Update > Auto Update"), F.lit(")"))


def after_parenthesis(x: Column) -> Column:
    return collapsed(F.regexp_replace(collapsed(x), r"^\)\.?\s*", ""))


def model_text(x: Column) -> Column:
    """The models of a condition as one text: collapsed, without closing full stops, a name's parts put together."""
    return F.replace(F.regexp_replace(collapsed(x), r"\.+$", ""), F.lit("/The/Frame"), F.lit("/The Frame"))


def model_list(x: Column) -> Column:
    return F.filter(F.split(model_text(x), "/"), lambda m: m != "")


# Shapes of addresses and phone numbers.
WEBSITE = r"^(www\.[^\s()]+)(?:\s*\(([^)]+)\))?$"
PHONE = r"1-\d{3}-[A-Z]+|\d{3}-\d{4}"


def website(x: Column) -> Column:
    """(url, label) of a value like "www.example.org (label)"; any other value is a url as it is, with an empty label."""
    c = collapsed(x)
    fits = c.rlike(WEBSITE)
    return F.struct(F.when(fits, F.regexp_extract(c, WEBSITE, 1)).otherwise(c).alias("url"), F.when(fits, F.regexp_extract(c, WEBSITE, 2)).otherwise("").alias("label"))


def phone_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(PHONE), 0)


def text_lines(x: Column) -> Column:
    """The collapsed lines of a text, empty ones left out."""
    return F.filter(F.transform(F.split(x, LINE_END), collapsed), lambda v: v != "")


def prefixed_parts(x: Column, prefix: str) -> Column:
    """A text cut in front of each prefix, parts trimmed, each with the prefix put before it; the text itself if it has no part."""
    parts = F.filter(F.transform(F.split(x, re.escape(prefix)), lambda p: F.btrim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(parts, lambda p: F.concat(F.lit(prefix), p))).otherwise(F.array(x))


def pieces_from(x: Column, starts: tuple[str, ...]) -> Column:
    """A text cut in front of each of the literal starts; what stands before the first is left out.  Whole if none occurs."""
    names = "|".join(re.escape(s) for s in sorted(starts, key=len, reverse=True))
    cut = F.split(F.regexp_replace(x, f"({names})", "\x01$1"), "\x01")
    parts = F.filter(F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))), collapsed), lambda p: p != "")
    return F.when(x.rlike(names), parts).otherwise(F.array(collapsed(x)))


def steps(x: Column, starts: tuple[str, ...]) -> Column:
    """The steps of a procedure: from each start to the next.  Empty unless all starts occur, first occurrences in order."""
    at = [F.instr(x, s) for s in starts]
    ordered = at[0] > 0
    for a, b in zip(at, at[1:]):
        ordered = ordered & (a <= b) & (b > 0)
    ends = [*at[1:], F.length(x) + 1]
    found = F.array(*[collapsed(F.substring(x, a, b - a)) for a, b in zip(at, ends)])
    return F.when(ordered, found).otherwise(F.array().cast("array<string>"))


# Model rows of specifications.
RESOLUTION_ROW = r"([^:]+):\s*(\d+\s*x\s*\d+)(?=\s+[^:]+:\s*|$)"
MODEL_ROW = r"([^:]+):\s*([^:]+?)(?=[,\s]+[^:]+:\s*|$)"
SOUND_ROW = r"([^:]+):\s*(.+?\bW)(?=[,\s]+[^:]+:\s*|$)"
RESOLUTION_FIELD, SOUND_FIELD, OTHER_MODELS = "Display Resolution", "Sound (Output)", "Other models"
MODEL_SPEC, COMMON_SPEC = "model_spec", "common_required_spec"


def spec_rows(field: Column, x: Column, category: Column) -> Column:
    """Rows (row_order, field, model_pattern, value, unit) of a specification's text: one for each model of a field that
    differs by model, else one for the whole value."""
    let = lambda c, f: F.get(F.transform(F.array(c), f), 0)  # a value that several steps use is worked out once
    made = lambda m, v: F.struct(m.alias("m"), v.alias("v"))
    name = lambda w: collapsed(F.substring_index(w, ":", 1))
    told = lambda w: collapsed(F.substring(w, F.instr(w, ":") + 1, F.length(w)))
    clean = lambda w: F.regexp_replace(name(w), "^[, ]+", "")

    def parted(w: Column) -> Column:
        two = lambda v: F.array(made(clean(w), F.btrim(F.substring_index(v, OTHER_MODELS, 1))), made(F.lit(OTHER_MODELS), F.btrim(F.substring(v, F.instr(v, OTHER_MODELS) + len(OTHER_MODELS), F.length(v)))))
        return let(told(w), lambda v: F.when((field == RESOLUTION_FIELD) & v.contains(OTHER_MODELS), two(v)).otherwise(F.array(made(clean(w), v))))

    def rows(value: Column) -> Column:
        # without a colon there are no pairs, which the patterns find out only by a try from each place
        pairs = lambda pattern: F.when(value.contains(":"), F.regexp_extract_all(value, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        plain = F.flatten(F.transform(F.when(field == SOUND_FIELD, pairs(SOUND_ROW)).otherwise(pairs(MODEL_ROW)), parted))
        models = F.when(field == RESOLUTION_FIELD, let(pairs(RESOLUTION_ROW), lambda d: F.when(F.size(d) > 0, F.transform(d, lambda w: made(name(w), told(w)))).otherwise(plain))).otherwise(plain)
        whole = F.array(made(F.lit(""), value))
        return F.when(category == MODEL_SPEC, let(models, lambda ms: F.when(F.size(ms) > 0, ms).otherwise(whole))).otherwise(whole)

    value = let(collapsed(x), lambda c: F.when((field != "") & c.startswith(field), F.btrim(F.substring(c, F.length(field) + 1, F.length(c)))).otherwise(c))
    return F.transform(let(value, rows), lambda r, i: F.struct((i + 1).alias("row_order"), field.alias("field"), r["m"].alias("model_pattern"), collapsed(r["v"]).alias("value"), unit_of(r["v"]).alias("unit")))


def list_marker(label: Column) -> Column:
    """The kind of a list label: note, decimal, parenthesised, number, roman, letter, or none of them."""
    x = collapsed(label)
    return (
        F.when(x.isin("※", "*", "NOTE"), "note").when(x.rlike(r"^\d{1,3}\.$"), "decimal").when(x.rlike(r"^\(?\d{1,3}\)$"), "parenthesised").when(x.rlike(r"^\d{1,3}$"), "number")
        .when(x.rlike(r"^\(?[ivx]{1,5}[.)]$"), "roman").when(x.rlike(r"^\(?[A-Za-z][.)]$"), "letter").otherwise("none")
    )


def inside_quotes(x: Column, at: Column) -> Column:
    """Whether position `at` (from 1) of a text lies inside straight or curly quotes."""
    head = F.substring(x, F.lit(1), at - 1)
    return (occurrences(head, '"') % 2 == 1) | (occurrences(head, "“") > occurrences(head, "”"))


def characters_in(x: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    """How many characters of a text lie in the code point ranges."""
    inside = "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in ranges)
    return F.length(x) - F.length(F.regexp_replace(x, f"[{inside}]", ""))


#: The scripts of languages that are written from right to left.
RTL_SCRIPTS = {"ARA": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)), "HEB": ((0x0590, 0x05FF),)}


def has_rtl_script(x: Column, language: Column, least: int = 10) -> Column:
    out = None
    for name, ranges in RTL_SCRIPTS.items():
        hit = characters_in(x, ranges) >= least
        out = F.when(language == name, hit) if out is None else out.when(language == name, hit)
    return out.otherwise(False)


def escaped(x: Column) -> Column:
    """A line as Markdown text: marks that would format it are escaped, at its beginning and inside."""
    inside = F.regexp_replace(x, r"([\\`*_\[\]<>|])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(inside, r"^(#{1,6}|[-+])(?=\s|$)", r"\\$1"), r"^(\d{1,9})([.)])(?=\s|$)", r"$1\\$2")


def is_bold_font(name: Column) -> Column:
    """By name: a heavy word in it, or a weight of 600 or more behind a dash."""
    n = F.lower(name)
    return F.coalesce(n.rlike("bold|black|heavy"), F.lit(False)) | F.coalesce(F.regexp_extract(n, r"[-_](\d{3})(?:\D|$)", 1).try_cast("int") >= 600, F.lit(False))


def is_italic_font(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("italic|oblique"), F.lit(False))


def cell_role(size: Column, orientation: Column, page: Column, row: Column, column: Column, page_role: Column) -> Column:
    """The role of a grid cell: cover cells lie at the head of large sheets; a book's cells have their page's role."""
    head = (row == 1) & (column <= 2)
    sheet = ((size == "A2") & (orientation == "landscape")) | ((size == "A3") & (orientation == "portrait") & (page == 1))
    return F.when((size == "A5") & (orientation == "portrait"), page_role).when(sheet & head, "cover").otherwise("content")


def is_language_label(x: Column) -> Column:
    return x.rlike(r"^[A-Z]+(-[A-Z]+)?$")


def layout(size: Column, orientation: Column, page: Column) -> Column:
    """(rows, columns, has_cover) of a page's grid."""
    grid = lambda r, c, cover: F.struct(F.lit(r).alias("rows"), F.lit(c).alias("columns"), cover.alias("has_cover"))
    return (
        F.when((size == "A2") & (orientation == "landscape"), grid(2, 8, F.lit(True))).when((size == "A3") & (orientation == "portrait"), grid(2, 4, page == 1))
        .when((size == "A5") & (orientation == "portrait"), grid(1, 2, F.lit(False))).otherwise(grid(1, 1, F.lit(False)))
    )


def mail_addresses(x: Column) -> Column:
    """The different addresses in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]"), 0)))


def network_addresses(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), 0)


def url_host(x: Column) -> Column:
    return F.regexp_extract(x, r"^https?://([^/?#]+)", 1)


def url_language(x: Column) -> Column:
    """A language of two letters as the first part of a path."""
    return F.regexp_extract(x, r"^https?://[^/]+/([a-z]{2})/", 1)


def words(x: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+"), 0)


def json_number(x: Column, name: str) -> Column:
    """A whole number of a JSON object; null if it has none."""
    return F.get_json_object(x, f"$.{name}").try_cast("long")


# Conditions in texts that run from right to left, without their spaces and direction marks.
DIRECTION_MARKS = "\u200e\u200f"


def condition_key(x: Column) -> Column:
    """A text without white space and direction marks, under which conditions compare."""
    return F.regexp_replace(x, f"(?U)[\\s{DIRECTION_MARKS}]", "")


def decimal_parts(x: Column) -> Column:
    """A text without the spaces that stand between a digit and a decimal sign with a digit behind it."""
    return F.regexp_replace(x, r"(?<=\d)[ \t]+(?=[.,]\d)", "")


def proven_decimals(x: Column, source: Column) -> Column:
    """decimal_parts() of a text where its source has just those characters; otherwise the text as it is."""
    fixed = decimal_parts(x)
    return F.when(F.coalesce((fixed != x) & (F.btrim(fixed) == F.btrim(source)), F.lit(False)), fixed).otherwise(x)
