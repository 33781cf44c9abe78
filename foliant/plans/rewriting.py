"""Registered queries of the review chain, one a rule, each with the SQL that gives the same rows.

No table holds the wordings of the rules, so each line of an order chooses a snippet of items; an order's snippets, one behind
the other, are its items.  The snippets of a rule are its cases, near misses, and what may stand next to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import rewrites
from foliant.plans.made import literal
from foliant.plans.registry import QUERIES, SQL, collapse_sql, quoted
from foliant.sources.places import dealt

Snippets = list[list[tuple[str, str]]]
KEYS = ["doc"]
SNIPPETS: dict[str, Snippets] = {}


def items(t, snippets: Snippets) -> DataFrame:
    piece = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("text"))
    made = F.get(F.array(*[F.array(*[piece(*i) for i in s]) for s in snippets]), F.expr(f"int(l_partkey % {len(snippets)})"))
    li = dealt(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_orderkey")
    rows = li.select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.posexplode(made).alias("i", "p"))
    ord_ = F.row_number().over(Window.partitionBy("doc").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "i")) - 1
    return rows.select("doc", ord_.alias("ord"), "p.kind", "p.text")


def items_sql(snippets: Snippets) -> str:
    made = "[" + ", ".join("[" + ", ".join(f"{{'kind': {literal(k)}, 'text': {literal(x)}}}" for k, x in s) + "]" for s in snippets) + "]"
    return f"""src AS (SELECT l_orderkey AS doc, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {made}[CAST(l_partkey % {len(snippets)} AS INTEGER) + 1] AS ps FROM lineitem),
un AS (SELECT doc, l_linenumber, l_partkey, l_suppkey, l_extendedprice, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM src),
items AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, i) - 1 AS ord, p.kind AS kind, p.text AS text FROM un)"""


def told(source: str) -> str:
    """The last common table as result, numbered from 0."""
    return f"SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS ord, kind, text FROM {source}"


def split_sql(when: str, parts: str, source: str = "items", name: str = "out") -> str:
    """A common table: items for which `when` holds as their parts (a list of structs kind, text), empty texts left out."""
    return f"""{name}_p AS (SELECT doc, ord, CASE WHEN {when} THEN list_filter({parts}, lambda p: trim(p.text) <> '') ELSE [{{'kind': kind, 'text': text}}] END AS ps FROM {source}),
{name}_u AS (SELECT doc, ord, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM {name}_p), {name} AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord, i) - 1 AS ord, p.kind AS kind, p.text AS text FROM {name}_u)"""


def runs_sql(opens: str, follows: str, ends: str, kind: str, text: str, source: str = "items", name: str = "out") -> str:
    """A common table: an item that opens takes in those behind it that follow, up to one that ends (walked item by item).
    `kind` is of the first item, `text` of the list `parts`."""
    return f"""{name}_f AS (SELECT doc, ord, kind, text, coalesce({opens}, false) AS o, coalesce({follows}, false) AS f, coalesce({ends}, false) AS e FROM {source}),
{name}_w AS (SELECT doc, ord, kind, text, o AS open, false AS done, ord AS run FROM {name}_f WHERE ord = 0
  UNION ALL SELECT n.doc, n.ord, n.kind, n.text, CASE WHEN w.open AND NOT w.done AND n.f THEN true ELSE n.o END, CASE WHEN w.open AND NOT w.done AND n.f THEN n.e AND NOT n.o ELSE false END,
    CASE WHEN w.open AND NOT w.done AND n.f THEN w.run ELSE n.ord END FROM {name}_w w JOIN {name}_f n ON n.doc = w.doc AND n.ord = w.ord + 1),
{name}_g AS (SELECT doc, run, arg_min(kind, ord) AS kind, arg_min(text, ord) AS text, bool_or(open) AS open, list(text ORDER BY ord) AS parts FROM {name}_w GROUP BY 1, 2),
{name} AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY run) - 1 AS ord, CASE WHEN open THEN {kind} ELSE kind END AS kind, CASE WHEN open THEN {text} ELSE text END AS text FROM {name}_g)"""


def pattern_sql(conditions: list[str], kind: str, text: str, source: str = "items", name: str = "out") -> str:
    """A common table: consecutive items that fulfil the conditions become one; texts are t0, t1 and so on."""
    n = len(conditions)
    leads = ", ".join(f"lead({'c' + str(i)}, {i}) OVER w AS l{i}, lead(text, {i}) OVER w AS t{i}, lead(kind, {i}) OVER w AS k{i}" for i in range(1, n))
    starts = " AND ".join(["c0", *[f"coalesce(l{i}, false)" for i in range(1, n)]])
    taken = " OR ".join(f"coalesce(lag(s, {i}) OVER w, false)" for i in range(1, n))
    return f"""{name}_c AS (SELECT *, {', '.join(f'coalesce({c}, false) AS c{i}' for i, c in enumerate(conditions))} FROM {source}), {name}_l AS (SELECT *, text AS t0, {leads} FROM {name}_c WINDOW w AS (PARTITION BY doc ORDER BY ord)),
{name}_s AS (SELECT *, {starts} AS s FROM {name}_l), {name}_k AS (SELECT *, {taken} AS taken FROM {name}_s WINDOW w AS (PARTITION BY doc ORDER BY ord)),
{name} AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS ord, CASE WHEN s THEN {kind} ELSE kind END AS kind, CASE WHEN s THEN {text} ELSE text END AS text FROM {name}_k WHERE NOT taken)"""


def drop_sql(when: str, source: str, name: str) -> str:
    return f"{name} AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS ord, kind, text FROM {source} WHERE NOT coalesce({when}, false))"


def marked_sql(source: str, name: str, value: str = "lag(kind) OVER (PARTITION BY doc ORDER BY ord)") -> str:
    """A common table with `before`: the kind of the item before."""
    return f"{name} AS (SELECT *, {value} AS before FROM {source})"


def rule(fn: Callable, snippets: Snippets, *tables: str, last: str = "out") -> None:
    """Registers a rule's query on its snippets and the SQL made of the common tables."""
    name = f"rule_{fn.__name__}"
    SNIPPETS[fn.__name__] = snippets

    def run(spark, sf_dir):
        rows = items(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), snippets)
        out = fn(rows, KEYS, "Acme") if fn is rewrites.remote_icons else fn(rows, KEYS)
        return rewrites.renumbered(out, KEYS, "ord").withColumn("ord", F.col("ord").cast("long"))

    QUERIES[name] = run
    SQL[name] = f"WITH RECURSIVE {', '.join([items_sql(snippets), *tables])} {told(last)}"


B, H, U, N, W, L, X = "body", "heading", "ui_label", "navigation", "warning", "list_item", "bullet"
joined_ = lambda x: collapse_sql(f"array_to_string({x}, ' ')")
path_ = lambda x: "'(' || regexp_replace(" + collapse_sql(f"regexp_replace(array_to_string({x}, ' '), '\\s*>\\s*', ' > ', 'g')") + ", 'Software Update > Update$', 'Software Update > Auto Update') || ')'"
part_ = lambda kind, text: f"{{'kind': {kind}, 'text': {text}}}"
any_ = lambda starts, x="text": "(" + " OR ".join(f"starts_with({x}, {literal(s)})" for s in starts) + ")"
english_ = lambda x: f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda y: trim(y)), lambda y: y <> '')"

rule(
    rewrites.stray_markers, [[(B, "–")], [(X, "– 2."), (B, "text 1.")], [(U, "Auto"), (B, "Auto")], [(B, "1.")], [(B, "a 11.")], [(B, " 1.")], [(N, "( >"), (B, "1. 2. 3.")], [(B, "plain")]],
    f"a AS (SELECT doc, ord, kind, CASE WHEN ends_with(text, ' 1.') THEN trim(substr(text, 1, length(text) - 3)) ELSE text END AS text FROM items WHERE NOT (text IN ({quoted(rewrites.STRAY_MARKERS)}) OR (kind = 'ui_label' AND text = 'Auto') OR text = ' 1.'))", last="a",
)
rule(
    rewrites.cautions, [[(W, "CAUTION"), (B, ": hot.")], [(W, "CAUTION"), (B, "hot")], [(W, "CAUTION")], [(B, ": alone")], [(W, "CAUTION!"), (B, ": x")], [(B, "CAUTION"), (B, ": y")]],
    pattern_sql(["kind = 'warning' AND text = 'CAUTION'", "kind = 'body' AND starts_with(text, ':')"], "'warning'", collapse_sql("(t0 || t1)")),
)
rule(
    rewrites.caution_warnings, [[(W, "CAUTION: a. WARNING - b. WARNING - c")], [(W, "CAUTION: a")], [(W, "WARNING - a")], [(B, "CAUTION: a WARNING - b")], [(W, "CAUTION:WARNING -")]],
    split_sql("kind = 'warning' AND starts_with(text, 'CAUTION:') AND contains(text, 'WARNING -')", "[" + part_("'bullet'", "trim(substr(text, 1, instr(text, 'WARNING -') - 1))") + ", " + part_("'bullet'", "trim(substr(text, instr(text, 'WARNING -')))") + "]"),
)
_batteries = "This apparatus uses batteries. Keep them. Store the accessories well. Do not drop or strike the product."
rule(
    rewrites.operation_lists, [[(H, "Operation"), (B, _batteries)], [(H, "Other"), (B, _batteries)], [(B, _batteries)], [(H, "Operation"), (B, "Store the accessories.")], [(X, _batteries)], [(B, "This apparatus uses batteries")]],
    "h AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord) AS head FROM items)",
    split_sql(f"head = 'Operation' AND kind = 'body' AND starts_with(text, {literal(rewrites.BATTERIES)})", f"list_transform({english_('text')}, lambda s: {{'kind': CASE WHEN {any_(rewrites.OPERATION_STARTS, 's')} THEN 'bullet' ELSE kind END, 'text': s}})", "h"),
)
_names = "|".join(rewrites.PRECAUTION_STARTS)
_intro = literal(rewrites.PRECAUTION_INTRO)
rule(
    rewrites.precautions,
    [[(B, f"Always ensure a. {rewrites.PRECAUTION_INTRO} Always use cabinets b. Never place c.")], [(B, "Always route d. When you have e. f")], [(B, f"g {rewrites.PRECAUTION_INTRO} none")], [(X, "Never place h")], [(B, "i Never place j")], [(B, f"{rewrites.PRECAUTION_INTRO}If the existing k")]],
    f"q AS (SELECT *, contains(text, {_intro}) AS has, CASE WHEN contains(text, {_intro}) THEN instr(text, {_intro}) + {len(rewrites.PRECAUTION_INTRO)} ELSE 1 END AS begin FROM items)",
    f"r AS (SELECT *, substr(text, begin) AS tail, regexp_extract(substr(text, begin), '{_names}') AS hit FROM q)",
    split_sql(f"kind = 'body' AND (has OR {any_(rewrites.PRECAUTION_STARTS)}) AND hit <> ''", "list_concat([" + part_("kind", "trim(substr(text, 1, begin + instr(tail, hit) - 2))") + f"], list_transform(string_split(regexp_replace(substr(tail, instr(tail, hit)), '({_names})', chr(1) || '\\1', 'g'), chr(1))[2:], lambda y: {{'kind': 'bullet', 'text': trim(y)}}))", "r"),
)
rule(
    rewrites.wall_anchors,
    [[(H, rewrites.FALLING), (B, ": Wall-anchor (not supplied) a"), (X, "– b"), (B, "-"), (B, ": Wall-anchor c stand properly.")], [(H, rewrites.FALLING), (B, ": Wall-anchor (not supplied)"), (B, "–"), (B, "d")], [(B, ": Wall-anchor (not supplied) e"), (X, "f")], [(H, "Other"), (B, ": Wall-anchor (not supplied) g")], [(N, "> h")], [(X, "- i stand properly.")]],
    f"h AS (SELECT *, lag(kind) OVER w = 'heading' AND lag(text) OVER w = {literal(rewrites.FALLING)} AS head FROM items WINDOW w AS (PARTITION BY doc ORDER BY ord))",
    runs_sql(
        f"head AND kind = 'body' AND starts_with(text, {literal(rewrites.ANCHOR)})", "kind IN ('body', 'bullet') AND (text IN ('-', '–') OR kind = 'bullet' OR starts_with(text, ': Wall-anchor'))", "false", "'body'",
        f"trim(regexp_replace({joined_('list_transform(list_filter(parts, lambda y: y NOT IN (' + quoted(('-', '–')) + ')), lambda y: trim(regexp_replace(y, ' + literal('^[-–][ ]*') + ', ' + literal('') + ')))')}, ' stand properly[.]$', ''))", "h",
    ),
)
rule(
    rewrites.frame_conditions, [[(B, "(The Frame only) Use it.")], [(B, "(The Frame only)")], [(X, "(The Frame only) no")], [(B, "(The Frame only)  ")], [(B, "see (The Frame only) x")]],
    split_sql("kind = 'body' AND starts_with(text, '(The Frame only) ')", "[" + part_("'condition_label'", "'(The Frame only)'") + ", " + part_("'body'", "trim(substr(text, 18))") + "]"),
)
rule(
    rewrites.model_scopes, [[(B, "(QX12 only) Hold it.")], [(B, "(QX12 only)")], [(B, "(see (a) below) text")], [(B, "(except for The Frame) Use (it).")], [(X, "(QX12 only) no")], [(B, "(only) text")], [(B, "plain")]],
    split_sql(
        r"kind = 'body' AND regexp_matches(text, '^\([^()]*(?:QX12|The Frame)[^()]*\)') AND regexp_matches(text, '\b(?:only|except for)\b')",
        "[" + part_("'condition_label'", r"regexp_extract(text, '^\([^()]*\)')") + ", " + part_("'body'", r"trim(regexp_replace(text, '^\([^()]*\)', ''))") + "]",
    ),
)
rule(
    rewrites.action_labels, [[(B, rewrites.ACTION_INTRO + "."), (B, "Bending"), (B, "Pulling"), (B, "other")], [(X, rewrites.ACTION_INTRO), (B, "Twisting")], [(B, "Bending")], [(B, rewrites.ACTION_INTRO), (X, "Bending"), (B, "Pulling")], [(B, rewrites.ACTION_INTRO)]],
    f"h AS (SELECT *, starts_with(lag(text) OVER (PARTITION BY doc ORDER BY ord), {literal(rewrites.ACTION_INTRO)}) AS intro FROM items)",
    runs_sql(f"intro AND kind = 'body' AND text IN ({quoted(rewrites.ACTION_LABELS)})", f"kind = 'body' AND text IN ({quoted(rewrites.ACTION_LABELS)})", "false", "'figure_action_labels'", "array_to_string(parts, chr(10))", "h"),
)
_route = "before LIKE '%#route'"
_bare = "regexp_replace(kind, '#route$', '')"
rule(
    rewrites.troubleshooting,
    [[(B, 'Please refer to "'), (U, "Support"), (B, '" in the User Guide.'), (N, ">"), (U, "Settings"), (B, "Troubleshooting"), (N, ")"), (B, "x")], [(B, 'refer to "'), (U, "Support"), (B, '" in the user guide'), (N, ")"), (N, "y")], [(B, 'refer to "'), (U, "Support"), (B, "no")], [(B, "Troubleshooting"), (N, "> z")], [(N, "> w")], [(U, "All")], [(B, 'refer to "'), (U, "A"), (B, '" in the user guide'), (B, "Troubleshooting")]],
    pattern_sql(["kind = 'body' AND ends_with(text, 'refer to \"')", "kind = 'ui_label'", "kind = 'body' AND starts_with(lower(text), '\" in the user guide')"], "'body#route'", collapse_sql("(t0 || t1 || t2)"), name="a"),
    marked_sql("a", "b"), drop_sql(f"{_route} AND kind IN ('navigation', 'ui_label') AND text = ')'", "b", "c"), marked_sql("c", "d"),
    runs_sql(f"{_route} AND kind IN ('navigation', 'ui_label')", "kind IN ('navigation', 'ui_label') OR (kind = 'body' AND text = 'Troubleshooting')", "kind IN ('navigation', 'ui_label') AND text = ')'", "'navigation'", path_("list_filter(parts, lambda y: y <> ')')"), "d", "e"),
    f"out AS (SELECT doc, ord, {_bare} AS kind, text FROM e)",
)
rule(
    rewrites.update_fragments, [[(X, "upgrade to the latest"), (B, "software. Use the keys.")], [(B, "now upgrade to the latest"), (B, "software. Use the")], [(B, "upgrade to the latest"), (X, "software. Use the")], [(B, "software. Use the"), (B, "upgrade to the latest")], [(H, "upgrade to the latest"), (B, "software. Use the")]],
    pattern_sql(["kind IN ('body', 'bullet') AND ends_with(text, 'upgrade to the latest')", "kind = 'body' AND starts_with(text, 'software. Use the')"], "'body'", collapse_sql("(t0 || ' ' || t1)")),
)
_closing = [
    marked_sql("a", "b"), runs_sql(f"{_route} AND NOT (kind = 'body' AND starts_with(text, ')'))", "NOT (kind = 'body' AND starts_with(text, ')'))", "false", "'navigation#route'", path_("parts"), "b", "c"), marked_sql("c", "d"),
    split_sql(f"coalesce({_route}, false) AND kind = 'body' AND starts_with(text, ')')", "[" + part_("kind", "trim(regexp_replace(trim(text), '^\\)\\.?\\s*', ''))") + "]", "d", "e"), f"out AS (SELECT doc, ord, {_bare} AS kind, text FROM e)",
]
rule(
    rewrites.update_sentences,
    [[(B, "Now. Use the"), (U, "USB"), (B, "or"), (U, "Internet"), (B, "in the menu ("), (N, ">"), (U, "Update"), (B, "). Then it"), (B, "more")], [(X, "Use the"), (U, "A"), (N, "or"), (U, "B"), (B, "menu ("), (B, ")")], [(B, "Use the"), (U, "A"), (B, "and"), (U, "B"), (B, "menu (")], [(B, "plain"), (U, "C")], [(B, ") alone")]],
    pattern_sql(["kind IN ('body', 'bullet') AND ends_with(text, 'Use the')", "kind = 'ui_label'", "text = 'or'", "kind = 'ui_label'", "ends_with(text, 'menu (')"], "kind || '#route'", collapse_sql("(t0 || ' ' || t1 || ' or ' || t3 || ' ' || trim(substr(t4, 1, length(t4) - 1)))"), name="a"), *_closing,
)
rule(
    rewrites.inline_sentences, [[(B, "Try pressing the"), (U, "Power"), (B, "button . Now"), (X, "end.")], [(B, "You can turn on the TV with the."), (B, "next"), (B, "last.")], [(X, "Try pressing the"), (B, "no.")], [(B, "plain")]],
    runs_sql("kind = 'body' AND (starts_with(text, 'You can turn on the TV with the') OR starts_with(text, 'Try pressing the'))", "true", "ends_with(text, '.')", "kind", collapse_sql(f"replace({joined_('parts')}, ' . ', '. ')")),
)
rule(
    rewrites.remote_icons,
    [[(B, "press the button on the remote control at the remote control sensor")], [(N, "press the button on the remote control at the remote control sensor")], [(X, "On. To pair"), (B, "a Acme Smart Remote, press the"), (B, "and buttons together for 3 seconds.")], [(X, "On. To pair"), (B, "a Acme Smart Remote, press the"), (B, "other")], [(B, "press the button on the remote control")]],
    "i AS (SELECT doc, ord, kind, CASE WHEN kind IN ('body', 'bullet') AND contains(text, 'press the button on the remote control') AND contains(text, 'remote control sensor') THEN replace(text, 'press the button on the remote control', 'press the {btn_power} button on the remote control') ELSE text END AS text FROM items)",
    pattern_sql(["kind IN ('body', 'bullet') AND ends_with(text, '. To pair')", "kind = 'body' AND text = 'a Acme Smart Remote, press the'", "kind = 'body' AND text = 'and buttons together for 3 seconds.'"], "kind", "t0 || ' a Acme Smart Remote, press the {btn_return} and {btn_play_pause} buttons together for 3 seconds.'", "i"),
)
_menu = "(kind IN ('navigation', 'ui_label') OR (kind = 'body' AND text IN ('General &', 'Privacy')) OR text = '.')"
rule(
    rewrites.go_to_menus, [[(B, "Now go to"), (N, ">"), (U, "Settings"), (B, "General &"), (B, "Privacy"), (B, "."), (N, "x")], [(B, "go to"), (B, "."), (N, "> y")], [(B, "go to"), (B, "other")], [(X, "go to"), (N, "> z")], [(B, "go to"), (N, "> a"), (X, ".")], [(N, "> b")], [(B, "Privacy")]],
    "g AS (SELECT doc, ord, CASE WHEN kind = 'body' AND ends_with(text, 'go to') THEN 'body#route' ELSE kind END AS kind, text FROM items)", marked_sql("g", "b"), drop_sql(f"{_route} AND text = '.'", "b", "c"), marked_sql("c", "d"),
    runs_sql(f"{_route} AND {_menu}", _menu, "text = '.'", "'navigation'", path_("list_filter(parts, lambda y: y <> '.')"), "d", "e"), f"out AS (SELECT doc, ord, {_bare} AS kind, text FROM e)",
)
rule(
    rewrites.model_menus, [[(B, "(QX1:"), (N, ">"), (U, "Settings"), (B, ")"), (B, "x")], [(B, "((QX1 and QX2) :"), (N, "> (y :"), (N, ")")], [(X, "(QX1:"), (N, ")")], [(B, "(QX1"), (N, "z")], [(B, "(QX3:")]],
    runs_sql("kind = 'body' AND starts_with(text, '(') AND ends_with(text, ':')", "true", "text = ')'", "'navigation'", path_("list_filter(list_concat([substr(parts[1], 2)], parts[2:]), lambda y: y <> ')')")),
)
rule(
    rewrites.parenthetical_menus,
    [[(B, "Open"), (U, "Settings"), (B, "menu ("), (N, ">"), (U, "Sound"), (B, "). Then it"), (B, "x")], [(X, "Select"), (U, "A"), (B, "("), (B, ")"), (N, "> y")], [(H, "Head"), (U, "B"), (B, "z (")], [(U, "C"), (B, "no")], [(B, ") w")]],
    pattern_sql(["kind IN ('body', 'bullet') AND NOT (kind = 'body' AND ends_with(text, '('))", "kind = 'ui_label'", "kind = 'body' AND ends_with(text, '(')"], "kind || '#route'", collapse_sql("(t0 || ' ' || t1 || ' ' || trim(substr(t2, 1, length(t2) - 1)))"), name="a"), *_closing,
)
_note = r"(kind = 'list_item' AND regexp_matches(text, '^\*{1,2}:'))"
_item = f"(((kind = 'list_item' AND starts_with(text, '*')) OR (kind = 'bullet' AND (text = 'Simple User Guide' OR starts_with(text, 'Warranty Card / Regulatory Guide')))) AND NOT {_note})"
_inside = "bool_or(kind = 'heading' AND text = '01 Package Content') OVER (PARTITION BY doc ORDER BY ord)"
_texts = r"list_transform(parts, lambda y: trim(regexp_replace(CASE WHEN contains(y, ' *:') THEN split_part(y, ' *:', 1) ELSE y END, '^\*+', '')))"
_notes = "list_filter(list_transform(parts, lambda y: CASE WHEN contains(y, ' *:') THEN '*: ' || trim(substr(y, instr(y, ' *:') + 3)) ELSE '' END), lambda y: y <> '')"
rule(
    rewrites.package_contents,
    [[(H, "01 Package Content"), (L, "* Cable"), (L, "*Stand *: not all"), (X, "Simple User Guide")], [(L, "* Other"), (B, "x")], [(L, "*: only here"), (B, "depending on it"), (B, "on it"), (B, "onward")], [(H, "02 Next")], [(X, "Warranty Card / Regulatory Guide (y)"), (X, "z")], [(L, "plain")]],
    f"p AS (SELECT *, {_inside} AS inside FROM items)", runs_sql(f"inside AND {_item}", f"inside AND {_item}", "false", "'item_list'", f"array_to_string({_texts}, chr(10)) || chr(2) || coalesce({_notes}[-1], '')", "p", "a"),
    f"q AS (SELECT *, {_inside} AS inside FROM a)", runs_sql(f"inside AND {_note}", r"kind = 'body' AND regexp_matches(text, '^(on|depending)\b')", "false", "'item_list_note'", joined_("parts"), "q", "b"),
    split_sql("kind = 'item_list' AND contains(text, chr(2))", "[" + part_("'item_list'", "split_part(text, chr(2), 1)") + ", " + part_("'item_list_note'", "split_part(text, chr(2), 2)") + "]", "b"),
)
rule(
    rewrites.package_notice, [[(X, "Keep it. The screen can be damaged from direct pressure. Hold the edges.")], [(X, "The screen can be damaged from direct pressure")], [(B, "a The screen can be damaged from direct pressure")], [(X, "b")]],
    split_sql(f"kind = 'bullet' AND instr(text, {literal(rewrites.PRESSURE)}) > 1", "[" + part_("kind", f"trim(substr(text, 1, instr(text, {literal(rewrites.PRESSURE)}) - 1))") + ", " + part_("'figure_notice'", f"substr(text, instr(text, {literal(rewrites.PRESSURE)}))") + "]"),
)
rule(
    rewrites.controller_legend, [[(U, "Control menu TV Controller"), (B, "button / * Motion Sensor"), (U, "switch")], [(L, "*: a note"), (B, "x")], [(B, "*: no list"), (U, "Control menu")], [(B, "y")]],
    runs_sql("text = 'Control menu TV Controller'", "NOT (kind = 'list_item' AND starts_with(text, '*:'))", "false", "'figure_legend'", f"replace({joined_('parts')}, '/ * Motion Sensor', '/ Microphone switch Motion Sensor')"),
)
_rest = "trim(regexp_replace(trim(substr(t3, 7)), '^:+', ''))"
rule(
    rewrites.microphone_labels,
    [[(H, "Type A"), (H, "Type B"), (H, "Type C"), (B, "Type D : On/Off Switch Use it")], [(B, "Type A"), (B, "Type B"), (B, "Type C"), (X, "Type D")], [(B, "Type A"), (B, "Type B"), (B, "Type C"), (X, "Type D other text")], [(B, "Type A"), (B, "Type B"), (B, "Type D")], [(B, "Type A"), (B, "Type B"), (B, "Type C"), (B, "Type Data")], [(B, "x")]],
    pattern_sql(["text = 'Type A'", "text = 'Type B'", "text = 'Type C'", "starts_with(text, 'Type D')"], "k3 || '#route'", f"'Type A' || chr(10) || 'Type B' || chr(10) || 'Type C' || chr(10) || 'Type D' || chr(2) || {_rest}", name="a"),
    split_sql("ends_with(kind, '#route')", "[" + part_("'figure_variant_labels'", "split_part(text, chr(2), 1)") + ", " + part_("'figure_callout_label'", "CASE WHEN starts_with(split_part(text, chr(2), 2), 'On/Off Switch ') THEN 'On/Off Switch' ELSE '' END") + ", " + part_(_bare, "CASE WHEN starts_with(split_part(text, chr(2), 2), 'On/Off Switch ') THEN trim(substr(split_part(text, chr(2), 2), 14)) ELSE split_part(text, chr(2), 2) END") + "]", "a"),
)
_models = "list_transform(list_concat([substr(parts[1], 36)], parts[2:]), lambda y: trim(y, '/'))"
rule(
    rewrites.model_conditions, [[(B, rewrites.CONDITION_START + "AB1/"), (B, "CD2/The"), (B, "Frame."), (B, "tail")], [(B, rewrites.CONDITION_START + "AB3."), (X, "more"), (B, "(no)")], [(N, "x y!")], [(B, "This function")]],
    runs_sql(f"starts_with(text, {literal(rewrites.CONDITION_START)})", "regexp_matches(text, '^[A-Za-z0-9*/._ -]+\\.?$')", "ends_with(text, '.')", "'model_condition'", f"{literal(rewrites.CONDITION_START)} || replace(regexp_replace({collapse_sql('array_to_string(' + _models + ', ' + literal('/') + ')')}, '\\.+$', ''), '/The/Frame', '/The Frame') || '.'"),
)
_heads = "|".join(h.replace(".", "\\.") for h in rewrites.EMBEDDED_HEADINGS)
rule(
    rewrites.embedded_headings,
    [[(B, "a Preventing the TV from falling b. Precautions when installing the TV with a stand")], [(B, 'see "Preventing the TV from falling" c')], [(H, "Preventing the TV from falling")], [(X, "The remote control does not work.")], [(B, 'open " Preventing the TV from falling')], [(B, "“Preventing the TV from falling” and How to turn on and off the Microphone")]],
    split_sql(
        f"kind NOT IN ('heading', 'spec_table') AND regexp_matches(text, '{_heads}')",
        f"list_transform(string_split(regexp_replace(regexp_replace(text, '(\"[^\"]*(?:\"|$)|“[^”]*(?:”|$))|({_heads})', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1) || chr(1), '', 'g'), chr(1)), lambda y: {{'kind': CASE WHEN y IN ({quoted(rewrites.EMBEDDED_HEADINGS)}) THEN 'heading' ELSE kind END, 'text': CASE WHEN y = 'Precautions when installing the TV with a' THEN y || ' stand' ELSE trim(y) END}})",
    ),
)
_steps = [literal(x) for x in rewrites.ANCHOR_STEPS]
_procedure = " ".join((": Wall-anchor (not supplied)", rewrites.ANCHOR_STEPS[0], "More. ", rewrites.ANCHOR_STEPS[1], rewrites.ANCHOR_STEPS[2], "with a cable."))
rule(
    rewrites.anchor_steps, [[(H, rewrites.FALLING), (B, _procedure), (B, "x")], [(H, "Other"), (B, _procedure)], [(H, rewrites.FALLING), (X, _procedure), (B, ": Wall-anchor (not supplied) " + rewrites.ANCHOR_STEPS[1])], [(B, _procedure)]],
    "h AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord) AS head, trim(substr(text, 29)) AS rest FROM items)", f"s AS (SELECT *, instr(rest, {_steps[0]}) AS a, instr(rest, {_steps[1]}) AS b, instr(rest, {_steps[2]}) AS c FROM h)",
    split_sql(f"head = {literal(rewrites.FALLING)} AND kind = 'body' AND starts_with(text, ': Wall-anchor (not supplied) ') AND a > 0 AND a <= b AND b <= c", "[" + part_("'procedure_note'", "'Wall-anchor (not supplied)'") + ", " + ", ".join(part_("'numbered_step'", f"'{i}. ' || trim(regexp_replace(substr(rest, {x}, {y}), ' +', ' ', 'g'))") for i, (x, y) in enumerate((("a", "b - a"), ("b", "c - b"), ("c", "length(rest)")), 1)) + "]", "s"),
)
