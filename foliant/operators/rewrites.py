"""Rewrites of ordered items (keys, ord, kind, text), each stated as windows over a key's items.

Four shapes cover the chain: drop, retell, split (one item into several) and join (several into one).  All windows are
partitioned by the same keys, so a chain of rewrites shuffles its items once.  `ord` stays in order and unique; renumbered()
closes its gaps."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import review as R
from foliant.functions import text as T


def renumbered(items: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """keys, ord (from 0 in the given order), kind, text."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return items.select(*keys, at.alias("_at"), "kind", "text").withColumnRenamed("_at", "ord")


def dropped(items: DataFrame, keys: list[str], when: Column) -> DataFrame:
    """The items for which `when` does not hold, without helper columns."""
    return items.select(*keys, "ord", "kind", "text", when.alias("_when")).where(~F.coalesce("_when", F.lit(False))).drop("_when")


def retold(items: DataFrame, when: Column, kind: Column | None = None, text: Column | None = None) -> DataFrame:
    """Items for which `when` holds get another kind or text, in place."""
    hit = F.coalesce(when, F.lit(False))
    change = {name: F.when(hit, new).otherwise(F.col(name)) for name, new in (("kind", kind), ("text", text)) if new is not None}
    return items.withColumns(change)


def piece(kind: Column, text: Column) -> Column:
    return F.struct(kind.alias("kind"), text.alias("text"))


def split(items: DataFrame, keys: list[str], when: Column, pieces: Column) -> DataFrame:
    """An item for which `when` holds becomes its pieces (an array of `piece`), empty texts left out.

    An item whose pieces are all empty goes; a null condition leaves an item as it is."""
    whole = F.array(piece(F.col("kind"), F.col("text")))
    # empty pieces go as rows: a filter of the array would have all that makes it up interpreted
    rows = items.withColumn("_when", F.coalesce(when, F.lit(False)))
    rows = rows.select(*keys, "ord", "_when", F.posexplode(F.when(F.col("_when"), pieces).otherwise(whole)).alias("_part", "_p"))
    rows = rows.where(~F.col("_when") | (F.btrim("_p.text") != ""))
    return renumbered(rows.select(*keys, "ord", "_part", F.col("_p.kind").alias("kind"), F.col("_p.text").alias("text")), keys, "ord", "_part")


def joined_runs(items: DataFrame, keys: list[str], opens: Column, follows: Column, ends: Column, kind: Column, text: Callable[[Column], Column]) -> DataFrame:
    """An item that opens a run takes in the items behind it while they follow, up to and including one that ends it.

    `text` makes the run's text from the array of its items' texts; `kind` is the run's (seen from its first item).  An
    item that opens does not end a run, and inside a run an item that could open another one follows like the rest.

    A run cannot cross an item that does not follow, nor the place behind an item that ends; between two such places
    the first opener opens, so a running sum and a running maximum find the runs."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = items.withColumns({"_opens": yes(opens), "_follows": yes(follows), "_ends": yes(ends) & ~yes(opens)})
    cut = ~F.col("_follows") | F.coalesce(F.lag("_ends").over(w), F.lit(True))
    rows = rows.withColumn("_stretch", F.sum(cut.cast("int")).over(w))
    inside = Window.partitionBy(*keys, "_stretch").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_first", F.min(F.when(F.col("_opens"), F.col("ord"))).over(inside))
    rows = rows.withColumn("_run", F.coalesce("_first", "ord")).withColumn("_kind", F.when(F.col("_first").isNotNull(), kind).otherwise(F.col("kind")))
    grouped = rows.groupBy(*keys, "_run").agg(F.min_by("_kind", "ord").alias("kind"), F.min_by("text", "ord").alias("_own"), F.max(F.col("_first").isNotNull()).alias("_open"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("_parts"))
    told = F.when(F.col("_open"), text(F.transform("_parts", lambda p: p["text"]))).otherwise(F.col("_own"))
    return grouped.select(*keys, F.col("_run").alias("ord"), "kind", told.alias("text"))


def joined_pattern(items: DataFrame, keys: list[str], pattern: list[Column], kind: Column, text: Callable[[list[Column]], Column]) -> DataFrame:
    """Consecutive items that satisfy the conditions one by one become one item.

    No item may satisfy both the first condition and a later one, so matches cannot overlap."""
    w = Window.partitionBy(*keys).orderBy("ord")
    n = len(pattern)
    rows = items.withColumns({f"_c{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(pattern)})
    whole = F.col("_c0")
    for i in range(1, n):
        whole = whole & F.coalesce(F.lead(f"_c{i}", i).over(w), F.lit(False))
    rows = rows.withColumn("_starts", whole)
    taken = F.lit(False)
    for i in range(1, n):
        taken = taken | F.coalesce(F.lag("_starts", i).over(w), F.lit(False))
    texts = [F.col("text"), *[F.lead("text", i).over(w) for i in range(1, n)]]
    rows = rows.withColumns({"_taken": taken, "_text": F.when(F.col("_starts"), text(texts)).otherwise(F.col("text")), "_kind": F.when(F.col("_starts"), kind).otherwise(F.col("kind"))})
    return rows.where(~F.col("_taken")).select(*keys, "ord", F.col("_kind").alias("kind"), F.col("_text").alias("text"))


def forward(items: DataFrame, keys: list[str], name: str, heading: str) -> DataFrame:
    """Adds `name`: the last heading at or before the item is this one."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return items.withColumn(name, F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(w) == heading, F.lit(False)))


# Words and phrases that the rules below look for.
STRAY_MARKERS = ("– 2.", "– 3.", "–", "– stand properly.", "( >", "1. 2. 3.")
OPERATION, BATTERIES = "Operation", "This apparatus uses batteries."
OPERATION_STARTS = (
    "This apparatus uses batteries.", "In your community, there might be environmental regulations", "Please contact your local authorities", "Store the accessories", "Do not drop or strike the product.",
    "If the product is damaged,", "Do not dispose of remote control or batteries in a fire.", "Do not short-circuit, disassemble, or overheat the batteries.", "After removing the screen protective film,",
    "If the protective film removal label is not found,",
)
PRECAUTION_INTRO = "Many injuries can be avoided by taking simple precautions such as:"
PRECAUTION_STARTS = ("Always use cabinets", "Always use furniture", "Always ensure", "Always educate", "Always route", "Never place", "If the existing", "When you have")
FALLING, ANCHOR, ANCHOR_START, STAND_TAIL = "Preventing the TV from falling", ": Wall-anchor (not supplied)", ": Wall-anchor", " stand properly."
ANCHOR_STEPS = (
    "Using the appropriate screws, firmly fasten a set of brackets to the wall.", "Using the appropriately sized screws, firmly fasten a set of brackets to the TV.",
    "Connect the brackets fixed to the TV and the brackets fixed to the wall",
)
FRAME_ONLY = "(The Frame only)"
ACTION_LABELS = ("Bending", "Twisting", "Pulling", "Pressing on", "Electric shock")
ACTION_INTRO = "Take care not to subject the cable to any of the actions below"
REFER, IN_GUIDE, TROUBLESHOOTING = 'refer to "', '" in the user guide', "Troubleshooting"
UPGRADE, SOFTWARE, USE_THE, MENU_OPEN = "upgrade to the latest", "software. Use the", "Use the", "menu ("
INLINE_STARTS = ("You can turn on the TV with the", "Try pressing the")
PRESS, SENSOR, PRESS_ICON = "press the button on the remote control", "remote control sensor", "press the {btn_power} button on the remote control"
TO_PAIR, TOGETHER, PAIR_ICONS = ". To pair", "and buttons together for 3 seconds.", "{btn_return} and {btn_play_pause} buttons together for 3 seconds."
GO_TO, NAVIGATION_BODIES = "go to", ("General &", "Privacy")
PACKAGE_HEADING = "01 Package Content"
PRESSURE = "The screen can be damaged from direct pressure"
LEGEND, LEGEND_OLD, LEGEND_NEW = "Control menu TV Controller", "/ * Motion Sensor", "/ Microphone switch Motion Sensor"
VARIANTS, SWITCH = ("Type A", "Type B", "Type C", "Type D"), "On/Off Switch"
CONDITION_START = "This function is supported only in "

KIND, TEXT = "kind", "text"


def _c() -> tuple[Column, Column]:
    return F.col(KIND), F.col(TEXT)


def starts_with_any(x: Column, starts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | x.startswith(s)
    return out


def without_suffix(x: Column, suffix: str) -> Column:
    return F.when(x.endswith(suffix), F.btrim(F.substring(x, F.lit(1), F.length(x) - len(suffix)))).otherwise(x)


def without_prefix(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), F.substring(x, len(prefix) + 1, F.length(x))).otherwise(x)


def stray_markers(items: DataFrame, keys: list[str]) -> DataFrame:
    """Markers that belong to nothing go, as does a lone "Auto" label; a step's number behind a text is cut off."""
    kind, text = _c()
    out = dropped(items, keys, text.isin(*STRAY_MARKERS) | ((kind == "ui_label") & (text == "Auto")) | (text == " 1."))
    return retold(out, text.endswith(" 1."), text=without_suffix(text, " 1."))


def cautions(items: DataFrame, keys: list[str]) -> DataFrame:
    """A bare CAUTION takes the colon text behind it."""
    kind, text = _c()
    return joined_pattern(items, keys, [(kind == "warning") & (text == "CAUTION"), (kind == "body") & text.startswith(":")], F.lit("warning"), lambda t: T.collapsed(F.concat(*t)))


def caution_warnings(items: DataFrame, keys: list[str]) -> DataFrame:
    """A caution and the warning behind it in one text part."""
    kind, text = _c()
    at = F.instr(text, "WARNING -")
    parts = [F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))]
    return split(items, keys, (kind == "warning") & text.startswith("CAUTION:") & (at > 0), F.array(*[piece(F.lit("bullet"), T.collapsed(p)) for p in parts]))


def operation_lists(items: DataFrame, keys: list[str]) -> DataFrame:
    """In the section on operation, the text on batteries becomes its sentences; those with a known start are bullets."""
    kind, text = _c()
    rows = forward(items, keys, "_operation", OPERATION)
    parts = F.transform(T.split_sentences(text, F.lit(True)), lambda s: piece(F.when(starts_with_any(s, OPERATION_STARTS), "bullet").otherwise(kind), s))
    return split(rows, keys, F.col("_operation") & (kind == "body") & text.startswith(BATTERIES), parts)


def precautions(items: DataFrame, keys: list[str]) -> DataFrame:
    """A list of precautions: what leads it stays, each precaution becomes a bullet."""
    kind, text = _c()
    has, names = text.contains(PRECAUTION_INTRO), "|".join(PRECAUTION_STARTS)
    begin = F.when(has, F.instr(text, PRECAUTION_INTRO) + len(PRECAUTION_INTRO)).otherwise(1)
    tail = F.substring(text, begin, F.length(text))
    at = F.regexp_instr(tail, F.lit(f"(?:{names})"))
    intro = F.substring(text, F.lit(1), begin + at - 2)
    bullets = F.transform(T.pieces_from(F.substring(tail, at, F.length(tail)), PRECAUTION_STARTS), lambda p: piece(F.lit("bullet"), p))
    return split(items, keys, (kind == "body") & (has | starts_with_any(text, PRECAUTION_STARTS)) & (at > 0), F.concat(F.array(piece(kind, T.collapsed(intro))), bullets))


def wall_anchors(items: DataFrame, keys: list[str]) -> DataFrame:
    """Behind the heading on falling, the fragments of the wall anchor's procedure become one text."""
    kind, text = _c()
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = items.withColumn("_head", F.coalesce((F.lag(KIND).over(w) == "heading") & (F.lag(TEXT).over(w) == FALLING), F.lit(False)))
    dash = text.isin("-", "–")
    told = lambda p: without_suffix(T.collapsed(F.array_join(F.transform(F.filter(p, lambda x: ~x.isin("-", "–")), lambda x: T.collapsed(F.regexp_replace(x, r"^[\-–]\s*", ""))), " ")), STAND_TAIL)
    more = kind.isin("body", "bullet") & (dash | (kind == "bullet") | text.startswith(ANCHOR_START))
    return joined_runs(rows, keys, F.col("_head") & (kind == "body") & text.startswith(ANCHOR), more, F.lit(False), F.lit("body"), told)


def frame_conditions(items: DataFrame, keys: list[str]) -> DataFrame:
    kind, text = _c()
    return split(items, keys, (kind == "body") & text.startswith(f"{FRAME_ONLY} "), F.array(piece(F.lit("condition_label"), F.lit(FRAME_ONLY)), piece(F.lit("body"), F.btrim(without_prefix(text, f"{FRAME_ONLY} ")))))


def model_scopes(items: DataFrame, keys: list[str]) -> DataFrame:
    """A condition on models that a text is, begins with, or has behind the laser class becomes a label of its own."""
    kind, text = _c()
    # each step a column of its own, so that none is worked out where another one names it
    rows = items.withColumns({"_end": R.closing(text, F.lit(1)), "_opens": R.laser_opens(text)})
    rows = rows.withColumn("_stop", R.closing(text, F.col("_opens")))
    rows = rows.withColumn("_parts", F.when((kind == "body") & text.contains("("), R.condition_parts(text, F.col("_end"), F.col("_stop"))))
    return split(rows, keys, F.col("_parts").isNotNull(), F.col("_parts"))


def action_labels(items: DataFrame, keys: list[str]) -> DataFrame:
    kind, text = _c()
    label = (kind == "body") & text.isin(*ACTION_LABELS)
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = items.withColumn("_intro", F.coalesce(F.lag(TEXT).over(w).startswith(ACTION_INTRO), F.lit(False)))
    return joined_runs(rows, keys, label & F.col("_intro"), label, F.lit(False), F.lit("figure_action_labels"), lambda p: F.array_join(p, "\n"))


ROUTE = "#route"  # marks, within one rule, an item that a menu path follows


def unmarked(items: DataFrame) -> DataFrame:
    return items.withColumn(KIND, F.regexp_replace(KIND, f"{ROUTE}$", ""))


def after_route(items: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `_routed`: the item before is marked."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return items.withColumn("_routed", F.coalesce(F.lag(KIND).over(w).endswith(ROUTE), F.lit(False)))


def troubleshooting(items: DataFrame, keys: list[str]) -> DataFrame:
    """A reference to the guide in three parts becomes one text, the menu path behind it one item; its parenthesis goes."""
    kind, text = _c()
    pattern = [(kind == "body") & text.endswith(REFER), kind == "ui_label", (kind == "body") & F.lower(text).startswith(IN_GUIDE)]
    rows = after_route(joined_pattern(items, keys, pattern, F.lit(f"body{ROUTE}"), lambda t: T.collapsed(F.concat(*t))), keys)
    part = kind.isin("navigation", "ui_label")
    rows = dropped(rows, keys, F.col("_routed") & part & (text == ")"))
    rows = after_route(rows, keys)
    more = part | ((kind == "body") & (text == TROUBLESHOOTING))
    return unmarked(joined_runs(rows, keys, F.col("_routed") & part, more, part & (text == ")"), F.lit("navigation"), lambda p: R.menu_path(F.filter(p, lambda x: x != ")"))))


def update_fragments(items: DataFrame, keys: list[str]) -> DataFrame:
    kind, text = _c()
    return joined_pattern(items, keys, [kind.isin("body", "bullet") & text.endswith(UPGRADE), (kind == "body") & text.startswith(SOFTWARE)], F.lit("body"), lambda t: T.collapsed(F.concat_ws(" ", *t)))


def routed_to_parenthesis(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Behind a marked item, everything up to a text that closes the parenthesis is a menu path; of that text, what stands
    behind the parenthesis stays."""
    kind, text = _c()
    closes = (kind == "body") & text.startswith(")")
    rows = joined_runs(after_route(rows, keys), keys, F.col("_routed") & ~closes, ~closes, F.lit(False), F.lit(f"navigation{ROUTE}"), R.menu_path)
    rows = after_route(rows, keys)
    rest = T.after_parenthesis(text)
    rows = split(rows, keys, F.col("_routed") & closes, F.array(piece(kind, rest)))
    return unmarked(rows)


def update_sentences(items: DataFrame, keys: list[str]) -> DataFrame:
    """A sentence that two labels and a menu interrupt becomes one text, its menu path one item."""
    kind, text = _c()
    pattern = [kind.isin("body", "bullet") & text.endswith(USE_THE), kind == "ui_label", text == "or", kind == "ui_label", text.endswith(MENU_OPEN)]
    told = lambda t: T.collapsed(F.concat_ws(" ", t[0], t[1], F.lit("or"), t[3], without_suffix(t[4], "(")))
    return routed_to_parenthesis(joined_pattern(items, keys, pattern, F.concat(kind, F.lit(ROUTE)), told), keys)


def inline_sentences(items: DataFrame, keys: list[str]) -> DataFrame:
    kind, text = _c()
    return joined_runs(items, keys, (kind == "body") & starts_with_any(text, INLINE_STARTS), F.lit(True), text.endswith("."), kind, lambda p: T.collapsed(F.replace(T.collapsed(F.array_join(p, " ")), F.lit(" . "), F.lit(". "))))


def remote_icons(items: DataFrame, keys: list[str], brand: str) -> DataFrame:
    """Buttons that the text leaves out, as icons, are put in as tokens."""
    kind, text = _c()
    written = kind.isin("body", "bullet")
    rows = retold(items, written & text.contains(PRESS) & text.contains(SENSOR), text=F.replace(text, F.lit(PRESS), F.lit(PRESS_ICON)))
    remote = f"a {brand} Smart Remote, press the"
    pattern = [written & text.endswith(TO_PAIR), (kind == "body") & (text == remote), (kind == "body") & (text == TOGETHER)]
    return joined_pattern(rows, keys, pattern, kind, lambda t: T.collapsed(F.concat(t[0], F.lit(f" {remote} {PAIR_ICONS}"))))


def go_to_menus(items: DataFrame, keys: list[str]) -> DataFrame:
    """Behind a body that ends in "go to", the menu's parts become one path; the full stop behind them goes."""
    kind, text = _c()
    rows = retold(items, (kind == "body") & text.endswith(GO_TO), kind=F.lit(f"body{ROUTE}"))
    rows = after_route(dropped(after_route(rows, keys), keys, F.col("_routed") & (text == ".")), keys)
    part = kind.isin("navigation", "ui_label") | ((kind == "body") & text.isin(*NAVIGATION_BODIES)) | (text == ".")
    return unmarked(joined_runs(rows, keys, F.col("_routed") & part, part, text == ".", F.lit("navigation"), lambda p: R.menu_path(F.filter(p, lambda x: x != "."))))


def model_menus(items: DataFrame, keys: list[str]) -> DataFrame:
    """A body that opens a parenthesis and ends in a colon begins a menu path, up to the closing parenthesis."""
    kind, text = _c()
    told = lambda p: R.menu_path(F.filter(F.transform(p, lambda x, i: F.when(i == 0, without_prefix(x, "(")).otherwise(x)), lambda x: x != ")"))
    return joined_runs(items, keys, (kind == "body") & text.startswith("(") & text.endswith(":"), F.lit(True), text == ")", F.lit("navigation"), told)


def parenthetical_menus(items: DataFrame, keys: list[str]) -> DataFrame:
    """A label and a text that opens a parenthesis, behind a body or bullet that opens none, join it; then comes a menu path."""
    kind, text = _c()
    opens = (kind == "body") & text.endswith("(")
    pattern = [kind.isin("body", "bullet") & ~opens, kind == "ui_label", opens]
    told = lambda t: T.collapsed(F.concat_ws(" ", t[0], t[1], without_suffix(t[2], "(")))
    return routed_to_parenthesis(joined_pattern(items, keys, pattern, F.concat(kind, F.lit(ROUTE)), told), keys)


def package_contents(items: DataFrame, keys: list[str]) -> DataFrame:
    """From the heading of the package's contents on, runs of listed items become one list, a line each, with the last note
    behind it; a note takes in what goes on with it."""
    kind, text = _c()
    w = Window.partitionBy(*keys).orderBy("ord")
    inside = F.coalesce(F.max((kind == "heading") & (text == PACKAGE_HEADING)).over(w), F.lit(False))
    rows = items.withColumn("_inside", inside)
    listed = F.col("_inside") & R.is_package_item(kind, text)
    mark = "\x02"

    def told(p: Column) -> Column:
        parts = F.transform(p, R.package_item)
        notes = F.filter(F.transform(parts, lambda x: x["note"]), lambda n: n != "")
        return F.concat(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), F.lit(mark), F.coalesce(F.get(notes, F.size(notes) - 1), F.lit("")))

    rows = joined_runs(rows, keys, listed, listed, F.lit(False), F.lit("item_list"), told)
    rows = rows.withColumn("_inside", inside)
    note = F.col("_inside") & R.is_package_note(kind, text)
    rows = joined_runs(rows, keys, note, R.is_package_note_more(kind, text), F.lit(False), F.lit("item_list_note"), lambda p: T.collapsed(F.array_join(p, " ")))
    two = F.array(piece(F.lit("item_list"), F.substring_index(text, mark, 1)), piece(F.lit("item_list_note"), F.substring_index(text, mark, -1)))
    return split(rows, keys, (kind == "item_list") & text.contains(mark), two)


def package_notice(items: DataFrame, keys: list[str]) -> DataFrame:
    kind, text = _c()
    at = F.instr(text, PRESSURE)
    parts = F.array(piece(kind, T.collapsed(F.substring(text, F.lit(1), at - 1))), piece(F.lit("figure_notice"), T.collapsed(F.substring(text, at, F.length(text)))))
    return split(items, keys, (kind == "bullet") & (at > 1), parts)


def controller_legend(items: DataFrame, keys: list[str]) -> DataFrame:
    """The controller's legend takes in everything up to the first note."""
    kind, text = _c()
    note = (kind == "list_item") & text.startswith(T.NOTE_START)
    return joined_runs(items, keys, text == LEGEND, ~note, F.lit(False), F.lit("figure_legend"), lambda p: F.replace(T.collapsed(F.array_join(p, " ")), F.lit(LEGEND_OLD), F.lit(LEGEND_NEW)))


def microphone_labels(items: DataFrame, keys: list[str]) -> DataFrame:
    """Four variant labels become one item; what stands behind the last is a switch's label and text, or a text."""
    kind, text = _c()
    mark = "\x02"
    pattern = [*[text == v for v in VARIANTS[:3]], text.startswith(VARIANTS[3])]
    w = Window.partitionBy(*keys).orderBy("ord")
    last = F.coalesce(F.lead(KIND, 3).over(w), kind)
    rest = lambda t: F.btrim(without_prefix(t, VARIANTS[3]))
    rows = joined_pattern(items.withColumn("_last", last), keys, pattern, F.concat(F.col("_last"), F.lit(ROUTE)), lambda t: F.concat(F.lit("\n".join(VARIANTS) + mark), F.btrim(F.regexp_replace(rest(t[3]), "^:+", ""))))
    own, tail = F.regexp_replace(KIND, f"{ROUTE}$", ""), F.substring_index(text, mark, -1)
    switch = tail.startswith(f"{SWITCH} ")
    parts = F.array(
        piece(F.lit("figure_variant_labels"), F.substring_index(text, mark, 1)), piece(F.lit("figure_callout_label"), F.when(switch, SWITCH).otherwise("")),
        piece(own, F.when(switch, F.btrim(without_prefix(tail, SWITCH))).otherwise(tail)),
    )
    return split(rows, keys, kind.endswith(ROUTE), parts)


def model_conditions(items: DataFrame, keys: list[str]) -> DataFrame:
    """A statement of the supported models takes in the models behind it, up to a full stop."""
    _, text = _c()
    return joined_runs(items, keys, text.startswith(CONDITION_START), R.is_model_more(text), text.endswith("."), F.lit("model_condition"), condition_text)


def condition_text(parts: Column) -> Column:
    """One sentence that names all models, separated by slashes."""
    bare = F.transform(parts, lambda p, i: F.btrim(F.when(i == 0, without_prefix(p, CONDITION_START)).otherwise(p), F.lit("/")))
    return F.concat(F.lit(CONDITION_START), T.model_text(F.array_join(bare, "/")), F.lit("."))


STAGE_RULES = 3
#: The review chain, in its fixed order.
CHAIN = (
    stray_markers, cautions, caution_warnings, operation_lists, precautions, wall_anchors, frame_conditions, model_scopes, action_labels, troubleshooting, update_fragments, update_sentences, inline_sentences,
    remote_icons, go_to_menus, model_menus, parenthetical_menus, package_contents, package_notice, controller_legend, microphone_labels, model_conditions,
)


def may_change(kind: Column, text: Column) -> Column:
    """Whether an item can be what a rule begins with: no item that fails this is changed unless another in its key passes."""
    whole = text.isin(*STRAY_MARKERS, "Auto", "CAUTION", LEGEND, VARIANTS[0], FALLING, PACKAGE_HEADING)
    ends = text.rlike(f"(?:{'|'.join(map(re.escape, (' 1.', REFER, UPGRADE, USE_THE, TO_PAIR, GO_TO, ':', '(')))})$")
    holds = (BATTERIES, PRECAUTION_INTRO, ACTION_INTRO, *PRECAUTION_STARTS, *INLINE_STARTS, PRESS, PRESSURE, CONDITION_START, "LASER PRODUCT", "CAUTION:")
    return whole | ends | text.startswith("(") | text.rlike("|".join(map(re.escape, holds)))


def prepared(items: DataFrame, keys: list[str], brand: str = "") -> DataFrame:
    """The whole chain over items whose texts are collapsed first; `brand` names the maker in the remote control's rule.

    All windows of the chain have one partitioning; keys without any item that a rule could begin with go past the chain.
    A task carries the plan of its whole stage, so a long chain is cut into stages of STAGE_RULES rules."""
    out = renumbered(items.withColumn(TEXT, T.collapsed(F.coalesce(TEXT, F.lit("")))), keys, "ord")
    out = out.withColumn("_may", F.bool_or(may_change(*_c())).over(Window.partitionBy(*keys)))
    rest = out.where(~F.col("_may")).drop("_may")
    out = out.where("_may").drop("_may")
    for i, rule in enumerate(CHAIN):
        if i and i % STAGE_RULES == 0:
            out = out.repartition(*keys)
        out = rule(out, keys, brand) if rule is remote_icons else rule(out, keys)
    return renumbered(out.unionByName(rest), keys, "ord")


# Texts inside which a heading begins, and the heading.
EMBEDDED_HEADINGS = {
    "Providing proper ventilation for your TV": "Providing proper ventilation for your TV", "Preventing the TV from falling": "Preventing the TV from falling",
    "Precautions when installing the TV with a": "Precautions when installing the TV with a stand", "How to turn on and off the Microphone": "How to turn on and off the Microphone",
    "The remote control does not work.": "The remote control does not work.",
}


def embedded_headings(items: DataFrame, keys: list[str], headings: dict[str, str] = EMBEDDED_HEADINGS) -> DataFrame:
    """Headings (trigger to heading) that stand inside other items' texts, outside quotes, become items of their own.

    An open quote reaches to the text's end."""
    opening, closing = "\x01", "\x02"
    quoted = '"[^"]*(?:"|$)|“[^”]*(?:”|$)'
    names = "|".join(re.escape(h) for h in sorted(headings, key=len, reverse=True))
    # quotes are matched first, and put back unchanged, so a heading inside them is not seen
    cut = F.regexp_replace(F.col(TEXT), f"({quoted})|({names})", "$1" + opening + "$2" + closing)
    parts = F.filter(F.split(F.regexp_replace(cut, opening + closing, ""), f"[{opening}{closing}]"), lambda p: F.btrim(p) != "")
    told = F.create_map(*[F.lit(x) for pair in headings.items() for x in pair])
    pieces = F.transform(parts, lambda p: piece(F.when(p.isin(*headings), "heading").otherwise(F.col(KIND)), F.coalesce(told[p], F.btrim(p))))
    return split(items, keys, ~F.col(KIND).isin("heading", "spec_table") & F.col(TEXT).rlike(names), pieces)


def anchor_steps(items: DataFrame, keys: list[str]) -> DataFrame:
    """In the section on falling, the wall anchor's procedure becomes a note and three numbered steps, if it has all three."""
    kind, text = _c()
    rows = forward(items, keys, "_falling", FALLING)
    told = F.col("_falling") & (kind == "body") & text.startswith(f"{ANCHOR} ")
    rows = rows.withColumn("_rest", F.when(told, F.btrim(without_prefix(text, ANCHOR))))
    rows = rows.withColumn("_found", F.when(F.col("_rest").isNotNull(), T.steps(F.col("_rest"), ANCHOR_STEPS)))
    steps = [piece(F.lit("numbered_step"), F.concat(F.lit(f"{i + 1}. "), F.get("_found", F.lit(i)))) for i in range(len(ANCHOR_STEPS))]
    parts = F.array(piece(F.lit("procedure_note"), F.lit(ANCHOR[2:])), *steps)
    return split(rows, keys, F.size("_found") == len(ANCHOR_STEPS), parts)
