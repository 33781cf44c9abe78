"""Column functions on the texts of review items: safety tables, regulatory notes, navigation, covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as T

# Rows of the safety symbol table, each from its start to the next one's.
SAFETY_ROWS = (
    ("high_voltage", "This symbol indicates that high voltage", "This symbol indicates that this product"),
    ("important_literature", "This symbol indicates that this product", "Class II product:"),
    ("class_ii", "Class II product:", "AC voltage:"),
    ("ac_voltage", "AC voltage:", "DC voltage:"),
    ("dc_voltage", "DC voltage:", "Caution. Consult instructions for use:"),
    ("consult_instructions", "Caution. Consult instructions for use:", None),
)
SAFETY_SECTION = "Warning! Important Safety Instructions"
CONSULT = "Caution. Consult instructions for use:"


def sentences(x: Column) -> Column:
    return T.split_sentences(x, F.lit(True))


def safety_rows(x: Column) -> Column:
    """Rows (row_order, symbol_key, label, lines) of a safety symbol table's text, in the fixed order; rows that the text
    does not have are left out."""
    made = []
    for i, (key, start, end) in enumerate(SAFETY_ROWS, 1):
        lines = sentences(T.segment(x, start, end))
        made.append(F.when(x.contains(start), F.struct(F.lit(i).alias("row_order"), F.lit(key).alias("symbol_key"), F.lit(start.rstrip(":")).alias("label"), lines.alias("lines"))))
    return F.array_compact(F.array(*made))


def caution_lines(x: Column) -> Column:
    """Lines of a warning that has no table: the leading word on its own, then each sentence, ended."""
    c = T.collapsed(x)
    leads = c.startswith("CAUTION ")
    rest = F.when(leads, F.btrim(F.substring(c, F.lit(len("CAUTION ") + 1), F.length(c)))).otherwise(c)
    told = F.transform(F.filter(F.transform(F.split(rest, r"\."), T.collapsed), lambda s: s != ""), lambda s: F.concat(s, F.lit(".")))
    return F.concat(F.when(leads, F.array(F.lit("CAUTION"))).otherwise(F.array().cast("array<string>")), told)


def block_rows(x: Column) -> Column:
    """Rows of a safety block: those of its table, else one that holds the caution's lines."""
    rows = safety_rows(x)
    fallback = F.array(F.struct(F.lit(0).alias("row_order"), F.lit("caution_warning").alias("symbol_key"), F.lit("CAUTION").alias("label"), caution_lines(x).alias("lines")))
    return F.when((F.size(rows) == 0) & x.contains("CAUTION"), fallback).otherwise(rows)


# Topics of regulatory notes, each from its start up to the next one's.
CLASS_NOTE, WIRELESS_NOTE, CABLE_NOTE = "This device is a Class B digital apparatus", "Unpacking and Installation Guide may differ", "* Shielded Twisted Pair"
DEVICE_TOPICS = (
    ("REG_CLASS_B_DIGITAL", "This device is a Class B digital apparatus.", "For information about the power supply"),
    ("REG_POWER_LABEL", "For information about the power supply", "To connect a LAN cable"),
    ("REG_LAN_CABLE_STP", "To connect a LAN cable", None),
)
WIRELESS_TOPICS = (
    ("REG_UNPACKING_GUIDE_VARIANCE", "The images and specifications of the Unpacking and Installation Guide may differ from the actual product.", "Operation in the band 5150 - 5250 MHz"),
    ("REG_5GHZ_INDOOR_USE", "Operation in the band 5150 - 5250 MHz", "[Operation in the band 5925 - 7125 MHz"),
    ("REG_6GHZ_BAND_OPERATION", "[Operation in the band 5925 - 7125 MHz", None),
)
SPEED, CUT_HEIGHT = "(100/10 Mbps)", "(10,000"
UNPARTED = "Operation of this product shall be limited to indoor use Operation of this product"
PARTED = "Operation of this product shall be limited to indoor use. Operation of this product"
BOX_MODELS = r"\.\)\s+(On (?:Wireless )?One Connect Box models,)"


def note_lines(topic: Column, x: Column) -> Column:
    """Lines of a regulatory note: sentences; some topics put models, speeds, abbreviations or a heading on lines of their own."""
    power = F.flatten(F.transform(F.split(F.regexp_replace(x, BOX_MODELS, ".)\n$1"), "\n"), sentences))
    main = F.when(x.contains(f" {CABLE_NOTE}"), F.substring_index(x, f" {CABLE_NOTE}", 1)).otherwise(x)
    extra = lambda when, what: F.when(when, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    cable = F.concat(sentences(F.replace(main, F.lit(f" {SPEED}"), F.lit(""))), extra(main.contains(f" {SPEED}"), SPEED), extra(x.contains(CABLE_NOTE), CABLE_NOTE))
    head = F.regexp_extract(x, r"^(\[[^\]]+\])\s*(.*)$", 1)
    rest = F.replace(F.when(head != "", F.regexp_extract(x, r"^(\[[^\]]+\])\s*(.*)$", 2)).otherwise(x), F.lit(UNPARTED), F.lit(PARTED))
    band = F.concat(F.when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")), sentences(rest))
    return F.when(topic == "REG_POWER_LABEL", power).when(topic == "REG_LAN_CABLE_STP", cable).when(topic == "REG_6GHZ_BAND_OPERATION", band).otherwise(sentences(x))


def regulatory_topics(x: Column, cable: Column) -> Column:
    """Notes (topic_id, text) of an item that states regulations; empty for any other.  `cable` tells that the item behind it
    explains the cable, which belongs to the last note."""
    note = lambda topic, text: F.struct(F.lit(topic).alias("topic_id"), T.collapsed(text).alias("text"))
    device = []
    for topic, start, end in DEVICE_TOPICS:
        found = T.segment(x, start, end)
        device.append(note(topic, found if end else F.when(cable, F.concat(found, F.lit(f" {CABLE_NOTE}"))).otherwise(found)))
    wireless = []
    for topic, start, end in WIRELESS_TOPICS:
        found = T.segment(x, start, end)
        wireless.append(note(topic, found if end else F.when(found.endswith(CUT_HEIGHT), F.concat(found, F.lit(" ft)."))).otherwise(found)))
    none = F.array().cast("array<struct<topic_id: string, text: string>>")  # not a filtered list, which each item would make
    return F.when(x.contains(CLASS_NOTE), F.array(*device)).when(x.contains(WIRELESS_NOTE), F.array(*wireless)).otherwise(none)


def regulatory_notes(x: Column, cable: Column) -> Column:
    """regulatory_topics() with the lines of each note."""
    return F.transform(regulatory_topics(x, cable), lambda n: F.struct(n["topic_id"].alias("topic_id"), n["text"].alias("text"), note_lines(n["topic_id"], n["text"]).alias("lines")))


def menu_path(parts: Column) -> Column:
    """The parts of a menu path as one text."""
    return T.navigation_path(F.array_join(parts, " "))


# The parts of a condition on models.
LASER = r"\bCLASS\s*1 LASER PRODUCT\s+\("
MODEL_TOKEN = r"\b[A-Z]{1,4}\d[\w*.-]*\b|The Frame|THE FRAME|Supported Model"
MODEL_SCOPE = r"\b(?:only|ONLY|except for|EXCEPT FOR)\b"


def has_model(x: Column) -> Column:
    return x.rlike(MODEL_TOKEN)


def is_model_scoped(x: Column) -> Column:
    return x.startswith("(") & x.endswith(")") & has_model(x) & x.rlike(MODEL_SCOPE)


def closing(x: Column, opens_at: Column) -> Column:
    """Position (from 1) of the parenthesis that closes the one at `opens_at`; 0 if none does.

    What stands before each closing one is a piece: the first at which as many have closed as opened is the one."""
    pieces = F.split(F.substring(x, opens_at, F.length(x)), r"\)")
    opened = lambda p: F.length(p) - F.length(F.replace(p, F.lit("("), F.lit("")))
    end = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("found")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p) + 1).alias("at"),
            (s["depth"] + opened(p) - 1).alias("depth"),
            F.when((s["found"] == 0) & (s["depth"] + opened(p) == 1), s["at"] + F.length(p) + 1).otherwise(s["found"]).alias("found"),
        ),
        lambda s: F.when(s["found"] > 0, opens_at + s["found"] - 1).otherwise(0),
    )
    # a case is worked out only where it holds
    return F.when((opens_at > 0) & (F.substring(x, opens_at, F.lit(1)) == "("), end).otherwise(0)


def laser_opens(x: Column) -> Column:
    """Where the parenthesis behind the laser class opens."""
    return F.regexp_instr(x, F.lit(LASER)) + F.length(F.regexp_extract(x, LASER, 0)) - 1


def condition_parts(x: Column, end: Column | None = None, stop: Column | None = None) -> Column:
    """Parts (kind, text) of a text that a model condition leads, is, or (behind the laser class) interrupts; null if none does.

    end, stop: where the first parenthesis closes, and the one behind the laser class, if they are columns already."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    piece = lambda a, b: F.btrim(F.substring(x, a, F.greatest(b - a + 1, F.lit(0))))
    end = closing(x, F.lit(1)) if end is None else end
    head, tail = piece(F.lit(1), end), piece(end + 1, F.length(x))
    at = F.regexp_instr(x, F.lit(LASER))
    stop = closing(x, laser_opens(x)) if stop is None else stop
    laser = F.filter(F.array(part("body", piece(F.lit(1), at - 1)), part("condition_label", piece(at, stop)), part("body", piece(stop + 1, F.length(x)))), lambda p: p["text"] != "")
    return (
        F.when(is_model_scoped(x), F.array(part("condition_label", x)))
        .when((end > 0) & (tail != "") & is_model_scoped(head), F.array(part("condition_label", head), part("body", tail)))
        .when((at > 0) & (stop > 0) & has_model(piece(at, stop)), laser)
    )


# What list a package lists.
PACKAGE_BULLETS, PACKAGE_BULLET_START = "Simple User Guide", "Warranty Card / Regulatory Guide"


def is_package_note(kind: Column, x: Column) -> Column:
    return (kind == "list_item") & x.rlike(r"^\*{1,2}:")


def is_package_item(kind: Column, x: Column) -> Column:
    listed = ((kind == "list_item") & x.startswith("*")) | ((kind == "bullet") & ((x == PACKAGE_BULLETS) | x.startswith(PACKAGE_BULLET_START)))
    return listed & ~is_package_note(kind, x)


def is_package_note_more(kind: Column, x: Column) -> Column:
    return (kind == "body") & x.rlike(r"^(on|depending)\b")


def package_item(x: Column) -> Column:
    """(text, note) of a package item; what stands behind " *:" is its note."""
    c = T.collapsed(x)
    has = c.contains(" *:")
    body = F.when(has, F.substring_index(c, " *:", 1)).otherwise(c)
    note = F.when(has, F.concat(F.lit("*: "), F.btrim(F.substring(c, F.instr(c, " *:") + 3, F.length(c))))).otherwise("")
    return F.struct(F.btrim(F.regexp_replace(body, r"^\*+", "")).alias("text"), note.alias("note"))


NOTE_NOISE = ("–", "-", "use.", "only.", "ft).")


def is_note_noise(x: Column) -> Column:
    return T.collapsed(x).isin(*NOTE_NOISE)


def is_model_more(x: Column) -> Column:
    """Whether a text may carry on a list of models."""
    return x.rlike(r"^[A-Za-z0-9*/._ -]+(?:/[A-Za-z0-9*/._ -]+)*\.?$")
