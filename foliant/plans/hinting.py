"""Registered queries of display hints and heading parity.

Each order is one of the cases below, by its key; the SQL states what each case gives, which was worked out by hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import hints
from foliant.plans.made import chosen, literal
from foliant.plans.registry import query

KEYS = ["doc"]


def cases(t, rows: list[list[dict]], schema: str) -> DataFrame:
    """doc and the rows of its case, which are stated as JSON."""
    made = chosen([json.dumps(r, ensure_ascii=False) for r in rows], f"o_orderkey % {len(rows)}")
    return t("orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.from_json(made, f"array<struct<{schema}>>")).alias("r")).select("doc", "r.*")


def expected(columns: str, *told: tuple, n: int) -> str:
    """SQL for the rows (case, values) that the cases give."""
    rows = ", ".join("(" + ", ".join(f"{literal(x)}::DOUBLE" if isinstance(x, float) else literal(x) for x in r) + ")" for r in told)
    return f"SELECT o_orderkey AS doc, {columns} FROM orders JOIN (VALUES {rows}) AS v(c, {columns}) ON o_orderkey % {n} = c"


def text_item(ord_: int, text: str | None, page: int = 0, size: float | None = 10.0, box=None, has_text: bool = False) -> dict:
    return {"ord": ord_, "text": text, "page": page, "size": size, "box": box, "has_text": has_text}


ICON = lambda ord_, w=10.0, h=10.0, **k: text_item(ord_, None, size=None, box=[0.0, 0.0, w, h], **k)
FLOWS = [
    [text_item(0, "Press "), ICON(1), text_item(2, " now.")], [text_item(0, "Press "), ICON(1, 31.0)], [text_item(0, "a", page=1), ICON(1), text_item(2, "b")], [ICON(0), ICON(1), text_item(2, "x")], [text_item(0, "no size", size=None), ICON(1)],
    [text_item(0, "Go (Home > "), ICON(1, 49.0, 24.0), text_item(2, " Settings > Sound). Then.")], [text_item(0, "Now. "), ICON(1, 40.0), text_item(2, " > A > B")], [text_item(0, "x "), ICON(1, 30.0), text_item(2, "(Menu) > A > B")],
    [text_item(0, "a > b. "), ICON(1, 31.0), text_item(2, " > c")], [text_item(0, "big letters here", size=10.0), text_item(1, "h", size=90.0), ICON(2, 30.0, 20.0)], [text_item(0, "said "), ICON(1, has_text=True)], [text_item(0, "  "), ICON(1), text_item(2, "")],
]
FLOW = "ord int, text string, page int, size double, box array<double>, has_text boolean"
_generic, _route = hints.GENERIC_ICON, hints.ROUTE_ICON


@query(expected(
    "ord, reason, font_size, width_ratio, height_ratio, separators, parenthesized",
    (0, 1, _generic, 10.0, 1.0, 1.0, None, None), (2, 1, _generic, 10.0, 1.0, 1.0, None, None), (3, 1, _generic, 10.0, 1.0, 1.0, None, None), (5, 1, _route, 10.0, 4.9, 2.4, 2, True), (6, 1, _route, 10.0, 4.0, 1.0, 2, False), (7, 1, _route, 10.0, 3.0, 1.0, 2, True),
    (9, 2, _generic, 10.0, 3.0, 2.0, None, None), n=12,
))
def inline_icons(t) -> DataFrame:
    return hints.inline_icons(cases(t, FLOWS, FLOW), KEYS)


SENTENCES = [["One. Two", " goes on. Three."], ["See www.a.b.", "Then e.g. this. 日本。", "End"], ["", "  Lead"], ["Mr. X left.", "He ran at 3.5 m. Fast"], ["no end", "here"]]


@query(expected("ord, offsets", (0, 1, "10"), (1, 1, "16"), (3, 1, "0,17"), n=5))
def sentence_breaks(t) -> DataFrame:
    flow = cases(t, [[{"ord": i, "text": x} for i, x in enumerate(c)] for c in SENTENCES], "ord int, text string").withColumn("path", F.array("ord"))
    s = hints.sentence_breaks(flow, KEYS)
    return s.select("doc", F.col("path")[0].alias("ord"), F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("offsets"))


_seg = lambda i, text, run=0, actual=False: {"ord": i, "text": text, "run": run, "actual": actual}
BREAKS = [
    [_seg(0, "a, "), _seg(1, "\n", actual=True), _seg(2, "b")], [_seg(0, "a"), _seg(1, "\n", actual=True), _seg(2, "b")], [_seg(0, "a,"), _seg(1, "\n"), _seg(2, "b")], [_seg(0, "a,"), _seg(1, "\n", actual=True), _seg(2, "b", 1)],
    [_seg(0, "a,"), _seg(1, "\n", actual=True)], [_seg(0, "a,"), _seg(1, "\n", actual=True), _seg(2, " ")], [_seg(0, "x,"), _seg(1, "\n", actual=True), _seg(2, "y,"), _seg(3, "\n", actual=True), _seg(4, "z")],
]


@query(expected("ord", (0, 1), (6, 1), (6, 3), n=7))
def comma_line_breaks(t) -> DataFrame:
    s = cases(t, BREAKS, "ord int, text string, run int, actual boolean").withColumn("path", F.array("ord"))
    return hints.line_breaks(s, KEYS).select("doc", F.col("path")[0].alias("ord"))


def _node(path: str, role: str, actual: str | None = None, source: str | None = None) -> dict:
    return {"path": [int(x) for x in path.split(".")], "role": role, "source_role": source or role, "actual_text": actual}


def _frag(path: str, text: str, weight: int | None, mcid: int | None = 1, page: int = 0) -> dict:
    return {"path": [int(x) for x in path.split(".")], "text": text, "weight": weight, "mcid": mcid, "page": page}


_frame = [_node("0", "paragraph"), _node("0.0", "table"), _node("0.0.0", "table_row"), _node("0.0.0.0", "table_cell"), _node("0.0.0.0.0", "figure"), _node("0.0.0.1", "table_cell"), _node("0.0.0.1.0", "paragraph"), _node("1", "paragraph")]
_second = [_node("0.0.0.1.1", "paragraph")]
_body = [_frag("1.0", "body text", 400, 9)]
_title = [_frag("0.0.0.1.0.0", "Title", 700)]
_inline = [_frag("0.0.0.1.0.0", "Title", 700), _frag("0.0.0.1.0.2", "more", 400, 2)]
_cut = [_node("0.0.0.1.0.1", "span", "\n")]
TABLES = [
    (_frame + _second, _title + _body), (_frame, _title + _body), (_frame + _cut, _inline + _body), (_frame + _cut + [_node("0.0.0.1.0.3", "span", "\n")], _inline + _body), (_frame + _second, [_frag("0.0.0.1.0.0", "Title", 450)] + _body),
    (_frame + _second, [*_title, _frag("0.0.0.0.1", "said", 400)] + _body), ([n for n in _frame if n["path"] != [1]] + _second, _title), (_frame + _second + [_node("0.0.0.1.0.5", "list")], _title + _body), ([*_frame[:6], _node("0.0.0.1.0", "paragraph", None, "Heading2"), _frame[7]] + _second, _title + _body),
    (_frame + _second, [_frag("0.0.0.1.0.0", "A", 700), _frag("0.0.0.1.0.1", "B", 700, 2), _frag("0.0.0.1.0.2", "C", 700, 3)] + _body), (_frame + _second + [_node("0.1", "paragraph")], _title + _body), (_frame + _second, [_frag("0.0.0.1.0.0", "Title", None)] + _body),
    (_frame + _second, [_frag("0.0.0.1.0.0", "T" * 161, 700)] + _body), (_frame + _cut, [_frag("0.0.0.1.0.0", "Title", 700), _frag("0.0.0.1.0.2", " ", 400, 2)] + _body),
]
_at = "0.0.0.1.0"


@query(expected("path, weight, body_weight, n_lines, title_end, qualifier_start", (0, _at, 700, 400, 1, None, None), (2, _at, 700, 400, 2, 5, 6), n=14))
def table_subtitles(t) -> DataFrame:
    nodes = cases(t, [n for n, _ in TABLES], "path array<int>, role string, source_role string, actual_text string")
    s = hints.table_subtitles(nodes, cases(t, [f for _, f in TABLES], "path array<int>, text string, weight int, mcid int, page int"), KEYS)
    return s.withColumns({"path": F.array_join(F.transform("path", lambda x: x.cast("string")), "."), "n_lines": F.col("n_lines").cast("int")})


def _heads(*languages: str) -> list[dict]:
    """Headings stated as level and, for promoted ones, label: "1 2a" is a source heading and a promoted one."""
    return [{"ordinal": o, "language": "EFSG"[o], "path": [o, i], "level": int(h[0]), "origin": "promoted" if h[1:] else "source", "label": h[1:] or None} for o, x in enumerate(languages) for i, h in enumerate(x.split())]


PARITY = [_heads("1 2 2 3", "1 2 2 3"), _heads("1 2", "1 3"), _heads("1 2a", "1 2"), _heads("1 2a", "1 2b"), _heads("1 2 3 2", "1 3 2"), _heads("1 2", "1 2 4"), _heads("1 2 3", "2 3 1 4"), _heads("1", "1", "2")]
HEADINGS = "ordinal int, language string, path array<int>, level int, origin string, label string"


@query(expected("language, position, component", (1, "F", 1, "level"), (2, "F", 1, "origin"), (3, "F", 1, "numbered_label"), (4, "F", 1, "count"), (5, "F", 2, "count"), (6, "F", 0, "count"), (6, "F", 2, "count"), (6, "F", 3, "count"), (7, "S", 0, "level"), n=8))
def heading_parity(t) -> DataFrame:
    return hints.heading_parity(cases(t, PARITY, HEADINGS), KEYS)


@query(expected("counts_match, levels_match, origins_match, labels_match", (0, True, True, True, True), (1, True, False, True, True), (2, True, True, False, True), (3, True, True, True, False), (4, False, True, True, True), (5, False, True, True, True), (6, False, True, True, True), (7, True, False, True, True), n=8))
def parity_audits(t) -> DataFrame:
    return hints.parity_audit(cases(t, PARITY, HEADINGS), KEYS)


@query("""WITH d AS (SELECT l_orderkey AS doc, l_linenumber AS n FROM lineitem WHERE l_tax > 0.02), h AS (SELECT l_orderkey AS doc, l_linenumber AS n FROM lineitem WHERE l_discount > 0.02), c AS (SELECT doc, n, sum(s) AS s FROM (SELECT doc, n, 1 AS s FROM d UNION ALL SELECT doc, n, -1 FROM h) GROUP BY 1, 2)
SELECT doc, n, CAST(s AS BIGINT) AS surplus, CASE WHEN s > 0 THEN 'missing' ELSE 'extra' END AS side FROM c WHERE s <> 0""")
def hint_disagreements(t) -> DataFrame:
    rows = lambda cond: t("lineitem").where(cond).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"))
    return hints.disagreements(rows("l_discount > 0.02"), rows("l_tax > 0.02"), ["doc", "n"])


LIMITS = (hints.GENERIC_ICON, hints.ROUTE_ICON, "other")


@query(f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 5.0 END AS width, CASE p_partkey % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 2.5 END AS height FROM part WHERE {literal(LIMITS[0])} <> ''""")
def icon_limits(t) -> DataFrame:
    return t("part").select("p_partkey", hints.icon_limits(chosen(LIMITS, "p_partkey % 3")).alias("x")).select("p_partkey", F.col("x.width").cast("decimal(2,1)").alias("width"), F.col("x.height").cast("decimal(2,1)").alias("height"))
