"""Display hints on document trees: sentence breaks, line breaks, inline icons, subtitles; and heading parity of languages."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, pairwise, zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from foliant.functions import text as T
from foliant.operators import align, sentences, stats
from foliant.operators.nodes import ancestry, visible
from foliant.sources import sinks
from foliant.sources.places import kept

# Limits of icons, in shares of the font size, and marks of menu routes.
ICON_LIMITS = {"small_inline_figure_with_adjacent_text": (3.0, 2.0), "navigation_route_inline_figure": (5.0, 2.5)}
GENERIC_ICON, ROUTE_ICON = ICON_LIMITS
ROUTE_END, ROUTE_CLOSING = ".!?。！？؟।", ")]}'\"»”’"
FIGURE = "￼"


def icon_limits(reason: Column) -> Column:
    """(width, height) that an icon may have at most, in shares of the font size; null for another reason."""
    out = None
    for name, (w, h) in ICON_LIMITS.items():
        told = F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
        out = F.when(reason == name, told) if out is None else out.when(reason == name, told)
    return out


def labelled(text: str) -> bool:
    """Whether a text begins with a balanced parenthesis that holds something."""
    t = text.lstrip()
    depths = list(accumulate((c == "(") - (c == ")") for c in t)) if t.startswith("(") else []
    return 0 in depths and bool(t[1 : depths.index(0)].strip())


SENTENCE_END = re.compile(rf"[{re.escape(ROUTE_END)}](?=[\s{re.escape(ROUTE_CLOSING)}]*(.?))", re.DOTALL)


def route_bounds(text: str) -> list[int]:
    """Places behind which a sentence ends; not where a menu goes on, nor behind a short abbreviation in a sentence."""
    found = []
    for m in SENTENCE_END.finditer(text):
        word = re.search(r"[^\W\d_]*$", text[max(0, m.start() - 4) : m.start()])[0]
        abbreviates = m[0] == "." and m[1].islower() and 0 < len(word) <= 3
        if m[1] != ">" and not abbreviates:
            found.append(m.end())
    return found


def sentence_of(text: str, lo: int, hi: int) -> tuple[int, bool, bool, list[int]]:
    """(separators, whether it has a word, whether its parentheses are balanced, how many are open behind each character)."""
    own = text[lo:hi]
    depths = list(accumulate((c == "(") - (c == ")") for c in own))
    return own.count(">"), any(c.isalnum() for c in own), depths[-1] == 0 and min(depths) == 0, depths


BEFORE_MARK = re.compile(f"[^>{FIGURE}]*")


def route_evidences(items: list[str | None]) -> list[tuple[int, bool, list[int]] | None]:
    """For each item of a flow (separators, parenthesised, items) of the menu route that it stands in as a figure (None);
    None for texts, and for figures that stand in none.

    A separator or a parenthesised label has to stand next to it, and its sentence needs two separators and a word.  A figure is
    one character of the flow, which is read once for all of them."""
    pieces = [FIGURE if t is None else t for t in items]
    text = "".join(pieces)
    out: list[tuple[int, bool, list[int]] | None] = [None] * len(items)
    if text.count(">") < 2:
        return out
    starts = [0, *accumulate(map(len, pieces))]
    # the nearest item with anything visible on either side
    shown = [i for i, p in enumerate(pieces) if p.strip()]
    cuts = [0, *route_bounds(text), len(text)]
    sentences_: dict[int, tuple] = {}
    for nth, at in enumerate(shown):
        if items[at] is not None:
            continue
        here = starts[at]
        k = bisect_right(cuts, here)
        lo, hi = cuts[k - 1], cuts[k]
        if lo not in sentences_:
            sentences_ = {lo: sentence_of(text, lo, hi)}  # figures come in order, so only the current one is kept
        separators, words, balanced, depths = sentences_[lo]
        if separators < 2 or not words:
            continue
        around = [items[i] for i in (*shown[max(0, nth - 1) : nth], *shown[nth + 1 : nth + 2])]
        beside = any(t is not None and ">" in (t.strip()[0], t.strip()[-1]) for t in around)
        label = labelled(BEFORE_MARK.match(text, here + 1)[0])
        if beside or label:
            held = range(bisect_right(starts, lo) - 1, bisect_left(starts, hi))
            out[at] = separators, (balanced and depths[here - lo] > 0) or label, [i for i in held if items[i]]
    return out


def route_evidence(items: list[str | None], at: int) -> tuple[int, bool, list[int]] | None:
    """The evidence for one figure of a flow."""
    return route_evidences(items)[at] if 0 <= at < len(items) else None


ROUTE = StructType([StructField("separators", IntegerType()), StructField("parenthesized", BooleanType()), StructField("items", ArrayType(IntegerType()))])


@pandas_udf(ArrayType(ROUTE))
def menu_routes(items: pd.Series) -> pd.Series:
    names = ROUTE.fieldNames()
    return pd.Series([[r and dict(zip(names, r)) for r in route_evidences(list(x))] for x in items], dtype=object)


def inline_icons(flow: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, reason, font_size, width_ratio, height_ratio, separators, parenthesized of the figures that are icons in
    running text.

    flow: keys (of a paragraph's flow), ord, page, text (null for a figure), size (of a text), box (of a figure), has_text
    (of a figure).  A figure is measured by the font size of the texts on its page around it: the robust median, weighted by
    visible characters, of its menu route's texts if it stands in one.

    All steps are windows and groups within a flow, so nothing is joined and each flow is read once for all its figures; a
    flow's stretch on one page is one row's array on the way."""
    w = Window.partitionBy(*keys).orderBy("ord")
    new = ~F.col("page").eqNullSafe(F.lag("page").over(w)) | F.lag("ord").over(w).isNull()
    rows = flow.withColumn("_new", new.cast("int")).withColumn("_seg", F.sum("_new").over(w))
    seg = [*keys, "_seg"]
    figure = F.col("text").isNull()
    seen = visible(F.col("text"))
    mark = F.when(figure | seen, F.struct(figure.alias("f"), F.col("page").alias("p")))
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_m", mark).withColumns({"_l": F.last("_m", ignorenulls=True).over(before), "_r": F.first("_m", ignorenulls=True).over(behind)})
    beside = lambda c: F.coalesce(~F.col(f"{c}.f") & (F.col(f"{c}.p") == F.col("page")), F.lit(False))
    fine = F.coalesce(figure & (F.col("page") >= 0) & ~F.col("has_text") & F.col("box").isNotNull() & (beside("_l") | beside("_r")), F.lit(False))
    side = lambda a, b: F.get("box", F.lit(b)) - F.get("box", F.lit(a))
    letters = F.when(seen, F.length(F.regexp_replace("text", T.WHITE + "+", "")))
    item = F.struct("ord", "text", "size", letters.alias("n"), fine.alias("fine"), side(0, 2).alias("w"), side(1, 3).alias("h"))
    pages = rows.groupBy(*seg).agg(F.array_sort(F.collect_list(item)).alias("_f"), F.bool_or(fine).alias("_any")).where("_any")
    pages = pages.withColumn("_routes", menu_routes(F.transform("_f", lambda x: x["text"])))
    own = pages.select(*seg, "_f", "_routes", F.posexplode("_f").alias("_at", "_own")).where("_own.fine").withColumn("_route", F.get("_routes", F.col("_at")))
    of = [*keys, "ord", "_w", "_h", "separators", "parenthesized"]
    told = own.select(*keys, "_own.ord", F.col("_own.w").alias("_w"), F.col("_own.h").alias("_h"), "_route.separators", "_route.parenthesized", F.col("_route.items").alias("_held"), F.posexplode("_f").alias("_i", "_x"))
    used = told.where(F.col("_x.n").isNotNull() & (F.col("separators").isNull() | F.array_contains("_held", F.col("_i")))).select(*of, F.col("_x.size").alias("size"), F.col("_x.n").alias("_n"))
    whole = F.every(F.coalesce((F.col("size") > 0) & (F.col("size") < float("inf")), F.lit(False))).over(Window.partitionBy(*of))
    good = used.withColumn("_whole", whole).where("_whole")
    out = stats.robust_median(good, of, "size", "_n", distinct=False, bounded=True).withColumnRenamed("median", "font_size")
    out = out.withColumn("reason", F.when(F.col("separators").isNotNull(), ROUTE_ICON).otherwise(GENERIC_ICON))
    out = out.withColumns({"width_ratio": F.col("_w") / F.col("font_size"), "height_ratio": F.col("_h") / F.col("font_size"), "_most": icon_limits(F.col("reason"))})
    out = out.where((F.col("width_ratio") <= F.col("_most.width")) & (F.col("height_ratio") <= F.col("_most.height")))
    return out.select(*keys, "ord", "reason", "font_size", "width_ratio", "height_ratio", "separators", "parenthesized")


def flow_breaks(texts: list[str]) -> list[list[int]]:
    """For each text of a flow the offsets at which sentences of the joined flow start.  Between two texts stands a space
    where their joint asks for one."""
    joined, at = "", []
    for t in texts:
        if joined and t and align.seam(joined[-1], t[0]) == "insert_space":
            joined += " "
        at.append(len(joined))
        joined += t
    out: list[list[int]] = [[] for _ in texts]
    i = 0
    for s in sentences.sentence_starts(joined):
        while i + 1 < len(at) and at[i + 1] <= s:
            i += 1
        if at and at[i] <= s < at[i] + len(texts[i]):
            out[i].append(s - at[i])
    return out


@pandas_udf(ArrayType(ArrayType(IntegerType())))
def breaks_of_flows(texts: pd.Series) -> pd.Series:
    return pd.Series([flow_breaks([t or "" for t in x]) if x is not None else None for x in texts])


def sentence_breaks(flow: DataFrame, keys: list[str], paths: str = "path") -> DataFrame:
    """keys, path, offsets: where sentences of a flow start in each of its fragments, those without a start left out.

    flow: keys, ord, path, text."""
    g = flow.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", paths, "text"))).alias("_f"))
    g = g.withColumn("_o", breaks_of_flows(F.transform("_f", lambda f: f["text"])))
    rows = g.select(*keys, F.explode(F.arrays_zip("_f", "_o")).alias("z")).select(*keys, F.col(f"z._f.{paths}").alias(paths), F.col("z._o").alias("offsets"))
    return rows.where(F.size("offsets") > 0)


def line_breaks(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path of the line ends that stand, as a text of their own, between a text that ends in a comma and another one.

    segments: keys (of a paragraph in a table's cell), ord, run (rises where another block interrupts), path, text, actual
    (whether the text stands in for another)."""
    w = Window.partitionBy(*keys).orderBy("ord")
    same = lambda f: F.coalesce(f("run").over(w) == F.col("run"), F.lit(False))
    before, behind = F.lag("text").over(w), F.lead("text").over(w)
    rows = segments.withColumns({"_a": same(F.lag) & visible(before) & before.rlike(rf",{T.WHITE}*$"), "_b": same(F.lead) & visible(behind)})
    return rows.where(F.col("actual") & (F.col("text") == "\n") & F.col("_a") & F.col("_b")).select(*keys, "path")


def table_subtitles(nodes: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, weight, body_weight, n_lines, title_end, qualifier_start: paragraphs that are titles in a table.

    A paragraph that wraps one table and is followed by a paragraph (the body) is looked into.  In a row, behind a cell that
    holds a figure and no text, the first paragraph of the next cell is a title if it is set 100 heavier than the body, in two
    lines at most and 160 characters, and has a qualifier: a paragraph behind it, or its own text behind one line end.

    nodes: path, role, source_role, actual_text; fragments: path, text, weight, page, mcid.  What several steps read is written
    to the shared folder, as plans would else repeat it, and nothing is broadcast, as all of it grows with the documents."""
    at = [*keys, "path"]
    nodes, fragments = kept(nodes, "subtitle-nodes"), kept(fragments, "subtitle-fragments")
    child = nodes.where("size(path) > 1").withColumn("_up", F.expr("slice(path, 1, size(path) - 1)"))
    kids = nodes.select(*at).unionByName(fragments.select(*at)).where("size(path) > 1").groupBy(*keys, F.expr("slice(path, 1, size(path) - 1)").alias("path")).agg(F.count("*").alias("_n"))
    wraps = nodes.where("role = 'paragraph'").join(kids.where("_n = 1"), at).select(*keys, F.col("path").alias("_up"))
    tables = child.where("role = 'table'").join(wraps, [*keys, "_up"]).select(*keys, "_up", F.col("path").alias("_table"))
    following = F.concat(F.expr("slice(_up, 1, size(_up) - 1)"), F.array(F.element_at("_up", -1) + 1))
    bodies = nodes.where("role = 'paragraph'").select(*keys, F.col("path").alias("_body"))
    tables = tables.withColumn("_body", following).join(bodies, [*keys, "_body"]).select(*keys, "_table", "_body")
    # the nearest table or row above a row decides whether it is the wrapped table's own
    rows = ancestry(nodes.where("role = 'table_row'"), keys, below=1).join(nodes.where("role in ('table', 'table_row')").select(*keys, F.col("path").alias("_up"), F.col("role").alias("_r")), [*keys, "_up"])
    owner = rows.groupBy(*at).agg(F.max_by("_r", F.size("_up")).alias("_r"), F.max_by("_up", F.size("_up")).alias("_table")).where("_r = 'table'")
    own = kept(owner.select(*keys, F.col("path").alias("_row"), "_table").join(tables.hint("merge"), [*keys, "_table"]), "subtitle-rows")
    cells = child.where("role = 'table_cell'").select(*keys, F.col("_up").alias("_row"), "path", F.element_at("path", -1).alias("_i")).join(own, [*keys, "_row"])
    below = ancestry(nodes, keys, "role", "actual_text").where(F.size("path") > F.size("_up"))
    seen = below.groupBy(*keys, F.col("_up").alias("path")).agg(F.bool_or(F.col("role") == "figure").alias("_fig"), F.bool_or(visible(F.col("actual_text"))).alias("_said"), F.every(F.col("role").isin("span", "link")).alias("_inline"))
    told = ancestry(fragments, keys, "text", below=1).groupBy(*keys, F.col("_up").alias("path")).agg(F.bool_or(visible(F.col("text"))).alias("_shown"))
    no = F.lit(False)
    cells = cells.join(seen.drop("_inline"), at, "left").join(told, at, "left")
    figure = F.coalesce("_fig", no) & ~F.coalesce("_said", no) & ~F.coalesce("_shown", no)
    w = Window.partitionBy(*keys, "_row").orderBy("_i")
    pairs = cells.withColumn("_figure", figure).withColumn("_next", F.lead(F.struct("_i", "path")).over(w)).where(F.col("_figure") & (F.col("_next._i") == F.col("_i") + 1))
    first = lambda c, n: F.concat(F.col(c), F.array(F.lit(n)))
    titles = pairs.select(*keys, "_row", "_body", F.col("_next._i").alias("_i"), first("_next.path", 0).alias("path"), first("_next.path", 1).alias("_second"))
    fit = nodes.where((F.col("role") == "paragraph") & ~T.is_heading_candidate(F.col("source_role"))).select(*at)
    titles = titles.join(fit, at).join(seen.select(*at, "_inline"), at, "left").where(F.coalesce("_inline", F.lit(True)))
    titles = titles.join(bodies.select(*keys, F.col("_body").alias("_second"), F.lit(True).alias("_qualified")), [*keys, "_second"], "left")
    titles = kept(titles, "subtitle-candidates")
    # the title's texts in order; a stand-in text hides what lies below it
    marks = nodes.where("actual_text is not null").select(*at, F.col("actual_text").alias("text"), F.lit(None).cast("int").alias("weight"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("mcid"), (F.col("actual_text") == "\n").alias("_cut"), F.lit(True).alias("_mark"))
    shown = fragments.select(*at, "text", "weight", "page", "mcid", F.lit(False).alias("_cut"), F.lit(False).alias("_mark")).unionByName(marks)
    texts = ancestry(shown, keys, "text", "weight", "page", "mcid", "_cut", "_mark").where(F.size("path") > F.size("_up")).withColumnRenamed("path", "_at").withColumnRenamed("_up", "path").join(titles.select(*at), at, "left_semi")
    texts = kept(texts, "subtitle-texts")
    hidden = ancestry(texts.withColumnRenamed("path", "_title").withColumnRenamed("_at", "path"), [*keys, "_title"], below=1).join(marks.select(*keys, F.col("path").alias("_up")), [*keys, "_up"]).where(F.size("_up") > F.size("_title")).select(*keys, F.col("_title").alias("path"), F.col("path").alias("_at")).distinct().withColumn("_hidden", F.lit(True))
    texts = texts.join(hidden, [*at, "_at"], "left").withColumn("_hidden", F.coalesce("_hidden", no))
    own_w = Window.partitionBy(*at).orderBy("_at")
    texts = kept(texts.withColumn("_cuts", F.sum((F.col("_cut") & ~F.col("_hidden")).cast("int")).over(own_w)), "subtitle-parts")
    part = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("_at", "text")))), lambda s: s["text"]), "")
    open_, frag = ~F.col("_hidden"), ~F.col("_mark")
    head = open_ & (F.col("_cuts") == 0)
    lit = visible(F.col("text"))
    weigh = lambda when: F.when(when & frag & lit, F.col("weight"))
    g = texts.groupBy(*at).agg(
        F.max("_cuts").alias("_cuts"), part(head).alias("_head"), part(open_ & (F.col("_cuts") > 0) & ~F.col("_cut")).alias("_tail"), part(frag).alias("_all"),
        F.every(F.when(head & frag & lit, F.col("weight").isNotNull())).alias("_known"), F.count_distinct(weigh(head)).alias("_weights"), F.count_distinct(F.when(frag & lit, F.struct("page", "mcid"))).alias("_lines"),
        F.every(F.when(frag & lit, (F.col("page") >= 0) & F.col("mcid").isNotNull())).alias("_placed"), F.count_distinct(F.when(head & frag & lit, F.struct("page", "mcid"))).alias("_head_lines"),
    )
    inline = F.col("_cuts") == 1
    shaped = F.when(F.col("_cuts") == 0, F.coalesce("_qualified", no)).when(inline, visible(F.col("_head")) & visible(F.col("_tail")) & F.coalesce("_known", no) & (F.col("_weights") == 1)).otherwise(False)
    name = T.collapsed(F.when(inline, F.col("_head")).otherwise(F.col("_all")))
    t = kept(titles.join(g, at).where(shaped & F.length(name).between(1, 160) & F.coalesce("_placed", no)), "subtitles")
    n = F.length(F.regexp_replace("text", T.WHITE + "+", ""))
    weights = lambda rows, k: stats.weighted_median_lower(rows.where(lit & F.col("weight").isNotNull()).withColumn("_n", n), k, "weight", "_n", bounded=True)
    mine = weights(texts.where(frag & (head | (F.col("_cuts") >= 0))).join(t.select(*at, inline.alias("_inl")), at).where(~F.col("_inl") | head), at).withColumnRenamed("median", "weight")
    body_texts = ancestry(fragments, keys, "text", "weight", below=1).withColumnRenamed("_up", "_body").drop("path").join(t.select(*keys, "_body").distinct(), [*keys, "_body"], "left_semi")
    whole = body_texts.where(lit).groupBy(*keys, "_body").agg(F.every(F.col("weight").isNotNull()).alias("_w")).where("_w")
    theirs = weights(body_texts, [*keys, "_body"]).withColumnRenamed("median", "body_weight").join(whole.hint("merge"), [*keys, "_body"], "left_semi")
    all_known = texts.where(frag & lit).join(t.select(*at, inline.alias("_inl")), at).where(~F.col("_inl") | head).groupBy(*at).agg(F.every(F.col("weight").isNotNull()).alias("_w")).where("_w")
    out = t.join(mine, at).join(theirs.hint("merge"), [*keys, "_body"]).join(all_known.hint("merge"), at, "left_semi")
    lines = F.when(inline, F.col("_head_lines")).otherwise(F.col("_lines"))
    out = out.where((lines <= 2) & (F.col("weight") >= F.col("body_weight") + 100))
    firsts = Window.partitionBy(*keys, "_row").orderBy("_i")
    out = out.withColumn("_k", F.row_number().over(firsts)).where("_k = 1")
    end = F.when(inline, F.length("_head"))
    return out.select(*keys, "path", "weight", "body_weight", F.col("_lines").alias("n_lines"), end.alias("title_end"), (end + 1).alias("qualifier_start"))


def anchors(expected: list[str], observed: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal entries of a longest common subsequence; of several the one that holds the earliest expected entries.

    From the last expected entry on, each pair gets the length of the longest chain that begins with it; a chain can follow a
    pair if it begins behind it, so the farthest beginning of each length is all that has to be kept."""
    places: dict[str, list[int]] = {}
    for j, x in enumerate(observed):
        places.setdefault(x, []).append(j)
    farthest: list[int] = []  # of chains of 1, 2, ... pairs, negated: rises
    of_length: list[list[tuple[int, int]]] = []
    for i in range(len(expected) - 1, -1, -1):
        for j, n in [(j, bisect_left(farthest, -j)) for j in places.get(expected[i], ())]:
            if n == len(farthest):
                farthest.append(-j)
                of_length.append([])
            farthest[n] = min(farthest[n], -j)
            of_length[n].append((i, j))
    out: list[tuple[int, int]] = []
    for pairs in reversed(of_length):
        out.append(min(p for p in pairs if not out or (p[0] > out[-1][0] and p[1] > out[-1][1])))
    return out


def aligned(expected: list[str], observed: list[str]) -> list[tuple[int | None, int | None]]:
    """Places of two sequences side by side: one by one if they are equally long, else around anchors; between two anchors
    entries are paired in order, and what is left over has no partner."""
    n, m = len(expected), len(observed)
    marks = [(i, i) for i in range(n)] if n == m else anchors(expected, observed)
    out: list[tuple[int | None, int | None]] = []
    for (a, b), (c, d) in pairwise([(-1, -1), *marks, (n, m)]):
        out += [*zip_longest(range(a + 1, c), range(b + 1, d)), (c, d)]
    return out[:-1]


PAIRS = ArrayType(StructType([StructField("expected", IntegerType()), StructField("observed", IntegerType())]))


@pandas_udf(PAIRS)
def aligned_places(expected: pd.Series, observed: pd.Series) -> pd.Series:
    return pd.Series([[{"expected": a, "observed": b} for a, b in aligned(list(x), list(y))] for x, y in zip(expected, observed)])


def heading_parity(headings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, language, position, component (count, level, origin or numbered_label) of each heading that differs from the
    first language's.

    headings: keys, ordinal (of the language), language, path, level, origin (source or promoted), label.  Wording plays no
    part.  A language's headings are one row's arrays, bounded by a document's headings."""
    entry = F.struct("level", "origin", "label")
    g = headings.groupBy(*keys, "ordinal", "language").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", entry.alias("e")))), lambda h: h["e"]).alias("entries"))
    lead = g.groupBy(*keys).agg(F.min_by("entries", "ordinal").alias("_reference"), F.min("ordinal").alias("_first"))
    both = g.join(lead, keys).where(F.col("ordinal") > F.col("_first"))
    told = lambda c: F.transform(c, lambda e: F.concat_ws("|", e["level"].cast("string"), e["origin"], F.coalesce(e["label"], F.lit("-"))))
    rows = both.select(*keys, "language", "_reference", "entries", F.explode(aligned_places(told("_reference"), told("entries"))).alias("p"))
    x, y = F.get("_reference", F.col("p.expected")), F.get("entries", F.col("p.observed"))
    missing = F.col("p.expected").isNull() | F.col("p.observed").isNull()
    faults = F.array_compact(F.array(
        F.when(missing, "count"), F.when(~missing & (x["level"] != y["level"]), "level"), F.when(~missing & (x["origin"] != y["origin"]), "origin"),
        F.when(~missing & (x["origin"] == "promoted") & (y["origin"] == "promoted") & ~x["label"].eqNullSafe(y["label"]), "numbered_label"),
    ))
    return rows.select(*keys, "language", F.coalesce("p.expected", "p.observed").alias("position"), F.explode(faults).alias("component"))


def parity_audit(headings: DataFrame, keys: list[str]) -> DataFrame:
    """keys and whether counts, levels, origins and labels of all languages match the first one's."""
    counts = headings.groupBy(*keys, "ordinal").agg(F.count("*").alias("n")).groupBy(*keys).agg((F.count_distinct("n") == 1).alias("counts_match"))
    f = heading_parity(headings, keys).groupBy(*keys).agg(*[F.bool_or(F.col("component") == c).alias(f"_{c}") for c in ("level", "origin", "numbered_label")])
    ok = lambda c: ~F.coalesce(c, F.lit(False))
    return counts.join(f, keys, "left").select(*keys, "counts_match", ok("_level").alias("levels_match"), ok("_origin").alias("origins_match"), ok("_numbered_label").alias("labels_match"))


def disagreements(hints: DataFrame, detected: DataFrame, columns: list[str]) -> DataFrame:
    """What a second detection finds that the hints lack (missing), and what the hints have that it does not find (extra)."""
    return sinks.differences(detected.select(*columns), hints.select(*columns)).withColumn("side", F.when(F.col("side") == "first", "missing").otherwise("extra"))
