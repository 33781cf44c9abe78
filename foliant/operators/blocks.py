"""Content blocks: items expanded, typed, placed in sections and marked for review; the views that reviewers read.

Items have doc, page, cell_order, ord (in the cell), kind, text; a document's items are read by page, cell and ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import review as R
from foliant.functions import text as T

ORDER = ("page", "cell_order", "ord")

# Headings, fields and block types.
COMPOUND = "04 Specifications and Other Information Specifications Display Resolution"
COMPOUND_PARTS = ("04 Specifications and Other Information", "Specifications")
STAND_CUT, STAND = "Precautions when installing the TV with a", "Precautions when installing the TV with a stand"
NOTES, UNSECTIONED = "Notes", "UNSECTIONED"
COMMON_FIELDS = ("Operating Temperature", "Operating Humidity", "Storage Temperature", "Storage Humidity")
OWN_TYPES = (
    "procedure_note", "numbered_step", "item_list", "item_list_note", "condition_label", "figure_notice", "figure_legend", "figure_variant_labels", "figure_action_labels", "figure_callout_label", "model_condition",
    "regulatory_note", "spec_table",
)
RISKY = (
    "safety_symbol_table", "navigation_ui", "spec_table", "regulatory_note", "procedure_note", "numbered_step", "figure_notice", "figure_legend", "figure_variant_labels", "figure_action_labels", "figure_callout_label", "model_condition",
)
LISTED = ("item_list", "figure_action_labels", "figure_variant_labels")
EXTRA = {"topic_id": "string", "spec_field": "string", "spec_category": "string"}


def _made(kind: Column, text: Column, topic: Column | None = None, field: Column | None = None, category: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    named = (("topic_id", topic), ("spec_field", field), ("spec_category", category))
    return F.struct(kind.alias("kind"), text.alias("text"), *[(none if c is None else c).alias(n) for n, c in named])


def _spec(field: Column, value: Column, category: str) -> Column:
    return _made(F.lit("spec_table"), T.collapsed(F.concat_ws(" ", field, value)), field=field, category=F.lit(category))


def with_sound_runs(items: DataFrame, cell: list[str]) -> DataFrame:
    """Behind a heading on sound, everything up to the next common field or the notes is its value: one item
    (kind sound, text the values).  A value that ends in a common field is cut in front of it, which becomes the next item."""
    kind, text = F.col("kind"), F.col("text")
    w = Window.partitionBy(*cell).orderBy("ord")
    heading = kind == "heading"
    opens = heading & ((text == T.SOUND_FIELD) | text.startswith(f"{T.SOUND_FIELD} "))
    stops = heading & text.isin(*COMMON_FIELDS, NOTES)
    tail = F.regexp_extract(text, f" ({'|'.join(COMMON_FIELDS)})$", 1)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda c: F.coalesce(F.max(F.when(c, F.col("ord"))).over(before), F.lit(-1))
    rows = items.withColumn("_inside", at(opens) > at(stops | (tail != "")))
    is_value = F.col("_inside") & ~stops
    cut = is_value & (tail != "")
    # values join the last item begun before them, so runs are numbered ahead of the cut and rows need one order more
    rows = rows.withColumn("_begun", F.coalesce(F.count_if(cut | ~is_value).over(before), F.lit(0)))
    part = lambda t, v: F.struct(t.alias("t"), v.alias("v"), (F.col("_begun") + (~v).cast("int")).alias("r"))
    value = F.btrim(F.substring(text, F.lit(1), F.length(text) - F.length(tail)))
    parts = F.when(cut, F.array(part(value, F.lit(True)), part(tail, F.lit(False)))).otherwise(F.array(part(text, is_value)))
    rows = rows.select(*cell, "ord", "kind", F.posexplode(parts).alias("_i", "_p")).select(*cell, F.col("_p.r").alias("_run"), "ord", "_i", "kind", F.col("_p.t").alias("text"), F.col("_p.v").alias("_value"))
    run = Window.partitionBy(*cell, "_run").orderBy("ord", "_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.where(~(F.col("_value") & (text == ""))).withColumn("_values", F.collect_list(F.when(F.col("_value"), text)).over(run)).where(~F.col("_value"))
    sound = (kind == "heading") & ((text == T.SOUND_FIELD) | text.startswith(f"{T.SOUND_FIELD} "))
    initial = F.btrim(F.substring(text, len(T.SOUND_FIELD) + 1, F.length(text)))
    return told.select(*cell, F.col("_run").alias("ord"), F.when(sound, "sound").otherwise(kind).alias("kind"), F.when(sound, F.btrim(F.concat_ws(" ", initial, F.array_join("_values", " ")))).otherwise(text).alias("text"))


def expanded(items: DataFrame) -> DataFrame:
    """Items with specifications and regulations taken apart: kind, text and topic_id, spec_field, spec_category.

    A field's heading takes the item behind it as value, whatever it is; that item then heads nothing.  A sound heading
    takes all up to the next common field; one that stands as another field's value counts as heading all the same."""
    cell = ["doc", "page", "cell_order"]
    w = Window.partitionBy(*cell).orderBy("ord")
    rows = with_sound_runs(items.select(*cell, "ord", "kind", "text"), cell)
    kind, text = F.col("kind"), F.col("text")
    heading = kind == "heading"
    following, next_kind = F.lead("text").over(w), F.lead("kind").over(w)
    cable = F.coalesce(T.collapsed(following) == R.CABLE_NOTE, F.lit(False))
    takes = following.isNotNull() & ((heading & ((text == COMPOUND) | (text == T.RESOLUTION_FIELD) | text.isin(*COMMON_FIELDS))) | ((kind != "sound") & text.contains(R.CLASS_NOTE) & cable))
    rows = rows.withColumns({"_takes": F.coalesce(takes, F.lit(False)), "_next": following, "_next_kind": next_kind, "_cable": cable})
    # of a run of items that would each take the next, every other one does
    rows = rows.withColumn("_n", F.row_number().over(w))
    others = F.coalesce(F.max(F.when(~F.col("_takes"), F.col("_n"))).over(w), F.lit(0))
    rows = rows.withColumn("_active", F.col("_takes") & ((F.col("_n") - others) % 2 == 1))
    rows = rows.withColumn("_taken", F.coalesce(F.lag("_active").over(w), F.lit(False))).where(~F.col("_taken"))
    h, value = F.lit("heading"), F.col("_next")
    compound = F.array(_made(h, F.lit(COMPOUND_PARTS[0])), _made(h, F.lit(COMPOUND_PARTS[1])), _spec(F.lit(T.RESOLUTION_FIELD), F.when(F.col("_next_kind") != "heading", value).otherwise(""), T.MODEL_SPEC))
    notes = R.regulatory_topics(F.col("_plain"), F.col("_cable"))
    regulates = (kind != "sound") & (F.col("_plain").contains(R.CLASS_NOTE) | F.col("_plain").contains(R.WIRELESS_NOTE))
    rows = rows.withColumn("_plain", T.collapsed(text)).withColumn("_notes", F.when(regulates, notes))
    sound = F.array(_made(h, F.lit(T.SOUND_FIELD)), _spec(F.lit(T.SOUND_FIELD), text, T.MODEL_SPEC))
    parts = (
        F.when(heading & (text == COMPOUND), compound).when(heading & (text == STAND_CUT), F.array(_made(h, F.lit(STAND)))).when((kind == "body") & (F.col("_plain") == NOTES), F.array(_made(h, F.lit(NOTES))))
        .when(F.size("_notes") > 0, F.transform("_notes", lambda n: _made(F.lit("regulatory_note"), n["text"], topic=n["topic_id"])))
        .when(heading & (text == T.RESOLUTION_FIELD) & F.col("_active"), F.array(_made(kind, text), _spec(text, value, T.MODEL_SPEC))).when(kind == "sound", sound)
        .when(heading & text.isin(*COMMON_FIELDS) & F.col("_active"), F.array(_made(kind, text), _spec(text, value, T.COMMON_SPEC))).otherwise(F.array(_made(kind, text)))
    )
    rows = rows.select(*cell, "ord", parts.alias("_parts"))
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.size("_parts")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # no item is without parts; as an outer one, this does not have Spark make all of them twice to look for such
    return rows.select(*cell, "_start", F.posexplode_outer("_parts").alias("_i", "_p")).select(*cell, (F.col("_start") + F.col("_i")).cast("int").alias("ord"), "_p.*")


def block_type(kind: Column, text: Column, section: Column) -> Column:
    """The type of an item's block, which for warnings depends on the section."""
    symbols = (section == R.SAFETY_SECTION) & (((kind == "warning") & text.contains("CAUTION") & text.contains("RISK OF ELECTRIC SHOCK")) | ((kind == "body") & text.startswith(R.CONSULT)))
    return F.when(kind.isin(*OWN_TYPES), kind).when(symbols | T.is_safety_table(text), "safety_symbol_table").when(kind.isin("navigation", "ui_label"), "navigation_ui").otherwise(kind)


def item_sentences(kind: Column, text: Column) -> Column:
    """Sentences of an item: none of a heading; notes, tables and listed lines as they are."""
    return F.when(kind == "heading", F.array().cast("array<string>")).when(kind.isin(*LISTED), F.split(text, "\n")).when(kind.isin("regulatory_note", "spec_table", "figure_legend", "model_condition", "condition_label"), F.array(text)).otherwise(R.sentences(text))


def block_lines(kind: Column, text: Column, topic: Column, sentences: Column | None = None) -> Column:
    """The lines of a block as reviewers see them.  sentences: those of the item, if they are a column already."""
    c = T.collapsed(text)
    sentences = item_sentences(kind, text) if sentences is None else sentences
    consult = F.array(F.lit("Caution."), F.btrim(F.substring(c, F.lit(len("Caution.") + 1), F.length(c))))
    return (
        F.when(kind.isin(*LISTED), F.split(text, "\n")).when(kind == "regulatory_note", R.note_lines(topic, text)).when(c.startswith(R.CONSULT), consult)
        .when(F.size(sentences) > 0, F.transform(sentences, T.collapsed)).otherwise(F.array(c))
    )


def content_blocks(items: DataFrame) -> DataFrame:
    """doc, block_order, section_order, section_heading, block_type, text, lines, sentences, inline_tokens, manual_review_required,
    page, cell_order and topic_id, spec_field, spec_category of each block of expanded() items.

    The section is the last heading at or before the block; blocks before the first share its number.  Scraps in the notes go."""
    kind, text = F.col("kind"), F.col("text")
    w = Window.partitionBy("doc").orderBy(*ORDER)
    heads = (kind == "heading") & ~T.is_safety_table(text)
    rows = items.withColumn("_heads", heads)
    rows = rows.withColumns({"section_heading": F.coalesce(F.last(F.when(F.col("_heads"), text), ignorenulls=True).over(w), F.lit(UNSECTIONED)), "section_order": F.greatest(F.sum(F.col("_heads").cast("int")).over(w), F.lit(1))})
    rows = rows.where(~((F.col("section_heading") == NOTES) & R.is_note_noise(text)))
    rows = rows.withColumn("block_type", block_type(kind, text, F.col("section_heading"))).withColumn("sentences", item_sentences(kind, text))
    risky = F.col("block_type").isin(*RISKY) | text.startswith("CAUTION:") | text.startswith("WARNING -")
    return rows.select(
        "doc", F.row_number().over(w).alias("block_order"), "section_order", "section_heading", "block_type", "text", block_lines(kind, text, F.col("topic_id"), F.col("sentences")).alias("lines"), "sentences",
        T.inline_tokens(text).alias("inline_tokens"), risky.alias("manual_review_required"), "page", "cell_order", *EXTRA,
    )


def summary(blocks: DataFrame) -> DataFrame:
    """Counts of a document's blocks: all, for manual review, by type, and its sections and cells."""
    of = lambda t: F.count_if(F.col("block_type") == t)
    return blocks.groupBy("doc").agg(
        F.count_distinct("page", "cell_order").alias("cell_count"), F.count("*").alias("block_count"), F.count_distinct("section_order", "section_heading").alias("section_count"),
        F.count_if("manual_review_required").alias("manual_review_block_count"), of("safety_symbol_table").alias("safety_table_count"), of("navigation_ui").alias("navigation_ui_count"), of("spec_table").alias("spec_table_count"),
        of("regulatory_note").alias("regulatory_note_count"),
    )


def summary_fields(summaries: DataFrame) -> DataFrame:
    """doc, field, value: a summary in long form."""
    names = [c for c in summaries.columns if c != "doc"]
    return summaries.select("doc", *[F.col(c).cast("string").alias(c) for c in names]).unpivot("doc", names, "field", "value")


def section_summary(blocks: DataFrame) -> DataFrame:
    """Blocks and those for manual review of each section, by number and heading."""
    return blocks.groupBy("doc", "section_order", F.col("section_heading").alias("heading")).agg(F.count("*").alias("block_count"), F.count_if("manual_review_required").alias("manual_review_block_count"))


def review_view(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc", "block_order", "section_heading", "block_type", "manual_review_required", F.array_join("lines", "\n").alias("lines_text"), F.size("sentences").alias("sentence_count"), "page", "cell_order")


def safety_view(blocks: DataFrame) -> DataFrame:
    """A row for each row of each safety block."""
    rows = blocks.where("block_type = 'safety_symbol_table'").select("doc", "block_order", "section_heading", F.explode(R.block_rows(F.col("text"))).alias("r"))
    return rows.select("doc", "block_order", "section_heading", "r.row_order", "r.symbol_key", "r.label", F.array_join("r.lines", "\n").alias("lines_text"))


def navigation_view(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_type = 'navigation_ui'").select("doc", "block_order", "section_heading", "text", "page", "cell_order")


def spec_view(blocks: DataFrame) -> DataFrame:
    """A row for each row of each specification."""
    b = blocks.where("block_type = 'spec_table'")
    rows = b.select("doc", "block_order", "section_heading", "spec_category", F.explode(T.spec_rows(F.col("spec_field"), F.col("text"), F.col("spec_category"))).alias("r"))
    return rows.select("doc", "block_order", "section_heading", "spec_category", "r.*")


def note_view(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_type = 'regulatory_note'").select("doc", "block_order", "section_heading", "topic_id", "text")


def content_markdown(blocks: DataFrame) -> DataFrame:
    """doc, markdown: a document's blocks in order, a heading where the section changes."""
    w = Window.partitionBy("doc").orderBy("block_order")
    new = F.coalesce(F.lag("section_heading").over(w) != F.col("section_heading"), F.lit(True))
    number = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    head = F.when(new, F.concat(F.lit("## "), number("section_order", 2), F.lit(". "), "section_heading", F.lit("\n\n"))).otherwise("")
    body = F.concat(head, F.lit("### Block "), number("block_order", 3), F.lit(" - "), "block_type", F.lit("\n\n"), F.lit("- manual_review_required: `"), F.col("manual_review_required").cast("string"), F.lit("`\n\n"), "text")
    parts = blocks.select("doc", "block_order", body.alias("_md"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_order", "_md"))), lambda p: p["_md"])
    return parts.groupBy("doc").agg(F.array_join(ordered, "\n\n").alias("markdown"))


def clean_joined(x: Column) -> Column:
    """Spaces that joining left around marks are taken out; a quote keeps its space before a word that goes on."""
    out = T.collapsed(x)
    for old, new in ((" .", "."), (" ,", ","), (" :", ":"), (" ;", ";"), ("( ", "("), (" )", ")"), ('" ', '"'), ('"in', '" in'), ('"and', '" and')):
        out = F.replace(out, F.lit(old), F.lit(new))
    return T.collapsed(out)


def cell_texts(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, normalized_text: a cell's items as running text.  Menus are left out, headings end in a full stop, labels and
    scraps join what stands before them."""
    kind, text = F.col("kind"), F.col("text")
    told = F.when(kind == "heading", T.ended(text)).otherwise(text)
    parts = items.where(kind != "navigation").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", told.alias("t")))).alias("_parts"))
    joined = clean_joined(F.array_join(F.transform("_parts", lambda p: p["t"]), " "))
    every = items.select(*keys).distinct().join(parts.select(*keys, joined.alias("normalized_text")), keys, "left")
    return every.withColumn("normalized_text", F.coalesce("normalized_text", F.lit("")))


def extraction_totals(cells: DataFrame, items: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """doc, total_chars, total_cells, empty_cells, total_sentences, ocr_recommended.  cells: keys (doc among them), text."""
    empty = F.btrim(F.regexp_replace("text", T.WHITE + "+", " ")) == ""
    a = cells.groupBy(doc).agg(F.sum(F.length("text")).alias("total_chars"), F.count("*").alias("total_cells"), F.count_if(empty).alias("empty_cells"))
    n = F.when(F.col("kind") != "heading", F.size(R.sentences(F.col("text")))).otherwise(0)
    out = a.join(items.groupBy(doc).agg(F.sum(n).alias("_n")), doc, "left").withColumn("total_sentences", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")
    return out.withColumn("ocr_recommended", needs_ocr(F.col("total_chars"), F.col("total_cells"), F.col("empty_cells")))


def needs_ocr(chars: Column, cells: Column, empty: Column) -> Column:
    """Hardly any text, or hardly any cell with text."""
    return (chars < 200) | F.coalesce((cells > 0) & (empty / cells > 0.8), F.lit(False))


def item_sections(items: DataFrame) -> DataFrame:
    """doc, section_order, heading, heading_kind, blocks: each section with its blocks (order, type, text) in order.

    Items before the first heading have a section of their own, UNSECTIONED."""
    kind, text = F.col("kind"), F.col("text")
    w = Window.partitionBy("doc").orderBy(*ORDER)
    heads = (kind == "heading").cast("int")
    rows = items.withColumns({"_n": F.sum(heads).over(w), "_at": F.row_number().over(w)})
    first = F.first("kind").over(w) != "heading"
    rows = rows.withColumn("section_order", F.col("_n") + first.cast("int"))
    kind_of = F.when(T.is_safety_table(text), "safety_symbol_table").when(kind.isin("navigation", "ui_label"), "navigation_ui").otherwise(kind)
    block = F.when(kind != "heading", F.struct("_at", kind_of.alias("block_type"), "text"))
    grouped = rows.groupBy("doc", "section_order").agg(F.max(F.when(kind == "heading", text)).alias("_heading"), F.array_sort(F.collect_list(block)).alias("_b"))
    blocks = F.transform("_b", lambda b, i: F.struct((i + 1).alias("block_order"), b["block_type"].alias("block_type"), b["text"].alias("text")))
    return grouped.select("doc", "section_order", F.coalesce("_heading", F.lit(UNSECTIONED)).alias("heading"), F.when(F.col("_heading").isNull(), "synthetic").otherwise("heading").alias("heading_kind"), blocks.alias("blocks"))


def section_block_view(sections: DataFrame) -> DataFrame:
    """A row for each block of each section."""
    return sections.select("doc", "section_order", "heading", F.explode("blocks").alias("b")).select("doc", "section_order", "heading", "b.*")


def section_safety_view(sections: DataFrame) -> DataFrame:
    """A row for each row of each safety table of each section."""
    rows = section_block_view(sections).where("block_type = 'safety_symbol_table'").select("doc", "section_order", "heading", "block_order", F.explode(R.safety_rows(F.col("text"))).alias("r"))
    return rows.select("doc", "section_order", "heading", "block_order", "r.row_order", "r.symbol_key", "r.label", F.array_join("r.lines", "\n").alias("lines_text"))


def item_view(items: DataFrame, pages: DataFrame, language: str) -> DataFrame:
    """Items of one language with the place of their cells, numbered in the cell.

    pages: doc, page, language, review_order, page_role."""
    own = pages.where(F.col("language") == language).select("doc", "page", "review_order", "page_role")
    at = F.row_number().over(Window.partitionBy("doc", "page", "cell_order").orderBy("ord"))
    return items.join(own, ["doc", "page"]).select("doc", "page", "review_order", "page_role", "cell_order", at.alias("item_order"), "kind", "text")


def sentence_view(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sentence_order, text of each sentence of cells' normalized_text."""
    return texts.select(*keys, F.posexplode(R.sentences(F.col("normalized_text"))).alias("_i", "text")).select(*keys, (F.col("_i") + 1).alias("sentence_order"), "text")


def cell_styles(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, span_count, max_font_size and the number of bold, italic and underlined spans."""
    return spans.groupBy(*keys).agg(F.count("*").alias("span_count"), F.max("size").alias("max_font_size"), *[F.count_if(c).alias(f"{c}_span_count") for c in ("bold", "italic", "underline")])


def item_styles(items: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each item (keys, ord) with the style of the spans of its cell whose texts it contains, or of all of them if it
    contains none: span_count, max_font_size, bold, italic, underline."""
    own = items.select(*keys, F.col("ord").alias("_item"), F.col("text").alias("_text"))
    both = own.join(spans.select(*keys, "text", "size", "bold", "italic", "underline"), keys, "left")
    hit = F.coalesce((F.col("text") != "") & F.col("_text").contains(F.col("text")), F.lit(False))
    seen = F.col("size").isNotNull()

    def told(when: Column, suffix: str) -> list[Column]:
        return [F.count_if(when).alias(f"n{suffix}"), F.max(F.when(when, F.col("size"))).alias(f"s{suffix}"), *[F.bool_or(F.when(when, F.col(c))).alias(f"{c}{suffix}") for c in ("bold", "italic", "underline")]]

    g = both.groupBy(*keys, "_item").agg(*told(hit & seen, "_h"), *told(seen, "_a"))
    pick = lambda h, a, none: F.coalesce(F.when(F.col("n_h") > 0, F.col(h)).otherwise(F.col(a)), none)
    return g.select(*keys, F.col("_item").alias("ord"), pick("n_h", "n_a", F.lit(0)).alias("span_count"), pick("s_h", "s_a", F.lit(0.0)).alias("max_font_size"), *[pick(f"{c}_h", f"{c}_a", F.lit(False)).alias(c) for c in ("bold", "italic", "underline")])


def cell_rects(blocks: DataFrame, width: Column, height: Column, rows: int = 2, columns: int = 8) -> DataFrame:
    """page, cell_order and the rectangle that is cut out for each cell of which a block needs a picture, once.

    blocks: page, cell_order, row, column (from 1), manual_review_required."""
    cells = blocks.where("manual_review_required").select("page", "cell_order", "row", "column").distinct()
    w, h = width / columns, height / rows
    return cells.select("page", "cell_order", ((F.col("column") - 1) * w).alias("x0"), ((F.col("row") - 1) * h).alias("y0"), (F.col("column") * w).alias("x1"), (F.col("row") * h).alias("y1"))
