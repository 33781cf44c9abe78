"""Cover pages: spans to typed regions, contact tables, schema checks, Markdown and review views.

Rules that name a maker are built from a brand, which is a parameter, as are the marks of its address."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

# Region types, and the texts that tell them.
LANGUAGE_LABELS = ("ENG", "KOR", "ARA", "INS", "TPE", "C-FRA")
DOCUMENT_CODE = r"^BN\d{2}-\d{5}[A-Z]-\d{2}$"
TITLE_SIZE = 20.0
MERGED = ("body", "disclaimer", "contact_note", "website")
FOOTERS = ("copyright", "document_code")
REQUIRED = ("language_label", "title", "model_serial_fields", "support_note", "disclaimer", "contact_heading", "contact_table", "copyright", "document_code")
MANUAL = ("contact_table", "model_serial_fields", "body", "disclaimer", "support_note")
BOX = ("x0", "y0", "x1", "y1")


@dataclass(frozen=True)
class Rules:
    """The maker's name, marks of its address in a body text, and a body text that is address as a whole."""

    brand: str
    address_marks: tuple[str, ...] = ()
    address_whole: tuple[str, ...] = ()

    @property
    def center(self) -> str:
        return f"{self.brand} Service Center"

    def region_type(self, text: Column, size: Column) -> Column:
        """The first of the ordered tests that a span passes."""
        return self.collapsed_type(T.collapsed(text), size)

    def collapsed_type(self, x: Column, size: Column) -> Column:
        """region_type() of a text that is collapsed already; many tests read it, so it should be a column."""
        return (
            F.when(x.isin(*LANGUAGE_LABELS), "language_label").when(x.contains("All rights reserved"), "copyright").when((x == "-00") | x.rlike(DOCUMENT_CODE), "document_code")
            .when(size >= TITLE_SIZE, "title").when(x.contains(f"Contact {self.brand}"), "contact_heading").when(x.isin(self.center, "Website", "Address"), "table_heading")
            .when(x.startswith("www."), "website").when(x.contains("If you have any questions, please call"), "support_note").when(x.contains("1-800"), "contact_value")
            .when(x.contains("Model") & x.contains("Serial"), "model_serial_fields").when(x.contains("Figures and illustrations"), "disclaimer")
            .when(x.contains("Product design and specifications may change"), "product_note").when(x.contains("questions or comments"), "contact_note").otherwise("body")
        )

    def is_contact(self, kind: Column, text: Column) -> Column:
        """Whether a region belongs to the contact table."""
        return kind.isin("table_heading", "contact_value", "website") | ((kind == "body") & (T.any_of(text, self.address_marks) | text.isin(*self.address_whole)))

    def heading(self, kind: Column, text: Column) -> Column:
        return (
            F.when(kind.isin("title", "contact_heading", "table_heading"), text).when(kind == "language_label", "Language").when(kind == "model_serial_fields", "Model / Serial")
            .when(kind == "support_note", "Support Note").when(kind == "website", "Website").when(kind == "contact_value", self.center).when(kind == "contact_table", "Contact table")
        )

    def schema(self, text: Column) -> Column:
        """The cover schema that a page's text has: its own, with required regions, or the generic one."""
        named = T.any_of(text, (f"Contact {self.brand} world wide", self.center, f"Comment contacter {self.brand}"))
        return F.when(text.contains(f"1-800-{self.brand.upper()}") & named, "contact_cover").otherwise("generic_cover")


def region_markdown(kind: Column, text: Column) -> Column:
    """A region as Markdown by its type."""
    sites = F.transform(T.prefixed_parts(text, "www."), lambda v: F.concat(F.lit("| Website | "), v, F.lit(" |")))
    return (
        F.when(kind == "title", F.concat(F.lit("# "), text)).when(kind.isin("contact_heading", "table_heading"), F.concat(F.lit("## "), text)).when(kind == "language_label", F.concat(F.lit("**Language:** "), text))
        .when(kind == "model_serial_fields", "| Field | Value |\n|---|---|\n| Model |  |\n| Serial No. |  |").when(kind == "website", F.concat(F.lit("| Type | Value |\n|---|---|\n"), F.array_join(sites, "\n")))
        .when(kind == "contact_value", F.concat(F.lit("| Service Center | "), text, F.lit(" |"))).when(kind == "document_code", F.concat(F.lit("**Document code:** "), text)).otherwise(text)
    )


def table_markdown(header: list[Column], row: list[Column]) -> Column:
    """A table of one row as Markdown; line ends in a value become breaks."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return F.concat_ws("\n", line(header), line([F.lit("---")] * len(header)), line([F.replace(v, F.lit("\n"), F.lit("<br>")) for v in row]))


def regions(spans: DataFrame, rules: Rules) -> DataFrame:
    """Regions of cover pages, numbered in reading order.

    spans: page, cell_order, ord, text, size, bold, italic, underline and a box.  Gives page, region_order, region_type,
    heading, text, box, cell_order, n_spans, size, bold, italic, underline, markdown and, for a contact table, its values.

    In a cell, spans go by height, then from left; runs of one type that may be merged become one region.  On a page the
    first product note joins the first disclaimer, and contact regions become one table.  Codes and copyright come last."""
    typed = spans.withColumn("_x", T.collapsed(F.col("text"))).withColumn("region_type", rules.collapsed_type(F.col("_x"), F.col("size"))).drop("_x")
    w = Window.partitionBy("page", "cell_order").orderBy("y0", "x0", "ord")
    same = (F.lag("region_type").over(w) == F.col("region_type")) & F.col("region_type").isin(*MERGED)
    placed = typed.withColumns({"_new": (~F.coalesce(same, F.lit(False))).cast("int"), "_at": F.row_number().over(w)})
    placed = placed.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a run's first span stands for it: a grouping would hold the texts of all runs of a task, and order them anew
    run = Window.partitionBy("page", "cell_order", "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = {"_text": F.collect_list("text"), "n_spans": F.count("*"), "size": F.max("size"), **{c: F.bool_or(c) for c in ("bold", "italic", "underline")}, **{c: (F.min if c in ("x0", "y0") else F.max)(c) for c in BOX}}
    found = placed.withColumns({f"_{c}" if c != "_text" else c: v.over(run) for c, v in told.items()}).where("_new = 1")
    found = found.select("page", "cell_order", "_run", "region_type", T.collapsed(F.array_join("_text", " ")).alias("text"), *[F.col(f"_{c}").alias(c) for c in ("n_spans", "size", "bold", "italic", "underline")], *[F.round(f"_{c}", 2).alias(c) for c in BOX])
    page = Window.partitionBy("page").orderBy("cell_order", "_run")
    found = found.withColumn("_seq", F.row_number().over(page)).drop("_run")
    return numbered(with_contact_tables(with_disclaimers(found), rules), rules)


def with_disclaimers(found: DataFrame) -> DataFrame:
    """The first product note of a page joins the page's first disclaimer, if it has both."""
    every = Window.partitionBy("page")
    of = lambda kind, value: F.min(F.when(F.col("region_type") == kind, value)).over(every)
    rows = found.withColumns({"_d": of("disclaimer", F.col("_seq")), "_p": of("product_note", F.struct("_seq", "text", *BOX))})
    both = F.col("_d").isNotNull() & F.col("_p").isNotNull()
    rows = rows.where(~F.coalesce(both & (F.col("_seq") == F.col("_p._seq")), F.lit(False)))
    takes = both & (F.col("_seq") == F.col("_d"))
    joined = F.when(takes & F.col("_p.text").isNotNull(), T.collapsed(F.concat_ws(" ", "text", "_p.text"))).otherwise(F.col("text"))
    box = {c: F.when(takes, (F.least if c in ("x0", "y0") else F.greatest)(c, f"_p.{c}")).otherwise(F.col(c)) for c in BOX}
    return rows.select(*[joined.alias(c) if c == "text" else box[c].alias(c) if c in BOX else F.col(c) for c in found.columns])


def with_contact_tables(found: DataFrame, rules: Rules) -> DataFrame:
    """A page's contact regions as one region, behind the others: service center (the last stated), websites (each once) and
    address, which is null without any sign of one.  Regions without a value stay as they are."""
    kind, text, contact = F.col("region_type"), F.col("text"), F.col("_contact")
    every = Window.partitionBy("page")
    rows = found.withColumn("_contact", F.coalesce(rules.is_contact(kind, text), F.lit(False)))
    values = lambda when: F.collect_list(F.when(contact & when, F.struct("_seq", "text"))).over(every)
    rows = rows.withColumns({
        "_first": F.min(F.when(contact, F.struct("_seq", "cell_order"))).over(every), "_last": F.max(F.when(contact, F.col("_seq"))).over(every), "_center": F.max(F.when(contact & (kind == "contact_value"), F.struct("_seq", "text"))).over(every),
        "_sites": values(kind == "website"), "_address": values(kind == "body"), "_headed": F.bool_or(contact & (kind == "table_heading") & (text == "Address")).over(every),
        **{f"_{c}": (F.min if c in ("x0", "y0") else F.max)(F.when(contact, F.col(c))).over(every) for c in BOX},
    })
    ordered = lambda c: F.transform(F.array_sort(c), lambda s: s["text"])
    own = lambda c: F.when(contact, c)  # a page's values, at its contact regions only
    rows = rows.withColumns({
        "service_center": own(F.coalesce("_center.text", F.lit(""))), "websites": own(F.array_join(F.array_distinct(F.flatten(F.transform(ordered("_sites"), lambda v: T.prefixed_parts(v, "www.")))), "\n")),
        "address": own(F.when(F.col("_headed") | (F.size("_address") > 0), F.array_join(ordered("_address"), "\n"))),
    })
    told = (F.col("service_center") != "") | (F.col("websites") != "") | (F.coalesce("address", F.lit("")) != "")
    # the first contact region of a page with values becomes its table, the others go
    rows = rows.withColumn("_table", contact & told).where(~F.col("_table") | (F.col("_seq") == F.col("_first._seq")))
    named = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    names, cells = [F.lit(rules.center), F.lit("Website")], [F.col("service_center"), F.col("websites")]
    md = F.when(F.col("address").isNull(), table_markdown(names, cells)).otherwise(table_markdown([*names, F.lit("Address")], [*cells, F.col("address")]))
    whole = T.collapsed(F.concat_ws(" ", named(rules.center, "service_center"), named("Website", "websites"), named("Address", "address")))
    table = {"cell_order": F.col("_first.cell_order"), "region_type": F.lit("contact_table"), "text": whole, **{c: F.lit(None) for c in ("n_spans", "size", "bold", "italic", "underline")}, **{c: F.round(f"_{c}", 2) for c in BOX}, "_seq": F.col("_last") + (1 << 20)}
    at = F.col("_table")
    return rows.select(*[F.when(at, table[c]).otherwise(F.col(c)).cast(found.schema[c].dataType).alias(c) if c in table else F.col(c) for c in found.columns], F.when(at, md).alias("_md"), *[F.when(at, F.col(c)).alias(c) for c in ("service_center", "websites", "address")])


def numbered(found: DataFrame, rules: Rules) -> DataFrame:
    """Adds region_order (by height, then from left; codes and copyright last, from left), heading and markdown."""
    footer = F.col("region_type").isin(*FOOTERS)
    w = Window.partitionBy("page").orderBy(footer, F.when(~footer, F.col("y0")), "x0", "_seq")
    kind, text = F.col("region_type"), F.col("text")
    return found.select(
        "page", F.row_number().over(w).alias("region_order"), "region_type", rules.heading(kind, text).alias("heading"), "text", *BOX, "cell_order", "n_spans", "size", "bold", "italic", "underline",
        F.coalesce("_md", region_markdown(kind, text)).alias("markdown"), "service_center", "websites", "address",
    )


def contact_fields(tables: DataFrame) -> DataFrame:
    """page, region_order, field_name, field_value, label: the values of contact tables in long form, each once a field."""
    t = tables.where("region_type = 'contact_table'")
    plain = lambda values: F.transform(F.array_distinct(values), lambda v: F.struct(v.alias("url"), F.lit("").alias("label")))
    center = F.filter(F.array(T.collapsed(F.col("service_center"))), lambda v: v != "")
    fields = {
        "service_center": plain(center), "service_phone_numbers": plain(F.flatten(F.transform(center, T.phone_tokens))),
        "websites": F.array_distinct(F.transform(T.text_lines(F.col("websites")), T.website)), "address": plain(F.coalesce(T.text_lines(F.col("address")), F.array().cast("array<string>"))),
    }
    told = lambda name: lambda x, i: F.struct(F.lit(name).alias("field_name"), i.alias("nth"), x["url"].alias("field_value"), x["label"].alias("label"))
    rows = F.flatten(F.array(*[F.transform(v, told(name)) for name, v in fields.items()]))
    return t.select("page", "region_order", F.explode(rows).alias("f")).select("page", "region_order", "f.*")


def schema_checks(cells: DataFrame, found: DataFrame, rules: Rules) -> DataFrame:
    """page, schema_id, status, missing: whether a page has the regions that its schema requires.  cells: page, cell_order, text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("cell_order", "text"))), lambda s: s["text"])
    named = cells.groupBy("page").agg(rules.schema(F.array_join(parts, " ")).alias("schema_id"))
    present = found.groupBy("page").agg(F.collect_set("region_type").alias("_present"))
    required = F.when(F.col("schema_id") == "contact_cover", F.array(*map(F.lit, REQUIRED))).otherwise(F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(required, F.coalesce("_present", F.array().cast("array<string>"))))
    out = named.join(present, "page", "left").withColumn("missing", missing)
    return out.select("page", "schema_id", F.when(F.size("missing") == 0, "PASS").otherwise("REVIEW_REQUIRED").alias("status"), "missing")


def reviewed(found: DataFrame) -> DataFrame:
    """Adds manual_review_required (also whether OCR is advised) and slug, the name of the region's picture."""
    label = F.coalesce(F.nullif("heading", F.lit("")), F.nullif("text", F.lit("")), F.col("region_type"))
    slug = T.slug(label)
    name = F.concat(F.lit("region_"), F.lpad(F.col("region_order").cast("string"), 2, "0"), F.lit("_"), "region_type", F.lit("_"), F.when(slug == "", "region").otherwise(slug))
    return found.withColumns({"manual_review_required": F.col("region_type").isin(*MANUAL), "slug": name})


def cover_summary(rows: DataFrame) -> DataFrame:
    """page and the counts of a cover's reviewed regions: all, those for manual review, tables."""
    return rows.groupBy("page").agg(F.count("*").alias("region_count"), F.count_if("manual_review_required").alias("manual_review_region_count"), F.count_if(F.col("region_type") == "contact_table").alias("table_region_count"))


def cover_markdown(found: DataFrame) -> DataFrame:
    """page, markdown: the regions' Markdown in order, empty ones left out, a blank line between two."""
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("markdown") != "", F.struct("region_order", "markdown")))), lambda s: s["markdown"])
    return found.groupBy("page").agg(F.array_join(parts, "\n\n").alias("markdown"))


def clipped(found: DataFrame, width: Column, height: Column, margin: float = 3.0) -> DataFrame:
    """Adds the box that is cut out for a region's picture: its own with a margin, within the page."""
    low = lambda c: F.greatest(F.col(c) - margin, F.lit(0.0))
    return found.withColumns({"clip_x0": low("x0"), "clip_y0": low("y0"), "clip_x1": F.least(F.col("x1") + margin, width), "clip_y1": F.least(F.col("y1") + margin, height)})
