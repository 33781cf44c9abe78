"""Quality of extracted documents: what the tree holds, what was lost, the hard gates and the status."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from foliant.functions import text as T

# Characters that must not get lost, roles of running text, diagnostics by what they tell.
SPECIAL_CHARACTERS = (">", "→", "/", "&", ":", "[", "]", "(", ")")
BODY_ROLES = ("paragraph", "list", "list_item", "label", "list_body", "table", "table_row", "table_header", "table_cell", "figure", "caption", "span", "link")
UNRESOLVED = ("unresolved_mcid", "unresolved_page_reference", "unsupported_objr", "tagged_xobject_unresolved")
LOSS = (*UNRESOLVED, "unsupported_stream_mcr", "tagged_form_xobject_unsupported", "tagged_xobject_unsupported", "invalid_mcid", "unsupported_structure_kid")
TYPOGRAPHY = ("typography_insufficient", "label_body_size_mismatch", "font_ratio_below_threshold")
GATES = (
    "is_marked", "has_structure", "has_heading", "has_body", "xml_round_trip", "resolved_references", "resolved_references_reported", "no_known_text_loss", "no_forbidden_xml_controls",
    "special_character_counts_preserved", "numbered_heading_series_valid", "numbered_heading_series_counts_consistent", "numbered_heading_typography_valid",
)
MULTILINGUAL_GATES = ("multilingual_interval_count_valid", "multilingual_heading_count_parity", "multilingual_heading_level_parity", "multilingual_heading_origin_parity", "multilingual_numbered_label_parity")


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark's functions do not have."""
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def measured(x: Column) -> Column:
    """A text as it is measured: normal form C, white space collapsed."""
    return T.collapsed(nfc(x))


def visibly_above(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path of the nodes above each visible fragment, repeated for each.  A fragment's path is its node's with its place
    appended and names them all, so nothing is a range over paths."""
    visible = fragments.where(F.btrim(F.regexp_replace("text", T.WHITE + "+", " ")) != "")
    return visible.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda n: F.slice("path", F.lit(1), n))).alias("path"))


def with_marks(nodes: DataFrame, keys: list[str], **places: DataFrame) -> DataFrame:
    """nodes with a mark for each table of places (keys, path): whether it has the node's path.

    The tables go under one another and not into joins, which would send all of them around again by the paths too."""
    rows = nodes.withColumn("_node", F.lit(True))
    for name, p in places.items():
        rows = rows.unionByName(p.select(*keys, "path", F.lit(True).alias(name)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "path")
    matches = F.lit(True)  # as in a join, what is null is nowhere
    for k in (*keys, "path"):
        matches = matches & F.col(k).isNotNull()
    return rows.withColumns({name: F.coalesce(F.bool_or(name).over(w) & matches, F.lit(False)) for name in places}).where("_node").drop("_node")


def traversal(nodes: DataFrame, fragments: DataFrame, promotions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the counts of a document's tree: elements, fragments, headings (with promoted ones), body roles and bodies
    with text, unknown roles, elements without text, forbidden characters and the fields that hold them.

    nodes: path, semantic_role, fields (texts of its attributes); promotions: path.  A document without elements is not in
    the result unless it has fragments."""
    n = with_marks(nodes, keys, has_text=visibly_above(fragments, keys), _promoted=promotions)
    role = F.col("semantic_role")
    heading = (role == "heading") | F.col("_promoted")
    body = role.isin(*BODY_ROLES)
    bad = F.transform(F.filter("fields", lambda x: x.isNotNull()), T.forbidden_characters)
    a = n.groupBy(*keys).agg(
        F.count("*").alias("element_count"), F.count_if(heading).alias("heading_count"), F.count_if(body).alias("body_role_node_count"), F.count_if(body & F.col("has_text")).alias("body_count"), F.count_if(role == "unknown").alias("unknown_role_count"),
        F.count_if(~F.col("has_text")).alias("empty_element_count"), F.sum(F.aggregate(bad, F.lit(0), lambda x, y: x + y)).alias("_bad"), F.sum(F.size(F.filter(bad, lambda x: x > 0))).alias("_fields"),
    )
    wrong = T.forbidden_characters(F.col("text"))
    b = fragments.groupBy(*keys).agg(F.count("*").alias("fragment_count"), F.sum(wrong).alias("_bad_text"), F.count_if(wrong > 0).alias("_bad_parts"))
    rows = a.unionByName(b, allowMissingColumns=True)
    both = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])  # a full join would lose how they are dealt
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = ("element_count", "fragment_count", "heading_count", "body_count", "body_role_node_count", "unknown_role_count", "empty_element_count")
    return both.select(*keys, *[zero(c).alias(c) for c in counts], (zero("_bad") + zero("_bad_text")).alias("forbidden_xml_control_count"), (zero("_fields") + zero("_bad_parts")).alias("forbidden_xml_control_field_count"))


def page_quality(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page and its fragments, characters and forbidden characters."""
    return fragments.groupBy(*keys, "page").agg(F.count("*").alias("fragment_count"), F.sum(F.length("text")).alias("character_count"), F.sum(T.forbidden_characters(F.col("text"))).alias("forbidden_xml_control_count"))


def role_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.groupBy(*keys, "source_role").agg(F.count("*").alias("n"))


def tagged_texts(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the fragments' texts in document order, empty ones left out, as measured."""
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("path", "text")))), lambda s: s["text"])
    return fragments.groupBy(*keys).agg(F.array_join(parts, " ").alias("_t")).select(*keys, measured(F.col("_t")).alias("text"))


def special_characters(tagged: DataFrame, baseline: DataFrame, keys: list[str], adjusted: DataFrame | None = None) -> DataFrame:
    """keys, character, tagged, baseline, count_preserved for each character that must not get lost.

    tagged and baseline: keys, text as measured.  A character is preserved if the baseline has none, or the tagged text as
    many at least.  adjusted (keys, character, verified) states counts that other evidence proves, in place of the baseline's."""
    both = tagged.select(*keys, F.col("text").alias("_a")).unionByName(baseline.select(*keys, F.col("text").alias("_b")), allowMissingColumns=True).groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    counted = lambda c: [T.occurrences(F.coalesce(c, F.lit("")), x) for x in SPECIAL_CHARACTERS]
    rows = F.array(*[F.struct(F.lit(x).alias("character"), a.alias("tagged"), b.alias("baseline")) for x, a, b in zip(SPECIAL_CHARACTERS, counted("_a"), counted("_b"))])
    out = both.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    wanted = F.col("baseline")
    if adjusted is not None:
        out = out.join(adjusted.select(*keys, "character", "verified"), [*keys, "character"], "left")
        wanted = F.coalesce("verified", "baseline")
        out = out.withColumn("baseline", wanted).drop("verified")
        wanted = F.col("baseline")
    return out.withColumn("count_preserved", (wanted == 0) | (F.col("tagged") >= wanted))


def useful_reference(code: Column, context: Column) -> Column:
    """Whether a diagnostic tells where: an unresolved id by page and id, both not negative; any other by any context."""
    number = lambda c: F.coalesce(context[c].try_cast("int") >= 0, F.lit(False))
    return F.when(code == "unresolved_mcid", number("page_index") & number("mcid")).otherwise(F.coalesce(F.size(context) > 0, F.lit(False)))


def diagnostic_counts(diagnostics: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the counts of a document's diagnostics (code, context as a map) that gates read."""
    code = F.col("code")
    unresolved = code.isin(*UNRESOLVED)
    return diagnostics.groupBy(*keys).agg(
        *[F.count_if(code == c).alias(f"{c}_count") for c in UNRESOLVED[:3]], F.count_if(unresolved).alias("unresolved_reference_count"), F.count_if(unresolved & ~useful_reference(code, F.col("context"))).alias("unreported_reference_count"),
        F.count_if(code.isin(*LOSS)).alias("extraction_loss_diagnostic_total"), F.count_if(code.isin(*TYPOGRAPHY)).alias("typography_diagnostic_count"),
    )


def multilingual_gates(status: Column, count: Column, level: Column, origin: Column, label: Column, excused: Column) -> Column:
    """The five gates of a heading audit by its status; without an audit, or where it does not apply, all hold."""
    yes, known = F.lit(True), F.coalesce(status, F.lit("not_configured"))
    idle = known.isin("not_configured", "not_applicable")
    blocked = known == "blocked_by_invalid_interval"
    told = lambda c: F.when(idle | blocked, yes).otherwise(F.coalesce(c, F.lit(False)))
    values = (~blocked, told(F.coalesce(count, F.lit(False)) | F.coalesce(excused, F.lit(False))), told(level), told(origin), told(label))
    return F.struct(*[v.alias(n) for n, v in zip(MULTILINGUAL_GATES, values)])


def evaluate(documents: DataFrame, counts: DataFrame, diagnostics: DataFrame, specials: DataFrame, series: DataFrame, keys: list[str], metrics: bool = False) -> DataFrame:
    """keys, every hard gate and status (pass or fail) of each document; metrics: and its counts, null where it has none.

    documents: marked, round_trip_ok and an audit's status, counts_match, levels_match, origins_match, labels_match,
    excused; counts as traversal(), diagnostics as diagnostic_counts(), specials as special_characters() give them; series:
    keys, valid, n of each numbered series.  What a document lacks counts as none of it."""
    s = series.groupBy(*keys).agg(F.every("valid").alias("_valid"), F.when(F.count_if("valid") >= 2, F.count_distinct(F.when(F.col("valid"), F.col("n"))) == 1).alias("_consistent"))
    kept = specials.groupBy(*keys).agg(F.every("count_preserved").alias("_kept"))
    d = documents.join(counts, keys, "left").join(diagnostics, keys, "left").join(kept, keys, "left").join(s, keys, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    gates = {
        "is_marked": F.coalesce("marked", F.lit(False)), "has_structure": n("element_count") > 0, "has_heading": n("heading_count") > 0, "has_body": n("body_count") > 0, "xml_round_trip": F.coalesce("round_trip_ok", F.lit(False)),
        "resolved_references": n("unresolved_reference_count") == 0, "resolved_references_reported": n("unreported_reference_count") == 0, "no_known_text_loss": n("extraction_loss_diagnostic_total") == 0,
        "no_forbidden_xml_controls": (n("forbidden_xml_control_count") == 0) & (n("forbidden_xml_control_field_count") == 0), "special_character_counts_preserved": F.coalesce("_kept", F.lit(True)),
        "numbered_heading_series_valid": F.coalesce("_valid", F.lit(True)), "numbered_heading_series_counts_consistent": F.coalesce("_consistent", F.lit(True)), "numbered_heading_typography_valid": n("typography_diagnostic_count") == 0,
    }
    out = d.withColumn("_m", multilingual_gates(*[F.col(c) for c in ("audit_status", "counts_match", "levels_match", "origins_match", "labels_match", "excused")]))
    out = out.select(*keys, *[v.alias(k) for k, v in gates.items()], "_m.*", *([c for c in counts.columns if c not in keys] if metrics else []))
    every = F.lit(True)
    for g in (*GATES, *MULTILINGUAL_GATES):
        every = every & F.col(g)
    return out.withColumn("status", F.when(every, "pass").otherwise("fail"))


def heading_hierarchy(nodes: DataFrame, fragments: DataFrame, promotions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, nth, path, level, classification, joined_text of each heading, promoted heading or heading candidate in order.

    nodes: path, source_role, semantic_role, heading_level; promotions: path, level."""
    p = promotions.select(*keys, "path", F.col("level").alias("_level")).distinct()
    n = nodes.join(p, [*keys, "path"], "left")
    heading, promoted = F.col("semantic_role") == "heading", F.col("_level").isNotNull()
    candidate = T.is_heading_candidate(F.col("source_role"))
    n = n.where(heading | promoted | candidate)
    classification = F.when(heading, "heading").when(promoted, "numbered_chapter_promotion").otherwise("source_role_candidate")
    level = F.when(heading, F.col("heading_level")).when(promoted, F.col("_level")).otherwise(T.candidate_level(F.col("source_role")))
    up = fragments.where("text <> ''").select(*keys, F.col("path").alias("_at"), "text", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.slice("path", F.lit(1), i))).alias("path"))
    texts = up.groupBy(*keys, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda s: s["text"]), " ").alias("joined_text"))
    told = n.select(*keys, "path", level.alias("level"), classification.alias("classification")).join(texts, [*keys, "path"], "left")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    return told.select(*keys, nth.alias("nth"), "path", "level", "classification", F.coalesce("joined_text", F.lit("")).alias("joined_text"))


def report_json(evaluated: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, report: a document's status, gates and counts as JSON with keys in order; null fields are kept.  Counts that
    evaluated has already are not worked out again."""
    gates = sorted((*GATES, *MULTILINGUAL_GATES))
    metrics = sorted(c for c in counts.columns if c not in keys)
    both = evaluated if set(metrics) <= set(evaluated.columns) else evaluated.join(counts, keys, "left")
    told = F.struct(F.struct(*gates).alias("hard_gates"), F.struct(*metrics).alias("metrics"), "status")
    return both.select(*keys, F.to_json(told, {"ignoreNullFields": "false"}).alias("report"))
