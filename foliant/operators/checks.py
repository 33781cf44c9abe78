"""Checks against expectations: phrases, page structure, required regions, changes between versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

MODES = ("exact", "partial", "similarity", "regex", "manual")


@dataclass(frozen=True)
class Phrase:
    """A phrase that texts must have (or must not): how it is matched and, for similarity, from which share on."""

    name: str
    mode: str
    value: str = ""
    required: bool = True
    least: float = 0.9

    def found(self, text: Column) -> Column:
        """Whether a line of the text matches: null where only people can tell."""
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        lines = F.transform(F.split(text, "\n"), T.collapsed)
        if self.mode == "exact":
            return F.array_contains(lines, self.value)
        if self.mode == "partial":
            return text.contains(self.value)
        if self.mode == "regex":
            return text.rlike(self.value)
        if self.mode == "similarity":
            size = lambda x: F.greatest(F.length(x), F.lit(len(self.value)), F.lit(1))
            # lines whose length alone rules a match out are not compared
            near = lambda x: F.when(F.abs(F.length(x) - len(self.value)) <= (1 - self.least) * size(x), 1 - F.levenshtein(x, F.lit(self.value)) / size(x) >= self.least).otherwise(False)
            return F.exists(lines, near)
        return F.lit(None).cast("boolean")


def phrases(docs: DataFrame, rules: list[Phrase]) -> DataFrame:
    """doc_id, rule, status for each document and rule: PASS, FAIL, or REVIEW_REQUIRED where it cannot be told.

    Rules are columns of one scan of the documents, so there is no join.  A null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    told = []
    for r in rules:
        hit = r.found(text)
        told.append(F.struct(F.lit(r.name).alias("rule"), F.when(hit.isNull(), "REVIEW_REQUIRED").when(hit == F.lit(r.required), "PASS").otherwise("FAIL").alias("status")))
    return docs.select("doc_id", F.explode(F.array(*told)).alias("r")).select("doc_id", "r.rule", "r.status")


def document_type(sizes: Column) -> Column:
    """From the set of a document's page sizes."""
    return F.when(F.array_distinct(sizes) == F.array(F.lit("A5")), "BOOK").when(F.array_contains(sizes, "A2"), "A2").when(F.array_contains(sizes, "A3"), "A3").otherwise("UNKNOWN")


def structure(profiles: DataFrame) -> DataFrame:
    """Adds issues and status to rows of doc_type, language_count, languages and found_type, found_languages.

    A document without detected languages counts as its profile's if that has only one."""
    alone = (F.size("found_languages") == 0) & (F.col("language_count") == 1)
    found = F.when(alone, F.col("languages")).otherwise(F.col("found_languages"))
    rules = {"doc_type": F.col("doc_type") != F.col("found_type"), "language_count": F.col("language_count") != F.size(found), "languages": F.col("languages") != found}
    issues = F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))
    return profiles.withColumn("issues", issues).withColumn("status", F.when(F.size("issues") == 0, "PASS").otherwise("REVIEW_REQUIRED"))


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str, intended: DataFrame | None = None) -> DataFrame:
    """keys, change (added, removed, changed), before, after of rows that differ; intended changes (keys) are left out.

    old and new have one row a key."""
    a = old.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    out = both.select(*keys, change.alias("change"), "before", "after").where("change is not null")
    return out if intended is None else out.join(intended.select(*keys).distinct(), keys, "left_anti")


def completeness(hints: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Hints that name no node, or a node twice: keys, n, problem.  Empty if every hint is used exactly once."""
    counted = hints.groupBy(*keys).agg(F.count("*").alias("n"))
    known = counted.join(nodes.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left")
    problem = F.when(F.col("_known").isNull(), "no_node").when(F.col("n") > 1, "repeated")
    return known.select(*keys, "n", problem.alias("problem")).where("problem is not null")


def bag_counts(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n_first, n_second: how often each row occurs on either side."""
    count = lambda df, n: df.groupBy(*columns).agg(F.count("*").alias(n))
    both = count(first, "n_first").join(count(second, "n_second"), columns, "full")
    return both.select(*columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_first", "n_second")])


def copies(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """digest, copies, first_id of texts that occur more than once."""
    return rows.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(ident).alias("first_id")).where("copies > 1")


def pinned(rows: DataFrame, pins: DataFrame, key: str, content: str) -> DataFrame:
    """rows with pin: ok where the content's SHA-256 is the one that pins (key, sha256) state, changed where it is not,
    unknown without a pin."""
    out = rows.join(pins.select(key, F.col("sha256").alias("_sha")), key, "left")
    same = F.sha2(F.col(content).cast("binary"), 256) == F.lower("_sha")
    return out.withColumn("pin", F.when(F.col("_sha").isNull(), "unknown").when(same, "ok").otherwise("changed")).drop("_sha")


def in_scope(profiles: DataFrame, scopes: DataFrame) -> DataFrame:
    """profiles with the name of the scope that they fall into, null for none: token (without regard to case), type and
    languages (null: any) have to agree.  scopes has one row a token, type and list of languages."""
    s = scopes.select(F.col("name").alias("scope"), F.lower("source_token").alias("_t"), F.col("doc_type").alias("_d"), F.col("languages").alias("_l"))
    fits = (F.lower("source_token") == F.col("_t")) & (F.col("_d").isNull() | (F.col("doc_type") == F.col("_d"))) & (F.col("_l").isNull() | (F.col("languages") == F.col("_l")))
    return profiles.join(s, fits, "left").drop("_t", "_d", "_l")
