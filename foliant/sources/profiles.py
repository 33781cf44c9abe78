"""Profiles of documents: file names, loading, validation, lookup by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "source_token string, region string, buyer_codes string, languages string, doc_type string, language_count int"

# What a strict profile row may hold.
REQUIRED = ("source_token", "languages", "doc_type", "language_count")
ALLOWED = (*REQUIRED, "region", "buyer_codes")
DOCUMENT_TYPES = ("A2", "A3", "BOOK")
LANGUAGE = r"^(?:[A-Z]{3}|[A-Z]-[A-Z]{3})$"
TOKEN = r"^[A-Z0-9]+(?: [A-Z0-9]+)*_[A-Z0-9-]+$"
STRICT_NAME = r"(?i)^BN68-\d{5}[A-Z]-\d{2}_SUG_.+ ALL_([^\r\n]+?)_\d{6}\.\d+\.pdf$"


def strict_token(name: Column) -> Column:
    """The source token in a file name of the standard form; null in any other, or where the token is not trimmed."""
    token = F.regexp_extract(name, STRICT_NAME, 1)
    return F.when((token != "") & (token == F.btrim(token, F.lit(" \t\x0b\x0c"))), token)


def items(x: Column) -> Column:
    """A list written with semicolons: trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(x, ";"), lambda v: F.btrim(v)), lambda v: v != "")


def array_rows(spark: SparkSession, path: str) -> DataFrame:
    """row_index, row (JSON text) of each element of a JSON array file, in the file's order."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("row_index", "row"))


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_last", F.row_number().over(w)).where("_last = 1").drop("_last")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from a JSON array; lists are split, and of several rows with one token the last counts."""
    parsed = array_rows(spark, path).select("row_index", F.from_json("row", SCHEMA).alias("p")).select("row_index", "p.*")
    return last_of_each(parsed, "source_token", "row_index").drop("row_index").withColumns({c: items(F.col(c)) for c in ("buyer_codes", "languages")})


def language_token(token: Column) -> Column:
    """numbered (L and two digits that are not 00), single (three letters, or a letter before them), named (four letters or
    more), or invalid."""
    return F.when(token == "LXX", "invalid").when(token.rlike(r"^L\d{2}$"), F.when(token == "L00", "invalid").otherwise("numbered")).when(token.rlike(LANGUAGE), "single").when(token.rlike("^[A-Z]{4,}$"), "named").otherwise("invalid")


def token_part(token: Column) -> Column:
    """What a source token says of its languages: all behind its last underscore."""
    return F.substring_index(token, "_", -1)


def inconsistent(token: Column, languages: Column) -> Column:
    """Whether the language part of a token contradicts the list: another number, one language for a combination, or another
    language than the one it names."""
    part, n = token_part(token), F.size(languages)
    kind = language_token(part)
    return (
        F.when(kind == "numbered", F.substring(part, 2, 2).cast("int") != n).when(kind == "named", n < 2)
        .when(kind == "single", languages != F.array(part)).otherwise(False)
    )


def strict_errors(rows: DataFrame) -> DataFrame:
    """row_index, source_token, languages, errors (all rules that a row breaks, in the order of checking) and accepted, for
    rows of row_index and row (JSON text).

    Tokens are compared without case.  Of a combination's rows that list other languages than the first, each is wrong."""
    v = F.try_parse_json("row")
    rows = rows.withColumn("_v", v).withColumn("_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    keys = F.when(F.col("_object"), F.json_object_keys("row")).otherwise(F.array().cast("array<string>"))
    kind = lambda c: F.schema_of_variant(F.try_variant_get("_v", f"$.{c}", "variant"))
    text = lambda c: F.when(kind(c) == "STRING", F.try_variant_get("_v", f"$.{c}", "string"))
    rows = rows.withColumns({"_keys": keys, "source_token": text("source_token"), "_listed": text("languages"), "_type": text("doc_type"), "_n": F.when(kind("language_count") == "BIGINT", F.try_variant_get("_v", "$.language_count", "bigint"))})
    rows = rows.withColumn("languages", F.split("_listed", ";"))
    langs, token = F.col("languages"), F.col("source_token")
    has = lambda c: F.array_contains("_keys", c)
    untrimmed = lambda c: F.coalesce((text(c) == "") | text(c).rlike(r"^\s|\s$"), F.lit(True))
    by_token = Window.partitionBy(F.lower("source_token")).orderBy("row_index")
    part = F.when(language_token(token_part(token)) == "named", token_part(token))
    by_name = Window.partitionBy(part).orderBy("row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rules = {
        "not_an_object": ~F.col("_object"),
        "field_missing": F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "_keys")) > 0,
        "field_unexpected": F.size(F.array_except("_keys", F.array(*map(F.lit, ALLOWED)))) > 0,
        "region_not_text": has("region") & untrimmed("region"),
        "buyer_codes_not_text": has("buyer_codes") & untrimmed("buyer_codes"),
        "token_not_text": has("source_token") & untrimmed("source_token"),
        "token_shape": ~token.rlike(TOKEN) | (language_token(token_part(token)) == "invalid"),
        "languages_not_text": has("languages") & untrimmed("languages"),
        "type_not_text": has("doc_type") & untrimmed("doc_type"),
        "count_not_a_number": has("language_count") & F.col("_n").isNull(),
        "count_not_positive": F.col("_n") <= 0,
        "language_empty": F.exists(langs, lambda x: x == ""),
        "language_shape": F.exists(langs, lambda x: (x != "") & ~x.rlike(LANGUAGE)),
        "language_repeated": F.size(F.array_distinct(F.transform(langs, F.lower))) < F.size(langs),
        "count_differs": F.col("_n") != F.size(langs),
        "type_unknown": ~F.col("_type").isin(*DOCUMENT_TYPES),
        "token_contradicts": inconsistent(token, langs),
        "token_repeated": token.isNotNull() & (F.row_number().over(by_token) > 1),
        "combination_differs": part.isNotNull() & (F.first("languages").over(by_name) != langs),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))
    return rows.withColumn("errors", found).select("row_index", "source_token", "languages", "errors", (F.size("errors") == 0).alias("accepted"))


def strict_load(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from a JSON array of which every row passes strict_errors(); raises with the first fault otherwise, or if
    the array is empty."""
    rows = array_rows(spark, path)
    checked = strict_errors(rows)
    first = checked.where(~F.col("accepted")).orderBy("row_index").first()
    if first is not None:
        raise ValueError(f"profile row {first.row_index}: {first.errors[0]}")
    if rows.isEmpty():
        raise ValueError("the file must hold a JSON array with at least one profile")
    return checked.join(rows, "row_index").select("row_index", "source_token", "languages", F.get_json_object("row", "$.doc_type").alias("doc_type"), F.size("languages").alias("language_count"))


def errors(profiles: DataFrame) -> DataFrame:
    """profiles (split lists) with `errors`: the rules that a row breaks."""
    same = F.count("*").over(Window.partitionBy(F.lower("source_token")))
    langs = F.col("languages")
    rules = {
        "token_missing": F.coalesce(F.btrim("source_token") == "", F.lit(True)),
        "token_untrimmed": F.btrim("source_token") != F.col("source_token"),
        "token_repeated": same > 1,
        "languages_missing": F.coalesce(F.size(langs) < 1, F.lit(True)),
        "languages_repeated": F.size(F.array_distinct(F.transform(langs, F.lower))) < F.size(langs),
        "language_shape": F.exists(langs, lambda v: ~v.rlike(LANGUAGE)),
        "count_differs": F.col("language_count") != F.size(langs),
        "type_unknown": ~F.col("doc_type").isin(*DOCUMENT_TYPES),
    }
    return profiles.withColumn("errors", F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()])))


def lookup(files: DataFrame, profiles: DataFrame, fold: bool = True) -> DataFrame:
    """Files with their profile by token, without regard to case if `fold`; `found` tells hits from misses.

    profiles has one row a token, so no file is doubled; adaptive execution broadcasts them if they are small."""
    key = F.lower("source_token") if fold else F.col("source_token")
    p = profiles.withColumn("_key", key).drop("source_token").withColumn("_found", F.lit(True))
    return files.withColumn("_key", key).join(p, "_key", "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_key", "_found")


def misses(files: DataFrame, profiles: DataFrame, fold: bool = True) -> DataFrame:
    """Files without a profile."""
    key = F.lower("source_token") if fold else F.col("source_token")
    return files.withColumn("_key", key).join(profiles.select(key.alias("_key")), "_key", "left_anti").drop("_key")


def overlaid(rows: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """rows with those of the overlay behind them, and `conflict`: whether an overlay row has a key that rows has, too."""
    known = rows.select(key).distinct().withColumn("_known", F.lit(True))
    added = overlay.join(known, key, "left").withColumn("conflict", F.coalesce("_known", F.lit(False))).drop("_known")
    return rows.withColumn("conflict", F.lit(False)).unionByName(added)


def missing_of(required: Column, present: Column) -> Column:
    """What is required and not present, sorted."""
    return F.array_sort(F.array_except(required, present))


def find_mapping(start: str, name: str) -> str:
    """The one file of this name in the folder of `start` or one above it; raises if there is none, or more than one."""
    from pathlib import Path

    here = Path(start).resolve()
    found = [p / name for p in ([here] if here.is_dir() else []) + list(here.parents) if (p / name).is_file()]
    if len(found) != 1:
        raise FileNotFoundError(f"{name}: {len(found)} files at or above {start}, where one is needed")
    return str(found[0])
