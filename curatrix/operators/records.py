"""Nested records: repair, flattening for publication, filters and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text

CONSTANTS = {"dct_publisher": "Curatrix", "dcat_theme": "chemistry", "dct_type": "abstract", "dct_language": "en"}


def author(name: Column, affiliations: Column) -> Column:
    return F.struct(name.alias("name"), affiliations.alias("affiliations"))


def ordered_affiliations(authors: Column) -> Column:
    """All affiliations of all authors, not blank, each at its first place."""
    every = F.flatten(F.transform(authors, lambda a: F.coalesce(a["affiliations"], F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def author_display(authors: Column, contact: Column) -> Column:
    """Names with the short form of their first affiliation that isn't empty, the contact first."""
    named = F.filter(authors, lambda a: a["name"].isNotNull() & (a["name"] != ""))
    first = F.concat(F.filter(named, lambda a: a["name"] == contact), F.filter(named, lambda a: ~a["name"].eqNullSafe(contact)))
    own = lambda a: F.try_element_at(F.filter(a["affiliations"], lambda x: x != ""), F.lit(1))
    shown = F.transform(first, lambda a: F.coalesce(F.concat(a["name"], F.lit(" ("), text.short_institution(own(a)), F.lit(")")), a["name"]))
    return F.array_join(shown, " · ")


def author_details(authors: Column) -> Column:
    """Named authors with all their affiliations as they stand."""
    named = F.filter(authors, lambda a: a["name"].isNotNull() & (a["name"] != ""))
    return F.transform(named, lambda a: F.struct(a["name"].alias("name"), F.coalesce(a["affiliations"], F.array().cast("array<string>")).alias("affs")))


def flatten(records: DataFrame) -> DataFrame:
    """Search entries from records (file_title, title, contact, issued, authors, and keywords and relations if there are any)."""
    there = lambda name, kind, empty: (F.coalesce(F.col(name), empty) if name in records.columns else empty).cast(kind).alias(name)
    authors = F.coalesce(F.col("authors"), F.array().cast("array<struct<name:string,affiliations:array<string>>>"))
    return records.select(
        "file_title",
        F.coalesce(F.nullif("title", F.lit("")), "file_title").alias("title"),
        "contact",
        F.filter(F.transform(authors, lambda a: a["name"]), lambda x: x.isNotNull() & (x != "")).alias("authors"),
        ordered_affiliations(authors).alias("affiliations"),
        author_display(authors, F.col("contact")).alias("author_display"),
        author_details(authors).alias("author_details"),
        F.substring("issued", 1, 4).alias("year"),
        there("keywords", "string", F.lit("")),
        there("relations", "array<string>", F.array()),
    )


def repaired(raw: Column) -> Column:
    """A record of untrusted JSON with every field present: authors given as strings become structs, a lone affiliation a list, anything unusable its empty default."""
    v = F.try_parse_json(raw)
    names = F.from_json(F.coalesce(F.try_variant_get(v, "$.authors", "string"), F.lit("[]")), "array<string>")
    one = lambda a: F.try_parse_json(a)
    many = lambda a: F.from_json(F.try_variant_get(one(a), "$.affiliations", "string"), "array<string>")
    single = lambda a: F.array(F.try_variant_get(one(a), "$.affiliations", "string"))
    lifted = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda a: F.when(F.startswith(a, F.lit("{")), author(F.coalesce(F.try_variant_get(one(a), "$.name", "string"), F.lit("")), F.filter(F.coalesce(many(a), single(a)), lambda x: x.isNotNull()))).otherwise(author(a, F.array().cast("array<string>"))))
    field = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")).alias(name)
    relations = F.from_json(F.try_variant_get(v, "$.relations", "string"), "array<string>")
    return F.struct(field("title"), field("contact"), field("keywords"), lifted.alias("authors"), F.coalesce(relations, F.array().cast("array<string>")).alias("relations"))


def fill_empty(old: Column, new: Column) -> Column:
    """The old value unless it is null, blank or the text of a missing number."""
    held = lambda x: F.nullif(F.nullif(text.strip(x), F.lit("")), F.lit("nan"))
    return F.coalesce(held(old), held(new), old)


def fill_empty_list(old: Column, new: Column) -> Column:
    """The old list unless it is null or empty."""
    return F.when(F.coalesce(F.size(old), F.lit(0)) > 0, old).otherwise(F.coalesce(new, old))


def listed(title: Column, n: int = 55) -> Column:
    """A title as a list shows it."""
    return F.substring(title, 1, n)


def badge(status: Column, pending: Column) -> Column:
    return F.when(status == "failed", "[!]").when(pending > 0, F.concat(F.lit("["), pending.cast("string"), F.lit("?]"))).otherwise("[ok]")


def contains_search(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined by spaces, hold the query in any case; a blank query keeps all."""
    if not query.strip():
        return df
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.strip().lower())))
