"""Scalar functions on names, addresses and identifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from curatrix.functions import similarity

EX = "http://example.org/ns#"


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at either end, Unicode's included. A pattern would take the square of a run of white space further in."""
    return F.btrim(x, F.lit(WHITE))


def normalise(x: Column) -> Column:
    return F.lower(strip(x))


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def short_institution(x: Column) -> Column:
    """What stands before the first comma."""
    return F.trim(F.substring_index(x, ",", 1))


def truncated(x: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(mark))).otherwise(x)


def html_escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def percent_encode(x: Column) -> Column:
    """As a part of an address: letters, digits and - _ . ! ~ * ' ( ) stay."""
    x = F.url_encode(x)
    for code, raw in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        x = F.replace(x, F.lit(code), F.lit(raw))
    return x


def name_to_uri(name: Column, base: str = EX) -> Column:
    """A node's address from its name: letters, digits, underscores and hyphens; letters beyond ASCII and dots go, spaces become underscores."""
    # Fixed value: the pattern of what a name keeps.
    kept = F.replace(F.regexp_replace(strip(name), r"[^A-Za-z0-9\s._-]", ""), F.lit("."), F.lit(""))
    return F.concat(F.lit(base), percent_encode(F.replace(kept, F.lit(" "), F.lit("_"))))


def local_name(uri: Column) -> Column:
    return F.regexp_extract(uri, r"([^/#]*)$", 1)


def is_valid_uri(x: Column) -> Column:
    return F.coalesce(F.try_parse_url(x, F.lit("PROTOCOL")).isin("http", "https") & (F.length(F.try_parse_url(x, F.lit("HOST"))) > 0) & ~F.contains(x, F.lit(",")) & ~F.contains(x, F.lit(" ")), F.lit(False))


def interpreted(value: Column) -> tuple[Column, Column]:
    """(kind, value): a DOI becomes an address at doi.org; an address is a uri, anything else a literal."""
    bare = strip(value)
    doi = F.when(F.startswith(bare, F.lit("doi:")), F.concat(F.lit("https://doi.org/"), F.trim(F.substr(bare, F.lit(5))))).when(F.regexp_like(bare, F.lit(r"^10\.\d{4,9}/")), F.concat(F.lit("https://doi.org/"), bare)).otherwise(bare)
    return kind_of(doi), doi


def kind_of(value: Column) -> Column:
    """Of an interpreted value: uri or literal."""
    return F.when(is_valid_uri(value), "uri").otherwise("literal")


# Fixed value: the pattern of a DOI.
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"


def dois(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(DOI), F.lit(0)))


def split_values(x: Column, separator: str) -> Column:
    """Trimmed parts that aren't blank."""
    return F.filter(F.transform(F.split(x, separator), strip), lambda v: v != "")


def split_authors(x: Column) -> Column:
    """Names joined by commas and a last "and"."""
    parts = F.split(F.replace(x, F.lit(" and "), F.lit(", ")), ",")
    return F.filter(F.transform(parts, lambda v: F.regexp_replace(F.trim(v), "^,+|,+$", "")), lambda v: v != "")


def parsed_organisation(x: Column) -> tuple[Column, Column, Column]:
    """(name, address, location) of a comma-separated organisation."""
    parts = F.filter(F.transform(F.split(x, ","), lambda v: F.trim(v)), lambda v: v != "")
    n = F.size(parts)
    numbered = F.transform(parts, lambda v, i: (i > 0) & F.regexp_like(v, F.lit("[0-9]")))
    at = F.array_position(numbered, True).cast("int")
    join = lambda a, start, count: F.array_join(F.slice(a, start, count), ", ")
    name = F.when(n == 0, F.lit("")).when((n <= 2) | (at == 0), F.element_at(parts, F.lit(1))).otherwise(join(parts, 1, F.greatest(at - 1, F.lit(0))))
    address = F.when((n > 2) & (at > 0), F.element_at(parts, F.greatest(at, F.lit(1)))).otherwise(F.lit(""))
    rest = F.when(at > 0, join(parts, at + 1, n)).otherwise(join(parts, 2, n))
    location = F.when(n <= 1, F.lit("")).when(n == 2, F.element_at(parts, F.lit(2))).otherwise(rest)
    return name, address, location


def carved_json(x: Column) -> Column:
    """The text from the first { to the last }, without Markdown fences; null if there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(x, "```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of lower-case strings; the second string is the matcher's reference, so the order matters. All pairs of a batch are compared at once."""
    out = pd.Series(float("nan"), index=a.index, dtype="float64")
    known = (a.notna() & b.notna()).to_numpy()
    if known.any():
        (x, left), (y, right) = pd.factorize(a[known]), pd.factorize(b[known])
        out[known] = similarity.ratios(similarity.Strings(similarity.lowered(list(left))), similarity.Strings(similarity.lowered(list(right))), x, y)
    return out.astype(object).where(known, None).astype("float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of ratio from lengths alone; filtering by it loses nothing."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.least(F.length(a), F.length(b)) / total)
