"""Titles and author blocks found in the text and layout of a document's first page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.text import strip

# Patterns of names and institutions.
NAME = r"[A-Z][a-z]+(?:\s[A-Z]\.?)?\s[A-Z][a-z]+"
SHORT_NAME = r"\b[A-Z]\.?\s?[A-Z][a-z]+"
INSTITUTION = r"\bUniversity\b|\bDortmund\b|\bInstitute\b|\bGermany\b"
TITLE_CHARS, TITLE_WORDS, BLOCK_LINES = 10, 3, 5
# White space inside a line, Unicode's and ASCII's.
_BLANK, _GAP = r"\t\x0B-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000", r"\t\x0B-\r "
#: The first line with more than TITLE_CHARS characters and TITLE_WORDS words between its first and last ones that aren't white space, and the lines below.
TITLE_AND_BELOW = (
    rf"(?dm)^[{_BLANK}]*+(?=[^{_BLANK}\n][^\n]{{{TITLE_CHARS - 1},}}[^{_BLANK}\n])"
    rf"(?:[^{_GAP}\n]++[{_GAP}]++){{{TITLE_WORDS}}}(?=[^\n]*?[^{_BLANK}\n])[^\n]*+(?:\n[^\n]*+){{0,{BLOCK_LINES}}}"
)
BOLD_SHARE, BOLD_CHARS = 0.6, 10


def bold_title(lines: Column) -> Column:
    """The first run of bold lines, joined, of lines array<struct<text, bold_ratio>>; short lines neither count nor break a run."""
    kept = F.filter(lines, lambda x: F.length(strip(x["text"])) >= BOLD_CHARS)
    bold = F.transform(kept, lambda x: F.coalesce(x["bold_ratio"] > BOLD_SHARE, F.lit(False)))
    start = F.array_position(bold, True).cast("int")
    after = F.slice(bold, F.greatest(start, F.lit(1)), F.size(bold))
    end = F.array_position(after, False).cast("int")
    run = F.slice(kept, F.greatest(start, F.lit(1)), F.when(end > 0, end - 1).otherwise(F.size(after)))
    return F.when(start > 0, F.array_join(F.transform(run, lambda x: strip(x["text"])), " ")).otherwise("")


def author_block(text: Column) -> Column:
    """Of the lines below the title those with a name, an institution or a comma; the title is the first line of some length.

    The pattern stops at the title and the lines below it, so no more of a text than these is split and tested."""
    below = F.slice(F.split(F.regexp_extract(text, TITLE_AND_BELOW, 0), "\n"), 2, BLOCK_LINES)
    return F.filter(F.transform(below, strip), lambda x: F.contains(x, F.lit(",")) | F.regexp_like(x, F.lit(SHORT_NAME)) | F.regexp_like(x, F.lit(INSTITUTION)))


def attributed(block: Column) -> Column:
    """Authors of a block: a line with a name opens an author, any other line is an affiliation of the author before it."""
    empty = F.array().cast("array<struct<name:string,affiliations:array<string>>>")
    lines = F.transform(block, lambda x: F.struct(x.alias("line"), F.regexp_extract(x, f"({NAME})", 1).alias("name")))

    def step(seen: Column, x: Column) -> Column:
        opened = F.array_append(seen, F.struct(x["name"].alias("name"), F.array().cast("array<string>").alias("affiliations")))
        last = F.element_at(seen, -1)
        longer = F.struct(last["name"].alias("name"), F.array_append(last["affiliations"], x["line"]).alias("affiliations"))
        added = F.array_append(F.slice(seen, 1, F.size(seen) - 1), longer)
        return F.when(x["name"] != "", opened).when(F.size(seen) > 0, added).otherwise(seen)

    return F.reduce(lines, empty, step)


def first_pages(pages: Column, n: int = 2) -> Column:
    """The first pages, each below a banner with its number."""
    return F.array_join(F.transform(F.slice(pages, 1, n), lambda p, i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), p)), "\n")
