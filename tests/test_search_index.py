"""Fuzzy search through pairs of letters against a scan of everything."""

import random

import pytest

from curatrix.operators import search

WORDS = "catalytic reduction of nitrogen oxides over zeolite supported copper methanol synthesis kinetics membrane reactor İstanbul straße".split()


def entries(spark, n=400):
    draw = random.Random(6)
    title = lambda: " ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 8)))
    rows = [(i, None if i % 50 == 0 else title(), [title() for _ in range(draw.randint(0, 2))] if i % 7 else None, ["", None] if i % 11 == 0 else []) for i in range(n)]
    return spark.createDataFrame(rows, "key int, title string, authors array<string>, affiliations array<string>"), rows


@pytest.mark.parametrize("query", ["zeolite", "methanol sinthesis", "Copper metanol", "xq", "a", "kinetics membran reactor", "STRASSE"])
@pytest.mark.parametrize("mode", ["all", "title"])
def test_index_equals_a_scan(spark, query, mode):
    frame, rows = entries(spark)
    wanted = query.lower()
    want = {}
    for key, title, authors, places in rows:
        values = [v for v in ([title] if mode == "title" else [title, *(authors or []), *(places or [])]) if v]
        best = min((search.substring_distance(wanted, v.lower()) / len(wanted) for v in values), default=None)
        if best is not None and best <= search.FUZZY:
            want[key] = best
    scan = {r.key: r.score for r in search.fuzzy_search(frame, query, mode).collect()}
    index = {r.key: r.score for r in search.indexed_search(frame, search.gram_index(frame, "key", mode), "key", query, mode).collect()}
    assert scan == want == index


def test_few_entries_are_compared(spark):
    """Titles of random letters: about one in fifty holds enough of a query's pairs."""
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60))) for i in range(5000)] + [(5000, "on nitrogen oxide reduction")]
    frame = spark.createDataFrame(rows, "key int, title string")
    met = frame.where(search._may_match("nitrogen oxides", search.FUZZY)(search._texts(frame, "title"))).count()
    assert 1 <= met < 150
    assert [r.key for r in search.fuzzy_search(frame, "nitrogen oxides", "title").collect()] == [5000]
