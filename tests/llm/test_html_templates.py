"""Templates by shape, and pages that would hold a task."""

import time

import pytest

from curatrix.llm import htmltext


def pages(spark, n, page):
    return spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(n)], "page_id long, url string, html string")


def test_menus_of_changing_links_go_by_their_shape(spark, monkeypatch):
    link = lambda i, k: f"<div><a href=/x{i}{k}>Link {i} of {k}</a></div>"
    page = lambda i: f"<body><div class=top>{link(i, 1)}{link(i, 2) * (i % 3)}</div><div><h1>Title {i}</h1><p>{f'own{i} ' * 40}</p></div></body>"
    got = htmltext.main_text(pages(spark, 12, page)).collect()
    assert all(r.text == f"Title {r.page_id}\n{(f'own{r.page_id} ' * 40).strip()}" for r in got)
    monkeypatch.setattr(htmltext, "MIN_PAGES", 1000)
    monkeypatch.setattr(htmltext, "ENOUGH_PAGES", 1000)
    assert all("Link" in r.text for r in htmltext.main_text(pages(spark, 12, page)).collect())


def test_recurrence_finds_what_names_call_furniture(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = htmltext.removals(rows).selectExpr("sum(n_template) as by_method", "sum(n_named) as by_name").first()
    assert got.by_method > 2 * rows.count() and got.by_name == 0
    few = pages(spark, 2, lambda i: f"<nav>menu {i}</nav><article><p>own {i}</p></article>")
    assert all(r.text == f"own {r.page_id}" for r in htmltext.main_text(few).collect())
    assert [(r.n_template, r.n_named) for r in htmltext.removals(few).collect()] == [(0, 1), (0, 1)]


def test_words_that_change_in_the_main_text_stay(spark):
    page = lambda i: f"<body><div>{''.join(f'<div class=part><p>part {k} of {i}</p></div>' for k in range(5))}</div></body>"
    assert all(r.text.count("part") == 5 for r in htmltext.main_text(pages(spark, 12, page)).collect())


HOSTILE = {
    "tags that never end": "<a " * 350_000,
    "quotes": "<a \">\" " * 150_000,
    "comments": "<!--" * 250_000 + ">",
    "sections": "<![CDATA[" * 110_000 + ">",
    "signs": "<" * 1_000_000 + ">",
    "depth": "<div>" * 100_000 + "</x>" * 120_000,
    "inline": "<p>" + "<b>x</b>" * 130_000,
    "scripts": "<script " * 120_000,
    "cells": "<td>" * 200_000,
    "long text": "<p>" + "word " * 1_000_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.time()
    assert isinstance(htmltext.extract(HOSTILE[name]), str)
    assert time.time() - began < 10


def test_text_of_elements_too_deep_stays():
    assert htmltext.extract("<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>after</p>").split() == ["deep", "after"]
    assert htmltext.extract("<p>one <b>two</b><i>three</i>") == "one twothree"
    assert htmltext.extract('<p title="a > b">x</p><a href="y>z</a>') == "x\nz"
