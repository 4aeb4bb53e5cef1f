"""Known languages against wrong declarations, registered domains and broken pages."""

import random
import time

import numpy as np
import pytest

from curatrix.llm import language

SF = "/root/testdata/sf0.01"


def test_wrong_declarations_and_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(5)
    known = [r for r in docs.where("lang is not null and length(text) > 300").orderBy("doc_id").collect() if r.doc_id % 3 == 0][:200]
    langs = sorted({r.lang for r in known})
    pages, truth = [], {}
    for i, r in enumerate(known):
        said = rng.choice([x for x in langs if x != r.lang]) if i % 2 else r.lang
        pages.append((i, f"https://{r.lang}{i % 5}.example.co.uk/{i}", f"<html lang={said}><p>{r.text[:400]}</p></html>"))
        truth[i] = r.lang
        pages.append((1000 + i, f"https://{r.lang}{i % 5}.example.co.uk/s{i}", "<html><p> </p></html>"))
        truth[1000 + i] = r.lang
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.where("doc_id % 3 <> 0")).collect()}
    right = lambda lo, hi: np.mean([got[i].lang == truth[i] for i in truth if lo <= i < hi])
    assert right(0, 1000) > 0.97  # the text outweighs a wrong declaration
    assert right(1000, 2000) > 0.9  # pages without words follow their host


def test_names_below_a_shared_suffix_share_nothing_more(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {x: docs.where(f"lang = '{x}' and length(text) > 500").orderBy("doc_id").first().text[:500] for x in ("en", "de")}
    pages = [(i, f"http://www.{'one' if i % 2 else 'two'}.co.uk/{i}", f"<p>{text['de' if i % 2 else 'en']}</p>") for i in range(40)]
    pages += [(100, "http://new.one.co.uk/", "<p>77</p>"), (101, "http://new.two.co.uk/", "<p>77</p>")]
    got = {r.page_id: r.lang for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert got[100] == "de" and got[101] == "en"


@pytest.mark.parametrize("page", ["<" * 1_000_000, "<" * 1_000_000 + ">", "<script " * 120_000 + ">", "<!--" * 250_000 + ">", "<html " * 170_000 + ">", "<p>" + "word " * 1_000_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    assert len(language.trigrams(language.visible(page))) >= 0 and language.declared(page, ["en"]) == 2
    assert time.time() - began < 5
