"""Main text: what no shortcut may lose."""

import pytest

from curatrix.llm import htmltext

BODY = "<h1>Title</h1><p>" + "Own words of the page. " * 20 + "</p>"
TEXT = "Title\n" + ("Own words of the page. " * 20).strip()


@pytest.mark.parametrize("wrapper", ['div class="content with-sidebar"', 'div class="no-sidebar"', 'div class="search-page"', 'div id="nav-wrapper"', "form action=/x", 'div class="comments-open"', 'div role="form"'])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_are_no_furniture(wrapper, inner):
    page = f'<body><nav>menu</nav><div class="sidebar">side</div><{wrapper}><{inner}>{BODY}</{inner}><div class="sidebar"><article>teaser</article></div></{wrapper.split()[0]}><footer>foot</footer></body>'
    got = htmltext.extract(page if inner == "article" else page.replace("<article>teaser</article>", "teaser"))
    assert got == TEXT


def test_articles_of_comments_stay_furniture():
    page = f"<body><div class='with-sidebar'><article>{BODY}</article></div><section id='comments'>" + "<article><p>me too, at length</p></article>" * 90 + "</section></body>"
    assert htmltext.extract(page) == TEXT


def test_articles_in_many_wrappers():
    assert htmltext.extract("".join(f"<div class='widget'><article><p>text {i}</p></article></div>" for i in range(5))) == "\n".join(f"text {i}" for i in range(5))


def test_notices_in_articles_go_and_shared_passages_stay(spark):
    notice, advert = "<div><p>Sign up for all of our letters</p></div>", "<p>Support this site today</p>"
    rows = [(i, f"http://h.example/{i}", f"<article><h1>Title {i}</h1>{notice}<p>{f'own{i} ' * 40}</p>{'<p>A passage that many quote</p>' if i % 2 else ''}{advert}</article>") for i in range(12)]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 12 and not any("Sign up" in r.text or "Support" in r.text for r in got)
    assert all(f"Title {r.page_id}" in r.text and f"own{r.page_id}" in r.text and ("many quote" in r.text) == (r.page_id % 2 == 1) for r in got)


@pytest.mark.parametrize("url", ["http://hot.example/{}", None])
def test_templates_of_one_layout_of_many(spark, url):
    rows = [(i, url and url.format(i), f"<body><div>Layout {i % 5} sells all of it</div><div><p>{f'own{i} ' * 40}</p></div></body>") for i in range(300)]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 300 and all("sells" not in r.text and f"own{r.page_id}" in r.text for r in got)
