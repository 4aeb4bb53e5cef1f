"""Every language of the documents is modelled, and rare ones from all they have."""

import random

from pyspark.sql import functions as F

from curatrix.llm import language


def test_more_than_32_languages_and_rare_ones(spark, monkeypatch):
    rng = random.Random(4)
    names = [a + b for a in "abcdefgh" for b in "klmnp"]
    words = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(40)] for x in names}
    text = lambda x, n: " ".join(rng.choices(words[x], k=n))
    docs = [(text(x, 100), x) for i, x in enumerate(names) for _ in range(300 if i == 0 else 5)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(docs)], "doc_id long, text string, lang string")
    for name in ("TRAIN_DOCS",):  # rare languages come whole, however many rows the frequent ones have
        monkeypatch.setattr(language, name, 20)
    langs, table = language.train(docs)
    assert sorted(langs) == names and langs[0] == names[0] and table.shape[1] == len(names)
    pages = [(i, f"http://{x}.example/{i}", f"<html lang={x}><p>{text(x, 60)}</p>") for i, x in enumerate(names * 2)]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == len(pages)
    assert all(got[i].text_lang == got[i].lang == got[i].declared == x for i, x in enumerate(names * 2))
    monkeypatch.undo()
    whole, _ = language.train(docs.where(F.col("lang") == names[3]))
    assert whole == [names[3]]
