"""Misspelled and quoted terms in whole documents."""

import zlib

import pytest

from curatrix.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def scores(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.score for r in toxicity.score(rows, model).orderBy("doc_id").collect()]


def test_misspelled_and_quoted_documents(spark, model):
    lexicon = toxicity._lexicon(model.lexicon, model.spelled)
    held = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0 and length(text) > 100").orderBy("doc_id").select("text", "toxic").collect()
    toxic, clean = [r.text for r in held if r.toxic == 1], [r.text for r in held if r.toxic == 0]
    plain, wrong = scores(spark, model, toxic), scores(spark, model, [toxicity.misspell(t, lexicon) for t in toxic])
    assert sum(s >= 0.5 for s in plain) > 0.9 * len(toxic)
    assert sum(s >= 0.5 for s in wrong) > 0.6 * len(toxic)
    assert sum(s >= 0.5 for s in scores(spark, model, clean)) < 0.02 * len(clean)
    strong = sorted((t for t in model.spelled if len(t) > 4), key=lambda t: (-model.spelled[t], zlib.crc32(t.encode())))[:3]
    told = [c[:300] + f' They wrote "{strong[0]} {strong[1]}" there.' for c in clean]
    said = [c[:300] + f" {strong[0]} {strong[1]} {strong[2]}, {strong[0]} all of you." for c in clean]
    quoted, meant = scores(spark, model, told), scores(spark, model, said)
    assert sum(s >= 0.5 for s in quoted) < 0.05 * len(clean)
    assert sum(q < m for q, m in zip(quoted, meant, strict=True)) > 0.95 * len(clean)


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ('they wrote "a moron" there', True),
        ('a 5" pipe broke. you are a moron now', False),
        ('a 5" pipe and a 7" pipe, you moron and 9" more', False),
        ('"fine", you are a moron, "so there"', False),
        ("er schrieb „moron“ dazu", True),
        ("il écrit « moron » ici", True),
        ('"' + "word " * 30 + "moron " + "word " * 30 + '"', False),
        ("moron", False),
        ('"moron"', True),
        ('"moron', False),
    ],
)
def test_quotation_is_judged_near_the_term(text, quoted):
    f = toxicity.features(text, toxicity.Lexicon({"moron": 1.0}, frozenset(["moron"])))
    assert (f[4] > 0) == quoted and (f[0] > 0) == (not quoted)


def test_empty_table(spark, model):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert toxicity.score(none, model).collect() == []
    assert toxicity.train(none, none).lexicon == {}


def test_ids_that_repeat_count_once(spark):
    rows = [(1, "you scum", 1)] * 500 + [(1, "you moron", 1), (2, "a fine day", 0), (3, "moron", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    from curatrix.llm.common import one_text

    assert sorted((r.doc_id, r.text) for r in one_text(docs, "doc_id", "toxic").collect()) == [(1, "you moron"), (2, "a fine day"), (3, "moron")]
