"""Operators against brute force, round trips and held-out labels, and on odd rows."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece as library
from pyspark.sql import functions as F

from curatrix.llm import ann, cotraining, htmltext, language, linecrf, sentencepiece, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None, None, None, 7), (2, "", "en", "a", 0, 7), (2, "", "en", "a", 0, 7), (None, " \n\t ", "xx", "\U0001f600", -5, 7), (3, "word " * 40_000, "en", "a", 200_000, 7), (4, "é▁ \x00 ß\n\n", "de", None, 9, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, score int")


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>x="</p>"</script></head><body><nav>menu</nav><header>site</header>
<div class="sidebar">side</div><article><header><h1>Title &amp; more</h1></header><p><b>One
 two<br>three<p>Four&nbsp;five<div class="ad">buy</div><aside>see</aside><ul><li>a<li>b</ul><form>f</form><section id="comments"><p>me too</p></section></article><footer>foot</footer></body></html>"""


def test_html_page():
    assert htmltext.extract(PAGE) == "Title & more\nOne two three\nFour five\na\nb"


@pytest.mark.parametrize("page", ["", "plain &lt;b&gt;", "<p>un<closed", "</div><p>x</p>", "<" * 50, "<article>" * 3000 + "deep", "<!-- never closed"])
def test_odd_html_gives_a_text(page):
    assert isinstance(htmltext.extract(page), str)


def test_html_tables(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Our shop sells all of it</div><div><p>Own words of page {i} " + f"w{i} " * 40 + "</p></div></body>") for i in range(8)]
    rows += [(None, None, None), (9, "x", ""), (9, "x", "")]
    got = htmltext.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert len(got) == 11 and all("shop" not in r.text for r in got) and sum("Own words" in r.text for r in got) == 8
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_of_a_split_host(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("url", F.expr("if(page_id % 3 = 0, 'http://hot.example/' || page_id, url)"))
    pages = pages.unionByName(pages.where("page_id < 9"))
    whole = sorted(map(tuple, htmltext.main_text(pages).collect()))
    monkeypatch.setattr(htmltext, "SLICE_PAGES", 5)
    assert htmltext._split_hosts(pages.withColumn("host", htmltext._host(F.col("url")))).where("host = 'hot.example' and slices > 10").count() == 1
    assert sorted(map(tuple, htmltext.main_text(pages).collect())) == whole and len(whole) == pages.count()


def test_html_pages_keep_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in htmltext.main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        plain = " ".join(htmltext.entities.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert r.text.replace("\n", " ") == plain


# Nearest neighbours


def test_neighbours_recall_and_scores(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in v.collect()}
    hit = total = 0
    for q, found in itertools.groupby(ann.search(v, v.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect(), lambda r: r.query_id):
        found = list(found)
        cos = {i: float(x @ rows[q] / np.linalg.norm(x) / np.linalg.norm(rows[q])) for i, x in rows.items() if i != q}
        best = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        hit, total = hit + len(set(best) & {r.vec_id for r in found}), total + 5
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and all(abs(r.score - cos[r.vec_id]) < 1e-12 for r in found)
    assert hit / total >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(50, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1e-300, 0.0]), (9, [1e-300, 0.0])]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(v, v.where("vec_id = 50")).orderBy("rank").collect()] == [(50, 1, 1), (50, 2, 2), (50, 3, 9)]
    assert ann.search(v.limit(0), v.limit(0)).collect() == []


# Classifiers


def test_quality_views(spark, docs, labels, odd):
    model = cotraining.train(docs, labels)
    scored = cotraining.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality > 0) for r in scored]) > 0.95
    assert cotraining.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    kept = cotraining.reject(odd, model)
    assert kept.columns == odd.columns and cotraining.reject(odd.limit(0), model).count() == 0
    assert cotraining.score(odd, cotraining.train(odd, labels.limit(0))).count() == len(ODD)


def test_toxicity_on_held_out_rows(spark, docs, labels, odd):
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= 0.5) == (r.toxic > 0) for r in rows]) > 0.9
    assert toxicity.score(odd, model).where("score < 0.5").count() == len(ODD)
    assert toxicity.reject(odd, model).columns == odd.columns and toxicity.reject(odd, model).count() == len(ODD)
    assert toxicity.score(odd, toxicity.train(odd, labels.limit(0))).count() == len(ODD)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_equal_edit_distances():
    terms = ["moron", "idiot", "disgusting", "scum", "pathetic"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0), frozenset(terms))
    words = {t[:i] + c + t[j:] for t in terms for i in range(len(t) + 1) for j in (i, i + 1, i + 2) for c in ("", "x", "o", "gg")}
    for w in words:
        near = sorted((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits(t))
        assert lexicon.fuzzy(w) == ((near[0][1], near[0][0]) if near else None), w


def test_quotation_counts_less():
    lexicon = toxicity.Lexicon({"moron": 1.0}, frozenset(["moron"]))
    plain, quoted = toxicity.features("you are a moron now", lexicon), toxicity.features('they wrote "a moron" there', lexicon)
    assert plain[0] > 0 and quoted[0] == 0 and quoted[4] > 0


# Rules


def test_rules_equal_brute_force(spark, docs, labels, odd):
    weights = linecrf.train(docs, labels)
    got = linecrf.quality_rules(docs.union(odd.select(docs.columns)), weights).collect()
    texts = [r.text or "" for r in docs.collect()] + [r[1] or "" for r in ODD]

    def counts(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = {}
        for i in range(len(words) - 7):
            runs.setdefault(tuple(words[i : i + 8]), []).append(i)
        repeated = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed

    made = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    assert sorted(made) == sorted(map(counts, texts))
    assert not any(r.kept and r.base_failed for r in got)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert np.mean([r.kept for r in got if r.doc_id in good and not r.base_failed]) > 0.97


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        unary, joint = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: sum(unary[i, a] for i, a in enumerate(y)) + sum(joint[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(linecrf.viterbi(unary, joint)) == max(itertools.product((0, 1), repeat=n), key=value)


# Languages


def test_languages(spark, docs):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = language.identify(pages, docs).collect()
    assert len(got) == pages.count() and np.mean([r.lang == r.declared for r in got]) > 0.95
    odd = spark.createDataFrame([(1, None, None, 1), (1, "", "", 1), (None, "http://a.b.c/", "<html lang='zz'>", 1), (2, "x", "<html lang=de>" + "the and of " * 50, 1)], "page_id long, url string, html string, lang int")
    rows = language.identify(odd, docs).collect()
    assert len(rows) == 4 and [r.lang for r in rows if r.page_id == 2] == ["en"]
    assert language.identify(odd.limit(0), docs).collect() == []
    assert [r.lang for r in language.identify(odd, docs.limit(0)).collect()] == [None] * 4


# Tokens


def test_tokens_equal_the_library_and_come_back(spark, docs, odd):
    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    rows = sentencepiece.encode(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert all(r.round_trip and r.ids == model.encode(r.text) for r in rows)
    encoded = sentencepiece.encode(odd)
    assert encoded.where("round_trip").count() == len(ODD)
    assert sorted(r.text for r in sentencepiece.decode(encoded).collect()) == sorted(r[1] or "" for r in ODD)


def test_unigram_relaxation_equals_all_segmentations():
    bytes_ = tuple(f"<0x{i:02X}>" for i in range(256))
    own = ("a", "b", "ab", "ba", "aba", "bab")
    scores = (-1.0, -1.1, -1.5, -2.4, -2.6, -2.2)
    encoder = sentencepiece.Encoder(sentencepiece.Model(bytes_ + own, (0.0,) * 256 + scores, (6,) * 256 + (1,) * 6, False, False))
    for text in map("".join, itertools.product("ab", repeat=7)):
        def best(at):
            return 0.0 if at == len(text) else max(s + best(at + len(p)) for p, s in zip(own, scores) if text.startswith(p, at))  # noqa: B023

        assert abs(sum(scores[i - 256] for i in encoder.encode(text).tolist()) - best(0)) < 1e-9


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.where("not round_trip").count() == 0 and out.count() > 500


def test_arrow_slices_cover_every_row():
    from curatrix.llm.common import slices

    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 3_000_000, 1, 2)] + [None]})
    assert sum(len(p) for p in slices(batch, "text")) == 6
