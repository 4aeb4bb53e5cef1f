"""Every unlabelled document can take part in co-training, and every line of a training text fits the field."""

import numpy as np
from pyspark.sql import functions as F

from curatrix.llm import cotraining, linecrf


def test_the_surest_rows_come_from_the_whole_table(spark, monkeypatch):
    n = 9_000  # more than were ever drawn
    words = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, repeat('good and plain text. ', 5), repeat('#$% {} 77 ', 9))").alias("text"), F.lit("en").alias("lang"), F.expr("if(id % 3 = 0, 'a', 'b')").alias("source"), F.expr("100 + id % 50").alias("n_chars"))
    labels = words.where("doc_id < 200").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    seen, surest = [], cotraining._surest
    monkeypatch.setattr(cotraining, "_surest", lambda pool, *a: seen.append(pool.count()) or surest(pool, *a))
    model = cotraining.train(words, labels)
    assert seen == [n - 200] * (4 * cotraining.ROUNDS)
    scored = cotraining.score(words, model).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in scored]) == 1


def test_chains_are_whole_texts(spark, monkeypatch):
    rows = [(i, "\n".join(f"line {i} {k} of a long text" for k in range(150 + i)), i % 2) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = []
    monkeypatch.setattr(linecrf, "fit", lambda chains: got.extend(chains))
    linecrf.train(frame.where("doc_id % 5 = 0"), frame)
    assert [len(y) for _, y in got] == [150 + i for i in range(0, 1500, 5)] and all(len(f) == len(y) for f, y in got)


def test_the_exchange_teaches_what_no_label_shows(spark, monkeypatch):
    """Labels cover one kind of text; the source, which the metadata view learns from them, tells of another kind, which the content view then knows without a source."""
    kinds = {("a", 1): "aba bab abb ", ("a", 0): "cdc dcd cdd ", ("b", 1): "zyz yzy zyy ", ("b", 0): "qkq kqk qkk "}
    rows = []
    for i in range(3000):
        good, kind = i % 2, "a" if i < 400 else "b"
        source = None if i >= 2800 else "good" if good else "poor"
        rows.append((i, kinds[kind, good] * 8, "en", source, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.where("doc_id < 400").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))

    def right():
        scored = cotraining.score(docs.where("doc_id >= 2800"), cotraining.train(docs, labels)).collect()
        return np.mean([(r.content_score >= 0.5) == (r.doc_id % 2 == 1) for r in scored])

    assert right() > 0.95
    monkeypatch.setattr(cotraining, "ROUNDS", 0)
    assert right() < 0.8
