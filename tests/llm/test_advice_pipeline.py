"""Copies go by row, whatever their ids."""

import corpus_pipeline


def test_copies_of_equal_or_no_id_go_and_other_texts_stay(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(9, text("a")), (1, text("a")), (1, text("a")), (None, text("a")), (None, text("b")), (None, text("b")), (9, text("c")), (2, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted((r.text[0], r.doc_id) for r in got) == [("a", 1), ("b", None), ("c", 9), ("d", 2)]


def test_rows_without_shingles_stay(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "", "en", "s", 0), (3, " \n", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_copies(spark, docs, "").count() == 4
