"""The field on documents that didn't fit it."""

import numpy as np
from pyspark.sql import functions as F

from curatrix.llm import linecrf


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    weights = linecrf.train(docs, labels.where(~held))
    rows = linecrf.quality_rules(docs.join(labels.where(held), "doc_id", "left_semi"), weights).join(labels, "doc_id").where("not base_failed").collect()
    poor, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert len(poor) > 40 and np.mean(poor) < 0.15 and np.mean(good) > 0.98


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    weights = linecrf.train(none, none)
    assert linecrf.quality_rules(none, weights).collect() == []
    some = spark.createDataFrame([(1, "word " * 30 + "\n" + " ".join(f"w{i}" for i in range(300)))], "doc_id long, text string")
    assert [r.kept for r in linecrf.quality_rules(some, weights).collect()] == [True]
