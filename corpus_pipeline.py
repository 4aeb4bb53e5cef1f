"""A corpus pipeline: toxic and poor documents go, near copies go, sources are mixed, texts become token ids.

Every stage is a function of (spark, docs, sf_dir) that returns a DataFrame; run() writes each result as Parquet and
reads it back as the next stage's documents, and deletes what no stage reads any more. The last result stays."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import cotraining, mixing, neardup, sentencepiece, toxicity
from curatrix.llm.common import cut, marked, read
from curatrix.session import delete, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(DOCUMENT), model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that co-training rejects go."""
    model = cotraining.train(docs, read(spark, sf_dir, "labels"))
    return cotraining.reject(docs.select(DOCUMENT), model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one of the smallest id. Rows without an id, or that share one, are rows of their own.

    A row's key is the hash of its id and text. Only rows whose key a bitmap marks, those that go or whose key repeats, are shuffled."""
    rows = docs.select(*DOCUMENT, F.xxhash64("doc_id", "text").alias("row"))
    groups = neardup.near_duplicates(rows.select("row", "text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    ids = cut(rows.select("row", "doc_id").join(groups.distinct(), "row"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = cut(ids.groupBy("component_id").agg(least.alias("least")).select("least.row"))
    again = ids.groupBy("row").count().where("count > 1").select("row")
    doubtful = marked(rows, ids.select("row").join(kept, "row", "left_anti").union(again), "row")
    exact = doubtful.where("marked").join(kept, "row", "left_semi").dropDuplicates(["row"])
    return doubtful.where("not marked").unionByName(exact).select(DOCUMENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words of each source as its target asks: a document comes once for every whole pass, and a last time with the words of its chosen blocks."""
    plan = mixing.mix_sources(docs.select(DOCUMENT)).where("taken > 0")
    return plan.mapInArrow(mixing.copies, "doc_id long, text string, lang string, source string, n_chars long")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return sentencepiece.encode(docs)


#: Rows and bytes of an Arrow batch between a task and its Python worker. Each side holds whole batches, some of very long texts; the defaults of 10 000 rows and 64 MB take a tenth of a small executor.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def _small_batches(stage: Stage) -> Stage:
    """The stage with batches of BATCH_BYTES and of BATCH_ROWS rows, unless the session has smaller ones already."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _small_batches(stage)) for name, stage in (("toxicity", drop_toxic), ("quality classifier", drop_poor), ("minhash near-dedup", drop_copies), ("mixing sources", mix), ("sentencepiece", tokenize))]

#: Learned classifiers and hashes decide the rows, which SQL can't express: tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage: doc_id, ids, n_ids, round_trip."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
    return docs
