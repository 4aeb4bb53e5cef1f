"""Single files of JSON or Turtle read by many tasks.

Spark's text reader splits a file by bytes and resynchronises at a separator. Pieces are numbered in the order of the
file, and what a piece means, inside or outside of a string and how deep in brackets, follows from prefix sums over the
pieces before it: windows inside of a block, and a row for each block for what went before. Pieces of one element then
meet by its number, and nothing larger than an element does."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.session import cut


#: Elements that are numbered in one task.
NUMBERED = 1 << 16


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, at, value) of what stands between separators; block and at order a file's pieces."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows (file, block, at, ...) with the sum of a value over all earlier pieces of the file."""
    own = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_value", value.cast("long"))
    blocks = rows.groupBy("file", "block").agg(F.sum("_value").alias("_all"))
    starts = blocks.select("file", "block", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    summed = rows.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0))).join(F.broadcast(starts), ["file", "block"])  # a row for each block of a file
    return summed.withColumn(name, F.col("_start") + F.col("_own")).drop("_value", "_own", "_start")


def _count(x: Column, letter: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(letter), F.lit("")))


def elements(spark: SparkSession, path: str, opener: str, closer: str) -> DataFrame:
    """(ord, value): texts of the parts of a JSON file's outer array or map that end with `closer` at its own level, in order, each with what stands between it and the one before.

    A file that starts with something else than `opener`, or whose brackets or quotes don't close, has none."""
    rows = pieces(spark, path, closer).withColumn("_bare", F.regexp_replace("value", r"(?s)\\.", ""))
    rows = running(cut(rows), _count(F.col("_bare"), '"'), "quotes")
    inside = F.col("quotes") % 2 == 1
    outer = F.regexp_replace(F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), "_bare"), r'"[^"]*("|$)', "")
    within = (F.col("quotes") + _count(F.col("_bare"), '"')) % 2 == 1
    rows = rows.withColumns({"_outer": outer, "_within": within})
    # The separator closes a bracket if it stands outside of a string; behind the last piece there is none, which `left` allows for.
    delta = sum((_count(F.col("_outer"), c) for c in "[{"), F.lit(0)) - sum((_count(F.col("_outer"), c) for c in "]}"), F.lit(0)) - F.when(F.col("_within"), 0).otherwise(1)
    rows = running(rows.withColumn("_delta", delta), F.col("_delta"), "depth")
    ends = ~F.col("_within") & (F.col("depth") + F.col("_delta") == 1)
    numbered = cut(running(rows.withColumn("_ends", ends), F.col("_ends").cast("int"), "ord").select("file", "block", "at", "value", "depth", "_delta", "_within", "_ends", "ord"))
    order = F.struct("block", "at")
    check = numbered.groupBy("file").agg(F.min_by("value", order).alias("first"), F.max_by(F.col("depth") + F.col("_delta") + 1, order).alias("left"), F.max_by("_within", order).alias("open"))
    sound = [r for r in check.collect() if r["first"].lstrip("\ufeff \t\r\n").startswith(opener) and not r.open and r.left == 0]
    if len(sound) != 1:
        return spark.createDataFrame([], "ord long, value string")
    finished = numbered.groupBy("file").agg(F.max(F.when(F.col("_ends"), F.col("ord"))).alias("most"))
    parts = numbered.join(F.broadcast(finished), "file").where("ord <= most").groupBy("ord")  # a row for each file
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), closer)
    return parts.agg(F.concat(texts, F.lit(closer)).alias("value"))


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decode = json.JSONDecoder().raw_decode
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for number, text in zip(batch.column("ord").to_pylist(), batch.column("value").to_pylist(), strict=True):
            at = len(text) - len(text.lstrip("\ufeff \t\r\n"))
            at += number == 0  # the bracket that opens the array
            place = 0
            while at < len(text):
                if text[at] in " \t\r\n,":
                    at += 1
                    continue
                try:
                    item, end = decode(text, at)
                except ValueError:
                    break
                if isinstance(item, dict):
                    out.append((number, place, text[at:end]))
                at, place = end, place + 1
            out.append((number, place, None))  # how many items the text holds
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.string())], names=["element", "place", "value"])


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the objects of a JSON array with their places in it, as texts; other items go."""
    items = cut(elements(spark, path, "[", "}").mapInArrow(_objects, "element long, place int, value string"))
    sizes = items.where("value is null").select(F.lit("").alias("file"), F.expr(f"element div {NUMBERED}").alias("block"), F.col("element").alias("at"), "place")
    starts = running(sizes, F.col("place"), "start").select(F.col("at").alias("element"), "start")
    return items.where("value is not null").join(starts, "element").select((F.col("start") + F.col("place")).alias("ord"), "value")


def map_entries(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the entries of a JSON map of arrays in order, each as a map of one entry."""
    bare = F.regexp_replace("value", r"^[\x{FEFF}\s]*[{,]", "{")
    return elements(spark, path, "{", "]").select("ord", F.concat(bare, F.lit("}")).alias("value"))
