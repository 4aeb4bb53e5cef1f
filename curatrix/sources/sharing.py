"""Files that tasks write to a folder that all of them share, each under its own name and whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.session import cut
from curatrix.sources import stores

#: Names that are broadcast to where the files are read; beyond that contents are joined by a shuffle.
LISTED = 1_000_000
COPIED = "name string, length long, modificationTime timestamp"


def put(path: str, data: bytes) -> None:
    """Writes beside the target and moves there, so that a reader, or a second attempt at the same task, never meets half a file."""
    system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    folder = place.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    beside = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        out.write(data)
    system.move(beside, place)


def _copies(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                put(f"{target}/{name}", content.as_py())
            yield batch.select(["name", "length", "modificationTime"])

    return run


def copy_newer(spark: SparkSession, source: str, target: str, manifest: str, pattern: str = "*.pdf") -> DataFrame:
    """Copies files of a folder that the manifest lacks or knows in an older state, and gives what was copied (name, length, modificationTime).

    The manifest, a table of names and source times, is written after the copies: a job that stops half-way copies
    again what it had not recorded, and a second run copies nothing. Listing reads no contents; tasks read the files
    through Spark and write them to the shared folder. A missing source folder copies nothing."""
    if not stores.exists(spark, source):
        return spark.createDataFrame([], COPIED)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source)
    found = found.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).select("name", "length", "modificationTime", "content")
    known = spark.read.schema(COPIED).parquet(manifest) if stores.exists(spark, manifest) else spark.createDataFrame([], COPIED)
    had = known.groupBy("name").agg(F.max("modificationTime").alias("had"))
    # Names are joined before contents are read.
    new = cut(found.select("name", "modificationTime").join(had, "name", "left").where("had is null or modificationTime > had").select("name"))
    wanted = F.broadcast(new) if new.count() <= LISTED else new
    done = cut(found.join(wanted, "name", "left_semi").mapInArrow(_copies(target), COPIED))
    if not done.isEmpty():
        done.write.mode("append").parquet(manifest)
    return done
