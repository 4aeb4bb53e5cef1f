"""What the corpus operators share: lineage cuts, table reads and bounded samples."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.session import delete, shared_folder

#: A word, as every contract here counts it.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_WRITTEN: dict[int, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows as a table written in the shared folder, which a lost executor can't take away.

    A written table also starts the planner's size estimates afresh; those of a checkpoint carry on, and a loop of joins
    multiplies them until planning takes longer than the work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(table)] = path
    weakref.finalize(table, _WRITTEN.pop, id(table), None)
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing will read again."""
    for table in tables:
        path = _WRITTEN.pop(id(table), None)
        if path:
            delete(table.sparkSession, path)


#: 64-bit words of the bitmap of wanted keys: what bounds its broadcast.
BITMAP_WORDS = 1 << 20


def marked(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df with a column `marked`, false only in rows whose key is not among keys: a bitmap of fixed size, which any number of keys fills and an exact join can follow."""
    place = F.xxhash64(key)
    word, bit = F.pmod(F.shiftright(place, 6), F.lit(BITMAP_WORDS)).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")
    words = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    found = df.withColumns({"word": word, "bit": bit}).join(F.broadcast(words), "word", "left")  # at most BITMAP_WORDS rows
    return found.withColumn("marked", F.coalesce(F.expr("shiftright(bits, bit) & 1 = 1"), F.lit(False))).drop("word", "bit", "bits")


def sample_share(rows: int, bound: int) -> float:
    """The share of rows that a bounded sample takes; 1 while the table fits the bound."""
    return 1.0 if rows <= bound else bound / rows


def in_sample(key: Column, share: float, seed: int) -> Column:
    """A seeded choice by key, the same on every run and for any partitioning."""
    if share >= 1.0:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each value of the keys, that of the least text: what an id is repeated adds nothing to a bounded sample."""
    others = [c for c in rows.columns if c not in (*keys, "text")]
    least = rows.groupBy(*keys).agg(F.min(F.struct("text", *others)).alias("least"))
    return least.select(*keys, "least.text", *[f"least.{c}" for c in others])


_HELD: dict[object, object] = {}


def held(key: object, build: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: one thing at a time, so that operators that follow each other don't add up in its memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each (one row at least), so memory follows the longest text and not the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
