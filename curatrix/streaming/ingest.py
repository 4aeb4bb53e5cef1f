"""Records appended as they come, once per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from curatrix.operators import curation


def append_new(spark: SparkSession, batch: DataFrame, store: str, key: str, batch_id: int) -> None:
    """Rows of a batch whose key no other batch stored; a batch run again replaces what its first run wrote."""
    from curatrix.sources.stores import exists

    fresh = batch.dropDuplicates([key])
    if exists(spark, store):
        held = spark.read.parquet(store).where(f"batch <> {int(batch_id)}")
        fresh = curation.unseen(fresh, held, key=key)
    fresh.write.mode("overwrite").parquet(f"{store}/batch={int(batch_id)}")


def ingest(source: DataFrame, store: str, key: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there and ends; started again it goes on where it stopped."""
    write = lambda batch, n: append_new(batch.sparkSession, batch, store, key, n)
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
