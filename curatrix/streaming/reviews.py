"""Review decisions as a stream of events, folded into one row for each record by keyed state.

An event is (key, seq, kind, author, raw, choice, name): stage, approve and discard set a record's status, override sets
what a reviewer chose for a name of an author, revert takes such a choice back. Of events on the same thing the one of
the largest seq holds, whenever it arrives; so events that are replayed, repeated, late or split into other batches
give the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curatrix.operators import curation

EVENT = "key string, seq long, kind string, author string, raw string, choice string, name string"
REVIEWED = "key string, seq long, status string, overrides array<struct<author:string,raw:string,choice:string,name:string,at:long>>"
_STATE = "status string, status_seq long, seq long, overrides string"
STATUS = {"stage": "pending", "approve": "approved", "discard": "discarded"}
OVERRIDE, REVERT = "override", "revert"


def fold(state: tuple[str | None, int, int, dict], events: pd.DataFrame) -> tuple[str | None, int, int, dict]:
    """The state (status, its seq, largest seq, overrides by author and name) after some events in any order."""
    status, status_seq, seq, overrides = state
    for e in events.itertuples(index=False):
        at = int(e.seq)
        seq = max(seq, at)
        if e.kind in STATUS and at > status_seq:
            status, status_seq = STATUS[e.kind], at
        elif e.kind in (OVERRIDE, REVERT):
            pair = json.dumps([e.author, e.raw])
            if at > overrides.get(pair, [-1])[0]:
                overrides[pair] = [at, *((e.choice, e.name) if e.kind == OVERRIDE else (REVERT, None))]
    return status, status_seq, seq, overrides


def _applied(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    status, status_seq, seq, overrides = held.get if held.exists else (None, -1, -1, "{}")
    state = (status, status_seq, seq, json.loads(overrides))
    for batch in batches:
        state = fold(state, batch.astype(object).where(batch.notna(), None))
    held.update((*state[:3], json.dumps(state[3])))
    chosen = [{"author": author, "raw": raw, "choice": choice, "name": name, "at": at} for (author, raw), (at, choice, name) in sorted(((tuple(json.loads(p)), v) for p, v in state[3].items()), key=repr)]
    yield pd.DataFrame({"key": [key[0]], "seq": [state[2]], "status": [state[0]], "overrides": [chosen]})


def reviewed(events: DataFrame) -> DataFrame:
    """A row (key, seq, status, overrides) for each key that a batch touches, as it stands after all events so far. Events without key, seq or kind count not at all."""
    known = events.where("key is not null and seq is not null and kind is not null")
    return known.groupBy("key").applyInPandasWithState(_applied, REVIEWED, _STATE, "update", GroupStateTimeout.NoTimeout)


def follow(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Follows a stream of events and appends what each batch changes to a log; a batch that is repeated writes its own folder anew."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return reviewed(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each key in the log; of rows of one seq, which a late event leaves, that of the latest batch."""
    log = spark.read.schema(REVIEWED + ", batch long").parquet(path)
    return curation.keep_last(log, "key", "batch").drop("batch")


def moved(staged: DataFrame, approved: DataFrame, reviews: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(approved, staged) by the reviews' status: approved records move, discarded ones go, others wait."""
    of = lambda status: reviews.where(F.col("status") == status).select(F.col("key").alias(key))
    grown, left = curation.approve(staged, approved, of("approved"), key)
    return grown, left.join(of("discarded"), key, "left_anti")


def overrides_of(reviews: DataFrame) -> DataFrame:
    """(key, author, raw, choice, name, at), one row for each pair, as curation.review takes them."""
    return reviews.select("key", F.explode("overrides").alias("o")).select("key", "o.*")
