"""Review events in any order and any split into batches give the same stores."""

import random

import pytest

from curatrix.operators import curation
from curatrix.streaming import reviews


def events(seed):
    draw = random.Random(seed)
    out = []
    for seq in range(160):
        key = f"file{draw.randrange(12)}"
        kind = draw.choice(["stage", "approve", "discard", "override", "override", "override", "revert"])
        pair = (draw.choice("AB"), draw.choice(["r1", "r2"])) if kind in ("override", "revert") else (None, None)
        out.append((key, seq, kind, *pair, *((draw.choice(["new", "existing"]), f"N{seq}") if kind == "override" else (None, None))))
    return out


def plain(rows):
    status, chosen = {}, {}
    for key, _, kind, author, raw, choice, name in sorted(rows, key=lambda e: e[1]):
        status.setdefault(key, None)
        if kind in reviews.STATUS:
            status[key] = reviews.STATUS[kind]
        else:
            chosen[key, author, raw] = (choice, name) if kind == "override" else ("revert", None)
    return status, chosen


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_and_order_gives_the_same(spark, tmp_path, seed):
    rows = events(seed)
    draw = random.Random(seed)
    again = rows + draw.sample(rows, 60)
    draw.shuffle(again)
    want = plain(rows)
    for n, source in enumerate(([rows], [again[i::5] for i in range(5)])):
        folder, log = str(tmp_path / f"in{n}"), str(tmp_path / f"log{n}")
        for part in source:
            spark.createDataFrame(part, reviews.EVENT).coalesce(1).write.mode("append").json(folder)
            query = reviews.follow(spark.readStream.schema(reviews.EVENT).json(folder), log, str(tmp_path / f"c{n}"))
            assert query.awaitTermination(120) and query.exception() is None
        now = reviews.current(spark, log)
        assert {r.key: r.status for r in now.collect()} == want[0]
        assert {(r.key, r.author, r.raw): (r.choice, r.name) for r in reviews.overrides_of(now).collect()} == want[1]
    staged = spark.createDataFrame([(f"file{i}", "pending") for i in range(13)], "key string, _status string")
    approved, left = reviews.moved(staged, spark.createDataFrame([("old",)], "key string"), now, "key")
    assert {r.key for r in approved.collect()} == {"old"} | {k for k, s in want[0].items() if s == "approved"}
    assert {r.key for r in left.collect()} == {f"file{i}" for i in range(13)} - {k for k, s in want[0].items() if s in ("approved", "discarded")}
    decisions = spark.createDataFrame([("A", "r1", "M", "auto_existing", None)], "author string, raw string, matched_canonical string, decision string, new_canonical string")
    one = reviews.overrides_of(now).where("key = 'file3'").drop("key")
    assert curation.review(decisions, one, at="at").count() == 1
