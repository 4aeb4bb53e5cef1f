import re
from fractions import Fraction

from hypothesis import given
from hypothesis import strategies as st

from curatrix.llm import mixing


def highest_quotients(seats, votes):
    dealt = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        i = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * dealt[i] + 1), -i))
        dealt[i] += 1
    return dealt


@given(st.integers(0, 200), st.lists(st.integers(0, 50), min_size=1, max_size=8))
def test_sainte_lague_equals_highest_quotients(seats, votes):
    assert mixing.sainte_lague(seats, votes) == highest_quotients(seats, votes)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_water_fill(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    targets = mixing.water_fill(sizes, weights)
    assert sum(targets) == sum(sizes) and all(t <= 3 * n for t, n in zip(targets, sizes))
    open_ = [t / w for t, w, n in zip(targets, weights, sizes) if t < 3 * n]
    assert len(set(open_)) <= 1


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_sources(docs).select("doc_id", "source", "text", "size", "source_size", "target", "taken", "passes", "first", "width", "blocks", "quota_blocks", "phase").collect()
    again = mixing.mix_sources(docs.repartition(7)).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again} and len(rows) == docs.count()
    taken, target = {}, {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r["size"] * r.passes + sum(mixing.in_chosen(r.first + i, r.width, r.blocks, r.quota_blocks, r.phase) for i in range(r["size"]))
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in taken)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "x " * 5000, "a"), (3, "", None), (None, "y y", None), (4, "z", "\U0001f600"), (4, "z", "\U0001f600"), (5, " ", "empty")]
    docs = spark.createDataFrame([(*r, 9, 8) for r in rows], "doc_id long, text string, source string, taken int, shard int")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 7 and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_shards_of_a_source_and_short_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    rows = [(i, "w " * (1 + i % 97), "abc"[i % 3] if i % 2 else "a") for i in range(600)] + [(1000, "w " * 100, "small")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in got:
        assert r.taken == r["size"] * r.passes + sum(mixing.in_chosen(r.first + i, r.width, r.blocks, r.quota_blocks, r.phase) for i in range(r["size"]))
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    n_shards = {s: n for s, n, *_ in mixing.plan_sources([(s, sum(r["size"] for r in got if r.source == s)) for s in target])}
    assert max(n_shards.values()) > 8
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS * (1 + n_shards[s]) for s in taken)


def test_sources_smaller_than_a_block(spark):
    rows = [(1, "w " * 30, "a"), *((10 + i, "w " * 1000, "b") for i in range(10)), (2, "w " * 100, "c")]
    got = {r.doc_id: r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].target == 90 and got[1].taken in (60, 90)
    assert got[2].target == 300 and abs(got[2].taken - 300) <= mixing.BLOCK_WORDS


def test_more_sources_than_any_table_of_the_plan(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', 70) as text", "concat('s', id) as source")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 3000 and abs(sum(r.taken for r in got) - 210_000) < 3000 * 70 * 0.1
