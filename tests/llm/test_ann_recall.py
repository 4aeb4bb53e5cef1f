"""Recall over lists of many partitions, chunks and blocks."""

import numpy as np
import pytest

from curatrix.llm import ann


def recall(spark, x, every):
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(v, v.where(f"vec_id % {every} = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q in got:
        near = x @ x[q]
        near[q] = -9
        found += len(got[q] & set(np.argsort(-near)[:5].tolist()))
    assert len(got) == -(-len(x) // every)
    return found / (5 * len(got))


@pytest.mark.parametrize(("chunk", "block"), [(512, 512), (16, 8)])
@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall_over_many_partitions(spark, monkeypatch, kind, chunk, block):
    monkeypatch.setattr(ann, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 32))
    if kind == "clustered":
        x += 3 * rng.standard_normal((40, 32))[rng.integers(0, 40, 3000) // 2]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert recall(spark, x, 30) >= 0.95
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["even", "clustered", "copies"])
def test_scan_of_many_queries_against_brute_force(monkeypatch, kind):
    measured, calls = ann.distances, []
    monkeypatch.setattr(ann, "distances", lambda *a: calls.append(1) or measured(*a))
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64))
    if kind == "clustered":
        x += 5 * rng.standard_normal((30, 64))[np.arange(3000) // 100]
    if kind == "copies":
        x[500:] = x[rng.integers(0, 500, 2500)]
    x = ann.unit(x)
    pieces = [(a, a + 100, np.arange(200)) for a in range(0, 3000, 100)]
    i, j = ann.scan(x[:200], x, pieces, 6)
    far = ((x[:200, None] - x[None]) ** 2).sum(axis=2)
    near = far <= np.sort(far, axis=1)[:, 5:6] + 1e-9  # ties included
    got = np.zeros_like(near)
    got[i, j] = True
    assert len(i) == got.sum() and (got & near).sum() >= 0.98 * near.sum()
    assert got.sum() < 1.1 * near.sum()
    assert len(calls) == 30  # a list is measured against all queries at once


def test_queries_look_into_their_lists_only():
    x = ann.unit(np.random.default_rng(4).standard_normal((90, 20)))
    i, j = ann.scan(x[:3], x, [(0, 30, np.array([0, 2])), (30, 90, np.array([1]))], 4)
    assert set(i.tolist()) == {0, 1, 2} and all((b < 30) == (a != 1) for a, b in zip(i, j, strict=True))


def test_small_lists_share_a_shelf_and_large_ones_are_chunks():
    shelf, chunks = ann.shelve(np.array([3, 0, 5, 4, 25, 2, 8, 1]), 10)
    assert shelf.tolist() == [0, 0, 0, 1, 2, 3, 3, 4] and chunks.tolist() == [1, 1, 1, 1, 3, 1, 1, 1]


def test_a_repeated_id_leaves_room_for_others(spark):
    rows = [(50, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(12)] + [(n, [1.0, 0.1 * n]) for n in range(2, 9)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.search(v, v.where("vec_id = 50")).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
