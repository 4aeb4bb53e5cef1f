import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import Row

from curatrix.llm import neardup
from curatrix.llm.neardup import near_duplicates

SF = "/root/testdata/sf0.01"


def shingles(text, k):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(own) < k:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posting = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            posting[x].append(i)
    pairs = {(a, b) for v in posting.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_equals_brute_force_on_the_small_table(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=k).collect()}
    assert got == brute(rows, k)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, long), (8, long + " x"), (9, long), (9, long), (None, "one two"), (None, None)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, band="x", hub=1, a=2) for i, t in rows], "doc_id long, text string, band string, hub int, a int")
    got = sorted((tuple(r) for r in near_duplicates(docs, shingle=4).collect()), key=str)
    assert (4, 1, 4, True) in got and (5, 1, 4, False) in got and (6, 1, 6, True) in got
    assert [r[2:] for r in got if r[0] in (7, 8, 9)] == [(7, True), (7, False), (7, False), (7, False)]
    assert [r for r in got if r[0] in (1, 2, 3)] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    assert [r[1:] for r in got if r[0] is None] == [(0, None, True), (1, None, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chain_of_near_copies_in_one_bucket_is_one_component(spark):
    base = [f"t{i}" for i in range(400)]
    rows = []
    for step in range(40):
        base = base[: step * 8] + [f"n{step}_{i}" for i in range(3)] + base[step * 8 + 3 :]
        rows.append((step, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, shingle=4).collect()}
    assert got == brute(rows, 4)


def test_rows_that_repeat_an_id_keep_their_own_links(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("b") + " q"), (3, text("a") + " q"), (4, text("c")), (4, text("c")), (7, text("d")), (7, text("d") + " q")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (7, 7, True), (7, 7, True)]


def percolating(n):
    """Texts that share a passage, so that most buckets hold unlike texts; some are near copies of each other, none of its bucket's hub."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for i in range(n):
        own = [f"w{rng.randrange(10**9)}" for _ in range(60)]
        rows.append((len(rows), " ".join(passage + own)))
        if i % 20 == 0:
            for k in range(3):
                rows.append((len(rows), " ".join(passage + own[: 55 + k] + ["x"])))
    return rows


@pytest.mark.parametrize("blocks", [(1 << 20, 4096), (3000, 16)])
def test_percolating_buckets_lose_no_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", blocks[0])
    monkeypatch.setattr(neardup, "BLOCK_ROWS", blocks[1])
    met, flag = [], neardup._opened_units
    monkeypatch.setattr(neardup, "_opened_units", lambda opened, classes: met.append(opened.count()) or flag(opened, classes))
    rows = percolating(300)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == brute(rows, 4) and met and met[0] > 500


def test_hubs_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", 700)
    base = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(base[: i % 90] + [f"x{i}"] + base[i % 90 + 1 :])) for i in range(200)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5)
