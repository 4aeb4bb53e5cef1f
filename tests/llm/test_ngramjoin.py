"""The n-gram join against all pairs that share a shingle: groups, chains, passages in common, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from test_neardup import SF, brute, percolating

from curatrix.llm import neardup, ngramjoin
from curatrix.llm.ngramjoin import ngram_join


def joined(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs, **options).collect()}


def plain(rows, k=5, percent=80):
    return {i: x[:2] for i, x in brute(rows, k, percent).items()}


def variants(seed, percent_apart):
    """Texts of many lengths, each with copies that differ from it in up to so many words of a hundred, beside the border."""
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 14, 30, 120]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) * percent_apart // 100))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 2])] = [f"x{rng.randrange(10)}"] * rng.choice([0, 1, 1, 2])
                copy = copy or ["y"]
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_beside_the_border(spark, seed):
    rows = variants(seed, 6)
    want = plain(rows)
    assert joined(spark, rows) == want and len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize(("shingle", "percent"), [(2, 50), (1, 67), (3, 100)])
def test_other_lengths_and_thresholds(spark, shingle, percent):
    rows = variants(11, 20)
    assert joined(spark, rows, shingle=shingle, percent=percent) == plain(rows, shingle, percent)


def test_equals_brute_force_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs).collect()} == plain(rows)


@pytest.mark.parametrize("blocks", [(1 << 20, 4096), (3000, 16)])
def test_texts_of_common_passages_lose_no_link(spark, monkeypatch, blocks):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", blocks[0])
    monkeypatch.setattr(neardup, "BLOCK_ROWS", blocks[1])
    met, units = [], neardup._opened_units
    monkeypatch.setattr(neardup, "_opened_units", lambda opened, own: met.append(opened.count()) or units(opened, own))
    rng = random.Random(5)
    rows = percolating(150)
    passages = [[f"p{j}_{i}" for i in range(25)] for j in range(6)]
    rows += [(len(rows) + i, " ".join(sum(rng.sample(passages, rng.choice([3, 4, 5])), [f"u{i % 9}"]))) for i in range(150)]
    assert joined(spark, rows) == plain(rows) and met and met[0] > 200


def test_chain_in_one_bucket(spark):
    base, rows = [f"t{i}" for i in range(400)], []
    for step in range(40):
        base = base[: step * 8] + [f"n{step}_{i}" for i in range(3)] + base[step * 8 + 3 :]
        rows.append((step, " ".join(base)))
    assert joined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, long), (8, long + " x"), (9, long), (9, long), (None, "one two"), (None, None)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, band="x", hub=1, v=2) for i, t in rows], "doc_id long, text string, band string, hub int, v int")
    got = sorted((tuple(r) for r in ngram_join(docs).collect()), key=str)
    assert (4, 1, 4) in got and (5, 1, 4) in got and (6, 1, 6) in got
    assert [r[2] for r in got if r[0] in (7, 8, 9)] == [7, 7, 7, 7]
    assert [r for r in got if r[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [r[1:] for r in got if r[0] is None] == [(0, None), (1, None)]
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_that_repeat_an_id_keep_their_own_links(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("b") + " q"), (3, text("a") + " q"), (4, text("c")), (4, text("c")), (7, text("d")), (7, text("d") + " q")]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (7, 7), (7, 7)]


def test_the_longer_prefix_loses_no_pair():
    """Any two sets at the threshold share as many tokens of their longer prefixes as the first filter asks of either."""
    rng = np.random.default_rng(1)
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        both = int(rng.integers(max(1, n * 4 // 5), n + 1))
        m = int(rng.integers(both, both + 30))
        if 100 * both < 80 * (n + m - both):
            continue
        tokens = rng.permutation(10_000)[: n + m - both]
        a, b = np.sort(tokens[:n]), np.sort(tokens[n - both :])
        (size_a, low_a), (size_b, low_b) = ngramjoin.lead(np.int64(n), 80), ngramjoin.lead(np.int64(m), 80)
        common = len(np.intersect1d(a[:size_a], b[:size_b]))
        assert common >= max(low_a, low_b)
