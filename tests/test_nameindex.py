"""The name index and block search against plain loops, and batch similarities against difflib."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import similarity, text
from curatrix.operators import matching, nameindex

WORDS = "department of chemistry university technical institute engineering munich berlin catalysis process reaction gmbh fritz haber ÄÖ straße lab".split()


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def edits(a, b):
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b), 1)


def names(seed, n):
    """Short and long names, some made of others by edits."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        kind = draw.randrange(4)
        name = "".join(draw.choice("abcd") for _ in range(draw.randint(0, 9))) if kind == 0 else " ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 6)))
        if kind > 1 and out:
            letters = list(draw.choice(out))
            for _ in range(draw.randint(0, 6)):
                at = draw.randrange(len(letters) + 1)
                letters[at : at + draw.randint(0, 2)] = draw.choice("abx ") * draw.randint(0, 2)
            name = "".join(letters)
        out.append(name.title() if draw.random() < 0.2 else name)
    return sorted({x for x in out if x})


def frame(spark, values, column="name"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_batches_equal_plain_loops():
    draw = random.Random(4)
    word = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    pairs = [(word("abc", draw.randint(0, 12)), word("abc", draw.randint(0, 12))) for _ in range(3000)]
    pairs += [(x, draw.choice(names(1, 60))) for x in names(2, 200)]
    pairs += [(word("ab c", draw.randint(180, 300)), word("ab cdefgh", draw.randint(180, 320))) for _ in range(40)]  # beyond LONG, with letters too frequent to start a match
    pairs += [("aaab" * 60, "baaa" * 70), ("a" * 300, "b" + "a" * 299), ("", ""), ("İx", "i̇X"), ("ΑΣ", "ας"), ("a\nB", "A\nb")]
    low = [(a.lower(), b.lower()) for a, b in pairs]
    at = np.arange(len(pairs))
    s, t = (similarity.Strings(similarity.lowered([p[i] for p in pairs])) for i in (0, 1))
    assert similarity.ratios(s, t, at, at).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in low]
    some = at[:3300:7]
    assert similarity.levenshteins(s, t, some, some).tolist() == [edits(*low[i]) for i in some]


def test_ratio_of_null_is_null(spark):
    rows = spark.createDataFrame([("a", "a"), (None, "a"), ("a", None), ("Ab", "aC")], "a string, b string")
    assert [r[0] for r in rows.select(text.ratio(rows.a, rows.b)).collect()] == [1.0, None, None, 0.5]


@pytest.mark.parametrize("t", [0.6, 0.7, 0.8, 0.95])
@pytest.mark.parametrize("measure", ["ratio", "levenshtein"])
def test_index_loses_no_pair(spark, t, measure):
    plain, column = {"ratio": (ratio, text.ratio), "levenshtein": (edits, text.levenshtein_similarity)}[measure]
    left, right = names(5, 120), names(6, 120) + names(5, 20)
    want = {(a, b) for a in left for b in set(right) if plain(a, b) >= t}
    got = [(r.a, r.b) for r in nameindex.alike(frame(spark, left), frame(spark, sorted(set(right))), t, column).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_names_that_share_no_rare_part_never_meet(spark):
    left, right = [f"aaaa bbbb {i % 7} xyz{i}" for i in range(50)], [f"cccc dddd {i % 5} uvw{i}" for i in range(50)]
    assert nameindex.met(frame(spark, left), frame(spark, right), 0.9).collect() == []


@pytest.mark.parametrize("measure", ["ratio", "levenshtein"])
def test_nearest_equals_a_loop(spark, monkeypatch, measure):
    plain, column = {"ratio": (ratio, text.ratio), "levenshtein": (edits, text.levenshtein_similarity)}[measure]
    monkeypatch.setattr(nameindex, "NAMES", 50)
    monkeypatch.setattr(nameindex, "CANDIDATES", 40)
    raws, candidates = ["", *names(8, 120)], names(9, 100)
    registry = matching.registry_long(frame(spark, candidates, "c").withColumn("v", F.concat("c", F.lit(" x"))).withColumn("p", F.lit(1)), "c", "v", "p")
    order = [(x, c) for c in sorted(candidates) for x in (c, c + " x")]
    got = {r.raw: (r.candidate, r.canonical, r.score) for r in matching.best_match(nameindex.nearest(frame(spark, raws, "raw"), registry, column).drop("candidate")).join(registry, ["canonical", "ord"]).collect()}
    for raw in raws:
        scores = [plain(raw, x) for x, _ in order]
        at = scores.index(max(scores))
        assert got[raw] == (*order[at], scores[at])
    floored = matching.match(frame(spark, raws, "raw"), registry, column, below=False).collect()
    assert {r.raw for r in floored} == {r for r in raws if max(plain(r, x) for x, _ in order) >= matching.LOW}


def test_empty_sides(spark):
    none, some = frame(spark, []), frame(spark, ["a"])
    assert nameindex.alike(none, some, 0.8).collect() == [] == nameindex.alike(some, none, 0.8).collect()


def test_organisations_equal_a_loop(spark):
    raws, known = ["", "x", "lab", "nobody at all", *names(12, 60)], names(13, 60) + ["Lab", "a"]
    raws += [k[2:-1] for k in known[::5]] + [f"the {k.upper()} here" for k in known[::6]]
    want = {}
    for raw in set(raws):
        best, score = None, 0.0
        for k in sorted(set(known)):
            a, b = raw.lower(), k.lower()
            s = 1.0 if a == b else 0.9 if a in b or b in a else ratio(raw, k)
            if s > score and s >= 0.85:
                best, score = k, s
        if best is not None:
            want[raw] = (best, round(score, 4))
    got = {r.raw: (r.canonical, r.score) for r in matching.organisation_match(frame(spark, raws, "raw"), matching.registry_long(frame(spark, known, "c"), "c")).collect()}
    assert got == want and len(want) > 20
