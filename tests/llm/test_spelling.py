"""Spelling variants against all pairs, deletion keys against strings, and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import kernel, queries, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, least_length=6, least_count=5, ratio=5):
    vocab = {w: n for w, n in Counter(words).items() if w is not None and len(w) >= least_length and n >= least_count}
    form, out = {}, {}
    for w, n in vocab.items():
        own = [x for x in vocab if x != w and near(x, w)]
        best = min(own, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= ratio * n else None
        out[w] = (len(own),)
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, vocab[w], out[w][0], vocab.get(form[w]))
    return out


def found(spark, words, **options):
    rows = spelling.spelling_variants(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), **options).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    random.seed(seed)
    words = []
    for _ in range(150):
        w = "".join(random.choice("aabÀß") for _ in range(random.randint(1, 8)))
        words += [w] * random.choice([1, 2, 3, 10, 50])
    assert found(spark, words, least_length=2, least_count=2, ratio=2) == brute(words, 2, 2, 2)


def test_several_tasks_give_the_same(spark, monkeypatch):
    random.seed(9)
    words = [w for w in ("".join(random.choice("abc") for _ in range(6)) for _ in range(400)) for _ in range(5)]
    monkeypatch.setattr(spelling, "TASK_KEYS", 64)
    assert found(spark, words) == brute(words)


def test_chains_ties_and_odd_rows(spark):
    words = ["letter"] * 625 + ["lettere"] * 125 + ["letteree"] * 25 + ["letetree"] * 5 + ["lettera"] * 125 + [None, "", "short"] * 9
    words += ["y" * 3000] * 5 + ["y" * 2999] * 25 + ["q" + "y" * 2999] * 5
    assert found(spark, words) == brute(words)
    assert found(spark, words)["letteree"][:2] == ("lettere", "letter")
    assert found(spark, []) == {} == found(spark, [None] * 9)


def test_collisions_are_told_apart(spark, monkeypatch):
    """With all hashes equal every word meets every other, and strings decide."""
    monkeypatch.setattr(kernel, "mix", lambda x: np.zeros_like(x))
    words = ["abcdef", "abcdeg", "abcde", "xbcdef", "abcdefg", "bacdef"]
    of, place, key = spelling.deletion_keys(words)
    rows = spelling.pa.table({"key": key.view(np.int64), "place": place.astype(np.int32), "word": [words[i] for i in of], "n": np.ones(len(of), np.int64)})
    got = {r["word"]: r["n_near"] for r in spelling._meet(rows).to_pylist()}
    assert got == {w: n for w in words if (n := sum(near(w, x) for x in words if x != w))}


def test_keys_are_those_of_the_deleted_strings():
    words = ["aab", "straße", "ÀÉÿ", "x", "", "zzzz", "ab"]
    of, place, key = spelling.deletion_keys(words)
    strings = [words[i] if p < 0 else words[i][:p] + words[i][p + 1 :] for i, p in zip(of, place, strict=True)]
    assert len(set(strings)) == len(set(key.tolist()))
    assert all(len({k for s, k in zip(strings, key.tolist(), strict=True) if s == t}) == 1 for t in strings)
    assert Counter((i, s) for i, s in zip(of.tolist(), strings, strict=True)).most_common(1)[0][1] == 1


def test_query_on_odd_documents(spark, tmp_path):
    texts = [(i, "Müller müller Größe ÄPFEL äpfel straİe Kelvin letters" * 3) for i in range(60)] + [(None, "letters letterz"), (7, None), (8, ""), (9, "letters " * 50_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"word": F.lit("x"), "run": F.lit(1), "n": F.lit(1)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    words = []
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            words.append(run[: h % len(run)] + run[h % len(run) + 1 :] if i is not None and h % 199 == 0 else run)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == brute(words) and got
