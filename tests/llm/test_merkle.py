"""The manifest against a plain tree, its proofs, and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from curatrix.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(nodes):
    """(root, for each node the list of (before, after)) of a list of digests."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            paths[k].append((run[: i % 16], run[i % 16 + 1 :]))
        at = [i // 16 for i in at]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    root, upper = climb([t[0] for t in trees])
    out = []
    for s, (subroot, paths), over in zip(sources, trees, upper, strict=True):
        for (_, _, own, row), path in zip(sorted(by[s], key=lambda x: x[:3]), paths, strict=True):
            path = path + over
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = "".join(UPPER.get(c, c) for c in text)
            folded = leaf((*row[:4], text))
            for before, after in path:
                folded = h(*before, folded, *after)
            proof = h(*(x for before, after in path for x in before + after))
            out.append((row[0], own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def proved(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "g": F.lit(1), "root": F.lit(2)})
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    altered = F.when(chosen, F.translate("text", "".join(UPPER), "".join(UPPER.values()))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.proved(docs, altered).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_equals_plain_tree(spark, n):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "en", i, f"Text Number {i}") for i in range(n)]
    rows += [(1000 + i, f"only{i}", "de", None, "Ein Text") for i in range(n // 8)]
    assert proved(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, "a", "en", 3, "Abc"), (5, "a", "en", 3, "Abc"), (5, "a", "en", 3, "Other"), (None, "a", None, None, None), (None, None, "x", 0, ""), (None, None, "x", 0, "B"), (6, "", "en", 1, "Äé ß"), (7, "1", "en", 1, "C"), (8, "0", "en", 1, "D" * 300_000), (9, "ä", "-", -1, "-")]
    assert proved(spark, rows) == brute(rows)
    assert proved(spark, []) == []


def test_hot_group_of_equal_rows(spark):
    rows = [(None, "hot", "en", 1, "Same")] * 400 + [(i, "cold", "en", 1, "Else") for i in range(40)]
    assert proved(spark, rows) == brute(rows)


def test_tampering_shows_only_where_the_text_changes(spark):
    rows = [(i, "s", "en", 1, "UPPER" if i % 2 else "lower") for i in range(100)]
    found = {r[0]: r[-1] for r in proved(spark, rows)}
    assert {i for i, ok in found.items() if not ok} == {i for i in range(100) if i % 2 and zlib.crc32(str(i).encode()) % 5 == 0}
