"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under their most frequent form.

Two such words share a string that one of them is, or that both become, when a code point is deleted; and they share
exactly one. Prefix and suffix polynomial hashes give the hash of every deletion of every word of a batch at once, as
NumPy integers. Keys are dealt to tasks by their top bits, sorted there, and words that meet in a key are compared as
strings, so a collision of hashes costs time and changes nothing. A key holds at most a word's length times the
alphabet. A task gives counts and the best neighbour of each word it has seen, never the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernel
from curatrix.llm.common import cut, release, slices

#: A run of letters: ASCII and the upper half of Latin-1.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Deletion keys that a task sorts at a time, about.
TASK_KEYS = 1 << 15


def folded(run: Column) -> Column:
    """A run with a-z for A-Z, other capitals as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(run.rlike(r"[À-Þ]"), F.translate(run, upper, upper.lower())).otherwise(F.lower(run))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run) for every run of letters of the whole texts, folded; null texts have none."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    return found.select("id", folded(F.col("run")).alias("run"))


def without(run: Column, at: Column) -> Column:
    """A run without its code point at a place from 0."""
    return F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words that are long and frequent enough."""
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key): the hash of every word itself, at place -1, and of each of its distinct deletions, at the first place that gives it."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    n = len(codes)
    up, down = kernel._powers(n + 2)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernel.mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    owner = np.repeat(np.arange(len(words)), ends - starts)
    first = np.ones(n, bool)
    first[1:] = codes[1:] != codes[:-1]
    first[starts[starts < n]] = True
    at = np.flatnonzero(first)
    of = owner[at]
    begin, end = starts[of], ends[of]
    shorter = (prefix[at] - prefix[begin]) * down[begin] + (prefix[end] - prefix[at + 1]) * down[begin + 1]
    whole = (prefix[ends] - prefix[starts]) * down[starts]
    key = kernel.mix(np.concatenate([whole, shorter]))
    return np.concatenate([np.arange(len(words)), of]), np.concatenate([np.full(len(words), -1), at - begin]), key


def _keys(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", 1 << 16):
                word, place, key = deletion_keys(part.column("word").to_pylist())
                radix = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
                rows = part.take(pa.array(word))
                yield pa.RecordBatch.from_arrays([pa.array(radix), pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), rows.column("word"), rows.column("n")], names=["radix", "key", "place", "word", "n"])

    return run


def are_near(a: str, p: int, b: str, q: int) -> bool:
    """Whether words that share a key, by their deletions at p and q (none at -1), differ by exactly one edit that leads through it."""
    if (a if p < 0 else a[:p] + a[p + 1 :]) != (b if q < 0 else b[:q] + b[q + 1 :]):
        return False
    if len(a) != len(b):
        return True
    differing = (i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y)
    i = next(differing, None)
    return i is not None and a[i + 1 :] == b[i + 1 :]


def _meet(table: pa.Table) -> pa.Table:
    """Of the words of a range of keys: how many near ones each has there, and the most frequent of them."""
    table = table.combine_chunks()
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    key, place, n = key[order], table.column("place").to_numpy()[order], table.column("n").to_numpy()[order]
    shared = np.zeros(len(key), bool)
    equal = key[1:] == key[:-1]
    shared[1:] |= equal
    shared[:-1] |= equal
    kept = np.flatnonzero(shared)
    words = dict(zip(kept.tolist(), table.column("word").take(pa.array(order[kept])).to_pylist(), strict=True))
    found: dict[str, list] = {}
    left, step = np.flatnonzero(equal), 1
    while len(left):
        for i in left.tolist():
            j = i + step
            a, b = words[i], words[j]
            if are_near(a, int(place[i]), b, int(place[j])):
                for x, y, m in ((a, b, int(n[j])), (b, a, int(n[i]))):
                    own = found.get(x)
                    if own is None:
                        found[x] = [1, m, y]
                    else:
                        own[0] += 1
                        if (-m, y) < (-own[1], own[2]):
                            own[1:] = m, y
        step += 1
        left = left[left + step < len(key)]
        left = left[key[left + step] == key[left]]
    rows = [(w, *x) for w, x in found.items()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(("word", "n_near", "near_n", "near"), kinds, strict=True))})


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words (word, n) that have near ones: how many, and the one of largest n, the least on ties."""
    total = vocab.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, (total // TASK_KEYS).bit_length())
    keys = vocab.select("word", "n").mapInArrow(_keys(bits), "radix long, key long, place int, word string, n long")
    parts = keys.groupBy("radix").applyInArrow(_meet, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.down")).alias("near_n"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the steps; n grows along a chain, so that there are few and no cycle."""
    reached = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if reached.join(onward, "root", "left_semi").isEmpty():
            return reached
        before, reached = reached, cut(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        release(before)


def spelling_variants(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct words (word) of at least least_length code points that occur least_count times.

    A word's form is its most frequent near word, the least in code-point order on ties, if that is at least `ratio`
    times as frequent; root follows forms to the last and is the word itself without one. Null words count not at all,
    words of any length count whole, an empty table gives no rows, and other columns are not read."""
    vocab = cut(vocabulary(words.select("word"), least_length, least_count))
    near = cut(near_words(vocab))
    placed = vocab.join(near, "word", "left").withColumn("is_form", F.col("near_n") >= ratio * F.col("n"))
    placed = placed.select("word", F.when(F.col("is_form"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("near_n")).alias("form_n"))
    roots = followed(placed.where("form is not null"))
    return placed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
