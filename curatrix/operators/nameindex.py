"""Fuzzy joins of names without a nested loop: an inverted index on rare parts, and bounds on what is left.

Two names of together S letters whose Ratcliff/Obershelp ratio is t have t * S / 2 letters in matching runs, and runs are
separated by letters that match nothing; so they share at least (1.5 t - 1) S - 1 pairs of neighbouring letters, each
counted as often as both have it. Levenshtein similarity obeys the same bounds. Names whose S makes that at least one
meet on such pairs, shorter ones on single letters: of each name the rarest ones are its prefix, as many as leave fewer
than the shared number outside, and names that share no token of their prefixes are never put together. Signatures of
256 bits of all letters and pairs bound the similarity of those that meet before any string is compared.

`alike` gives all pairs from a threshold on, `nearest` the best candidate of each name however far: there blocks of both
sides meet in tasks, signatures order the candidates, and a name stops as soon as no bound exceeds what it has found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import similarity, text
from curatrix.session import cut

WORDS = 4
LETTERS, PAIRS = [f"l{i}" for i in range(WORDS)], [f"p{i}" for i in range(WORDS)]
BITS = ", ".join(f"{c} long" for c in LETTERS + PAIRS)
#: Names that a task compares at a time, and candidates they meet there.
NAMES, CANDIDATES = 2_000, 20_000
#: Cells of a table of bounds, and candidates of a name that are compared before its bounds are looked at again.
CELLS, STEP = 1 << 20, 8
EPS = 1e-9
Batch = Callable[[similarity.Strings, similarity.Strings, np.ndarray, np.ndarray], np.ndarray]
#: The similarities that this index knows, as columns and for batches.
BATCHES: dict[object, Batch] = {text.ratio: similarity.ratios, text.levenshtein_similarity: similarity.levenshteins}


def least_sum(t: float) -> float:
    """Letters of two names from which on they share a pair of neighbouring letters at similarity t."""
    return 2 / (1.5 * t - 1) if 1.5 * t > 1 + EPS else 1e18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A token for each code of an owner and the number of its occurrence there."""
    order = np.lexsort((codes, owner))
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = np.arange(len(codes))
    number = np.empty(len(codes), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return _mixed(codes * np.uint64(0x9E3779B97F4A7C15) + number)


def _signatures(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, WORDS), np.uint64)
    bit = tokens >> np.uint64(56)
    np.bitwise_or.at(out, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def parts(names: list[str]) -> tuple[similarity.Strings, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of names in lower case the letters and the pairs of neighbouring letters, as (tokens, owner)."""
    s = similarity.Strings(similarity.lowered(names))
    owner = np.repeat(np.arange(len(names)), s.lengths)
    codes = s.codes.astype(np.uint64)
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
    return s, (_numbered(codes, owner), owner), (_numbered((codes[inner] << np.uint64(32)) + codes[inner + 1], owner[inner]) ^ np.uint64(0xD6E8FEB86659FD93), owner[inner])


def _columns(names: list[str]) -> tuple[similarity.Strings, list[pa.Array], tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    s, letters, pairs = parts(names)
    bits = np.hstack([_signatures(*letters, len(names)), _signatures(*pairs, len(names))]).view(np.int64)
    return s, [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(2 * WORDS)], letters, pairs


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s, bits, _, _ = _columns(batch.column("name").to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.lengths), *bits], names=[*batch.schema.names, "n", *LETTERS, *PAIRS])


def _listed(t: float):
    """For each name a row for single letters and one for pairs, if it can have partners there: the tokens, and how many of the rarest make its prefix."""
    border = least_sum(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, bits, letters, pairs = _columns(batch.column("name").to_pylist())
            n = s.lengths
            smallest = 2 * n / (2 - t)  # letters of a name and its shortest partner
            for route, (tokens, owner), some, wanted in (
                (0, letters, (n > 0) & (smallest < border), np.ceil(t * smallest / 2 - EPS)),
                (1, pairs, (n > 1) & (2 * n / t >= border - EPS), np.ceil((1.5 * t - 1) * np.maximum(smallest, border) - 1 - EPS)),
            ):
                sizes = np.bincount(owner, minlength=len(n))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(tokens.view(np.int64)))
                wanted = np.where(some, wanted, 0)
                kept = pa.array(np.flatnonzero(some & (sizes >= wanted)))
                columns = [*batch.columns, pa.array(n), *bits, pa.array(np.full(len(n), route, np.int32)), pa.array((sizes - wanted + 1).astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays([c.take(kept) for c in columns], names=[*batch.schema.names, "n", *LETTERS, *PAIRS, "route", "length", "tokens"])

    return run


def _shared(size: str, words: list[str]) -> Column:
    """An upper bound of the tokens that two names have in common."""
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}_{w}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{w}")))) for w in words[1:]), F.bit_count(F.col(f"{x}_{words[0]}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{words[0]}")))))
    return F.least(F.expr(size.format("a")) - only("a", "b"), F.expr(size.format("b")) - only("b", "a"))


def met(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of distinct names (name) of both sides that can reach similarity t: they share a rare token, and lengths and signatures allow it. Equal empty names are no pair."""
    kinds = f"name string, side string, n long, {BITS}, route int, length int, tokens array<long>"
    both = left.select("name", F.lit("a").alias("side")).union(right.select("name", F.lit("b").alias("side")))
    listed = cut(both.mapInArrow(_listed(t), kinds))
    tokens = listed.select("name", "side", "route", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"), F.count_distinct("side").alias("sides"))
    ranked = tokens.join(counts, "token").groupBy("name", "side", "route").agg(F.sort_array(F.collect_list(F.struct("df", "token", "sides"))).alias("ranked"))
    prefix = ranked.join(listed.drop("tokens"), ["name", "side", "route"])
    # A token that one side alone has takes its place in the prefix and meets nothing.
    prefix = prefix.withColumn("x", F.explode(F.expr("slice(ranked, 1, length)"))).where("x.sides = 2").drop("ranked", "length").withColumn("token", F.col("x.token")).drop("x")
    one = lambda side: prefix.where(F.col("side") == side).select("token", "route", *[F.col(c).alias(f"{side}_{c}") for c in ("name", "n", *LETTERS, *PAIRS)])
    total, border = F.col("a_n") + F.col("b_n"), least_sum(t)
    pairs = one("a").join(one("b"), ["token", "route"]).where((F.col("route") == 1) == (total >= border - EPS))
    pairs = pairs.where(2 * F.least("a_n", "b_n") >= t * total - EPS).where(2 * _shared("{}_n", LETTERS) >= t * total - EPS)
    pairs = pairs.where(_shared("{}_n - 1", PAIRS) >= (1.5 * t - 1) * total - 1 - EPS)
    return pairs.select(F.col("a_name").alias("a"), F.col("b_name").alias("b")).distinct()


def alike(left: DataFrame, right: DataFrame, t: float, measure=text.ratio) -> DataFrame:
    """(a, b, score) of all pairs of distinct names of both sides that reach similarity t, empty names aside. b is the reference of the measure."""
    return met(left, right, t).withColumn("score", measure(F.col("a"), F.col("b"))).where(F.col("score") >= t)


def _bounds(size_a: np.ndarray, bits_a: np.ndarray, size_b: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """Upper bounds of the similarity of every name with every candidate, a row for each name."""
    total = size_a[:, None] + size_b
    out = np.ones(total.shape)
    for words, less in ((slice(0, WORDS), 0), (slice(WORDS, 2 * WORDS), 1)):
        a, b = bits_a[:, words], bits_b[:, words]
        both = np.zeros(total.shape, np.int64)
        for i in range(WORDS):
            both += np.bitwise_count(a[:, i, None] & b[:, i])
        ones_a, ones_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
        shared = np.minimum((np.maximum(size_a - less, 0) - ones_a)[:, None] + both, np.maximum(size_b - less, 0) - ones_b + both)
        bound = 2 * (shared + total + 1) / (3 * np.maximum(total, 1)) if less else 2 * shared / np.maximum(total, 1)
        np.minimum(out, bound, out=out)
    out[total == 0] = 1.0
    return out


def _best(batch: Batch, floor: float):
    """Of a block of names the best candidate of a block: the highest score, the first by ord on ties, and none below the floor."""
    names = ("raw", "candidate", "canonical", "score", "ord_name", "ord_place")
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(left) and len(right):
            right = right.sort_by([("ord_name", "ascending"), ("ord_place", "ascending"), ("name", "ascending")])
            raws, held = left.column("name").to_pylist(), right.select(["name", "canonical", "ord_name", "ord_place"]).to_pylist()
            s, t = similarity.Strings(similarity.lowered(raws)), similarity.Strings(similarity.lowered([h["name"] for h in held]))
            bits = [np.stack([x.column(c).to_numpy() for c in LETTERS + PAIRS], axis=1).view(np.uint64) for x in (left, right)]
            step = max(1, CELLS // len(held))
            for start in range(0, len(raws), step):
                bounds = _bounds(s.lengths[start : start + step], bits[0][start : start + step], t.lengths, bits[1])
                best, which = np.full(len(bounds), floor - EPS), np.full(len(bounds), -1)
                live = np.flatnonzero(bounds.max(axis=1) >= best - EPS)
                while len(live):
                    k = min(STEP, bounds.shape[1])
                    own = bounds[live]
                    at = np.argpartition(-own, k - 1, axis=1)[:, :k]
                    open_ = np.take_along_axis(own, at, axis=1) >= best[live, None] - EPS
                    a, b = np.repeat(live, k)[open_.ravel()], at.ravel()[open_.ravel()]
                    scores = batch(s, t, a + start, b)
                    bounds[a, b] = -1.0
                    order = np.lexsort((b, -scores, a))
                    first = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
                    a, b, scores = a[first], b[first], scores[first]
                    better = (scores > best[a]) | ((scores == best[a]) & (b < which[a]))
                    best[a[better]], which[a[better]] = scores[better], b[better]
                    live = live[bounds[live].max(axis=1) >= best[live] - EPS]
                rows += [(raws[start + i], held[j]["name"], held[j]["canonical"], float(x), held[j]["ord_name"], held[j]["ord_place"]) for i, (j, x) in enumerate(zip(which.tolist(), best.tolist(), strict=True)) if j >= 0]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return run


def nearest(names: DataFrame, registry: DataFrame, measure=text.ratio, floor: float = 0.0) -> DataFrame:
    """(raw, candidate, canonical, score, ord): of each distinct name (raw) the best row of a registry (candidate, canonical, ord) that scores at least floor, the least ord on ties."""
    left = cut(names.select(F.col("raw").alias("name")).mapInArrow(_signed, f"name string, n long, {BITS}"))
    right = registry.select(F.col("candidate").alias("name"), "canonical", F.col("ord.name").alias("ord_name"), F.col("ord.place").alias("ord_place"))
    right = cut(right.mapInArrow(_signed, f"name string, canonical string, ord_name string, ord_place int, n long, {BITS}"))
    rows, columns = max(1, -(-left.count() // NAMES)), max(1, -(-right.count() // CANDIDATES))
    block = lambda key, n: F.pmod(F.xxhash64("name", key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("row", block(F.lit(1), rows)).withColumn("column", every(columns))
    b = right.withColumn("column", block(F.lit(2), columns)).withColumn("row", every(rows))
    found = a.groupBy("row", "column").cogroup(b.groupBy("row", "column")).applyInArrow(_best(BATCHES[measure], floor), "raw string, candidate string, canonical string, score double, ord_name string, ord_place int")
    return found.select("raw", "candidate", "canonical", "score", F.struct(F.col("ord_name").alias("name"), F.col("ord_place").alias("place")).alias("ord"))
