"""Nearest neighbours by cosine with an adaptive dimension scan.

Vectors are scaled to length one and rotated by a seeded orthogonal matrix, so that any first d of D dimensions are a
fair sample of a distance. Inverted lists come from spherical k-means on a bounded sample; every vector is indexed.
Within a probed list the rotated vectors are measured in column blocks: after each block a hypothesis test compares the
scaled partial distances with each query's fifth-best distance so far and abandons pairs that would hardly get below it.
What remains is scored exactly, in double precision, on the original vectors.

The number of probed lists is chosen on the sample, as the least that reaches TARGET_RECALL there. Small lists share a
shelf, which a query is sent to once and scans with one limit; large ones are split in chunks of rows, and the queries
of a shelf in blocks, so that a list with a third of all vectors or queries is many tasks. Many queries are measured
against a list at once. Where vectors are even in all directions that recall needs about half of all lists, so the
pairs measured grow with the product of queries and rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import in_sample, sample_share

#: Vectors and numbers in the sample that fits the lists.
FIT_ROWS, FIT_NUMBERS = 20_000, 4_000_000
MAX_LISTS = 4096
#: Rows and queries that meet in one group, and the numbers that either may hold; rows and queries measured at once.
CHUNK_ROWS, QUERY_BLOCK, GROUP_NUMBERS = 4096, 4096, 1 << 20
PIECE_ROWS, PIECE_QUERIES, SCORED_PAIRS = 512, 256, 4096
COLUMN_BLOCK = 16
#: Pairs are measured one by one when less than this share of them is left.
SPARSE = 1 / 16
#: Significance of the test: a candidate goes if its scaled partial distance exceeds the limit by this many standard deviations.
SIGMAS = 2.1
TARGET_RECALL, LEAST_FOUND = 0.98, 100


def rotation(dims: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest part first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact cosines of pairs of original vectors, both of length one; the same for equal rows wherever they stand."""
    return (rows * queries).sum(axis=1)


def k_means(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 4) -> np.ndarray:
    centres = x[np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmax(x[i : i + 4096] @ centres.T, axis=1)
    return out


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET_RECALL, queries: int = 300) -> int:
    """The least number of lists that holds `target` of the sample's own nearest neighbours."""
    own = nearest(x, centres)
    picked = np.arange(0, len(x), max(1, len(x) // queries))
    ranks = []
    for i in picked:
        near = x @ x[i]
        near[i] = -2
        best = np.argpartition(-near, min(k, len(near) - 1))[:k]
        order = np.empty(len(centres), np.int64)
        order[np.argsort(-(centres @ x[i]), kind="stable")] = np.arange(len(centres))
        ranks += order[own[best]].tolist()
    return int(np.quantile(ranks, target, method="higher")) + 1


def distances(queries: np.ndarray, rows: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Squared distances of rotated queries and rows; infinite for pairs that some column block showed to be hardly within the query's limit."""
    dims = queries.shape[1]
    far = np.zeros((len(queries), len(rows)))
    pairs = None
    for a in range(0, dims, COLUMN_BLOCK):
        z = min(a + COLUMN_BLOCK, dims)
        q, r = queries[:, a:z], rows[:, a:z]
        bound = limit * (z / dims * (1 + SIGMAS / np.sqrt(z)) ** 2 if z < dims else 1) + 1e-9
        if pairs is None:
            far += (q * q).sum(axis=1)[:, None] + (r * r).sum(axis=1) - 2 * (q @ r.T)
            far[far > bound[:, None]] = np.inf
            left = np.isfinite(far)
            if left.sum() < SPARSE * left.size:
                pairs = np.nonzero(left)
        else:
            i, j = pairs
            partial = far[i, j] + ((q[i] - r[j]) ** 2).sum(axis=1)
            stay = partial <= bound[i]
            far[i, j] = np.where(stay, partial, np.inf)
            pairs = i[stay], j[stay]
        if pairs is not None and not len(pairs[0]):
            break
    return far


def scan(queries: np.ndarray, rows: np.ndarray, pieces: list[tuple[int, int, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a rotated query and a row that may be among the query's k nearest; pieces: runs of rows and the queries that look there.

    The first rows that a query meets are measured in full; what comes through tightens its limit for the next."""
    best = np.full((len(queries), k), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start, end, own in pieces:
        for a in range(start, end, PIECE_ROWS):
            far = distances(queries[own], rows[a : min(end, a + PIECE_ROWS)], best[own, -1])
            some = np.isfinite(far).any(axis=1)
            far, asking = far[some], own[some]
            nearest_few = np.partition(far, k - 1, axis=1)[:, :k] if far.shape[1] > k else far
            best[asking] = np.sort(np.concatenate([best[asking], nearest_few], axis=1), axis=1)[:, :k]
            i, j = np.nonzero(np.isfinite(far) & (far <= best[asking, -1][:, None] + 1e-9))
            found.append((asking[i], j + a, far[i, j]))
    i, j, far = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    kept = far <= best[i, -1] + 1e-9
    return i[kept], j[kept]


def nearest_of(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best pairs, ties to the smaller id; an id that repeats counts once, by its best score."""
    order = np.lexsort((-score, ids, i))
    order = order[np.r_[True, (i[order][1:] != i[order][:-1]) | (ids[order][1:] != ids[order][:-1])][: len(order)]]
    order = order[np.lexsort((ids[order], -score[order], i[order]))]
    own = i[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def shelve(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(shelf, chunks) of each list: neighbouring lists share a shelf while they hold no more than so many rows; a larger list has its own, in chunks."""
    shelf = np.zeros(len(sizes), np.int64)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > rows:
            at, held = at + 1, 0
        shelf[i], held = at, held + n
    return shelf, np.maximum(1, -(-np.bincount(shelf, sizes).astype(np.int64) // rows))[shelf]


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of vectors that have an id and hold finite numbers, not all zero."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first, ties to the smaller vec_id.

    Both inputs have vec_id and embedding. A query doesn't find its own id. Vectors that are null, zero or hold null or
    non-finite numbers take no part, nor do those of another length than most. Rows that repeat an id count as one
    neighbour with its best score. Empty inputs give no rows; other columns are not read."""
    rows = _usable(vectors)
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dims, n = lengths[0]["dims"], lengths[0]["count"]
    rows = rows.where(F.size("v") == dims)
    asked = _usable(queries).where(F.size("v") == dims)
    bound = max(64, min(FIT_ROWS, FIT_NUMBERS // dims))
    sample = rows.where(in_sample(F.col("vec_id"), sample_share(n, bound), 41)).orderBy("vec_id").limit(2 * bound).toPandas()
    x = unit(np.array(sample["v"].tolist(), float)) if len(sample) else np.eye(1, dims)
    lists = max(1, min(MAX_LISTS, int(2 * np.sqrt(n)), len(x) // 4 or 1))
    centres = k_means(x, lists)
    probes = probes_needed(x, centres, k) if len(x) > k else lists
    shared = spark.sparkContext.broadcast(centres)  # at most MAX_LISTS rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = np.array(batch.column("v").flatten()).reshape(len(batch), dims)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(nearest(unit(v), shared.value).astype(np.int32))], names=["vec_id", "v", "list"])

    indexed = rows.mapInArrow(assign, "vec_id long, v array<double>, list int")
    sizes = np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]

    def probed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        v = np.array(batch.column("v").flatten()).reshape(len(batch), dims)
        order = np.argsort(-(unit(v) @ shared.value.T), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) < LEAST_FOUND + 1).sum(axis=1) + 1
        count = np.minimum(np.maximum(enough, probes), lists)
        return np.repeat(np.arange(len(batch)), count), order[np.arange(lists) < count[:, None]]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(at, 256) for batch in batches for at in range(0, len(batch), 256))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lists + 1)), pa.array(np.r_[np.bincount(probed(part)[1], minlength=lists), len(part)])], names=["list", "asking"])

    asking = np.zeros(lists + 1, np.int64)  # the queries of each list, and of all
    for r in asked.mapInArrow(tally, "list long, asking long").groupBy("list").agg(F.sum("asking").alias("asking")).collect():
        asking[r["list"]] = r["asking"]
    rows_each, queries_each = (max(1, min(most, GROUP_NUMBERS // dims)) for most in (CHUNK_ROWS, QUERY_BLOCK))
    shelf, chunks = shelve(sizes, rows_each)
    blocks = np.maximum(1, -(-np.minimum(np.bincount(shelf, asking[:-1]), asking[-1]).astype(np.int64) // queries_each))[shelf]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            pick, taken = probed(part)
            order = np.lexsort((shelf[taken], pick))
            pick, taken = pick[order], taken[order].astype(np.int32)
            starts = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (shelf[taken][1:] != shelf[taken][:-1])])
            own = pa.array(pick[starts])
            looked = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(taken)].astype(np.int32)), pa.array(taken))
            yield pa.RecordBatch.from_arrays([part.column("vec_id").take(own), part.column("v").take(own), pa.array(taken[starts]), looked], names=["query_id", "v", "list", "lists"])

    probing = asked.mapInArrow(probe, "query_id long, v array<double>, list int, lists array<int>")
    # Both sides of a cogroup are dealt by hashes of their keys, so these must be of one type.
    plan = lambda: spark.createDataFrame(pd.DataFrame({"list": np.arange(lists), "shelf": shelf, "chunks": chunks, "blocks": blocks}), "list int, shelf int, chunks int, blocks int")
    part = lambda key, name, m: F.pmod(F.xxhash64(F.lit(name), key), F.col(m)).cast("int")
    upto = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = indexed.join(F.broadcast(plan()), "list").withColumn("chunk", part(F.col("vec_id"), "c", "chunks")).withColumn("block", upto("blocks")).select("shelf", "chunk", "block", "list", "vec_id", "v")
    right = probing.join(F.broadcast(plan()), "list").withColumn("block", part(F.col("query_id"), "b", "blocks")).withColumn("chunk", upto("chunks")).select("shelf", "chunk", "block", "query_id", "v", "lists")
    turn = rotation(dims)

    def scanned(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(own) and len(asking):
            v, q = (unit(np.array(t.column("v").combine_chunks().flatten()).reshape(len(t), dims)) for t in (own, asking))
            ids, query_ids, lists_of = own.column("vec_id").to_numpy(), asking.column("query_id").to_numpy(), own.column("list").to_numpy()
            order = np.lexsort((ids, lists_of))
            v, ids, lists_of = v[order], ids[order], lists_of[order]
            turned, turned_q = v @ turn, q @ turn
            looked = asking.column("lists").combine_chunks()
            looking, looked = np.repeat(np.arange(len(asking)), looked.value_lengths().to_numpy()), looked.flatten().to_numpy()
            # So many nearest rows that k + 1 ids are among them, the query's own included.
            rows_near = (k + 1) * int(np.unique(ids, return_counts=True)[1].max())
            runs = [(x, *np.searchsorted(lists_of, [x, x + 1]).tolist()) for x in np.unique(lists_of)]
            for at in range(0, len(asking), PIECE_QUERIES):
                here = (looking >= at) & (looking < at + PIECE_QUERIES)
                pieces = [(a, z, looking[here & (looked == x)] - at) for x, a, z in runs]
                i, j = scan(turned_q[at : at + PIECE_QUERIES], turned, [p for p in pieces if len(p[2])], rows_near)
                i += at
                other = ids[j] != query_ids[i]
                i, j = i[other], j[other]
                score = np.concatenate([np.zeros(0), *(cosines(q[i[s : s + SCORED_PAIRS]], v[j[s : s + SCORED_PAIRS]]) for s in range(0, len(i), SCORED_PAIRS))])
                best = nearest_of(i, ids[j], score, k)
                out.append((query_ids[i[best]], ids[j[best]], score[best]))
        columns_out = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns_out[0], pa.int64()), "vec_id": pa.array(columns_out[1], pa.int64()), "score": pa.array(columns_out[2], pa.float64())})

    keys = ["shelf", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scanned, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id", "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
