"""Jaccard join of documents on word n-grams by prefixes under several global orders.

Two sets that share at least `need` of their n members share one among the first n - need + 1 of each under every
order of all n-grams. So candidates have to share a prefix token under all of ORDERS orders, which are intersected
before two full sets are compared. One more filter goes first, which needs no counts:

0. by hash: the prefix is longer by half its length, and then two sets share several of its tokens. A set of whose prefix
   too few tokens occur in any other text's is linked with nothing. It leaves a tenth of the texts, whose n-grams
   are counted in full;
1. by document frequency, rare ones first: an inverted index of the prefixes gives buckets of texts that share a token.
   N-grams that one text alone holds come first and fill its prefix without a bucket;
2. and 3. by classes of frequency (its bit length), each with a hash order of its own inside of a class.

Texts with equal sets become one class before anything is compared, and tokens that the same texts share become one
bucket. A bucket's members meet its hub, then what still belongs to several components meets in blocks, as in
`neardup`; there the orders 2 and 3 and set sizes decide which texts travel, and links are confirmed on full sets. No
pair is emitted for members that a hub connects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernel, neardup
from curatrix.llm.common import BITMAP_WORDS, cut, marked, release, slices

#: Seeds of the orders that follow the one by frequency.
SEEDS = (2, 3)
ORDERS = 1 + len(SEEDS)
#: Keys with which an eighth of the bitmap's bits are set.
BITMAP_KEYS = 8 * BITMAP_WORDS


def need(n, percent: int):
    """Members that a set of n has in common with any set at that similarity, at least."""
    return -(-n * percent // 100)


def lead(n, percent: int):
    """(length of the longer prefix in hash order, tokens of it that other texts must have)."""
    more = lambda m: np.maximum(1, (m - need(m, percent) + 1) // 2)
    # A partner may be as small as need(n), and has fewer tokens in its own longer prefix.
    return np.minimum(n, n - need(n, percent) + more(n)), more(need(n, percent))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)), _signed(flat))


def _described(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, wanted, h1, h2, leads = [], [], [], [], []
                for own in kernel.shingle_sets(part.column("text"), k):
                    size, low = lead(np.int64(len(own)), percent) if len(own) else (0, 0)
                    counts.append(len(own))
                    wanted.append(int(low))
                    h1.append(kernel.mix(own).sum(dtype=np.uint64) if len(own) else np.uint64(0))
                    h2.append(kernel.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(own) else np.uint64(0))
                    leads.append(own[: int(size)])
                columns = [part.column("v"), part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(wanted, pa.int64()), _signed(np.array(h1, np.uint64)), _signed(np.array(h2, np.uint64)), _lists(leads)]
                yield pa.RecordBatch.from_arrays(columns, names=["v", "doc_id", "n_shingles", "wanted", "h1", "h2", "lead"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(kernel.shingle_sets(part.column("text"), k))
                yield pa.RecordBatch.from_arrays([part.column("v"), pa.array([len(x) for x in sets], pa.int64()), _lists(sets)], names=["v", "n_shingles", "tokens"])

    return run


def promising(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(v, n_shingles) of the classes (v) that the first filter leaves, of rows (v, n_shingles, wanted, lead).

    A token that one class alone holds counts against it; hot tokens shrink to a row for each task before they travel.
    The bitmap may let a copy through, which then counts for its class: more is compared, nothing is lost."""
    held = marked(rows, classes, "v").where("marked")
    tokens = held.select("v", F.explode("lead").alias("token")).groupBy("token").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    alone = tokens.where("low = high").groupBy(F.col("low").alias("v")).agg(F.count("*").alias("alone"))
    found = classes.join(alone, "v", "left")
    return found.where(F.col("size") - F.coalesce("alone", F.lit(0)) >= F.col("wanted")).select("v", "n_shingles")


def _first(order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """For each group the first of its values in an order that keeps groups together."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values[order[at]], kind))


def _prefixes(percent: int):
    """Prefixes of whole sets from rows (v, n_shingles, df, token) that stand together by v and in order of df and token."""

    def made(table: pa.Table) -> pa.RecordBatch:
        v, n, df, token = (table.column(c).to_numpy() for c in ("v", "n_shingles", "df", "token"))
        starts = np.flatnonzero(np.diff(v, prepend=v[0] - 1))
        known = np.diff(np.append(starts, len(v)))
        lengths = known - need(n[starts], percent) + 1
        kept = lengths > 0
        owner, level = np.repeat(np.arange(len(starts)), known), np.frexp(df.astype(float))[1]
        starts, lengths = starts[kept], lengths[kept]
        columns = [pa.array(v[starts]), pa.array(n[starts]), _first(np.arange(len(v)), starts, lengths, token, pa.int64())]
        for seed in SEEDS:
            h = kernel.mix(token.view(np.uint64) ^ kernel.mix(np.array([seed], np.uint64)))
            columns.append(_first(np.lexsort((h, level, owner)), starts, lengths, (h >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()))
        return pa.RecordBatch.from_arrays(columns, names=["v", "n_shingles", *(f"o{i}" for i in range(ORDERS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the last set so far, which the next batch may go on with
        for batch in batches:
            v = batch.column("v").to_numpy()
            if not len(v):
                continue
            begin, last = 0, int(np.searchsorted(v, v[-1]))
            if rest:
                begin = int(np.searchsorted(v, rest[0].column("v")[0].as_py(), "right"))
                rest.append(batch.slice(0, begin))
                if begin == len(v):
                    continue
                yield made(pa.Table.from_batches(rest))
            if last > begin:
                yield made(pa.Table.from_batches([batch.slice(begin, last - begin)]))
            rest = [batch.slice(last)]
        if rest:
            yield made(pa.Table.from_batches(rest))

    return run


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(v, n_shingles, o0, o1, ...): of sets (v, n_shingles, tokens) the prefixes under each order, without the n-grams that one set alone holds; sets whose whole prefix is such go."""
    tokens = sets.select("v", "n_shingles", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    listed = tokens.join(shared, "token").select("v", "n_shingles", "df", "token")
    kinds = "v long, n_shingles long, o0 array<long>, " + ", ".join(f"o{i + 1} array<int>" for i in range(len(SEEDS)))
    return listed.repartition("v").sortWithinPartitions("v", "df", "token").mapInArrow(_prefixes(percent), kinds)


def _buckets(index: DataFrame) -> DataFrame:
    """(band, v) of the tokens that prefixes by frequency share; tokens that the same texts share are one bucket, which the least of them names."""
    members = index.select("v", F.explode("o0").alias("token"))
    at, back = F.xxhash64("v"), F.xxhash64(F.lit(7), "v")
    sizes = members.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(at).alias("x"), F.bit_xor(back).alias("y")).where("n > 1")
    kept = cut(sizes.groupBy("n", "x", "y").agg(F.min("token").alias("token")))
    shared = cut(members.join(kept.select("token", "n"), "token").withColumnRenamed("token", "band"))
    release(kept)
    return shared


def alike(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, rank) that set sizes and the prefixes under the further orders leave possible, with both sizes."""
    orders = index.columns[3:]
    for side in ("a", "b"):
        pairs = pairs.join(index.select(F.col("v").alias(side), F.col("n_shingles").alias(f"{side}_n"), *[F.col(o).alias(f"{side}_{o}") for o in orders]), side)
    possible: Column = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    for o in orders:
        possible = possible & F.arrays_overlap(f"a_{o}", f"b_{o}")
    return pairs.where(possible).select("a", "b", "a_n", "b_n", "rank")


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the bounds of its rows."""
    rows = column.combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    return rows.flatten().to_numpy(), np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy())]).astype(np.int64)


def _shared(percent: int, orders: list[str]):
    """Of each unit the rows that share a prefix token with one of another component under every order, if this unit's bucket is the first that both are in."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("unit").to_numpy(), kind="stable")).combine_chunks()
        flagged = np.zeros(len(table), bool)
        if len(table):
            c, band, stray, sizes = (table.column(x).to_numpy() for x in ("c", "band", "stray", "n_shingles"))
            ragged = {x: _ragged(table.column(x)) for x in ("bands", *orders)}
            for start, end in neardup._runs(table.column("unit").to_numpy()):
                members = np.arange(start, end)[~stray[start:end]]
                if not len(members):
                    continue
                flat = {}
                for x, (values, bounds) in ragged.items():
                    at = np.concatenate([np.arange(bounds[m], bounds[m + 1]) for m in members])
                    flat[x] = values[at], np.concatenate([[0], np.cumsum(bounds[members + 1] - bounds[members])[:-1]])
                for s in np.arange(start, end)[stray[start:end]]:
                    hits = (c[members] != c[s]) & (100 * np.minimum(sizes[members], sizes[s]) >= percent * np.maximum(sizes[members], sizes[s]))
                    for x in orders:
                        if hits.any():
                            values, bounds = ragged[x]
                            mine = np.isin(flat[x][0], values[bounds[s] : bounds[s + 1]])
                            hits &= np.logical_or.reduceat(mine, flat[x][1])
                    if hits.any():
                        values, bounds = ragged["bands"]
                        theirs, begin = flat["bands"]
                        common = np.where(np.isin(theirs, values[bounds[s] : bounds[s + 1]]), theirs, np.iinfo(np.int64).max)
                        hits &= np.minimum.reduceat(common, begin) == band[s]
                        flagged[members[hits]] = True
                        flagged[s] |= hits.any()
        return table.select(["unit", "stray", "v", "c", "n_shingles"]).filter(pa.array(flagged))

    return run


def ngram_join(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for every input row.

    Rows are linked if their sets of distinct `shingle`-word shingles have 100 * intersection >= percent * union, and
    component_id is the smallest id that links reach. Null and empty texts have an empty set and link with nothing. Rows
    that repeat an id are rows of their own, each linked by its own text. A null id takes no part: its component_id is
    null. Whole texts count, however long; ties under an order are broken by the token; an empty table gives no rows;
    other columns are not read."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = source.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    source = source.withColumn("v", F.xxhash64("doc_id", "text") if repeated else F.col("doc_id"))
    texts = source.where("doc_id is not null").select("v", "text")
    rows = cut(source.select("v", "doc_id", "text").mapInArrow(_described(shingle, percent), "v long, doc_id long, n_shingles long, wanted long, h1 long, h2 long, lead array<long>"))
    held = rows.where("n_shingles > 0 and doc_id is not null")
    least = F.min(F.struct("doc_id", "v", "n_shingles", "wanted", F.size("lead").alias("size"))).alias("least")
    classes = cut(held.groupBy("h1", "h2").agg(least).select("h1", "h2", "least.*"))
    open_ = cut(promising(held.select("v", "n_shingles", "wanted", "lead"), classes))
    own = marked(texts, open_, "v").where("marked").select("v", "text")
    if open_.count() > BITMAP_KEYS:  # the bitmap lets most texts through
        own = own.join(open_.select("v"), "v", "left_semi")
    own = own.groupBy("v").agg(F.first("text").alias("text")) if repeated else own
    sets = cut(own.mapInArrow(_sets(shingle), "v long, n_shingles long, tokens array<long>"))
    index = cut(prefixes(sets, percent))
    release(sets, open_)

    shared = _buckets(index)
    # A bucket's hub is the member that shares buckets with most others: the text that copies were made of.
    central = shared.groupBy("v").agg(F.sum("n").alias("weight"))
    hubs = cut(shared.join(central, "v").groupBy("band").agg(F.min(F.struct((-F.col("weight")).alias("rank"), "v")).alias("hub")).select("band", F.col("hub.v").alias("hub")))
    buckets = cut(shared.join(hubs, "band").where("v <> hub").select("band", "v", "hub"))
    likely = cut(alike(buckets.groupBy(F.col("hub").alias("a"), F.col("v").alias("b")).agg((-F.count("*")).alias("rank")), index, percent))

    orders = index.columns[3:]
    bands = shared.groupBy("v").agg(F.collect_list("band").alias("bands"))
    payload = index.select("v", "n_shingles", *orders).join(bands, "v").select("v", "n_shingles", "bands", *orders)
    flagged = lambda opened: neardup._opened_units(opened, payload).groupBy("g").applyInArrow(_shared(percent, orders), neardup.UNITS)
    labels = neardup.linked(likely, buckets, texts, shingle, percent, flagged, repeated)
    release(shared, hubs, index)
    return neardup.assigned(rows.drop("lead"), classes, labels, repeated).withColumn("component_id", F.coalesce("component_id", "doc_id"))
