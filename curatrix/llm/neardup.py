"""MinHash near-duplicate classes with odd sketches.

One pass over the texts gives each row the hash of its whole shingle set, band keys from a MinHash signature and an
odd sketch: the signature's samples folded into a parity bitmap. Rows with equal sets become one class before
anything is compared, so thousands of copies cost one row. Classes that share a band key meet in three steps; in each
the XOR population count of two sketches estimates the similarity and discards unlikely pairs, and what remains is
confirmed on the full sets of both texts:

1. each class with the likeliest of its buckets' hubs, 2. with its other hubs, unless links connect them by then,
3. in buckets whose other members then still belong to several components, all members outside the largest component
with all members, in blocks inside tasks. Sketches meet first; only texts of a block that some sketch there calls
likely are moved to it, and a task counts shared shingles and emits links, never pairs. A pair meets in the first
band that it shares.

Texts travel to units of work of bounded size: a hub with some of its bucket, or two blocks. A fixed-size bitmap of the
texts that a step needs keeps all others out of its shuffle.

With 24 bands of 4 rows a pair at similarity 0.8 shares no band with probability 3e-6. The sketch threshold lies
more than six standard deviations below 0.8."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernel
from curatrix.llm.common import cut, marked, release, slices

BANDS, ROWS = 24, 4
SAMPLES = BANDS * ROWS
SKETCH_LONGS = 8
SKETCH_BITS = 64 * SKETCH_LONGS
#: Six standard deviations of an estimate from SAMPLES samples below 0.8, less the sketch's own error.
SLACK = 0.30
_RNG = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_CHUNK = 4096
#: A block of texts that meets another holds about so many shingles and rows at most; tasks take about GROUP_SHINGLES at a time.
BLOCK_SHINGLES, BLOCK_ROWS, GROUP_SHINGLES, GROUP_ROWS = 1 << 20, 4096, 1 << 18, 1 << 14

_SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima over the set, in chunks that fit a core's cache."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        part = shingles[i : i + _CHUNK, None] * _MULTIPLY
        part += _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return kernel.mix(least)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS) * kernel._STEPS[:ROWS]
    return kernel.mix(rows.sum(axis=1, dtype=np.uint64) + kernel._STEPS[:BANDS])


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """The signature's (position, minimum) pairs folded into a bitmap by parity."""
    bits = kernel.mix(sig + kernel.mix(np.arange(SAMPLES, dtype=np.uint64))) % np.uint64(SKETCH_BITS)
    parity = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def sketch_similarity(differing: int) -> float:
    """Similarity that the number of differing bits points to."""
    share = min(differing, SKETCH_BITS // 2 - 1) * 2 / SKETCH_BITS
    return 1 + float(np.log(1 - share)) * SKETCH_BITS / (4 * SAMPLES)


def _differing_bits(similarity: float) -> int:
    """The largest number of differing bits that still points to `similarity`."""
    return max(d for d in range(SKETCH_BITS // 2) if sketch_similarity(d) >= similarity)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _signatures(k: int):
    fields = [("v", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))]
    schema = pa.schema(fields + [(s, pa.int64()) for s in _SKETCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = len(part)
                counts, h1, h2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                keys, sketches = np.zeros((n, BANDS), np.uint64), np.zeros((n, SKETCH_LONGS), np.uint64)
                for i, own in enumerate(kernel.shingle_sets(part.column("text"), k)):
                    counts[i] = len(own)
                    if len(own):
                        h1[i] = kernel.mix(own).sum(dtype=np.uint64)
                        h2[i] = kernel.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                        sig = signature(own)
                        keys[i], sketches[i] = band_keys(sig), odd_sketch(sig)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(_signed(keys).ravel()))
                columns = [part.column("v"), part.column("doc_id"), pa.array(counts), pa.array(_signed(h1)), pa.array(_signed(h2)), bands]
                columns += [pa.array(_signed(sketches[:, i])) for i in range(SKETCH_LONGS)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges (a, b): least vertex reachable, by neighbour minima and pointer jumping; every round is cut to the shared folder."""
    both = cut(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("component")))
    before = None
    while True:
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before or total is None:
            release(both)
            return labels
        before = total
        seen = both.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("component").alias("near"))
        # Written first, so that the rows of a hot component can be split.
        lower = cut(labels.join(seen, "v").select("v", F.least("component", "near").alias("component")))
        jump = lower.select(F.col("v").alias("component"), F.col("component").alias("further"))
        old, labels = labels, cut(lower.join(jump, "component", "left").select("v", F.coalesce(F.least("component", "further"), "component").alias("component")))
        release(old, lower)


def _bits_apart() -> Column:
    return sum((F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col(f"a_{_SKETCH[0]}").bitwiseXOR(F.col(f"b_{_SKETCH[0]}"))))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that set sizes and sketches leave possible, with both sizes and the bits their sketches differ in."""
    for side in ("a", "b"):
        own = classes.select(F.col("v").alias(side), F.col("n_shingles").alias(f"{side}_n"), *[F.col(s).alias(f"{side}_{s}") for s in _SKETCH])
        pairs = pairs.join(own, side)
    fits = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    apart = _bits_apart()
    return pairs.where(fits & (apart <= _differing_bits(percent / 100 - SLACK))).select("a", "b", "a_n", "b_n", apart.alias("rank"))


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    edges = np.flatnonzero(np.diff(sorted_keys)) + 1
    bounds = [0, *edges.tolist(), len(sorted_keys)]
    return zip(bounds[:-1], bounds[1:], strict=True)


def _partners(strays: np.ndarray, members: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions of strays and of members) that sizes and sketches leave possible, a few strays at a time."""
    most = _differing_bits(percent / 100 - SLACK)
    strays, members = strays[np.argsort(sizes[strays], kind="stable")], members[np.argsort(sizes[members], kind="stable")]
    held = sizes[members]
    for i in range(0, len(strays), 64):
        some = strays[i : i + 64]
        low = np.searchsorted(held, -(-int(sizes[some[0]]) * percent // 100))
        high = np.searchsorted(held, int(sizes[some[-1]]) * 100 // percent, "right")
        near = members[low:high]
        if not len(near):
            continue
        apart = np.zeros((len(some), len(near)), np.uint16)
        for word in range(sketches.shape[1]):
            apart += np.bitwise_count(sketches[some, word][:, None] ^ sketches[near, word])
        x, y = np.nonzero(apart <= most)
        x, y = some[x], near[y]
        fits = 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
        yield x[fits], y[fits]


def _flag(percent: int):
    """Of each unit the rows that some sketch of another component calls likely, if this unit's band is the first that both share."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("unit").to_numpy(), kind="stable")).combine_chunks()
        c, band, stray, sizes = (table.column(x).to_numpy() for x in ("c", "band", "stray", "n_shingles"))
        sketches = np.stack([table.column(s).to_numpy() for s in _SKETCH], axis=1).view(np.uint64)
        bands = table.column("bands").chunk(0).flatten().to_numpy().reshape(len(table), BANDS) if len(table) else np.zeros((0, BANDS), np.int32)
        short = band.astype(np.int32)
        flagged = np.zeros(len(table), bool)
        for start, end in _runs(table.column("unit").to_numpy()) if len(table) else ():
            rows = np.arange(start, end)
            for x, y in _partners(rows[stray[start:end]], rows[~stray[start:end]], sizes, sketches, percent):
                other = c[x] != c[y]
                x, y = x[other], y[other]
                first = (bands[x] == bands[y]).argmax(axis=1)
                here = bands[x, first] == short[x]
                flagged[x[here]] = flagged[y[here]] = True
        return table.select(["unit", "stray", "v", "c", "n_shingles"]).filter(pa.array(flagged))

    return run


def _confirm(k: int, percent: int):
    """Links within units between strays and members of other components: for each stray and component the smallest partner."""

    def run(table: pa.Table) -> pa.Table:
        a_out: list[int] = []
        b_out: list[int] = []
        if len(table):
            table = table.take(np.argsort(table.column("unit").to_numpy(), kind="stable")).combine_chunks()
            v, c, stray = (table.column(x).to_numpy() for x in ("v", "c", "stray"))
            _, first, which = np.unique(v, return_index=True, return_inverse=True)
            texts = table.select(["text"]).take(first).combine_chunks().to_batches()[0]
            sets = [own for part in slices(texts, "text") for own in kernel.shingle_sets(part.column("text"), k)]
            for start, end in _runs(table.column("unit").to_numpy()):
                rows = np.arange(start, end)
                strays, members = rows[stray[start:end]], rows[~stray[start:end]]
                if not len(strays) or not len(members):
                    continue
                own = [sets[which[i]] for i in members]
                sizes = np.array([len(x) for x in own])
                flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
                if len(own) > 1:
                    order = np.argsort(flat, kind="stable")
                    flat, owner = flat[order], owner[order]
                for i in strays:
                    mine = sets[which[i]]
                    low, high = np.searchsorted(flat, mine), np.searchsorted(flat, mine, "right")
                    n = high - low
                    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(own))
                    hits = members[(100 * both >= percent * (sizes + len(mine) - both)) & (c[members] != c[i])]
                    hits = hits[np.lexsort((v[hits], c[hits]))]
                    least = hits[np.flatnonzero(np.diff(c[hits], prepend=c[hits[0]] - 1 if len(hits) else 0))] if len(hits) else hits
                    b_out += v[least].tolist()
                    a_out += [int(v[i])] * len(least)
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def linked(likely: DataFrame, buckets: DataFrame, texts: DataFrame, shingle: int, percent: int, flagged: Callable[[DataFrame], DataFrame], repeated: bool) -> DataFrame:
    """(v, component) of the texts (v, text) that links connect.

    likely (a, b, a_n, b_n, rank): pairs of a hub and a member of its buckets (band, v), of least rank the likeliest.
    flagged gives of open buckets' members (band, v, c) the units in which texts are to meet. repeated: texts hold a v more than once."""

    def confirmed(placed: DataFrame) -> DataFrame:
        """Links (a, b) that units (unit, stray, v, c, n_shingles) hold; each text travels once to each of its units."""
        own = marked(texts, placed, "v").where("marked").drop("marked")
        own = own.groupBy("v").agg(F.first("text").alias("text")) if repeated else own
        groups = -(-(placed.agg(F.sum("n_shingles")).first()[0] or 1) // GROUP_SHINGLES)
        met = placed.join(own, "v").withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups)))
        return cut(met.select("g", "unit", "stray", "v", "c", "text").groupBy("g").applyInArrow(_confirm(shingle, percent), "a long, b long"))

    def confirmed_pairs(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, a_n, b_n) that pass: units are a hub and a block of those that it is to meet."""
        blocks = pairs.groupBy("a").agg(F.ceil(F.sum("b_n") / BLOCK_SHINGLES).alias("blocks")).where("blocks > 1")
        pairs = pairs.join(blocks, "a", "left").withColumn("unit", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1)))))
        unit = lambda stray, x: pairs.select("unit", F.lit(stray).alias("stray"), F.col(x).alias("v"), F.col(x).alias("c"), F.col(f"{x}_n").alias("n_shingles"))
        placed = cut(unit(True, "b").union(unit(False, "a").distinct()))
        links = confirmed(placed)
        release(placed)
        return links

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends lie in different components."""
        for side in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("v").alias(side), F.col("component").alias(f"{side}_c")), side, "left")
        return pairs.where(~F.coalesce("a_c", "a").eqNullSafe(F.coalesce("b_c", "b")))

    best = likely.groupBy("b").agg(F.min(F.struct("rank", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    edges = confirmed_pairs(likely.join(best, ["a", "b"]))
    labels = components(edges)

    rest = cut(apart(likely.join(best, ["a", "b"], "left_anti"), labels).select("a", "b", "a_n", "b_n"))
    if rest.limit(1).count():
        more = confirmed_pairs(rest)
        if more.limit(1).count():
            edges = edges.union(more)
            labels = components(edges)
    release(rest, likely)

    # Every member has met its hub. Buckets whose other members belong to several components are still open.
    placed = buckets.select("band", "v").join(labels, "v", "left").select("band", "v", F.coalesce("component", "v").alias("c"))
    mixed = cut(placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band"))
    opened = cut(placed.join(mixed, "band"))
    release(mixed)
    if opened.limit(1).count():
        met = cut(flagged(opened))
        if met.limit(1).count():
            more = confirmed(met)
            if more.limit(1).count():
                labels = components(edges.union(more))
            release(more)
        release(met)
    release(buckets, opened, edges)
    return labels


def assigned(rows: DataFrame, classes: DataFrame, labels: DataFrame, repeated: bool) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, by its class and the class's component."""
    found = classes.select("h1", "h2", "doc_id", "v").join(labels, "v", "left").withColumn("component", F.coalesce("component", "v"))
    if repeated:  # components go by v and not by id
        least = found.groupBy("component").agg(F.min("doc_id").alias("class_id"))
        found = found.join(least, "component")
    else:
        found = found.withColumn("class_id", F.col("component"))
    component = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n_shingles", "h1", "h2").join(found.select("h1", "h2", "class_id"), ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for every input row.

    Rows are linked if their sets of distinct `shingle`-word shingles have 100 * intersection >= percent * union.
    Null and empty texts have an empty set and link with nothing. Rows that repeat an id are rows of their own, each
    linked by its own text. A null id takes no part: component_id is null and the row is kept. Whole texts count,
    however long. Other columns are not read."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = source.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    source = source.withColumn("v", F.xxhash64("doc_id", "text") if repeated else F.col("doc_id"))
    schema = "v long, doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH)
    rows = cut(source.select("v", "doc_id", "text").mapInArrow(_signatures(shingle), schema))
    sets = rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2")
    classes = cut(sets.agg(F.min(F.struct("doc_id", "v")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), *[F.first(s).alias(s) for s in _SKETCH]).select("h1", "h2", "least.doc_id", "least.v", "n_shingles", "bands", *_SKETCH))
    members = classes.select("v", F.explode("bands").alias("band"))
    # Written first: a join with an aggregate of the same exchange can't split a hot band.
    sizes = cut(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(members.join(sizes, "band"))
    # A bucket's hub is its most central member, the one that shares bands with most others: the text that copies were made of.
    central = shared.groupBy("v").agg(F.sum("n").alias("weight"))
    hubs = cut(shared.join(central, "v").groupBy("band").agg(F.min(F.struct((-F.col("weight")).alias("rank"), "v")).alias("hub")).select("band", F.col("hub.v").alias("hub")))
    buckets = cut(shared.join(hubs, "band").where("v <> hub").select("band", "v", "hub"))
    release(sizes, shared, hubs)
    likely = cut(_likely(buckets.select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct(), classes, percent))
    own = classes.select("v", "n_shingles", F.transform("bands", lambda b: F.shiftright(F.shiftleft(b, 32), 32).cast("int")).alias("bands"), *_SKETCH)
    flagged = lambda opened: _opened_units(opened, own).groupBy("g").applyInArrow(_flag(percent), UNITS)
    labels = linked(likely, buckets, source.where("doc_id is not null").select("v", "text"), shingle, percent, flagged, repeated)
    return assigned(rows, classes, labels, repeated).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: What is told of the texts that are to meet.
UNITS = "unit long, stray boolean, v long, c long, n_shingles long"


def _opened_units(opened: DataFrame, own: DataFrame) -> DataFrame:
    """opened (band, v, c) and own (v, n_shingles, ...) as units: blocks of a bucket's members against blocks of those outside its largest component, in groups g of about GROUP_ROWS rows."""
    per_component = opened.join(own.select("v", "n_shingles"), "v").groupBy("band", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")
    plan = per_component.groupBy("band").agg(F.max(F.struct("n", "size", "c")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    plan = cut(plan.select("band", F.col("main.c").alias("main"), blocks(F.col("n"), F.col("size")).alias("m_blocks"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("s_blocks"), "n"))
    groups = -(-plan.agg(F.sum(F.col("n") * (F.col("s_blocks") + F.col("m_blocks")))).first()[0] // GROUP_ROWS)
    block = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = opened.join(plan.drop("n"), "band")
    members = dealt.withColumn("m", block("m_blocks")).withColumn("s", each("s_blocks")).withColumn("stray", F.lit(False))
    strays = dealt.where("c <> main").withColumn("s", block("s_blocks")).withColumn("m", each("m_blocks")).withColumn("stray", F.lit(True))
    units = members.unionByName(strays).select("band", "stray", "v", "c", F.xxhash64("band", "m", "s").alias("unit"))
    return units.join(own, "v").withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups))).select("g", "unit", "band", "stray", "v", "c", *own.columns[1:])
