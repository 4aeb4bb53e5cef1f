"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions.

Sizes are words. The target total is cut into equal blocks; sources, and within each source its shards, get whole
blocks by highest quotients size / (2n + 1). A shard's documents stand in a seeded order as one stream of words; the
shard gives whole passes over the stream and, for the rest, as many of its blocks as its quota asks, chosen evenly
from a seeded start. A shard's blocks are of one width, as near to BLOCK_WORDS as cuts its stream with the least rest;
only the last may be shorter. A document's share of the chosen blocks follows from its place in the stream alone, so no block
is ever materialised.

The driver holds one row per source; each source's shards, at most MAX_SHARDS, are dealt their blocks in a task."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm import kernel
from curatrix.llm.common import WORD, cut, slices

BLOCK_WORDS = 64
SHARD_WORDS = 250_000
MAX_SHARDS = 4096
MAX_REPEATS = 3


def water_fill(sizes: list[int], weights: list[int], cap: int = MAX_REPEATS) -> list[Fraction]:
    """Targets in proportion to weights that add up to the sum of sizes; none above cap times its size, the excess reshared by weight."""
    targets = [Fraction(0)] * len(sizes)
    free, left = set(range(len(sizes))), Fraction(sum(sizes))
    while free:
        share = left / sum(weights[i] for i in free)
        over = [i for i in free if share * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = share * weights[i]
            break
        for i in over:
            targets[i] = Fraction(cap * sizes[i])
            left -= targets[i]
            free.discard(i)
    return targets


def sainte_lague(seats: int, votes: list[Fraction | int], limits: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2n + 1), ties to the earlier party, none above its limit.

    The first seats come from a divisor that can't give too many; only the last few are dealt one by one."""
    total = sum(votes)
    limits = limits or [seats] * len(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    dealt = [min(int(limit), max(0, int(Fraction(v) * seats / total) - 1)) for v, limit in zip(votes, limits, strict=True)]
    queue = [(-Fraction(v, 1) / (2 * n + 1), i) for i, (v, n, limit) in enumerate(zip(votes, dealt, limits, strict=True)) if v and n < limit]
    heapq.heapify(queue)
    for _ in range(seats - sum(dealt)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        dealt[i] += 1
        if dealt[i] < limits[i]:
            heapq.heappush(queue, (-Fraction(votes[i], 1) / (2 * dealt[i] + 1), i))
    return dealt


def plan_sources(found: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3)) -> list[tuple[str | None, int, int, float, int]]:
    """From (source, words): rows (source, shards, source_size, target, quota in blocks)."""
    by = dict(found)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    sizes = [by[s] for s in names]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(names))])
    quotas = sainte_lague(round(sum(targets) / BLOCK_WORDS), targets, [-(-MAX_REPEATS * n // BLOCK_WORDS) for n in sizes])
    shards = [min(MAX_SHARDS, 1 << max(0, -(-n // SHARD_WORDS) - 1).bit_length()) for n in sizes]
    return [(name, n, size, float(target), quota) for name, n, size, target, quota in zip(names, shards, sizes, targets, quotas, strict=True)]


_PLAN = pa.schema([("s_source", pa.string()), ("shards", pa.int32()), ("source_size", pa.int64()), ("target", pa.float64()), ("source_quota", pa.int64())])
_DEALT = pa.schema([("q_source", pa.string()), ("q_shard", pa.int32()), ("shard_size", pa.int64()), ("quota", pa.int64())])


def deal_shards(shards: pa.Table) -> pa.Table:
    """The shards of one source (source, shard, shard_size, source_quota) with their quotas."""
    shards = shards.sort_by("shard")
    sizes = shards.column("shard_size").to_pylist()
    quotas = sainte_lague(shards.column("source_quota")[0].as_py(), sizes, [-(-MAX_REPEATS * n // BLOCK_WORDS) for n in sizes])
    return pa.table([shards.column("source"), shards.column("shard"), shards.column("shard_size"), pa.array(quotas, pa.int64())], schema=_DEALT)


def _seeded(seed: int, *key: Column) -> Column:
    return F.xxhash64(F.lit(seed), *key)


def mix_sources(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs with size, source_size, target, taken and what places the chosen words: passes, first, width, blocks, quota_blocks, phase.

    A null text has size 0 and is never taken; null is a source of its own, after all others. A null id is ordered
    like any id. Rows that repeat an id take part as often as they occur; rows equal in id and size share their
    words in any order, which leaves the multiset of results the same on every run. An empty table gives none. A
    column named like a result is replaced."""
    docs = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    spark = docs.sparkSession
    found = [tuple(r) for r in docs.groupBy("source").agg(F.sum("size").alias("n")).collect()]  # a row for each source
    plan = plan_sources(found, weights)
    columns = list(zip(*plan, strict=True)) or [()] * len(_PLAN)
    by_source = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, _PLAN.types, strict=True)], schema=_PLAN))
    names = [c for c in docs.columns if c not in ("source_size", "target", "taken", "shards", "source_quota", "shard_size", "quota", "shard", "s_source", "q_source", "q_shard")]
    # A row for each source and shard; where these are few the planner broadcasts them by its own size check.
    placed = docs.select(names).join(by_source, F.col("source").eqNullSafe(F.col("s_source")))
    placed = placed.withColumn("shard", F.pmod(_seeded(seed, F.col("doc_id")), F.col("shards")).cast("int"))
    shards = placed.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    by_shard = shards.groupBy("source").applyInArrow(deal_shards, "q_source string, q_shard int, shard_size long, quota long")
    placed = placed.join(cut(by_shard), F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    order = Window.partitionBy("source", "shard").orderBy(_seeded(seed + 1, F.col("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(order))
    n = F.col("shard_size")
    wanted = F.least(F.col("quota") * BLOCK_WORDS, MAX_REPEATS * n)
    passes = F.when(n > 0, F.expr(f"least(quota * {BLOCK_WORDS}, {MAX_REPEATS} * shard_size) div shard_size")).otherwise(F.lit(0)).cast("long")
    width = F.when(n > 0, F.ceil(n / F.greatest(F.round(n / BLOCK_WORDS), F.lit(1)))).otherwise(F.lit(1)).cast("long")
    placed = placed.withColumns({"passes": passes, "first": F.col("end") - F.col("size"), "width": width}).withColumn("blocks", F.expr("(shard_size + width - 1) div width"))
    rest = F.least(F.col("blocks"), F.round((wanted - F.col("passes") * n) / F.col("width")).cast("long"))
    rest = F.when(F.col("passes") >= MAX_REPEATS, F.lit(0)).otherwise(rest).cast("long")
    phase = F.when(F.col("blocks") > 0, F.pmod(_seeded(seed + 2, F.col("source"), F.col("shard")), F.col("blocks"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumns({"quota_blocks": rest, "phase": phase})

    def chosen(x: str) -> str:
        """Words chosen before place x of the stream."""
        j = f"least({x} div width, blocks)"
        before = lambda k: f"(({k} * quota_blocks + phase) div blocks)"
        part = f"if({x} div width < blocks, ({before(f'({j} + 1)')} - {before(j)}) * ({x} % width), 0)"
        return f"if(blocks = 0, 0, {before(j)} * width + {part})"

    taken = F.expr(f"passes * size + {chosen('end')} - {chosen('first')}").cast("long")
    return placed.withColumn("taken", taken).drop("s_source", "q_source", "q_shard", "shards", "source_quota", "shard", "shard_size", "quota", "end")


def in_chosen(position: int, width: int, blocks: int, quota_blocks: int, phase: int) -> bool:
    """Whether the word at this place of its shard's stream is in a chosen block."""
    j = position // width
    return j < blocks and ((j + 1) * quota_blocks + phase) // blocks > (j * quota_blocks + phase) // blocks


DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as often as the mix takes them: once for every whole pass, and once more with the words of their chosen blocks, of which neighbours keep the white space between them."""
    for batch in batches:
        for part in slices(batch, "text"):
            pick, texts = [], []
            found = kernel.words(part.column("text"), fold=False)
            for i, r in enumerate(part.select(["text", "size", "taken", "passes", "first", "width", "blocks", "quota_blocks", "phase"]).to_pylist()):
                whole = r["passes"] if r["size"] else 0
                left = r["taken"] - whole * r["size"]
                pick += [i] * whole
                texts += [r["text"]] * whole
                if left == r["size"] > 0:
                    pick.append(i)
                    texts.append(r["text"])
                elif left > 0:
                    a, b = found.bounds[i], found.bounds[i + 1]
                    base = found.offsets[i]
                    data = found.data[base : found.offsets[i + 1]].tobytes()
                    runs: list[list[int]] = []
                    for k in range(r["size"]):
                        if in_chosen(r["first"] + k, r["width"], r["blocks"], r["quota_blocks"], r["phase"]):
                            if runs and runs[-1][1] == k:
                                runs[-1][1] = k + 1
                            else:
                                runs.append([k, k + 1])
                    starts, ends = found.starts[a:b] - base, found.ends[a:b] - base
                    pick.append(i)
                    texts.append("\n".join(data[starts[x] : ends[y - 1]].decode() for x, y in runs))
            rows = part.take(pa.array(pick, pa.int64()))
            texts_out = pa.array(texts, pa.string())
            sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), texts_out, rows.column("lang"), rows.column("source"), sizes], names=DOCUMENT)
