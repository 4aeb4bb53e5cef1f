"""Registry matching, guarded merges and leader clustering.

Fuzzy joins run on distinct strings, after equal ones have met by an ordinary join. Candidates come from an inverted
index of rare letters or pairs of letters, or from blocks whose bounds order them (`nameindex`); no nested loop forms
all pairs. Only `facing`, for callers that ask for all pairs of two small tables, does: it broadcasts a side of at most
BROADCAST_ROWS counted rows, and beyond that deals both sides into blocks that meet once each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.operators import nameindex
from curatrix.session import cut

HIGH, LOW = 0.95, 0.70
MERGE, GUARD, ORGANISATION = 0.72, 0.72, 0.85
#: From this similarity on a name is looked up by its rare parts; the fewer letters must agree, the more names share one.
NEAR = 0.8
BROADCAST_ROWS = 20_000
Similarity = Callable[[Column, Column], Column]


def registry_long(registry: DataFrame, canonical: str, variant: str | None = None, place: str | None = None) -> DataFrame:
    """(candidate, canonical, ord) of every canonical and its variants. ord orders candidates: canonicals in code point order, each before its variants in their places."""
    own = registry.select(F.col(canonical).alias("canonical")).where("canonical is not null").distinct()
    at = lambda x: F.struct(F.col("canonical").alias("name"), x.cast("int").alias("place")).alias("ord")
    rows = own.select(F.col("canonical").alias("candidate"), "canonical", at(F.lit(-1)))
    if variant:
        named = registry.select(F.col(variant).alias("candidate"), F.col(canonical).alias("canonical"), (F.col(place) if place else F.lit(0)).alias("at"))
        rows = rows.union(named.where("candidate is not null and canonical is not null").select("candidate", "canonical", at(F.col("at"))))
    return rows


def facing(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Pairs of rows that meet a condition; the right side is broadcast only if it was counted to be small."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), condition)
    n = 64
    spread = left.select("*", F.pmod(F.xxhash64(*left.columns), F.lit(n)).alias("_block"))
    copied = right.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread.join(copied.withColumnRenamed("_block", "_other"), (F.col("_block") == F.col("_other")) & condition).drop("_block", "_other")


def names_of(raws: DataFrame) -> DataFrame:
    return raws.select("raw").where("raw is not null").distinct()


def best_match(pairs: DataFrame) -> DataFrame:
    """(raw, canonical, score, ord): the highest score, the first candidate in registry order on ties."""
    best = F.min_by(F.struct("canonical", "score", "ord"), F.struct((-F.col("score")).alias("down"), "ord"))
    return pairs.groupBy("raw").agg(best.alias("b")).select("raw", "b.*")


def indexed(names: DataFrame, registry: DataFrame, threshold: float, similarity: Similarity = text.ratio) -> DataFrame:
    """(raw, candidate, canonical, ord, score) of the pairs that reach a threshold, by the index."""
    pairs = nameindex.alike(names.select(F.col("raw").alias("name")), registry.select(F.col("candidate").alias("name")).distinct(), threshold, similarity)
    return pairs.toDF("raw", "candidate", "score").join(registry, "candidate")


def match(raws: DataFrame, registry: DataFrame, similarity: Similarity = text.ratio, low: float = LOW, below: bool = True) -> DataFrame:
    """(raw, canonical, score): for each name the best of all candidates, as if it had met every one; those below `low` only if `below`.

    Names equal to a candidate apart from case score 1 without comparison. The others look for candidates from NEAR on in
    the index; those that find none there are compared in blocks, by bounds. An empty registry gives no rows."""
    registry = cut(registry)
    names = names_of(raws)
    known = registry.select(F.lower("candidate").alias("key"), "canonical", "ord").groupBy("key").agg(F.min_by(F.struct("canonical", "ord"), "ord").alias("b"))
    exact = names.join(known, F.lower("raw") == F.col("key")).select("raw", "b.canonical", F.lit(1.0).alias("score"), "b.ord")
    found, others = exact, cut(names.join(exact.select("raw"), "raw", "left_anti"))
    if low < NEAR:
        near = cut(best_match(indexed(others, registry, NEAR, similarity)))
        found, others = exact.unionByName(near), cut(others.join(near.select("raw"), "raw", "left_anti"))
    rest = best_match(nameindex.nearest(others, registry, similarity, 0.0 if below else low))
    return found.unionByName(rest).select("raw", "canonical", "score")


def decided(matches: DataFrame, high: float = HIGH, low: float = LOW) -> DataFrame:
    """Adds decision; a new name has no canonical."""
    decision = F.when(F.col("score") >= high, "auto_existing").when(F.col("score") < low, "auto_new").otherwise("pending")
    return matches.withColumn("decision", decision).withColumn("canonical", F.when(decision != "auto_new", F.col("canonical"))).withColumn("score", F.round("score", 4))


def guarded_merge(raws: DataFrame, registry: DataFrame, similarity: Similarity = text.ratio, threshold: float = MERGE, guard: float = GUARD, separator: str = ",") -> DataFrame:
    """(raw, canonical, method, score): names to merge into a canonical whose whole and whose first component are both alike, and whose address differs.

    A name that is a canonical stays. One that is a variant goes to its canonical if the two are alike, also when that
    means to stay at the same address; the others, and variants that aren't alike, go to the most alike canonical."""
    first = lambda c: F.trim(F.substring_index(c, separator, 1))
    alike = lambda c: similarity(first(F.col("raw")), first(F.col(c))) >= guard
    own = registry.where("candidate = canonical").select("candidate", "canonical", "ord").distinct()
    names = names_of(raws).where("raw <> ''").join(own.select(F.col("canonical").alias("raw")), "raw", "left_anti")
    variants = registry.where("candidate <> canonical").groupBy(F.col("candidate").alias("raw")).agg(F.max_by("canonical", "ord").alias("canonical"))
    known = names.join(variants, "raw").withColumn("score", similarity(F.col("raw"), F.col("canonical")))
    known = cut(known.where((F.col("score") >= threshold) & alike("canonical")).select("raw", "canonical", F.lit("variant-exact").alias("method"), "score"))
    pairs = indexed(names.join(known, "raw", "left_anti"), own, threshold, similarity)
    best = best_match(pairs.where(alike("candidate")))
    merges = known.unionByName(best.select("raw", "canonical", F.lit("fuzzy").alias("method"), "score"))
    return merges.where(text.name_to_uri(F.col("raw")) != text.name_to_uri(F.col("canonical"))).withColumn("score", F.round("score", 4))


def _held(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) of distinct names (name) of which the first, not empty, stands in the second apart from case; they meet on the rarest pair of letters of the first, or on its one letter."""
    low = F.lower("name")
    pairs = lambda x: F.when(F.length(x) == 1, F.array(x)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substr(x, i, F.lit(2)))))
    letters = lambda x: F.array_distinct(F.split(x, ""))
    grams = outer.where("name <> ''").select(F.col("name").alias("outer"), F.explode(F.array_union(pairs(low), letters(low))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = inner.where("name <> ''").select(F.col("name").alias("inner"), F.explode(pairs(low)).alias("gram"))
    rarest = own.join(counts, "gram").groupBy("inner").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rarest.join(grams, "gram").where(F.contains(F.lower("outer"), F.lower("inner"))).select("inner", "outer")


def organisation_match(raws: DataFrame, registry: DataFrame, similarity: Similarity = text.ratio, threshold: float = ORGANISATION) -> DataFrame:
    """(raw, canonical, score): equal apart from case 1, containment either way 0.9, else the similarity. An empty name stands in every candidate, so it has the first.

    Equal names and names that hold each other meet on a rare pair of letters, like ones by the index; no other pair is formed."""
    registry = cut(registry)
    names = names_of(raws)
    left, right = names.select(F.col("raw").alias("name")), registry.select(F.col("candidate").alias("name")).distinct()
    inside = _held(left, right).toDF("raw", "candidate").union(_held(right, left).select("outer", "inner"))
    told = inside.distinct().withColumn("score", F.when(F.lower("raw") == F.lower("candidate"), F.lit(1.0)).otherwise(F.lit(0.9)))
    near = nameindex.alike(left, right, threshold, similarity).toDF("raw", "candidate", "score").join(told.select("raw", "candidate"), ["raw", "candidate"], "left_anti")
    pairs = told.where(F.col("score") >= threshold).unionByName(near).join(registry, "candidate")
    first = registry.orderBy("ord").limit(1).select("candidate", "canonical", "ord").withColumn("score", F.lit(0.9)).where(F.col("score") >= threshold)
    empty = names.where("raw = ''").withColumn("_one", F.lit(1)).join(first.withColumn("_one", F.lit(1)), "_one").drop("_one")
    best = best_match(pairs.unionByName(empty.select(pairs.columns)))
    return best.select("raw", "canonical", F.round("score", 4).alias("score"))


def affiliated(raws: DataFrame, known: DataFrame, similarity: Similarity = text.ratio, threshold: float = ORGANISATION) -> DataFrame:
    """(raw, matched, name, address, confidence) of each distinct name against a list (key, name, address): the list's name and address of the best hit, the least name on ties; a name without a hit stays as it is at 0."""
    registry = registry_long(known, "key")
    best = organisation_match(raws, registry, similarity, threshold).select("raw", F.col("canonical").alias("key"), "score")
    met = names_of(raws).join(best.join(known, "key"), "raw", "left")
    hit = F.col("score").isNotNull()
    return met.select("raw", hit.alias("matched"), F.coalesce("name", "raw").alias("name"), "address", F.coalesce("score", F.lit(0.0)).alias("confidence"))


def leader_clusters(names: DataFrame, threshold: float = LOW) -> DataFrame:
    """(leader, member) from (name, ord): in order each unassigned name leads and takes all later unassigned names whose ratio to it reaches threshold.

    A name leads as soon as none of the earlier names that it is like can still lead, and belongs to the first leader
    among them. So every round decides many names at once, wherever they stand: the sweep is rounds of joins over the
    open links. A name given twice counts at its least ord; null names count not at all."""
    names = cut(names.where("name is not null").groupBy("name").agg(F.min("ord").alias("ord")))
    met = nameindex.met(names.select("name"), names.select("name"), threshold)
    for side in ("a", "b"):
        met = met.join(names.select(F.col("name").alias(side), F.col("ord").alias(f"{side}o")), side)
    links = cut(met.where("ao < bo").where(text.ratio(F.col("a"), F.col("b")) >= threshold).select("a", "ao", "b"))
    open_names, open_links, leaders = names.select("name"), links, []
    while True:
        heads = cut(open_names.join(open_links.select(F.col("b").alias("name")), "name", "left_anti"))
        leaders.append(heads)
        led = open_links.join(heads.withColumnRenamed("name", "a"), "a", "left_semi").select(F.col("b").alias("name")).distinct()
        gone = cut(heads.union(led))
        open_names = cut(open_names.join(gone, "name", "left_anti"))
        if open_names.isEmpty():
            break
        # A name that was taken never leads, so its links fall away with it.
        open_links = cut(open_links.join(gone.withColumnRenamed("name", "a"), "a", "left_anti").join(gone.withColumnRenamed("name", "b"), "b", "left_anti"))
    heads = reduce(DataFrame.union, leaders)
    taken = links.join(heads.withColumnRenamed("name", "a"), "a", "left_semi").groupBy(F.col("b").alias("member")).agg(F.min_by("a", F.struct("ao", "a")).alias("leader"))
    return heads.select(F.col("name").alias("leader"), F.col("name").alias("member")).unionByName(taken)
