"""Fuzzy search: a query matches a text if it comes close to some part of it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from curatrix.functions import text
from curatrix.operators import triples

# The largest share of a query that may be edited, and the lengths of result lists.
FUZZY, RATIO = 0.35, 0.3
SUGGESTIONS, NODES, TRIPLES = 6, 10, 30
FIELDS = {"all": ("title", "authors", "affiliations"), "title": ("title",), "author": ("authors",), "affiliation": ("affiliations",)}


def substring_distance(pattern: str, where: str) -> int:
    """Least edit distance between the pattern and any part of a text, by bit vectors of the pattern's length (Myers 1999)."""
    m, places = len(pattern), {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1) if m else 0
    plus, minus, here = full, 0, m
    least = m
    for c in where if m else "":
        same = places.get(c, 0)
        level = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | (full & ~(level | plus)), plus & level
        here += bool(up & top) - bool(down & top)
        least = min(least, here)
        up, down = (up << 1) & full, (down << 1) & full
        diagonal = same | minus
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return least


def fuzzy_score(query: str) -> Callable[[Column], Column]:
    """Of an array of texts: the least share of the query's letters that must change for it to lie in one of them; null if there is none."""
    wanted = query.strip().lower()

    @F.pandas_udf(DoubleType())
    def score(values: pd.Series) -> pd.Series:
        found = []
        for row in values:
            own = [substring_distance(wanted, v.lower()) for v in row if v] if row is not None else []
            found.append(min(own) / len(wanted) if own else None)
        return pd.Series(found, dtype="float64")

    return score


def needed_grams(query: str, threshold: float) -> tuple[dict[str, int], int]:
    """(pairs of neighbouring letters of a query with how often each occurs, how many of these places any text within the threshold holds): an edit spoils two places at most."""
    wanted = query.strip().lower()
    grams: dict[str, int] = {}
    for i in range(len(wanted) - 1):
        grams[wanted[i : i + 2]] = grams.get(wanted[i : i + 2], 0) + 1
    return grams, len(wanted) - 1 - 2 * int(threshold * len(wanted) + 1e-9)


def _may_match(query: str, threshold: float) -> Callable[[Column], Column]:
    """Whether an array of texts has one with enough of the query's pairs of letters, which the rest need not be compared for."""
    grams, need = needed_grams(query, threshold)
    if need <= 0:
        return lambda values: F.lit(True)

    def enough(value: Column) -> Column:
        held = [F.contains(F.lower(value), F.lit(g)).cast("int") * n for g, n in grams.items()]
        return sum(held[1:], held[0]) >= need

    return lambda values: F.exists(values, enough)


def _texts(entries: DataFrame, mode: str) -> Column:
    kinds = dict(entries.dtypes)
    return F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) if kinds[c].startswith("array") else F.array(F.col(c).cast("string")) for c in FIELDS[mode]])


def gram_index(entries: DataFrame, key: str, mode: str = "all") -> DataFrame:
    """(gram, key): which entries hold which pairs of neighbouring letters in a field; written by gram once, it answers any number of queries."""
    letters = F.explode(F.array_distinct(F.filter(_texts(entries, mode), lambda v: v.isNotNull()))).alias("value")
    rows = entries.select(key, letters).select(key, F.lower("value").alias("value")).where("length(value) > 1")
    grams = F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substr(F.col("value"), i, F.lit(2)))
    return rows.select(F.explode(F.array_distinct(grams)).alias("gram"), key).distinct()


def indexed_search(entries: DataFrame, index: DataFrame, key: str, query: str, mode: str = "all", threshold: float = FUZZY) -> DataFrame:
    """As fuzzy_search, but only entries that the index (gram, key) gives enough pairs of letters for are read further; keys are unique. A query too short to need a pair reads all."""
    grams, need = needed_grams(query, threshold)
    if not query.strip() or need <= 0:
        return fuzzy_search(entries, query, mode, threshold)
    weight = F.element_at(F.create_map(*[F.lit(x) for g, n in grams.items() for x in (g, n)]), F.col("gram"))
    near = index.where(F.col("gram").isin(*grams)).groupBy(key).agg(F.sum(weight).alias("held")).where(F.col("held") >= need)
    return fuzzy_search(entries.join(near.select(key), key, "left_semi"), query, mode, threshold)


def fuzzy_search(entries: DataFrame, query: str, mode: str = "all", threshold: float = FUZZY) -> DataFrame:
    """Entries with a field near the query and their score, best first is score order; a blank query keeps all at score 0.

    Fields that aren't arrays count as one text. A map over rows: nothing is shuffled, and only entries that hold enough
    of the query's pairs of letters are compared."""
    if not query.strip():
        return entries.withColumn("score", F.lit(0.0))
    texts = _texts(entries, mode)
    return entries.where(_may_match(query, threshold)(texts)).withColumn("score", fuzzy_score(query)(texts)).where(F.col("score") <= threshold)


def suggestions(nodes: DataFrame, query: str, n: int = SUGGESTIONS) -> DataFrame:
    """The nearest nodes (id, label) to a query, best first, ties by id."""
    label = F.array("label")
    near = nodes.where(_may_match(query, FUZZY)(label)).withColumn("score", fuzzy_score(query)(label)).where(F.col("score") <= FUZZY)
    return near.orderBy("score", "id").limit(n)


def node_search(nodes: DataFrame, query: str, n: int = NODES, threshold: float = RATIO, contained: bool = False) -> DataFrame:
    """The best nodes (id, label) by similarity to a query. A label that holds the query stays at any similarity, and scores 1 if `contained`. A blank query finds nothing."""
    if not query.strip():
        return nodes.where(F.lit(False)).withColumn("score", F.lit(0.0))
    wanted = F.lit(query.strip().lower())
    holds, alike = F.contains(F.lower("label"), wanted), text.ratio(wanted, F.col("label"))
    scored = nodes.withColumn("score", F.greatest(alike, holds.cast("double")) if contained else alike)
    return scored.where((F.col("score") >= threshold) | F.contains(F.lower("label"), wanted)).orderBy(F.desc("score"), "id").limit(n)


#: Predicates that lead from an abstract to the nodes whose labels a mode searches; titles are its own.
MODES = {"title": None, "author": triples.AUTHOR, "affiliation": triples.SOURCE}


def _alike(query: str, name: Column) -> Column:
    """Similarity of a name to a query, 1 if it holds it."""
    wanted = F.lit(query.strip().lower())
    return F.greatest(text.ratio(wanted, name), F.contains(F.lower(name), wanted).cast("double"))


def abstract_search(t: DataFrame, query: str, mode: str = "title", n: int = TRIPLES, threshold: float = RATIO) -> DataFrame:
    """(s, title, score): the best abstracts by title, or by their likest author or organisation; ties by address. A blank query finds nothing.

    Distinct names are scored once, and only names that reach the threshold are joined to abstracts."""
    abstracts, labels = triples.nodes_of(t, triples.ABSTRACT), triples.titles(t)
    if not query.strip():
        return labels.where(F.lit(False)).select("s", "title", F.lit(0.0).alias("score"))
    owners = labels.join(abstracts, "s", "left_semi")
    link = MODES[mode]
    if link:
        links = t.where(F.col("p") == link).select("s", F.col("o").alias("node"))
        named = labels.withColumnRenamed("s", "node").join(links.select("node").distinct(), "node", "left_semi").withColumnRenamed("title", "name")
    else:
        named = owners.select("s", F.col("title").alias("name"))
    good = named.select("name").distinct().withColumn("score", _alike(query, F.col("name"))).where(F.col("score") >= threshold)
    best = named.join(good, "name")
    if link:
        best = links.join(best.select("node", "score"), "node")
    return best.groupBy("s").agg(F.max("score").alias("score")).join(owners, "s").select("s", "title", "score").orderBy(F.desc("score"), "s").limit(n)


def graph_search(t: DataFrame, query: str, kind: str, prop: str, n: int = NODES, threshold: float = RATIO) -> DataFrame:
    """(s, name, score): the best nodes of a class by the similarity of their property and label together; a text that holds the query stays at any similarity. Name is the property, else the label."""
    wanted = query.lower()
    own = t.where(F.col("p").isin(prop, triples.LABEL)).join(triples.nodes_of(t, kind), "s", "left_semi").groupBy("s").agg(*[F.coalesce(F.min(F.when(F.col("p") == p, F.col("o"))), F.lit("")).alias(c) for p, c in ((prop, "title"), (triples.LABEL, "label"))])
    rows = own.where("title <> '' or label <> ''").withColumn("both", F.concat_ws(" ", "title", "label"))
    scored = rows.select("both").distinct().withColumn("score", text.ratio(F.lit(wanted), F.col("both"))).where((F.col("score") >= threshold) | F.contains(F.lower("both"), F.lit(wanted)))
    name = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("label"))
    return rows.join(scored, "both").select("s", name.alias("name"), "score").orderBy(F.desc("score"), "s").limit(n)
