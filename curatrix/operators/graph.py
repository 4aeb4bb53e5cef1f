"""The graph of abstracts, authors and affiliations: neighbourhoods of fixed depth. Nothing recurses: a level is a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct n of edges (id, n) from nodes (id)."""
    return edges.join(nodes, "id", "left_semi").select(F.col("n").alias("id")).distinct()


class Graph:
    """abs_au: (a, u) and au_aff: (u, f), with prefixed ids."""

    def __init__(self, abs_au: DataFrame, au_aff: DataFrame):
        pair = lambda df, x, y: df.select(F.col(x).alias("id"), F.col(y).alias("n"))
        self.abs_of, self.au_of_abs = pair(abs_au, "u", "a"), pair(abs_au, "a", "u")
        self.aff_of, self.au_of_aff = pair(au_aff, "u", "f"), pair(au_aff, "f", "u")
        self.edges = abs_au.select(F.col("u").alias("src"), F.col("a").alias("dst")).union(au_aff.select("u", "f")).distinct()

    def visible(self, focal: str, level: int) -> DataFrame:
        """(id): the nodes visible from a focal node at level 1 to 4."""
        start = self.edges.sparkSession.range(1).select(F.lit(focal).alias("id"))
        abs_, au, aff = (lambda e: lambda n: _neighbours(n, e))(self.abs_of), None, (lambda e: lambda n: _neighbours(n, e))(self.aff_of)
        au_abs, au_aff = (lambda n: _neighbours(n, self.au_of_abs)), (lambda n: _neighbours(n, self.au_of_aff))
        if focal.startswith("u:"):
            own_abs, own_aff = abs_(start), aff(start)
            seen = start.union(own_abs).union(own_aff)
            co = au_abs(own_abs)
            steps = [lambda s: co, lambda s: au_aff(own_aff), lambda s: aff(co.where(F.col("id") != focal))]
        elif focal.startswith("a:"):
            authors = au_abs(start)
            seen = start.union(authors).union(aff(authors))
            steps = [lambda s: abs_(authors), lambda s: au_abs(s), lambda s: aff(s)]
        else:
            authors = au_aff(start)
            seen = start.union(authors)
            steps = [lambda s: abs_(authors).union(aff(authors)), lambda s: au_abs(s), lambda s: aff(s)]
        for step in steps[: level - 1]:
            seen = seen.union(step(seen.distinct()))
        return seen.distinct()

    def induced(self, nodes: DataFrame) -> DataFrame:
        """Edges whose ends are both among the nodes."""
        return self.edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
