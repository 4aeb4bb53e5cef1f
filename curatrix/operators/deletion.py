"""Deleting abstracts in full: triples with orphans, records, files, and what could not be found.

A table of reference counts (node, kind, n), the abstracts that refer to each person or organisation, is kept beside
the triples and changed by deltas: a deletion reads the references of the doomed abstracts and the counts of the nodes
they touch, and compares the two, in place of reading who else refers to them. As in a sequence of single deletions, a
node goes with the last abstract that refers to it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.operators import triples as T
from curatrix.session import cut

PERSON, ORGANISATION = "person", "organisation"
#: Predicates of abstracts by the kind of node that they refer to.
REFERENCES = {T.AUTHOR: PERSON, T.CONTACT: PERSON, T.SOURCE: ORGANISATION}
#: Warnings.
NO_RECORD, NO_FILE = "no record of that title", "no such file"


@dataclass
class Deleted:
    """What a deletion leaves and tells: triples, counts and records after it; nodes (node, kind, label) that went as orphans; records that went, with their abstract and the path of their file if there is one; warnings (s, warning, what)."""

    triples: DataFrame
    counts: DataFrame
    records: DataFrame
    orphans: DataFrame
    removed: DataFrame
    warnings: DataFrame


def references(triples: DataFrame) -> DataFrame:
    """(s, node, kind), once however many predicates of a kind an abstract uses.

    Triples don't repeat, so those of the first predicate of a kind are distinct as they are; what others say besides is added."""
    parts = []
    for kind in dict.fromkeys(REFERENCES.values()):
        predicates = [p for p, k in REFERENCES.items() if k == kind]
        first = (F.col("p") == predicates[0]) & (F.col("o_kind") == "uri")
        own = triples.where(F.col("p").isin(predicates) & (F.col("o_kind") != "literal"))
        main = own.where(first).select("s", F.col("o").alias("node"))
        more = own.where(~first).select("s", F.col("o").alias("node")).distinct().join(main, ["s", "node"], "left_anti")
        parts.append(main.union(more).select("s", "node", F.lit(kind).alias("kind")))
    return reduce(DataFrame.union, parts)


def counted(refs: DataFrame) -> DataFrame:
    """(node, kind, n) of references."""
    return refs.groupBy("node", "kind").agg(F.count("*").alias("n"))


def changed(counts: DataFrame, added: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """Counts after references (s, node, kind) came and others went; nodes without one leave the table."""
    out = counts
    for refs, sign in ((added, 1), (gone, -1)):
        if refs is not None:
            out = out.unionByName(counted(refs).withColumn("n", F.col("n") * sign))
    return out.groupBy("node", "kind").agg(F.sum("n").alias("n")).where("n > 0")


def _labels(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (s, ...) with title: their title, else their label, else their local name."""
    own = triples.where(F.col("p").isin("dct:title", T.LABEL)).join(nodes.select("s").distinct(), "s", "left_semi")
    best = own.groupBy("s").agg(F.min(F.struct((F.col("p") != "dct:title").alias("second"), "o")).alias("best"))
    return nodes.join(best, "s", "left").withColumn("title", F.coalesce("best.o", F.regexp_extract("s", "([^/#:]*)$", 1))).drop("best")


def preview(triples: DataFrame, counts: DataFrame, doomed: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """(node, kind, label) that would go with the doomed abstracts (s): all their references come from these. lost: their references, if they are known."""
    touched = counted(lost if lost is not None else references(triples).join(doomed.select("s"), "s", "left_semi"))
    gone = touched.join(counts.withColumnRenamed("n", "all"), ["node", "kind"]).where(F.col("n") >= F.col("all"))
    return _labels(triples, gone.select(F.col("node").alias("s"), "kind")).select(F.col("s").alias("node"), "kind", F.col("title").alias("label"))


def delete_abstracts(triples: DataFrame, counts: DataFrame, records: DataFrame, files: DataFrame, doomed: DataFrame) -> Deleted:
    """The deletion of abstracts (s) from triples, counts, records (file_title, `dct:title`, ord) and a listing (path, file_title).

    Every abstract takes the first record of its title that no earlier one has taken; abstracts go in order of their
    addresses. A record whose file is not listed, and an abstract without a record, give a warning."""
    doomed = cut(doomed.select("s").distinct())
    lost = cut(references(triples).join(doomed, "s", "left_semi"))
    orphans = cut(preview(triples, counts, doomed, lost))
    gone = cut(doomed.select(F.col("s").alias("node")).union(orphans.select("node")).distinct())
    left = T.without(triples, gone)

    nth = lambda order: F.row_number().over(Window.partitionBy("title").orderBy(order)).alias("nth")
    asked = _labels(triples, doomed).select("s", "title", nth("s"))
    titles = asked.select("title").distinct()
    held = records.select(F.coalesce("dct:title", F.lit("")).alias("title"), "file_title", "ord").join(titles, "title", "left_semi")
    held = held.select("title", "file_title", "ord", nth("ord"))
    taken = cut(asked.join(held, ["title", "nth"], "left").join(files.groupBy("file_title").agg(F.min("path").alias("path")), "file_title", "left"))
    removed = taken.where("ord is not null").select("s", "file_title", "ord", "path")
    warning = F.when(F.col("ord").isNull(), F.lit(NO_RECORD)).when((F.col("file_title") != "") & F.col("path").isNull(), F.lit(NO_FILE))
    warnings = taken.select("s", warning.alias("warning"), F.when(F.col("ord").isNull(), F.col("title")).otherwise(F.col("file_title")).alias("what")).where("warning is not null")
    return Deleted(left, changed(counts, gone=lost), records.join(removed.select("ord"), "ord", "left_anti").select(records.columns), orphans, removed, warnings)


def nodes_of_files(files: DataFrame, records: DataFrame, triples: DataFrame) -> DataFrame:
    """(file_title, title, s, state) of every listed file: its first record by `ord`, that record's abstract of least address by title, and found, not in dataset or not in triples."""
    firsts = records.groupBy("file_title").agg(F.min_by(F.coalesce("dct:title", F.lit("")), "ord").alias("title"))
    abstracts = _labels(triples, T.nodes_of(triples, T.ABSTRACT)).groupBy("title").agg(F.min("s").alias("s"))
    met = files.select("file_title").distinct().join(firsts, "file_title", "left").join(abstracts, "title", "left")
    state = F.when(F.col("title").isNull(), "not in dataset").when(F.col("s").isNull(), "not in triples").otherwise("found")
    return met.select("file_title", "title", "s", state.alias("state"))
