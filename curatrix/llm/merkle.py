"""A Merkle manifest of a dataset: one tree per group of rows, a tree of the groups' roots above, and a proof for every row.

Rows are numbered in their group, the number divided by the fan-out names the parent, and the sorted children of a
parent are hashed into it, level by level, each level a written table of a sixteenth of the rows below. Proofs go down
the same tables: a join per level gives each child the path of its parent and its own siblings, so a path that many
rows have in common travels once for each parent and not once for each row. Nothing but the tree's height reaches the
driver, and no group meets in one task: rows are dealt by ranges of group and order, numbered inside of a range and
moved by the counts of the ranges before.

A digest is the lower-case hex SHA-256 of its concatenated inputs; digests enter as hex text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import cut, release

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value that can't be taken for another beside its neighbours: its UTF-8 byte count, a colon and the value; a null is a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*map(encoded, values))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (g, salt, order...) with i, the place from 0 in their g by the order, and n, the rows of that g. The salt spreads rows that are equal in all of the order, between which any order is the same."""
    dealt = cut(rows.repartitionByRange("g", *order, "salt").drop("salt").withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("g")
    before = F.sum("count").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("g", "part").count().select("g", "part", F.coalesce(before, F.lit(0)).alias("start"), F.sum("count").over(whole).alias("n"))
    own = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)).cast("long")
    placed = dealt.withColumn("own", own).join(starts, ["g", "part"])
    return placed.withColumn("i", F.col("start") + F.col("own") - 1).drop("part", "own", "start")


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["hash"]), "")


def tree(leaves: DataFrame, *extra: str) -> tuple[list[DataFrame], DataFrame | None]:
    """(levels, tops) of leaves (g, i, n, hash, extra...).

    A level is a written table of parents (g, up, n, kids), kids in order; tops (g, level, hash) has what remains of each
    g and the level it stands on. A g of one leaf has that leaf for its top. Without leaves there is no level."""
    levels: list[DataFrame] = []
    tops: list[DataFrame] = []
    nodes = leaves
    while True:
        columns = ["i", "hash", *(extra if not levels else ())]
        kids = F.sort_array(F.collect_list(F.struct(*columns))).alias("kids")
        level = cut(nodes.groupBy("g", F.expr(f"i div {FANOUT}").alias("up"), "n").agg(kids))
        most = level.agg(F.max("n")).first()[0]
        if most is None:
            return [], None
        levels.append(level)
        hashed = F.when(F.col("n") == 1, F.col("kids")[0]["hash"]).otherwise(digest(_joined(F.col("kids"))))
        above = level.select("g", F.col("up").alias("i"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), hashed.alias("hash"))
        tops.append(above.where("n = 1").select("g", F.lit(len(levels)).alias("level"), "hash"))
        if most <= FANOUT:
            return levels, reduce(DataFrame.unionByName, tops)
        nodes = above.where("n > 1")


def paths(levels: list[DataFrame], tops: DataFrame, above: DataFrame) -> DataFrame:
    """(g, kid, path, and the columns of above) of every leaf, from above (g, path, ...): what leads from the tops on.

    A path lists (before, after), the joined siblings on either side, from the leaf upwards."""
    carried = [c for c in above.columns if c not in ("g", "path")]
    nodes = None
    for k in reversed(range(len(levels))):
        own = tops.where(F.col("level") == k + 1).join(above, "g").select("g", F.lit(0).cast("long").alias("up"), "path", *carried)
        nodes = own if nodes is None else own.unionByName(nodes.select("g", F.col("kid.i").alias("up"), "path", *carried))
        met = levels[k].join(nodes, ["g", "up"]).select("g", "n", "kids", "path", *carried, F.posexplode("kids").alias("at", "kid"))
        step = F.struct(_joined(F.slice("kids", F.lit(1), F.col("at"))).alias("before"), _joined(F.slice("kids", F.col("at") + 2, F.lit(FANOUT))).alias("after"))
        nodes = met.select("g", "kid", F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(step), "path")).alias("path"), *carried)
    return nodes


def folded(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf_hash, lambda h, step: digest(step["before"], h, step["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf upwards and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(rows: DataFrame, group: str, key: str, *extra: str) -> DataFrame:
    """(key, leaf, extra..., subroot, root, path), a row for every row of rows (group, key, leaf, extra...).

    Groups are ordered by UTF-8 bytes and a null group comes first; inside a group rows go by key, null keys first, and
    repeated keys by leaf. Repeated rows are leaves of their own. An empty table gives no rows."""
    g = F.coalesce(F.concat(F.lit("1"), F.col(group)), F.lit("0")).alias("g")
    dealt = cut(rows.select(g, F.col(key).alias("key"), F.col("leaf").alias("hash"), *extra, F.rand(12).alias("salt")))
    levels, tops = tree(numbered(dealt, "key", "hash"), "key", *extra)
    columns = [F.col("kid.key").alias(key), F.col("kid.hash").alias("leaf"), *[F.col(f"kid.{c}").alias(c) for c in extra], "subroot", "root", "path"]
    step = "array<struct<before: string, after: string>>"
    if tops is None:
        kinds = dict(rows.dtypes)
        return rows.sparkSession.createDataFrame([], f"{key} {kinds[key]}, leaf string, " + "".join(f"{c} {kinds[c]}, " for c in extra) + f"subroot string, root string, path {step}")
    release(dealt)
    tops = cut(tops)
    ranked = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("key"), "hash", F.lit(0.0).alias("salt")), "key")
    upper, roots = tree(ranked, "key")
    start = roots.select("g", F.array().cast(step).alias("path"), F.col("hash").alias("root"))
    over = cut(paths(upper, roots, start).select(F.col("kid.key").alias("g"), F.col("kid.hash").alias("subroot"), "root", "path"))
    return paths(levels, tops, over).select(*columns)


def proved(docs: DataFrame, altered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, where the text of each row is checked as `altered` gives it.

    Leaves are digests of doc_id, source, lang, n_chars and the whole text. A null in any of them is told from an empty
    text; texts of any length count whole; repeated rows are leaves of their own; an empty table gives no rows. Other
    columns are not read."""
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text", altered.alias("altered"))
    own, other = leaf(*map(F.col, FIELDS)), leaf(*map(F.col, FIELDS[:-1]), F.col("altered"))
    # A row that is checked as it is needs no second digest.
    leaves = doc.select("doc_id", "source", own.alias("leaf"), F.when(~F.col("altered").eqNullSafe(F.col("text")), other).alias("other"))
    found = manifest(leaves, "source", "doc_id", "other")
    out = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
