"""Decisions, stores and their edits. A store is a DataFrame; every edit returns a new one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions import text
from curatrix.operators import matching

STAGING = ("_status", "_aff_decisions", "_raw_affiliations")


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by partial aggregation rather than a window."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), F.col(order)).alias("r")).select("r.*")


def last_of(df: DataFrame, *keys: str, at: str | None = None) -> DataFrame:
    """One row for each value of the keys: the last by column `at`, without which rows that repeat keys are taken by all of their columns."""
    order = F.struct(*[c for c in ([at] if at else []) + df.columns if c not in keys and "map<" not in dict(df.dtypes)[c]])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def decided_value(decision: Column, raw: Column, matched: Column, new: Column) -> Column:
    """What a decision makes of a raw name; without one it stays."""
    return F.when(decision.isin("existing", "auto_existing"), F.coalesce(matched, raw)).when(decision.isin("new", "auto_new"), F.coalesce(new, raw)).otherwise(raw)


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows (author, raw, ...) with value; of several decisions on a pair the last by ord holds."""
    last = decisions.groupBy("author", "raw").agg(F.max_by(F.struct("decision", "matched_canonical", "new_canonical"), "ord").alias("d"))
    joined = rows.join(last, ["author", "raw"], "left")
    return joined.withColumn("value", decided_value(F.col("d.decision"), F.col("raw"), F.col("d.matched_canonical"), F.col("d.new_canonical"))).drop("d")


def existing(candidates: DataFrame, *stores: DataFrame, key: str) -> DataFrame:
    """Candidates whose key some store holds."""
    out = None
    for store in stores:
        part = candidates.join(store.select(key), key, "left_semi")
        out = part if out is None else out.union(part)
    return out.distinct()


def duplicates(candidates: DataFrame, *stores: DataFrame) -> DataFrame:
    """Candidates (file_title, `dct:title`, ...) that some store holds, with why: file, or title if that is alike apart from case and outer spaces. An empty title is no reason."""
    title = text.normalise(F.coalesce("dct:title", F.lit("")))
    held = [s.select("file_title", title.alias("_title")) for s in stores]
    every = reduce(DataFrame.union, held)
    files = every.select("file_title").distinct().withColumn("_file", F.lit(True))
    titles = every.select("_title").where("_title <> ''").distinct().withColumn("_named", F.lit(True))
    met = candidates.withColumn("_title", title).join(files, "file_title", "left").join(titles, "_title", "left")
    why = F.when(F.col("_file"), F.lit("file")).when(F.col("_named"), F.lit("title"))
    return met.withColumn("why", why).where("why is not null").select(*candidates.columns, "why")


def unseen(candidates: DataFrame, *stores: DataFrame, key: str) -> DataFrame:
    """Candidates whose key no store holds."""
    for store in stores:
        candidates = candidates.join(store.select(key), key, "left_anti")
    return candidates


def approve(staged: DataFrame, approved: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(approved, staged) after rows with these keys move; staging fields go, an error note stays."""
    moved = staged.join(keys, key, "left_semi").drop(*STAGING)
    return approved.unionByName(moved, allowMissingColumns=True), staged.join(keys, key, "left_anti")


def approve_reviewed(staged: DataFrame, approved: DataFrame, decisions: DataFrame, registry: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(approved, staged, registry) after records (key, authors, ...) with these keys move.

    Their decisions (key, author, raw, decision, matched_canonical, new_canonical, ord) put the decided names in place
    of the raw ones and enter the registry of pairs (canonical, variant), where a canonical without variants has a null."""
    keys = staged.join(keys, key, "left_semi").select(key)
    taken = decisions.join(keys, key, "left_semi").where("raw is not null and raw <> ''")
    last = taken.groupBy(key, "author", "raw").agg(F.max_by(F.struct("decision", "matched_canonical", "new_canonical"), "ord").alias("d"))
    value = decided_value(F.col("d.decision"), F.col("raw"), F.nullif("d.matched_canonical", F.lit("")), F.nullif("d.new_canonical", F.lit("")))
    names = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("author", "raw").alias("k"), value.alias("v")))).alias("names"))
    moved = staged.join(keys, key, "left_semi").join(names, key, "left")
    renamed = lambda a: a.withField("affiliations", F.transform(a["affiliations"], lambda x: F.coalesce(F.try_element_at("names", F.struct(a["name"].alias("author"), x.alias("raw"))), x)))
    moved = moved.withColumn("authors", F.transform("authors", renamed)).drop("names", *STAGING)
    settled = last.withColumn("canonical", value).where(F.col("d.decision").isin("existing", "auto_existing", "new", "auto_new"))
    new = F.col("d.decision").isin("new", "auto_new")
    pairs = settled.select("canonical", F.when(F.col("canonical") != F.col("raw"), F.col("raw")).alias("variant"), new.alias("new")).where("variant is not null or new")
    known = registry.select("canonical").distinct()
    bare = pairs.where("variant is null").select("canonical").distinct().join(known, "canonical", "left_anti").join(pairs.where("variant is not null").select("canonical"), "canonical", "left_anti")
    grown = registry_upsert(registry, pairs.where("variant is not null").select("canonical", "variant")).unionByName(bare.select("canonical", F.lit(None).cast("string").alias("variant")))
    return approved.unionByName(moved, allowMissingColumns=True), staged.join(keys, key, "left_anti"), grown


def save(store: DataFrame, edits: DataFrame, key: str, order: str | None = None, at: str | None = None) -> DataFrame:
    """The first row of each edited key, by `order`, takes the edit, new keys are appended; without an order keys are unique. Of several edits of a key the last by `at` holds."""
    edits = last_of(edits, key, at=at).select(edits.columns if at is None or at in store.columns else [c for c in edits.columns if c != at])
    if order is None:
        return store.join(edits.select(key), key, "left_anti").unionByName(edits)
    firsts = store.join(edits.select(key), key, "left_semi").groupBy(key).agg(F.min(order).alias(order))
    others = store.join(firsts, [key, order], "left_anti")
    return others.unionByName(edits.drop(order).join(firsts, key, "left").select(store.columns)).select(store.columns)


def remove_author(records: DataFrame, decisions: DataFrame, removed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, decisions) without the authors (key, author, place): the one at that place of the list goes, and with it every decision of that name."""
    gone = removed.groupBy(key).agg(F.collect_set(F.col("place").cast("int")).alias("_places"))
    kept = records.join(gone, key, "left").withColumn("authors", F.filter("authors", lambda a, i: ~F.coalesce(F.array_contains("_places", i), F.lit(False)))).drop("_places")
    return kept, decisions.join(removed.select(key, "author").distinct(), [key, "author"], "left_anti")


def rename_author(records: DataFrame, decisions: DataFrame, renamed: DataFrame, key: str, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, decisions) after renames (key, author, place, name): the author at that place, and every decision of the old name, also a namesake's. Of several renames of a place the last by `at` holds."""
    renamed = last_of(renamed, key, "author", "place", at=at)
    by = last_of(renamed, key, "place", at=at).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "name"))).alias("_names"))
    new = lambda a, i: a.withField("name", F.coalesce(F.try_element_at("_names", i), a["name"]))
    rows = records.join(by, key, "left").withColumn("authors", F.transform("authors", new)).drop("_names")
    names = renamed.groupBy(key, "author").agg(F.max_by("name", "place").alias("_name"))
    return rows, decisions.join(names, [key, "author"], "left").withColumn("author", F.coalesce("_name", "author")).drop("_name").select(decisions.columns)


def remove_affiliation(records: DataFrame, decisions: DataFrame, removed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records, decisions) without affiliations (key, author, place, raw, at): item `at` of the author at that place, and decisions on that name of that author."""
    gone = removed.groupBy(key).agg(F.collect_set(F.struct(F.col("place").cast("int").alias("place"), F.col("at").cast("int").alias("at"))).alias("_gone"))
    left = lambda a, i: a.withField("affiliations", F.filter(a["affiliations"], lambda x, j: ~F.coalesce(F.array_contains("_gone", F.struct(i.cast("int").alias("place"), j.cast("int").alias("at"))), F.lit(False))))
    rows = records.join(gone, key, "left").withColumn("authors", F.transform("authors", left)).drop("_gone")
    return rows, decisions.join(removed.select(key, "author", "raw").distinct(), [key, "author", "raw"], "left_anti")


def registry_upsert(registry: DataFrame, additions: DataFrame) -> DataFrame:
    """(canonical, variant) pairs with new ones added once; a name is no variant of itself."""
    fresh = additions.where("canonical <> variant").distinct().join(registry, ["canonical", "variant"], "left_anti")
    return registry.unionByName(fresh)


def edited(df: DataFrame, updates: DataFrame, key: str, column: str, at: str | None = None) -> DataFrame:
    """Rows whose value an update changes, null-safe; of several updates of a key the last by `at` holds."""
    new = last_of(updates, key, at=at).select(key, F.col(column).alias("_new"))
    return df.join(new, key).where(~F.col(column).eqNullSafe(F.col("_new"))).withColumn(column, F.col("_new")).drop("_new")


def cyclic_next(df: DataFrame, key: str, group: Column) -> DataFrame:
    """Adds next: the following key of the group, the first after the last."""
    w = Window.partitionBy(group).orderBy(key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("next", F.coalesce(F.lead(key).over(w), F.first(key).over(whole)))


def lazy_decisions(pairs: DataFrame, decisions: DataFrame, registry: DataFrame, similarity=text.ratio) -> DataFrame:
    """decisions (author, raw, matched_canonical, match_score, decision) with one by matching for every pair (author, raw) that has none; only names that lack one are matched."""
    names = ["author", "raw", "matched_canonical", "match_score", "decision"]
    open_pairs = pairs.select("author", "raw").distinct().join(decisions.select("author", "raw"), ["author", "raw"], "left_anti")
    made = matching.decided(matching.match(open_pairs.select("raw"), registry, similarity))
    made = open_pairs.join(made, "raw", "left").select("author", "raw", F.col("canonical").alias("matched_canonical"), F.coalesce("score", F.lit(0.0)).alias("match_score"), F.coalesce("decision", F.lit("auto_new")).alias("decision"))
    return decisions.select(names).unionByName(made)


def review(decisions: DataFrame, overrides: DataFrame, at: str | None = None) -> DataFrame:
    """Decisions (author, raw, matched_canonical, decision, new_canonical) after a reviewer's overrides (author, raw, choice, name).

    A choice of existing or new takes its name; revert restores what matching found, an automatic decision as a plain
    one; without an override nothing changes. Of several overrides of a pair the last by `at` holds."""
    by = last_of(overrides, "author", "raw", at=at).select("author", "raw", "choice", "name")
    choice, was = F.col("choice"), F.col("decision")
    plain = F.when(was == "auto_existing", "existing").when(was == "auto_new", "new").otherwise(F.lit("pending"))
    decision = F.when(choice.isin("existing", "new"), choice).when(choice == "revert", plain).otherwise(was)
    matched = F.when(choice == "existing", F.col("name")).otherwise(F.col("matched_canonical"))
    new = F.when(choice == "new", F.col("name")).when((choice == "revert") & (was == "auto_new"), F.col("raw")).otherwise(F.col("new_canonical"))
    changed = decisions.join(by, ["author", "raw"], "left")
    return changed.select("author", "raw", matched.alias("matched_canonical"), decision.alias("decision"), new.alias("new_canonical"))
