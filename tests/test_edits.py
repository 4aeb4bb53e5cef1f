"""Several edits of one thing: one row, and the last holds."""

from curatrix.operators import curation


def test_two_edits_of_a_key_save_one_row(spark):
    store = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, v string, ord int")
    edits = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("c", "w", 5), ("c", "u", 9)], "k string, v string, at int")
    got = curation.save(store.drop("ord"), edits, "k", at="at").collect()
    assert sorted(map(tuple, got)) == [("a", "new"), ("b", "y"), ("c", "u")]
    ordered = curation.save(store, spark.createDataFrame([("a", "p", 1, 1), ("a", "q", 1, 2)], "k string, v string, ord int, at int"), "k", "ord", at="at")
    assert sorted(map(tuple, ordered.collect())) == [("a", "q", 1), ("b", "y", 2)]
    assert len(curation.save(store.drop("ord"), edits.drop("at"), "k").collect()) == 3


def test_two_updates_of_a_key_count_once(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    updates = spark.createDataFrame([("a", "z", 1), ("a", "x", 2), ("b", "q", 1), ("b", "r", 2)], "k string, v string, at int")
    assert [tuple(r) for r in curation.edited(rows, updates, "k", "v", at="at").collect()] == [("b", "r")]


def test_two_overrides_of_a_pair_keep_one_decision(spark):
    decisions = spark.createDataFrame([("A", "r", "M", "auto_existing", None)], "author string, raw string, matched_canonical string, decision string, new_canonical string")
    overrides = spark.createDataFrame([("A", "r", "new", "N", 1), ("A", "r", "existing", "E", 2)], "author string, raw string, choice string, name string, at int")
    assert [tuple(r) for r in curation.review(decisions, overrides, at="at").collect()] == [("A", "r", "E", "existing", None)]
    assert curation.review(decisions, overrides.drop("at")).count() == 1


def test_two_renames_of_a_place_take_the_last(spark):
    records = spark.createDataFrame([("f", [("A", ["x"]), ("B", ["y"])])], "k string, authors array<struct<name:string,affiliations:array<string>>>")
    decisions = spark.createDataFrame([("f", "A", "x")], "k string, author string, raw string")
    renamed = spark.createDataFrame([("f", "A", 0, "First", 1), ("f", "A", 0, "Second", 2)], "k string, author string, place int, name string, at int")
    rows, told = curation.rename_author(records, decisions, renamed, "k", at="at")
    assert [a.name for a in rows.first().authors] == ["Second", "B"] and [tuple(r) for r in told.collect()] == [("f", "Second", "x")]
