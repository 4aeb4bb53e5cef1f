"""Work that grows with the input: what plans read, shuffle and write."""

import contextlib
import io

from curatrix import session
from curatrix.operators import deletion, numbering, profiles, search, triples


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_classes_split_cells_once_and_tell_both_kinds_of_a_link(spark):
    rows = [("a:1", "dct:title", "T"), ("a:1", "foaf:agent", "A, B, A"), ("a:1", "dcat:contactPoint", "A"), ("a:1", "schema:Organization", "U, Street 7, P"), ("a:2", "schema:Organization", "U, Street 7, P"), ("a:2", "x", "doi:10.1234/q"), ("a:3", "x", None)]
    cells = spark.createDataFrame(rows, "a string, column string, value string")
    out = profiles.classes(cells)
    assert "ExistingRDD" not in plan(out)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    links = {(s, b) for s, p, b, kind in got if kind == "bnode"}
    assert len(links) == 3 + 2 + 1 + 2 + 3 + 1 + 1  # of the collection, agents, contact, organisations, their address, title, doi
    assert ("ex:x", "rdf:type", "owl:ObjectProperty", "uri") in got and ("dct:title", "rdf:type", "owl:DatatypeProperty", "uri") in got


TRIPLE = "s string, p string, o string, o_kind string"


def test_tasks_follow_rows(spark):
    few, many = session.spread(spark.range(10), 10, "id"), session.spread(spark.range(10), 5_500_000, "id")
    assert few.rdd.getNumPartitions() == 4 and many.rdd.getNumPartitions() == 6
    assert plan(many.distinct()).count("Exchange") == 1


def test_edges_are_triples_without_a_shuffle(spark):
    pairs = lambda *rows, names: spark.createDataFrame(rows, names)
    t = triples.instance_triples(pairs(("a:1", "T"), ("a:1", "T"), ("a:1", "S"), names="a string, title string"), pairs(("a:1", "u:1"), names="a string, u string"), pairs(("u:1", "f:1"), names="u string, f string"), pairs(("a:1", "u:1"), names="a string, u string"))
    got = [tuple(r) for r in t.collect()]
    assert len(got) == len(set(got)) == 3 + 3 + 3 + 2
    assert "Exchange" not in plan(t.where("p = 'ex:hasAuthor'")) and plan(t.where("p = 'ex:hasAuthor'")).count("ExistingRDD") == 1
    assert "Exchange" not in plan(deletion.references(t.where("p <> 'ex:contactPoint'")))
    assert [tuple(r) for r in deletion.references(t).collect()] == [("a:1", "u:1", "person")]


def test_references_of_several_predicates_and_kinds_count_once(spark):
    rows = [("a", "ex:hasAuthor", "u", "uri"), ("a", "ex:hasAuthor", "u", "bnode"), ("a", "ex:contactPoint", "u", "uri"), ("a", "ex:contactPoint", "v", "bnode"), ("a", "ex:hasAuthor", "w", "literal"), ("a", "schema:sourceOrganization", "u", "uri")]
    got = sorted(tuple(r) for r in deletion.references(spark.createDataFrame(rows, TRIPLE)).collect())
    assert got == [("a", "u", "organisation"), ("a", "u", "person"), ("a", "v", "person")]


def test_merges_make_only_touched_triples_distinct(spark):
    rows = [("u:1", "p", "f:1", "uri"), ("u:1", "p", "f:2", "uri"), ("f:1", "q", "x", "uri"), ("f:2", "q", "x", "uri"), ("u:1", "p", "f:2", "literal"), ("u:2", "p", "y", "uri")]
    out = triples.merge_uris(spark.createDataFrame(rows, TRIPLE), spark.createDataFrame([("f:2", "f:1")], "old string, new string"))
    assert sorted(tuple(r) for r in out.collect()) == [("f:1", "q", "x", "uri"), ("u:1", "p", "f:1", "uri"), ("u:1", "p", "f:2", "literal"), ("u:2", "p", "y", "uri")]
    top = next(line for line in plan(out).splitlines() if "Union" in line or "Aggregate" in line)
    assert "Union" in top


def test_deletion_reads_references_once_and_looks_up_no_literals(spark):
    rows = [("a:1", "ex:hasAuthor", "u:1", "uri"), ("a:2", "ex:hasAuthor", "u:2", "uri"), ("a:1", "ex:contactPoint", "u:2", "uri"), ("n", "rdfs:label", "a:1", "literal"), ("n", "ex:about", "a:1", None)]
    t, doomed = spark.createDataFrame(rows, TRIPLE), spark.createDataFrame([("a:1",), ("a:1",)], "s string")
    assert [tuple(r) for r in triples.orphans(t, doomed).collect()] == [("u:1", "person")]
    assert sorted(tuple(r) for r in triples.cascade_delete(t, doomed).collect()) == [("a:2", "ex:hasAuthor", "u:2", "uri"), ("n", "rdfs:label", "a:1", "literal")]
    left = triples.without(t, spark.createDataFrame([("a:1",)], "node string"))
    assert "o_kind" in plan(left) and "Union" in plan(left)


def test_numbers_take_no_second_sort(spark):
    rows = spark.createDataFrame([(g, k) for k in range(50) for g in ("x", "y", None)], "g string, k int")
    got = numbering.numbered(rows, "k", group="g")
    assert "row_number" not in plan(got)
    assert all(r.i == r.k for r in got.collect()) and got.count() == 150


def test_search_groups_only_the_texts_it_compares(spark):
    rows = [("a:1", "rdf:type", "ex:Abstract", "uri"), ("a:1", "dct:title", "Steel", "literal"), ("a:1", "ex:hasAuthor", "u:1", "uri"), ("u:1", "rdfs:label", "Ann", "literal"), ("a:2", "rdf:type", "ex:Abstract", "uri"), ("a:2", "ex:hasAuthor", "u:1", "uri")]
    t = spark.createDataFrame(rows, TRIPLE)
    found = search.graph_search(t, "steel", triples.ABSTRACT, "dct:title")
    assert "IN (dct:title,rdfs:label)" in plan(found) and [r.s for r in found.collect()] == ["a:1"]
    assert [tuple(r) for r in search.abstract_search(t, "ann", "author").collect()] == [("a:1", "Steel", 1.0)]


def test_flat_splits_cells_once(spark):
    rows = [("a:1", "foaf:agent", "A, B, A"), ("a:2", "foaf:agent", "A"), ("a:1", "schema:Organization", "U, Street 7, P; V"), ("a:2", "schema:Organization", "V"), ("a:2", "x", None)]
    known = spark.createDataFrame([("U, Street 7, P", "Uni", "Uni, Street 7, P")], "raw string, name string, address string")
    out = profiles.flat(spark.createDataFrame(rows, "a string, column string, value string"), known)
    assert plan(out).count("foaf:agent") == 0
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) == 1 + 2 + 2 + 3 + 4 + 3 + 4 + 3 + 1
