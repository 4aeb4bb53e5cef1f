"""Merges of addresses: long chains, cycles, several targets."""

from curatrix.operators import triples


def merges(spark, pairs):
    return spark.createDataFrame(pairs, "old string, new string")


def test_chain_of_ten_thousand_links_has_one_end(spark):
    pairs = [(f"n{i:05}", f"n{i + 1:05}") for i in range(10_000)]
    got = triples.resolved(merges(spark, pairs[::-1])).collect()
    assert {r.new for r in got} == {"n10000"} and len(got) == 10_000


def test_cycles_become_their_least_address_and_are_told(spark):
    m = merges(spark, [("c", "a"), ("a", "b"), ("b", "c"), ("t1", "t2"), ("t2", "b"), ("x", "y"), ("s", "s"), ("p", "q"), ("q", "p")])
    assert {tuple(r) for r in triples.resolved(m).collect()} == {("b", "a"), ("c", "a"), ("t1", "a"), ("t2", "a"), ("x", "y"), ("q", "p")}
    assert {tuple(r) for r in triples.cycles(m).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("p", "p"), ("q", "p")}
    assert triples.cycles(merges(spark, [("x", "y")])).collect() == []


def test_of_several_targets_the_least_holds(spark):
    t = spark.createDataFrame([("f:old", "ex:isAffiliationOf", "u:1", "uri"), ("u:1", "ex:hasAffiliation", "f:old", "uri"), ("u:1", "rdfs:label", "f:old", "literal")], "s string, p string, o string, o_kind string")
    got = {tuple(r) for r in triples.merge_uris(t, merges(spark, [("f:old", "f:z"), ("f:old", "f:b"), (None, "f:c"), ("f:d", None)])).collect()}
    assert got == {("f:b", "ex:isAffiliationOf", "u:1", "uri"), ("u:1", "ex:hasAffiliation", "f:b", "uri"), ("u:1", "rdfs:label", "f:old", "literal")}


def test_no_merges(spark):
    assert triples.resolved(merges(spark, [])).collect() == []
