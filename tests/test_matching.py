"""The live metric against difflib, variants, guards and stores that a writer left half-way."""

import difflib
import os
import random

import pytest

from curatrix.functions import text
from curatrix.operators import matching, records, triples
from curatrix.plans import catalogue
from curatrix.sources import stores

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


def plain_match(raw, registry):
    best, score = None, 0.0
    for candidate, canonical in registry:
        if (s := ratio(raw, candidate)) > score:
            best, score = canonical, s
    decision = "auto_existing" if score >= 0.95 else "auto_new" if score < 0.7 else "pending"
    return (raw, None if decision == "auto_new" else best, round(score, 4), decision)


def test_registry_match_equals_difflib(spark):
    registry = [(r.candidate, r.canonical) for r in catalogue.registry(spark, SF).orderBy("ord").collect()]
    raws = [r.raw for r in catalogue.raws(spark, SF).collect()]
    assert any(a != b for a, b in registry)
    got = {tuple(r) for r in catalogue.QUERIES["registry_match_ratio"](spark, SF).select("raw", "canonical", "score", "decision").collect()}
    assert got == {plain_match(raw, registry) for raw in raws}


def test_guarded_merge_equals_difflib(spark):
    names, registry = catalogue.labels_of_organisations(spark, SF)
    rows = registry.orderBy("ord").collect()
    canonicals = [r.canonical for r in rows if r.candidate == r.canonical]
    variants = {}
    for r in rows:
        if r.candidate != r.canonical:
            variants[r.candidate] = r.canonical
    first = lambda x: x.split(",")[0].strip()
    want = set()
    for raw in {r.raw for r in names.collect()} - set(canonicals) - {""}:
        target = variants.get(raw)
        if target and ratio(raw, target) >= 0.72 and ratio(first(raw), first(target)) >= 0.72:
            want.add((raw, target, "variant-exact", round(ratio(raw, target), 4)))
            continue
        best, score = None, 0.0
        for c in canonicals:
            s = ratio(raw, c)
            if s > score and ratio(first(raw), first(c)) >= 0.72:
                best, score = c, s
        if score >= 0.72:
            want.add((raw, best, "fuzzy", round(score, 4)))
    got = {tuple(r) for r in matching.guarded_merge(names, registry).select("raw", "canonical", "method", "score").collect()}
    assert got == want and {m for _, _, m, _ in want} == {"variant-exact", "fuzzy"}


def test_the_guard_reads_up_to_the_first_comma(spark):
    names = spark.createDataFrame([("Interface Science Department, Fritz Institute, Berlin",), ("Theory Departement, Fritz Institute, Berlin",)], "raw string")
    registry = matching.registry_long(spark.createDataFrame([("Theory Department, Fritz Institute, Berlin",)], "c string"), "c")
    assert [r.raw[:6] for r in matching.guarded_merge(names, registry).collect()] == ["Theory"]


def test_similarity_and_search_equal_difflib(spark):
    for r in catalogue.QUERIES["similarity_ratio"](spark, SF).collect():
        assert r.ratio == round(ratio(r.a, r.b), 4)
    for r in catalogue.QUERIES["search_topk_ratio"](spark, SF).collect():
        assert r.score == round(max(ratio("blue steel", r.candidate), float("blue steel" in r.candidate.lower())), 4)


def test_leaders_equal_a_sweep(spark):
    names = sorted(r.candidate for r in catalogue.canonicals(spark, SF).collect())
    want, taken = set(), set()
    for i, a in enumerate(names):
        if a not in taken:
            for b in names[i:]:
                if b not in taken and (a == b or ratio(a, b) >= 0.70):
                    taken.add(b)
                    want.add((a, b))
    assert {tuple(r) for r in catalogue.QUERIES["cluster_leader"](spark, SF).select("leader", "member").collect()} == want


def test_leaders_of_linked_names_equal_a_sweep(spark):
    """Chains, where a name that is taken leaves its own neighbours free, repeated names and null."""
    draw = random.Random(3)
    names = ["".join(draw.choice("ab") + draw.choice("cd") for _ in range(4)) + draw.choice(["", "x", "yy"]) for _ in range(60)]
    order = {}
    for i, name in enumerate(names):
        order.setdefault(name, i)
    want, taken = set(), set()
    for a in order:
        if a not in taken:
            for b in order:
                if order[b] >= order[a] and b not in taken and (a == b or ratio(a, b) >= 0.70):
                    taken.add(b)
                    want.add((a, b))
    rows = spark.createDataFrame([*zip(names, range(len(names)), strict=True), (None, 0)], "name string, ord int")
    assert {tuple(r) for r in matching.leader_clusters(rows).select("leader", "member").collect()} == want
    assert 1 < len({a for a, _ in want}) < len(want)
    assert matching.leader_clusters(rows.where("ord < 0")).collect() == []


def test_empty_registry(spark):
    none = matching.registry_long(spark.createDataFrame([], "c string"), "c")
    names = spark.createDataFrame([("a",), (None,)], "raw string")
    assert matching.match(names, none).collect() == [] and matching.guarded_merge(names, none).collect() == []


def test_display_takes_the_first_affiliation_that_is_not_empty(spark):
    rows = spark.createDataFrame([("f", "", "B", "2025-01-02", [("A", ["", "X, Y"]), ("B", [""]), ("C", None), ("", ["Z"])])], "file_title string, title string, contact string, issued string, authors array<struct<name:string,affiliations:array<string>>>")
    r = records.flatten(rows).first()
    assert r.author_display == "B · A (X) · C" and r.title == "f" and r.keywords == "" and r.relations == []
    assert [(a.name, a.affs) for a in r.author_details] == [("A", ["", "X, Y"]), ("B", [""]), ("C", [])]


def test_fill_and_list_of_titles(spark):
    rows = spark.createDataFrame([(" \t", "a", [], ["x"]), ("nan", "b", ["y"], ["x"]), ("c", "d", None, ["x"])], "old string, new string, l array<string>, m array<string>")
    got = rows.select(records.fill_empty(rows.old, rows.new), records.fill_empty_list(rows.l, rows.m)).collect()
    assert [tuple(r) for r in got] == [("a", ["x"]), ("b", ["y"]), ("c", ["x"])]
    assert spark.range(1).select(records.listed(text.F.lit("t" * 60)).alias("t")).first().t == "t" * 55


def test_merges_make_the_canonical_an_organisation(spark):
    t = spark.createDataFrame([("f:old", "rdfs:subClassOf", "schema:Organization", "uri"), ("u:1", "ex:hasAffiliation", "f:old", "uri")], "s string, p string, o string, o_kind string")
    merges = spark.createDataFrame([("f:old", "f:new")], "old string, new string")
    got = {tuple(r) for r in triples.merge_uris(t, merges, spark.createDataFrame([("f:new", "New"), ("f:other", "Other")], "new string, label string")).collect()}
    assert got == {("f:new", "rdf:type", "owl:Class", "uri"), ("f:new", "rdfs:subClassOf", "schema:Organization", "uri"), ("f:new", "rdfs:label", "New", "literal"), ("u:1", "ex:hasAffiliation", "f:new", "uri")}


def test_a_writer_stopped_between_its_moves_loses_no_store(spark, tmp_path):
    path = str(tmp_path / "store.json")
    rows = spark.createDataFrame([("a",)], "file_title string")
    stores.write_store(rows, path)
    os.rename(path, f"{path}.old")
    assert [r.file_title for r in stores.read_store(spark, path, "file_title string").collect()] == ["a"]
    stores.write_store(spark.createDataFrame([("b",)], "file_title string"), path)
    assert [r.file_title for r in stores.read_store(spark, path, "file_title string").collect()] == ["b"]


@pytest.mark.parametrize(("raw", "safe"), [("a b/c", "a%20b%2Fc"), ("!'()~*-_.", "!'()~*-_."), ("ä&+", "%C3%A4%26%2B")])
def test_percent_encoding(spark, raw, safe):
    assert spark.range(1).select(text.percent_encode(text.F.lit(raw)).alias("x")).first().x == safe
