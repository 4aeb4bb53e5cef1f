"""JSON files split into many tasks against the json module; registries and layouts written and read again."""

import json
import random

import pytest

from curatrix.operators import numbering
from curatrix.sources import splitting, stores

ODD = ["}", '"', "\\", "a}b{", "]", "[", "\\\"}", "\n", "é", "", "},{", '{"x":"}"}', " "]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "900", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def record(draw):
    text = lambda: "".join(draw.choice(ODD) for _ in range(draw.randint(0, 3)))
    return {"file_title": text(), "dct:title": text(), "authors": [{"name": text(), "affiliations": [text()]} for _ in range(draw.randint(0, 2))], "dct:relation": [text() for _ in range(draw.randint(0, 2))]}


@pytest.mark.parametrize("indent", [None, 4])
@pytest.mark.parametrize("plain", [True, False])
def test_a_split_store_equals_the_parsed_file(spark, tmp_path, small_splits, indent, plain):
    draw = random.Random(3)
    items = [record(draw) if plain or draw.random() < 0.7 else draw.choice([1, "a}", None, [1, [2]], [{"a": {"b": "]"}}, {}], [[[["}"]]]], True]) for _ in range(120)]
    path = tmp_path / "s.json"
    path.write_text(json.dumps(items, indent=indent, ensure_ascii=False), encoding="utf-8")
    assert splitting.pieces(spark, str(path), "}").select("block").distinct().count() > 5
    rows = stores.read_store(spark, str(path)).orderBy("ord").collect()
    want = [(i, x) for i, x in enumerate(items) if isinstance(x, dict)]
    assert [r.ord for r in rows] == [i for i, _ in want]
    for r, (_, x) in zip(rows, want, strict=True):
        assert r.file_title == x["file_title"] and r["dct:title"] == x["dct:title"] and r["dct:relation"] == x["dct:relation"]
        assert [(a.name, a.affiliations) for a in r.authors] == [(a["name"], a["affiliations"]) for a in x["authors"]]


@pytest.mark.parametrize("content", ["", "[]", " [ ] \n", "{}", '{"a": [{"b": 1}]}', '[{"a": 1}', '[{"a": 1}, {"b', "[1, 2]", '"[{}]"'])
def test_files_without_records(spark, tmp_path, content):
    path = tmp_path / "s.json"
    path.write_text(content)
    assert stores.read_store(spark, str(path)).collect() == []


@pytest.mark.parametrize("indent", [None, 2])
def test_a_split_registry_equals_the_parsed_file(spark, tmp_path, small_splits, indent):
    draw = random.Random(5)
    registry = {f"{i} {draw.choice(ODD)}": [draw.choice(ODD) + str(k) for k in range(draw.randint(0, 4))] for i in range(80)}
    path = tmp_path / "r.json"
    path.write_text("\ufeff" + json.dumps(registry, indent=indent, ensure_ascii=False), encoding="utf-8")
    rows = stores.read_registry(spark, str(path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.canon_ord, r.var_ord or 0)):
        got.setdefault(r.canonical, []).extend([] if r.variant is None else [r.variant])
    assert got == registry and list(got) == list(registry)


def test_a_registry_reads_back_as_written(spark, tmp_path):
    rows = spark.createDataFrame([("b", 0, "b1"), ("b", 1, "b2"), ("a", None, None), ("b", 5, "b1"), ("ä", 0, "x")], "canonical string, var_ord int, variant string")
    path = str(tmp_path / "reg")
    for _ in range(2):
        stores.write_registry(rows, path)
        rows = stores.read_registry(spark, path)
        assert sorted(map(tuple, rows.select("canon_ord", "canonical", "var_ord", "variant").collect()), key=repr) == [(0, "a", None, None), (1, "b", 0, "b1"), (1, "b", 1, "b2"), (2, "ä", 0, "x")]


def test_migration_skips_converts_and_starts_empty(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps([{"file_title": "a"}, {"file_title": "b"}]))
    (tmp_path / "groups.json").write_text(json.dumps({"A": [{"A": 2}, {"A1": 1}], "B": []}))
    layout = {n: str(tmp_path / n) for n in ("records", "staged", "registry")}
    legacy = {"records": str(tmp_path / "old.json"), "registry": str(tmp_path / "groups.json")}
    assert stores.migrate(spark, layout, legacy) == {"records": "converted", "staged": "started empty", "registry": "converted"}
    assert sorted(r.file_title for r in stores.read_store(spark, layout["records"]).collect()) == ["a", "b"]
    assert stores.read_store(spark, layout["staged"]).collect() == []
    assert {(r.canonical, r.variant) for r in stores.read_registry(spark, layout["registry"]).collect()} == {("A", "A1"), ("B", None)}
    assert set(stores.migrate(spark, layout, legacy).values()) == {"skipped"}


def test_running_numbers(spark):
    rows = spark.createDataFrame([(g, k) for g in ("a", "b", None) for k in range(200)], "g string, k int").repartition(7)
    assert {(r.g, r.k, r.i) for r in numbering.numbered(rows, "k", group="g").collect()} == {(g, k, k) for g in ("a", "b", None) for k in range(200)}
    assert sorted(r.i for r in numbering.numbered(rows, "k").collect()) == list(range(600))
