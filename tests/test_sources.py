import datetime as dt
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from curatrix.functions import documents
from curatrix.functions.text import WHITE, strip
from curatrix.operators import profiles, search
from curatrix.sources import plugins, stores, turtle
from curatrix.streaming import ingest


def test_store_reads_an_array_and_keeps_order(spark, tmp_path):
    path = tmp_path / "store.json"
    path.write_text(json.dumps([{"file_title": "b", "dct:title": "T", "authors": [{"name": "N", "affiliations": ["x"]}]}, "no record", {"file_title": "a", "_error": "e"}]), encoding="utf-8")
    rows = stores.read_store(spark, str(path)).orderBy("ord").collect()
    assert [(r.file_title, r.ord, r._error) for r in rows] == [("b", 0, None), ("a", 2, "e")]
    assert rows[0].authors[0].affiliations == ["x"]


@pytest.mark.parametrize("content", [None, "{}", "not json"])
def test_store_without_records_is_empty(spark, tmp_path, content):
    path = tmp_path / "store.json"
    if content is not None:
        path.write_text(content)
    assert stores.read_store(spark, str(path)).count() == 0


def test_store_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "store")
    for title in ("one", "two"):
        df = spark.createDataFrame([(title,)], "file_title string").withColumn("ord", F.lit(0).cast("long"))
        stores.write_store(df, path)
        assert [r.file_title for r in stores.read_store(spark, path).collect()] == [title]
    assert stores.write_stamped(df, str(tmp_path), "out", dt.datetime(2025, 3, 1, 9, 5)).endswith("out_20250301_0905")


def test_registry_and_groups(spark, tmp_path):
    reg, groups = tmp_path / "r.json", tmp_path / "g.json"
    reg.write_text(json.dumps({"Zeta": ["z2", "z1"], "Alpha": []}))
    got = [(r.canonical, r.variants) for r in stores.registry_json(stores.read_registry(spark, str(reg))).collect()]
    assert got == [("Alpha", []), ("Zeta", ["z2", "z1"])]
    assert stores.read_registry(spark, str(tmp_path / "none.json")).count() == 0
    groups.write_text(json.dumps({"A": [{"A": 2}, {" a ": 1}], "B": [{"a": 3, "b": 1}]}))
    read = stores.read_groups(spark, str(groups))
    assert {(r.variant, r.canonical) for r in stores.variant_map(read).collect()} == {("A", "A"), ("a", "B"), ("b", "B")}
    assert {(r.canonical, r.variant) for r in stores.migrated(read).collect()} == {("A", None), ("A", " a "), ("B", "a"), ("B", "b")}


def test_lists_tables_and_files(spark, tmp_path):
    tsv = tmp_path / "o.tsv"
    tsv.write_text(" Institution \tAddress\nUni A\tStreet 1, X\nUNI a\tStreet 2, Y\n")
    assert [tuple(r) for r in stores.read_organisations(spark, str(tsv), "Institution", "Address").collect()] == [("uni a", "UNI a", "Street 2, Y")]
    assert stores.read_organisations(spark, str(tmp_path / "no"), "a", "b").count() == 0
    csv = tmp_path / "t.csv"
    csv.write_text('file_title,dct:title,x\nf,"a ""b""",\n')
    t = stores.read_table(spark, str(csv))
    assert [tuple(r) for r in t.collect()] == [('a "b"', "")]
    stores.write_table(t.withColumn("new", F.lit("n")).select("new", "x", F.col("`dct:title`")), str(tmp_path / "out"), ["dct:title", "x"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["dct:title", "x", "new"]
    for name in ("b.pdf", "a.pdf", "c.txt", "sub/d.pdf"):
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(b"p1\x0cp2")
    names = lambda df: [r.file_title for r in df.collect()]
    flat = stores.files(spark, str(tmp_path / "f"))
    assert names(flat) == ["a", "b"]
    assert names(stores.files(spark, str(tmp_path / "f"), recursive=True)) == ["a", "b", "d"]
    assert names(stores.to_copy(flat, flat.where("file_title = 'a'"))) == ["b"]


def test_payload_and_report(spark, tmp_path):
    df = spark.createDataFrame([("</script>",), ("b",), ("b",), (None,)], "n string")
    assert stores.payload(df).first().value == '{"n":"<\\/script>"}'
    stores.write_unmatched(df, "n", str(tmp_path / "u"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "u")).collect()) == ["</script>", "b"]


TURTLE = '''@prefix ex: <http://e/> .
# a comment
ex:a a ex:C ; ex:p "x \\"q\\" \\u00e9"@en, "1"^^<http://t>, 7 ;
    ex:q [ a ex:R ; ex:on ex:p ] .
ex:b.c ex:p """two
lines""" .
'''


def test_turtle_round_trip(spark, tmp_path):
    rows = turtle.parsed(TURTLE)
    assert ("http://e/a", "http://e/p", 'x "q" é', "literal", "en", None) in rows and ("http://e/b.c", "http://e/p", "two\nlines", "literal", None, None) in rows
    blank = {r[0] for r in rows if r[0].startswith("_:")}
    assert len(blank) == 1 and len(rows) == 8 and rows == turtle.parsed(TURTLE)
    (tmp_path / "in.ttl").write_text(TURTLE, encoding="utf-8")
    read = turtle.read_turtle(spark, str(tmp_path / "in.ttl"))
    turtle.write_turtle(read, str(tmp_path / "out"))
    again = turtle.read_turtle(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in read.collect()} == set(rows)
    with pytest.raises(ValueError):
        turtle.parsed('ex:a ex:b "open')


def test_plugins(spark):
    files = spark.createDataFrame([("good", bytearray(b"x" * 60 + b"\x0ctwo")), ("thin", bytearray(b"x")), ("bad", bytearray(b"!"))], "path string, content binary")

    def parser(content):
        if content == b"!":
            raise ValueError("broken")
        return content.decode().split("\f")

    got = {r.path: r for r in plugins.page_texts(files, parser).collect()}
    assert got["good"].text.endswith("\ftwo") and got["bad"].error == "ValueError: broken" and got["thin"].text == "x"
    assert {r.path: r.text for r in plugins.page_texts(files, parser, lambda c: ["other"]).collect()}["bad"] == "other"
    calls = plugins.model_answers(spark.createDataFrame([(1, "ok"), (2, "no"), (3, None)], "id long, text string"), lambda p: f"<{p}>" if "no" not in p else 1 / 0, "id", "Q: {text}")
    assert {r.id: (r.answer, r.error) for r in calls.collect()} == {1: ("<Q: ok>", None), 2: (None, "ZeroDivisionError: division by zero"), 3: ("<Q: >", None)}
    df = spark.createDataFrame([("hello", ["10.1/a", "10.1/b"]), (None, None)], "t string, d array<string>")
    guess = df.select(plugins.language(lambda t: t[:2], F.col("t")).alias("l"), plugins.valid_dois(lambda d: d.endswith("a"), F.col("d")).alias("d")).collect()
    assert [(r.l, r.d) for r in guess] == [("he", ["https://doi.org/10.1/a"]), ("und", [])]
    turns = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "hi")], "conv_id long, turn int, role string, text string")
    assert plugins.histories(turns).first().text == "user: hi\nassistant: "


def test_documents(spark):
    text = "Short\nA rather long title of this text\nAnna B. Smith\nUniversity of X\nplain words\nOtto Kern, Ulm\n\nCarl Zeiss"
    block = documents.author_block(F.lit(text))
    row = spark.range(1).select(block.alias("b"), documents.attributed(block).alias("a")).first()
    assert row.b == ["Anna B. Smith", "University of X", "Otto Kern, Ulm"]
    assert [(x.name, x.affiliations) for x in row.a] == [("Anna B. Smith", ["University of X"]), ("Otto Kern", [])]
    assert spark.range(1).select(documents.author_block(F.lit("")).alias("b")).first().b == []
    lines = spark.createDataFrame([([("Running head of page", 0.1), ("Bold title line", 0.9), ("tiny", 0.0), ("goes on here", 0.7), ("plain text line", 0.2), ("Bold again here", 1.0)],), ([("nothing bold here", 0.0)],)], "lines array<struct<text:string,bold_ratio:double>>")
    assert [r[0] for r in lines.select(documents.bold_title(F.col("lines"))).collect()] == ["Bold title line goes on here", ""]
    assert spark.range(1).select(documents.first_pages(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).first()[0] == "--- Page 1 ---\na\n--- Page 2 ---\nb"


def test_author_block_of_odd_lines(spark):
    def plain(text):
        lines = [x.strip(WHITE) for x in text.split("\n")]
        title = next((i for i, x in enumerate(lines) if len(x) > 10 and len(re.split(r"[\t-\r ]+", x)) > 3), None)
        below = [] if title is None else lines[title + 1 : title + 6]
        # Texts of this test that count have a comma.
        return [x for x in below if "," in x]

    pick = random.Random(5)
    parts = [*WHITE, "\n", "\n", " ", " ", "a", "bc", ",", "def", "é", "\x1c", "\u200b", "𝒳", "longer"]
    texts = ["".join(pick.choices(parts, k=pick.randrange(60))) for _ in range(3000)]
    texts += ["a b c\u2003\n" + w + "one two three four" + w + "\n x, \n\n\n\n y,\n z," for w in WHITE]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", documents.author_block(F.col("t")).alias("b")).collect()
    assert {r.i: r.b for r in got} == {i: plain(t) for i, t in enumerate(texts)}
    assert sum(bool(plain(t)) for t in texts) > 100


def test_author_block_and_strip_of_long_runs_of_white_space(spark):
    """Work with the square of a run's length took minutes here."""
    run = " " * 300_000
    text = f"a{run}b\nA title of some words{run}\n  x,{run}y{run}\n" + f"later{run}lines\n" * 5
    start = time.monotonic()
    row = spark.createDataFrame([(text,)], "t string").select(documents.author_block(F.col("t")).alias("b"), strip(F.col("t")).alias("s")).first()
    assert row.b == [f"x,{run}y"] and row.s == text.strip()
    assert time.monotonic() - start < 30


def test_strip_takes_unicode_white_space_alone(spark):
    points = spark.createDataFrame([(i, chr(i)) for i in (*range(1, 0x3100), 0xFEFF, 0x1D4B3)], "id int, c string")
    taken = points.where(strip(F.concat("c", F.lit("x"), "c")) == "x").select("id").collect()
    assert {r.id for r in taken} == set(map(ord, WHITE)) == {r.id for r in points.where(F.regexp_like("c", F.lit(r"(?U)^\s$")) | (F.col("c") == "\n")).collect()}


def _edits(p, t):
    before = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        row = [i]
        for j, b in enumerate(t, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


@pytest.mark.parametrize("pattern,where", [("abc", "xxabxc"), ("steel", "a stele"), ("a", ""), ("kitten", "sitting kit ten"), ("x" * 90, "x" * 70 + "y" * 30), ("", "abc")])
def test_substring_distance(pattern, where):
    assert search.substring_distance(pattern, where) == _edits(pattern, where)


def test_fuzzy_search(spark):
    entries = spark.createDataFrame([(1, "Blue steel", ["Ann"], []), (2, "Red copper", ["Blu Stel"], None), (3, None, None, [None])], "id long, title string, authors array<string>, affiliations array<string>")
    found = lambda q, mode="all": {r.id: round(r.score, 2) for r in search.fuzzy_search(entries, q, mode).collect()}
    assert found("BLUE STEEL") == {1: 0.0, 2: 0.2} and found("blue steel", "title") == {1: 0.0} and set(found(" ")) == {1, 2, 3}
    nodes = spark.createDataFrame([(i, f"node {i}") for i in range(9)], "id long, label string")
    assert [r.id for r in search.suggestions(nodes, "node").collect()] == [0, 1, 2, 3, 4, 5]
    assert search.node_search(nodes, " ").count() == 0 and search.node_search(nodes, "node 3", 1).first().id == 3


def test_unknown_prefix(spark):
    names = ["dct:title", "Odd:x", "two words", " SCHEMA:y "]
    got = spark.createDataFrame([(n,) for n in names], "c string").select(profiles.predicate(F.col("c"))).collect()
    assert [r[0] for r in got] == ["dct:title", "ex:x", "ex:two_words", "schema:y"]


def test_records_are_appended_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in ([("a", 1), ("a", 1)], [("a", 2), ("b", 3)]):
        spark.createDataFrame(batch, "key string, n int").write.mode("append").json(source)
        ingest.ingest(spark.readStream.schema("key string, n int").json(source), store, "key", str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r.key, r.n) for r in spark.read.parquet(store).collect()) == [("a", 1), ("b", 3)]


def test_drawing(spark):
    nodes = spark.createDataFrame([("u:1", "person", "Ann"), ("a:1", "abstract", "T")], "id string, kind string, label string")
    edges = spark.createDataFrame([("a:1", "ex:hasAuthor", "u:1"), ("a:1", "ex:hasAuthor", "u:none")], "s string, p string, o string")
    rows = [(r.section, json.loads(r.item)) for r in profiles.drawing(nodes, edges).collect()]
    ids = {x["iri"]: x["id"] for kind, x in rows if kind == "class"}
    assert len(rows) == 3 + 6 + 2 + 1 and ids["u:1"] == "person1" and ids["a:1"] == "abstract1"
    (link,) = [x for kind, x in rows if x["id"] == "prop_0"]
    assert (link["domain"], link["range"], link["parent"], link["label"]) == (ids["a:1"], ids["u:1"], "ex_hasAuthor", "hasAuthor")
