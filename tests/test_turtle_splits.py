"""A Turtle file read in splits against the parse of the whole text."""

import random

import pytest

from curatrix.sources import splitting, turtle


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def document(seed):
    """Statements over several lines, with strings that look like ends, comments and declarations."""
    draw = random.Random(seed)
    odd = ['"plain ."', '"a # b ."@en', '"""one .\nex:x ex:y ex:z .\n# no comment\n"two" . """', '"""a\n\n."""', "7", "1.5", "<http://x/#a.>", "ex:n.m", '"q\\" ."', '[ a ex:R ;\n  ex:on ex:p ]', '"""x\\""" y"""', "true"]
    lines = ["@prefix ex: <http://e/> .", "@prefix o: <http://o/#> . # declared"]
    for i in range(150):
        values = " ,\n    ".join(draw.choice(odd) for _ in range(draw.randint(1, 3)))
        lines.append(draw.choice(["# comment . with \"\"\" quotes", "", "   "]))
        lines.append(f"ex:s{i} a o:C ;" + draw.choice(["\n", " "]) + f"ex:p {values}" + draw.choice([" .", " .  # end \"\"\"", "\n.", f" . ex:t{i} ex:p ex:u ."]))
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_equal_the_whole(spark, tmp_path, small_splits, seed):
    text = document(seed)
    (tmp_path / "g.ttl").write_text(text, encoding="utf-8")
    blocks = splitting.pieces(spark, str(tmp_path / "g.ttl"), "\n").select("block").distinct().count()
    got = {tuple(r) for r in turtle.read_turtle(spark, str(tmp_path / "g.ttl")).collect()}
    assert blocks > 8 and got == set(turtle.parsed(text)) and len(got) > 300


def test_several_files_and_none(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.ttl").write_text('@prefix ex: <http://e/> .\nex:a ex:p "open\\nend" .\nex:b ex:p """x\n', encoding="utf-8")
    with pytest.raises(Exception, match="no Turtle"):
        turtle.read_turtle(spark, str(folder)).collect()
    (folder / "a.ttl").write_text("@prefix ex: <http://e/> .\nex:a ex:p ex:b .", encoding="utf-8")
    (folder / "b.ttl").write_text("@prefix ex: <http://e/> .\nex:b ex:p ex:c .\n", encoding="utf-8")
    assert {r.s for r in turtle.read_turtle(spark, str(folder)).collect()} == {"http://e/a", "http://e/b"}
    (folder / "b.ttl").write_text("@prefix ex: <http://other/> .\n", encoding="utf-8")
    with pytest.raises(ValueError, match="stands for"):
        turtle.read_turtle(spark, str(folder))
    (folder / "a.ttl").write_text("")
    (folder / "b.ttl").write_text("")
    assert turtle.read_turtle(spark, str(folder)).collect() == []
