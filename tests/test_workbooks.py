"""Workbooks written and read, files as other programs write them, and copies of files."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from curatrix.sources import sharing, workbooks


def test_a_table_comes_back_as_it_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "ROWS", 40)
    odd = ["", "a & <b>", ' "q" ', "two\nlines", "tab\there", "cr\rx", "_x0041_", "\x01", "ä😀", "1.50", "=A1", " outer "]
    rows = [(f"{i:03}", odd[i % len(odd)], odd[(i * 5) % len(odd)] or None) for i in range(100)]
    df = spark.createDataFrame(rows, "file_title string, `dct:title` string, x string").withColumn("new", F.lit("n"))
    told = workbooks.write_workbook(df.select("new", "x", "dct:title", "file_title"), str(tmp_path / "b"), ["file_title", "dct:title", "x"], "file_title").collect()
    assert sorted(map(tuple, told)) == [(0, 40), (1, 40), (2, 20)]
    back = workbooks.read_workbook(spark, str(tmp_path / "b"), dropped=())
    assert back.columns == ["file_title", "dct:title", "x", "new"]
    assert sorted(map(tuple, back.collect())) == [(i, t, x or "", "n") for i, t, x in rows]
    assert workbooks.read_workbook(spark, str(tmp_path / "b")).columns == ["dct:title", "x", "new"]
    placed = workbooks.read_workbook(spark, str(tmp_path / "b"), dropped=(), ordered=True).orderBy("_path", "_row").collect()
    assert [r.file_title for r in placed] == [r[0] for r in rows]
    workbooks.write_workbook(df.limit(3), str(tmp_path / "b"), [])
    assert [f for f in sorted(os.listdir(tmp_path / "b")) if f.endswith(".xlsx")] == ["part-00000.xlsx"]


def foreign() -> bytes:
    """A sheet with shared and rich strings, gaps, booleans, formulas and a second sheet, as spreadsheet programs write it."""
    out, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="3" r:id="r9"/><sheet name="Other" sheetId="4" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r2" Target="worksheets/b.xml"/><Relationship Id="r9" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>k</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t>flag</t></si></sst>")
        z.writestr("xl/worksheets/a.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c></row><row r="4"><c r="A4"><v>7.5</v></c><c r="C4" t="b"><v>1</v></c></row><row r="5"><c r="A5" t="s"><v>1</v></c><c r="D5"><v>9</v></c></row><row r="6"><c r="A6" t="str"><f>B1</f><v>calc</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>z</t></is></c></row><row><c><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files_of_other_programs(spark, tmp_path):
    (tmp_path / "f.xlsx").write_bytes(foreign())
    t = workbooks.read_workbook(spark, str(tmp_path / "f.xlsx"), ordered=True).drop("_path")
    assert t.columns == ["_row", "k", "flag"] and sorted(map(tuple, t.collect())) == [(2, "7.5", "True"), (3, "rich", ""), (4, "calc", "")]
    assert [tuple(r) for r in workbooks.read_workbook(spark, str(tmp_path / "f.xlsx"), sheet="Other").collect()] == [("1",)]
    with pytest.raises(Exception, match="no sheet"):
        workbooks.read_workbook(spark, str(tmp_path / "f.xlsx"), sheet="None")


@pytest.mark.parametrize(("i", "name"), [(0, "A"), (25, "Z"), (26, "AA"), (701, "ZZ"), (702, "AAA"), (16383, "XFD")])
def test_names_of_columns(i, name):
    assert workbooks.column_name(i) == name and workbooks.column_index(f"{name}12") == i


def test_copies_move_only_what_changed(spark, tmp_path):
    source, target, manifest = tmp_path / "s", str(tmp_path / "t"), str(tmp_path / "m")
    copied = lambda: sorted(r.name for r in sharing.copy_newer(spark, str(source), target, manifest).collect())
    assert copied() == []
    source.mkdir()
    for name in ("a.pdf", "b.pdf", "c.txt"):
        (source / name).write_bytes(name.encode() * 1000)
        os.utime(source / name, (1_600_000_000, 1_600_000_000))
    assert copied() == ["a.pdf", "b.pdf"] and copied() == []
    (source / "a.pdf").write_bytes(b"changed")
    assert copied() == ["a.pdf"] and copied() == []
    assert (tmp_path / "t" / "a.pdf").read_bytes() == b"changed" and sorted(os.listdir(target)) == ["a.pdf", "b.pdf"]
