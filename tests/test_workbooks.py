"""All sheets of several workbooks, each sheet a scan of its own."""

import zipfile

import pytest
from pyspark.sql import functions as F

from evalspark.sources import workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def save(path, sheets):
    """``sheets``: name -> rows of cells; None is a cell that is not there."""
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        tags = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{LINKS}"><sheets>{tags}</sheets></workbook>')
        rel = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row) if v is not None)}</row>' for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    save(at / "a.xlsx", {"one": [["k", "v"], ["1", "x"], ["2", None], ["3", "z", "beyond"]], "two": [["k"], *[[str(i)] for i in range(25_000)]], "none": [], "head": [["k", "w"]]})
    save(at / "b.xlsx", {"one": [["v", "k"], ["y", "4"]]})
    return at


def rows_of(df):
    return sorted((r["file"].rsplit("/", 1)[-1], r["sheet"], r["source_row"], r["record"]) for r in df.collect())


def test_all_sheets(spark, folder):
    df = workbook.read_workbooks(spark, str(folder))
    want = [("a.xlsx", "one", 2, {"k": "1", "v": "x"}), ("a.xlsx", "one", 3, {"k": "2", "v": None}), ("a.xlsx", "one", 4, {"k": "3", "v": "z"}), ("b.xlsx", "one", 2, {"v": "y", "k": "4"})]
    assert rows_of(df.where("sheet = 'one'")) == want
    two = df.where("sheet = 'two'").agg(F.count("*"), F.min("source_row"), F.max("source_row"), F.countDistinct("source_row"), F.sum(F.col("record")["k"].cast("long"))).first()
    assert tuple(two) == (25_000, 2, 25_001, 25_000, 25_000 * 24_999 // 2)
    assert {r["sheet"] for r in df.select("sheet").distinct().collect()} == {"one", "two"}
    tasks = df.select("sheet", F.spark_partition_id().alias("task")).distinct().groupBy("task").agg(F.countDistinct("sheet").alias("n"))
    assert tasks.where("n > 1").isEmpty()  # no task has two sheets of a file


def test_chosen_sheets_and_columns(spark, folder):
    got = rows_of(workbook.read_workbooks(spark, str(folder), ["one"], ["k"]))
    assert [r[3] for r in got] == [{"k": "1"}, {"k": "2"}, {"k": "3"}, {"k": "4"}]
    assert "Exchange" not in workbook.read_workbooks(spark, str(folder), ["one"])._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="no sheet 'two'"):
        workbook.read_workbooks(spark, str(folder), ["two"]).collect()
    with pytest.raises(ValueError, match="sheets is empty"):
        workbook.read_workbooks(spark, str(folder), [])


def test_faults(spark, tmp_path):
    save(tmp_path / "c.xlsx", {"s": [["k", "k"], ["1", "2"]]})
    with pytest.raises(Exception, match="repeats a column name"):
        workbook.read_workbooks(spark, str(tmp_path)).collect()
