"""Workbooks: kinds of cells, headers, broken files."""

from __future__ import annotations

import io
import zipfile

from sunledger.operators import referrals
from sunledger.sources.workbooks import read_workbooks, sheet_columns, workbook_rows

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(sheet, strings=None, target="/xl/sheets/s.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="First" r:id="rId7"/><sheet name="Second" r:id="rId8"/></sheets></workbook>')
        box.writestr("xl/_rels/workbook.xml.rels", f'<R><Relationship Id="rId8" Target="sheets/other.xml"/><Relationship Id="rId7" Target="{target}"/></R>')
        if strings is not None:
            box.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        box.writestr("xl/sheets/s.xml", f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>")
        box.writestr("xl/sheets/other.xml", "<worksheet/>")
    return out.getvalue()


STRINGS = "<si><t>EPBC No</t></si><si><t>Project</t></si><si><r><t>Sunny </t></r><r><t>Solar &amp; Co</t></r><rPh><t>reading</t></rPh></si>"
SHEET = (
    '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t> Valid Date </t></is></c><c r="E2" t="inlineStr"><is><t>PROJECT</t></is></c><c r="AA2" t="str"><v>State</v></c></row>'
    '<row r="3"><c r="A3" t="inlineStr"><is><t>2024/1</t></is></c><c r="B3" t="s"><v>2</v></c><c r="C3"><v>9</v></c><c r="D3"><v>45366</v></c><c r="E3" t="inlineStr"><is><t>second of a name</t></is></c><c r="AA3" t="str"><f>x</f><v>NSW</v></c></row>'
    '<row r="5"><c r="A5"><v>7.50</v></c><c r="B5" t="b"><v>1</v></c><c r="D5" t="e"><v>#REF!</v></c></row><row r="6"/><row><c><v>1e3</v></c><c t="inlineStr"><is/></c></row>'
)


def test_cells_and_headers(spark):
    files = spark.createDataFrame([("a.xlsx", workbook(SHEET, STRINGS)), ("b.xlsx", b"no container"), ("c.xlsx", workbook(SHEET, "<si/>")), ("d.xlsx", workbook("")), ("e.xlsx", workbook(SHEET, STRINGS)[:300])], "path string, content binary")
    rows = workbook_rows(files)
    got = {r["row"]: r["cells"] for r in rows.filter("path = 'a.xlsx'").collect()}
    assert got[3] == {"epbc no": "2024/1", "project": "Sunny Solar & Co", "valid date": "45366", "state": "NSW"}
    assert got[5] == {"epbc no": "7.5", "project": "TRUE", "valid date": None, "state": None} and got[7] == {"epbc no": "1000", "project": "", "valid date": None, "state": None}
    assert set(got) == {3, 5, 7}
    assert {r["path"]: r["row"] for r in rows.filter("error is not null").collect()} == {"b.xlsx": None, "c.xlsx": None, "e.xlsx": None}
    uploaded = {r["epbc_number"]: r for r in referrals.upload_rows(sheet_columns(rows.filter("path = 'a.xlsx'")), "u/").collect()}
    assert uploaded["2024/1"]["referral_date"] == "2024-03-15" and uploaded["2024/1"]["state"] == "NSW" and uploaded["1000"]["project_name"] == "1000"


def test_files_through_spark(spark, tmp_path):
    for name in ("one.xlsx", "deep/two.xlsx", "three.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(workbook(SHEET, STRINGS, "sheets/s.xml"))
    rows = workbook_rows(read_workbooks(spark, str(tmp_path)))
    assert sorted((r["path"].rsplit("/", 1)[1], r["row"]) for r in rows.collect()) == [(f, n) for f in ("one.xlsx", "two.xlsx") for n in (3, 5, 7)]


def test_first_alias_wins(spark):
    """A field's first alias that is a header counts, even where its cell is empty."""
    sheet = '<row><c t="inlineStr"><is><t>Title</t></is></c><c t="inlineStr"><is><t>Project Name</t></is></c></row><row><c t="inlineStr"><is><t>from title</t></is></c></row>'
    got = sheet_columns(workbook_rows(spark.createDataFrame([("a", workbook(sheet))], "path string, content binary"))).collect()
    assert [(r["project"], r["epbc number"]) for r in got] == [(None, None)]


def test_long_sheets_go_by_row(spark):
    sheet = '<row><c t="str"><v>EPBC</v></c></row>' + "".join(f"<row><c><v>{i}</v></c></row>" for i in range(60_000))
    got = workbook_rows(spark.createDataFrame([("a", workbook(sheet))], "path string, content binary"))
    assert got.count() == 60_000 and got.agg({"row": "max"}).first()[0] == 60_001
