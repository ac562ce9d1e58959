"""Workbooks that the test writes as plain zip and XML, layouts, and SQL scripts."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracelake.operators import lineage as ln
from tracelake.sources import layout as lay, workbooks as wb

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write(path, sheets):
    """sheets: [(name, xml of the rows)]."""
    path.parent.mkdir(exist_ok=True)
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" * (i % 2)}w/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r><rPh><t>no</t></rPh></si></sst>")
        for i, (_, rows) in enumerate(sheets):
            z.writestr(f"xl/w/s{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")


ROWS = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"/></row>'
    '<row r="3"><c r="B3"><v>20</v></c><c r="AA3" t="inlineStr"><is><t>a,"b"</t></is></c></row><row r="4"><c t="b"><v>1</v></c><c t="str"><v>f</v></c></row>'
)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    top = tmp_path_factory.mktemp("archive")
    write(top / "SRC_STGDIH" / "STG_A.xlsx", [("DDL", ""), ("STG_A", ROWS)])
    write(top / "SRC_STGDIH" / "only_ddl.xlsx", [(" ddl ", ROWS)])
    write(top / "STGDIH_DWHDIH" / "DWH_A.xlsx", [("dwh_a", "")])
    write(top / "elsewhere" / "X.xlsx", [("X", ROWS), ("x ", ROWS)])
    (top / "SRC_STGDIH" / "broken.xlsx").write_bytes(b"no zip")
    (top / "SRC_STGDIH" / "~$STG_A.xlsx").write_bytes(b"lock")
    (top / "v.sql").write_text("create view v as\nselect 1")
    return top


def test_rows(spark, archive):
    rows = wb.sheet_rows(spark, str(archive))
    got = rows.where("sheet = 'STG_A'").orderBy("ord").collect()
    assert [r.cells for r in got] == [["one", None, "two"], [None, "20", *[None] * 24, 'a,"b"'], ["True", "f"]]
    bad = rows.where("error is not null").collect()
    assert len(bad) == 1 and bad[0].path.endswith("/broken.xlsx") and bad[0].cells is None
    text = wb.sheet_text(rows.where("sheet = 'STG_A'")).first().text
    assert text.split("\n") == ["one,,two" + "," * 24, ",20" + "," * 25 + '"a,""b"""', "True,f" + "," * 25, ""]


def test_catalog(spark, archive):
    rows = wb.sheet_rows(spark, str(archive))
    files = wb.tables(rows, lay.DEFAULT)
    assert {(r.stage_dir, r.stem, r.table, r.sheet) for r in files.collect()} == {("SRC_STGDIH", "STG_A", "STG_A", "STG_A"), ("SRC_STGDIH", "only_ddl", "only_ddl", " ddl "), ("STGDIH_DWHDIH", "DWH_A", "dwh_a", "dwh_a")}
    found = ln.catalog(files, lay.DEFAULT.hops_frame(spark), list(lay.DEFAULT.stages)).select("table_key", "to_stage").collect()
    assert {tuple(r) for r in found} == {("STG_A", "staging"), ("ONLY_DDL", "staging"), ("DWH_A", "dwh")}
    last = wb.final_sheets(rows.where(F.endswith("path", F.lit("X.xlsx")))).collect()
    assert [(r.sheet_key, r.sheet) for r in last] == [("X", "x ")]


def test_scripts(spark, archive):
    got = wb.sql_texts(spark, str(archive)).collect()
    assert [(r.path.rpartition("/")[2], r.text) for r in got] == [("v.sql", "create view v as\nselect 1")]


def test_layout(spark, archive, tmp_path):
    assert lay.load(spark, str(archive)) == lay.DEFAULT and lay.DEFAULT.last_dir == "STGDIH_DWHDIH"
    good = {"stages": ["a", "b"], "hops": [{"dir": "H", "from": "a", "to": "b"}], "non_hop_sheets": [" ddl"]}
    (tmp_path / "archive.json").write_text(json.dumps(good))
    assert lay.load(spark, str(tmp_path)).non_hop_sheets == {"DDL"}
    for change in ({"stages": []}, {"hops": []}, {"hops": [{"dir": "H", "from": "a", "to": "c"}]}, {"hops": [{"from": "a", "to": "b"}]}, {"hops": [{"dir": "H", "to": "b"}]}, {"cloud": {"stage": "z"}}):
        with pytest.raises(lay.LayoutError):
            lay.parse(json.dumps(good | change))
    with pytest.raises(lay.LayoutError):
        lay.parse("{")
