"""Whole runs over small archives that the test writes, with the grid reader in the extractor's place."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tracelake import cli
from tracelake.operators import checks
from tracelake.operators import lineage as ln
from tracelake.operators import store as st
from tracelake.plans import archive as runs
from tracelake.plans import scoring
from tracelake.sinks import documents, workbook
from tracelake.sources import extractors as ex
from tracelake.sources import kinds
from tracelake.sources import layout as lay
from tracelake.sources import workbooks as wb
from tracelake.streaming.arrivals import convert_arrivals

COLUMNS = [("PARTY_ID", "VARCHAR2", "20"), ("OPEN_DT", "DATE", "8")]
HOPS = [("SRC_STG", "STG_PARTY", "RAW_PARTY"), ("STG_DWH", "DWH_PARTY", "STG_PARTY")]
SHAPE = {"stages": ["source", "staging", "dwh"], "hops": [{"dir": "SRC_STG", "from": "source", "to": "staging"}, {"dir": "STG_DWH", "from": "staging", "to": "dwh"}], "non_hop_sheets": ["DDL"]}
FOUR = SHAPE | {"stages": [*SHAPE["stages"], "cloud"], "cloud": {"glob": "*CLOUD*.xlsx", "stage": "cloud", "table_prefixes": ["DWH_"]}}


def sheet(path, rows, lines=None):
    """A workbook of one sheet; the sheet's name stays Sheet1, so the file's name names the table."""
    path.parent.mkdir(parents=True, exist_ok=True)
    workbook.write(workbook.Sheet([], rows, 1, [10], 1), str(path))
    return path


def hop(path, target, source):
    rows = [["Target Table Name", target], [], ["Target Column", "Target Datatype", "Target Size", "Source Table", "Source Column", "Notes"]]
    return sheet(path, rows + [[c, d, s, source, c, "1-1"] for c, d, s in COLUMNS])


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers do not have this module


class Counted(ex.Grid):
    """The grid reader, which fails on one table."""

    def records(self, kind, text):
        if "STG_BROKEN" in text:
            raise RuntimeError("x" * 500)
        return super().records(kind, text)


def build(top, final):
    for folder, target, source in HOPS:
        hop(top / folder / f"{target}.xlsx", target, source)
    rename(top)
    if final:
        rows = [["Cloud table", "PARTY"], [], ["Column", "Datatype", "Length", "Nullable", "Description"]]
        sheet(top / "Mapping_to_CLOUD.xlsx", rows + [[c, d, s, "Y", f"about {c}"] for c, d, s in COLUMNS])
        rename(top, {"Mapping_to_CLOUD": "PARTY"})
    return str(top)


def rename(top, names=None):
    """Gives the one sheet of each workbook a name: its file's, or the one given."""
    import zipfile

    for p in top.rglob("*.xlsx"):
        with zipfile.ZipFile(p) as z:
            parts = {n: z.read(n) for n in z.namelist()}
        name = (names or {}).get(p.stem, p.stem).encode()
        parts["xl/workbook.xml"] = parts["xl/workbook.xml"].replace(b'name="Sheet1"', b'name="' + name + b'"')
        with zipfile.ZipFile(p, "w") as z:
            for n, c in parts.items():
                z.writestr(n, c)


@pytest.fixture(scope="module")
def cases(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("runs")
    out = {}
    for name, final, shape in (("A", True, FOUR), ("B", False, FOUR), ("C", False, SHAPE)):
        root = build(top / name, final)
        out[name] = runs.archive(spark, root, st.ExtractionStore(spark, str(top / f"kept-{name}"), Counted()), lay.parse(json.dumps(shape)))
    return out


def chains(result):
    return [[(e.stage, e.table, e.column) for e in r.lineage] for r in result.records.orderBy("rec_id").collect()]


def test_three_cases(cases):
    """A final stage that is there, one that is declared and missing, and none."""
    three = lambda c: [("source", "RAW_PARTY", c), ("staging", "STG_PARTY", c), ("dwh", "DWH_PARTY", c)]
    assert chains(cases["A"]) == [[*three(c), ("cloud", "PARTY", c)] for c, *_ in COLUMNS]
    assert chains(cases["B"]) == chains(cases["C"]) == [three(c) for c, *_ in COLUMNS]
    a, b, c = (cases[n].coverage.first().asDict() for n in "ABC")
    assert (a["complete_chains"], b["complete_chains"], c["complete_chains"]) == ("2/2 (100%)", "0/2 (0%)", "2/2 (100%)")
    assert (a["stage_cloud"], b["stage_cloud"]) == ("2/2 (100%)", "0/2 (0%)") and "stage_cloud" not in c
    assert a["datatype_cloud"] == "2/2 (100%)" and b["datatype_cloud"] is None
    assert a["with_description"] == "2/2 (100%)" and b["with_description"] == "0/2 (0%)" and a["distinct_target_fields"] == 2 and a["n_to_1_target_fields"] == 0
    ends = cases["B"].chains.first()
    assert (ends.complete_chains, ends.chains, ends.unmatched_tails_count, ends.unmatched_tails_examples) == (0, 2, 2, "dwh: DWH_PARTY.OPEN_DT; dwh: DWH_PARTY.PARTY_ID")
    last = cases["A"].records.orderBy("rec_id").first().lineage[-1]
    assert last.constraint == "Y" and last.offline_path.endswith("Mapping_to_CLOUD.xlsx") and last.sources == []
    reports = {(r.path.rpartition("/")[2], r.sheet): r for r in cases["A"].reports.collect()}
    assert len(reports) == 3 and all(r.errors == [] and not r.cached for r in reports.values())
    m = reports["DWH_PARTY.xlsx", "DWH_PARTY"].metrics
    assert (m.fields_covered, m.records_emitted, m.schema_clean_records, m.fidelity_verified) == ("2/2", 2, "2/2", "8/8")


def test_what_is_kept_and_what_fails(spark, tmp_path):
    root = tmp_path / "arch"
    build(root, False)
    hop(root / "STG_DWH" / "DWH_OTHER.xlsx", "DWH_OTHER", "STG_BROKEN")
    hop(root / "SRC_STG" / "STG_UNUSED.xlsx", "STG_UNUSED", "X")
    sheet(root / "STG_DWH" / "DWH_EMPTY.xlsx", [])
    rename(root)
    shape = lay.parse(json.dumps(SHAPE))
    run = lambda: runs.archive(spark, str(root), st.ExtractionStore(spark, str(tmp_path / "kept"), Counted()), shape)
    first = {r.path.rpartition("/")[2]: r for r in run().reports.collect()}
    assert set(first) == {"DWH_PARTY.xlsx", "STG_PARTY.xlsx", "DWH_OTHER.xlsx", "DWH_EMPTY.xlsx"}  # what no chain comes to is not converted
    assert first["DWH_OTHER.xlsx"].errors == ["extraction failed - RuntimeError: " + "x" * 200] and first["DWH_OTHER.xlsx"].metrics is None
    assert first["DWH_EMPTY.xlsx"].errors == ["empty sheet"] and not first["DWH_PARTY.xlsx"].cached
    (root / "STG_DWH" / "DWH_PARTY.xlsx").rename(root / "STG_DWH" / "DWH_PARTY_V2.xlsx")
    again = run()
    second = {r.path.rpartition("/")[2]: r for r in again.reports.collect()}
    assert second["DWH_PARTY_V2.xlsx"].cached and second["STG_PARTY.xlsx"].cached and not second["DWH_OTHER.xlsx"].cached and again.records.count() == 2
    rolled = checks.roll_up(again.reports, []).first()
    assert (rolled.files, rolled.converted, rolled.failed) == (4, 2, 2)
    with pytest.raises(runs.RunError, match="DWH_NONE"):
        runs.archive(spark, str(root), st.ExtractionStore(spark, str(tmp_path / "kept"), Counted()), shape, ["dwh_party ", "DWH_NONE"])
    with pytest.raises(runs.RunError):
        runs.archive(spark, str(tmp_path / "nothing"), st.ExtractionStore(spark, str(tmp_path / "kept"), Counted()), shape)


def test_sinks_and_score(spark, cases, tmp_path):
    a = cases["A"]
    out, xlsx = str(tmp_path / "o.json"), str(tmp_path / "o.xlsx")
    assert documents.write_document(a.records, out) == 2
    made = json.load(open(out, encoding="utf-8"))
    assert list(made[0]) == ["description", "lineage"] and made[0]["lineage"][0]["datatype"] == "VARCHAR2" and made[0]["lineage"][0]["constraint"] is None
    assert list(made[0]["lineage"][2]["sources"][0]) == ["table", "column", "transformation_type", "transformation_logic", "role"]
    documents.write_lines(a.records, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    workbook.write_archive(a.records, a.stages, xlsx)
    rows = wb.sheet_rows(spark, xlsx, "*").orderBy("ord").collect()
    assert [r.line for r in rows] == [1, 2, 3, 4] and rows[0].cells[::5] == ["Source", "Staging", "Dwh", "Cloud"]
    assert rows[2].cells[10:13] == ["DWH_PARTY", "PARTY_ID", a.records.first().lineage[2].offline_path] and rows[2].cells[20] == "about PARTY_ID" and rows[2].cells[22] == "1-1"
    # the dictionary against itself as the truth: captions in line 2, records after it
    same = scoring.compare(spark, xlsx, out)
    assert (same["manual_rows"], same["program_rows"], same["matched_rows"], same["mismatches"], same["rows_only_in_manual"]) == (2, 2, 2, [], [])
    assert same["overall_field_accuracy"].endswith("(100.0%)") and same["by_column"]["dwh_path"] == "2/2 (100%)" and same["by_column"]["logic"] == "2/2 (100%)"
    made[0]["lineage"][2]["size"] = "21"
    made[1]["lineage"][1]["column"] = "OTHER"
    json.dump(made, open(out, "w", encoding="utf-8"))
    other = scoring.compare(spark, xlsx, out)
    assert other["matched_rows"] == 1 and other["rows_only_in_program"] == 1 and other["rows_only_in_manual"] == ["DWH_PARTY.OPEN_DT <- STG_PARTY.OPEN_DT"]
    assert other["mismatches"] == [{"row": "DWH_PARTY.PARTY_ID <- STG_PARTY.PARTY_ID", "column": "dwh_size", "manual": "20", "program": "21"}]


VIEW = 'CREATE VIEW "V" ("A","B") AS SELECT x.a, upper(b) FROM s.BASE x'
UPPER = "create view w (c) as select A from V"


def recorded():
    row = lambda t, c, st_, sc, **more: {"target_table": t, "target_column": c, "source_schema": None, "source_table": st_, "source_column": sc, "source_alias": None, "source_role": None, "transformation_logic": "direct"} | more
    v = [row("V", "A", "BASE", "a", source_alias="x"), row("V", "B", "BASE", "b", source_role="wrong"), row("V", "ZQ", None, None)]
    return ex.Recorded({ex.text_key("view_sql", VIEW): f"```json\n{json.dumps(v)}\n```", ex.text_key("view_sql", UPPER): json.dumps([row("w", "c", "v", "a")])})


def test_views(spark, tmp_path):
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "v.sql").write_text(VIEW)
    (tmp_path / "sql" / "w.sql").write_bytes(UPPER.encode() + b"\xff")
    result = runs.views(spark, str(tmp_path / "sql"), st.ExtractionStore(spark, str(tmp_path / "kept"), recorded()))
    assert result.targets == ["v.sql", "w.sql"]
    got = [(r.lineage[-1].column, len(r.lineage), r.resolved_source and (r.resolved_source.table, r.resolved_source.column, r.resolved_source.via)) for r in result.records.orderBy("rec_id").collect()]
    assert got == [("A", 2, None), ("B", 2, None), ("ZQ", 1, None), ("c", 2, ("BASE", "a", ["V.A"]))]
    by = {r.path.rpartition("/")[2]: r for r in result.reports.collect()}
    assert "expected 2 target fields, got 3 from 3 records" in by["v.sql"].errors and "record 1: role source_role" in by["v.sql"].errors
    assert any("'ZQ' is not in the source" in e for e in by["v.sql"].errors) and by["w.sql"].metrics.fields_covered == "1/unknown"
    report = cli.summary(result)
    assert report["views_chained_to_origin"] == 1 and report["mode"] == "sql" and all(p.startswith("v.sql: ") for p in report["source_errors"])
    cli.print_summary(report)
    wide = result.records.select("rec_id", *ln.view_wide_row()).orderBy("rec_id").collect()
    assert (wide[0].alias, wide[0].path, wide[3].ultimate, wide[3].via, wide[2].source_table) == ("x", "v.sql", "BASE.a", "V.A", None)
    out, truth = str(tmp_path / "o.json"), tmp_path / "truth.xlsx"
    documents.write_document(result.records, out, views=True)
    sheet(truth, [["Source schema", "ource Table", "Source Column", "View Name", "View Column", "Role", "Transformation", "Đường dẫn"], [None, "base", "A", "v", "a", "VALUE", "Direct", "/x/v.sql"], [None, "BASE", "zzz", "V", "B", "value", "direct", "v.sql"]])
    got = scoring.compare_views(spark, str(truth), out)
    assert got["matched_rows"] == 1 and got["by_column"]["source_table"] == "1/1 (100%)" and got["by_column"]["role"] == "1/1 (100%)" and got["by_column"]["transformation"] == "1/1 (100%)" and got["by_column"]["path"] == "1/1 (100%)"
    workbook.write_views(result.records, str(tmp_path / "o.xlsx"))
    assert wb.sheet_rows(spark, str(tmp_path / "o.xlsx"), "*").count() == 5
    with pytest.raises(FileNotFoundError):
        wb.sql_texts(spark, str(tmp_path / "kept-not"))


def test_command_line(spark, tmp_path, monkeypatch):
    root = build(tmp_path / "arch", True)
    (tmp_path / "arch" / "archive.json").write_text(json.dumps(FOUR))
    monkeypatch.chdir(tmp_path)
    args = lambda *x: cli.parse_args(["build", *x])
    assert cli.build(spark, args("--archive", root, "--cache", str(tmp_path / "kept"))) == 0
    report = json.load(open("report.json", encoding="utf-8"))
    assert report["targets"] == ["DWH_PARTY"] and report["files_read"] == 3 and report["coverage"]["complete_chains"] == "2/2 (100%)" and report["source_errors"] == []
    assert cli.compare(spark, cli.parse_args(["compare", str(tmp_path / "output.xlsx"), str(tmp_path / "output.json")])) == 0
    assert json.load(open("compare.json", encoding="utf-8"))["matched_rows"] == 2
    assert cli.build(spark, args()) == 1 and cli.build(spark, args("--archive", root, "--table", "NO")) == 1 and cli.build(spark, args("--sql", str(tmp_path / "none"))) == 1


def test_kinds_and_extractors(spark):
    with pytest.raises(kinds.KindError):
        kinds.get("x")
    assert kinds.anchors("view_sql") is None and kinds.anchors("x") is None and len(kinds.anchors("hop_spec")) == 2
    good = dict(name="a", reader=kinds.EXCEL, fields=("x",), never_null=frozenset(), anchors=(("x",),), task="t")
    for change in ({"name": ""}, {"reader": "pdf"}, {"fields": ()}, {"never_null": frozenset("y")}, {"anchors": None}, {"anchors": ((),)}, {"anchors": (("X",),)}, {"task": " "}, {"reader": kinds.TEXT}, {"enums": {"y": ("a",)}}):
        with pytest.raises(kinds.KindError):
            kinds.Kind(**good | change)
    with pytest.raises(kinds.KindError):
        kinds.registry(kinds.Kind(**good), kinds.Kind(**good))
    asked = ex.Asked(lambda prompt: "```json\n[]```" if "hop\tx" in prompt else "{")
    assert asked.records("hop_spec", "hop\tx") == []
    df = spark.createDataFrame([("k1", "hop_spec", "hop\tx"), ("k2", "hop_spec", "y"), ("k3", "none", "y")], "content_key string, kind string, text string")
    got = {r.content_key: r for r in ex.converted(df, asked).collect()}
    assert got["k1"].records == "[]" and got["k1"].error is None and "JSONDecodeError" in got["k2"].error and "KindError" in got["k3"].error
    for tasks in ({}, kinds.KINDS | {"more": "x"}, {k: "" for k in kinds.KINDS}):
        with pytest.raises(kinds.KindError):
            ex.Asked(lambda p: p, tasks)


def test_shape_and_nested_fidelity(spark):
    good = {f: None for f in kinds.get("cloud_sheet").fields} | {"column": "C"}
    rows = [json.dumps(x) for x in (good, good | {"size": 3}, {k: v for k, v in good.items() if k != "size"}, good | {"more": 1}, good | {"column": None}, 5)]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    got = [r.e for r in df.select(checks.shape_errors(list(good), ["column"], texts=True).alias("e")).collect()]
    assert got == [[], ["size is no string but BIGINT"], ["missing size"], ["surplus more"], ["null column"], ["not an object"]]
    nested = json.dumps([{"lineage": [{"table": "T", "column": None, "sources": [{"column": "zz"}]}], "description": None}, 5])
    one = spark.createDataFrame([(nested, "T")], "r string, t string").select(checks.nested_fidelity("r", "t").alias("f")).first().f
    assert (one.checked, one.missing, one.nulls) == (2, ["record 0.lineage[0].sources[0].column: 'zz' is not in the source"], 2)


def test_composed_characters(spark):
    from tracelake.functions import keys as k

    df = spark.createDataFrame([("Đường".encode().decode(), " Đường "), (None, "")], "a string, b string")
    assert df.select((k.clean("a") == k.clean("b")).alias("x")).where("x").count() == 2


def test_dates(spark, tmp_path):
    path = sheet(tmp_path / "d.xlsx", [["a", "b", "c"]])
    import zipfile

    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    cells = b'<row r="2"><c r="A2" s="0"><v>45292</v></c><c r="B2" s="3"><v>45292.5</v></c><c r="C2"><v>1.5</v></c></row></sheetData>'
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b"</sheetData>", cells)
    parts["xl/styles.xml"] = parts["xl/styles.xml"].replace(b"</cellXfs>", b'<xf numFmtId="14"/></cellXfs>')
    with zipfile.ZipFile(path, "w") as z:
        for n, c in parts.items():
            z.writestr(n, c)
    assert wb.sheet_rows(spark, str(path), "*").where(F.col("ord") == 1).first().cells == ["45292", "2024-01-01 12:00:00", "1.5"]


def test_arrivals(spark, tmp_path):
    """What came by a stream is not converted again by a run, nor by the stream."""
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "v.sql").write_text(VIEW)
    store = st.ExtractionStore(spark, str(tmp_path / "kept"), recorded())
    for _ in range(2):
        convert_arrivals(spark, str(tmp_path / "sql"), "view_sql", store, str(tmp_path / "seen"), once=True).awaitTermination()
    result = runs.views(spark, str(tmp_path / "sql"), store)
    assert [r.cached for r in result.reports.collect()] == [True] and result.records.count() == 3
