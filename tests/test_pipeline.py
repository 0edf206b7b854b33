import io
import tarfile
import zipfile

import pytest

from gridloom.operators import cells, classify, collate
from gridloom.plans.analyze import AnalyzeOptions, analyze_cells
from gridloom.plans.compose import compose_blocks, compose_cells, compose_long, traceback
from gridloom.plans.pipeline import PipelineState, read_cells
from gridloom.sources import html, ooxml, registry
from gridloom.sources.explore import explore, finding_stats, read_findings, well_names
from gridloom.streaming.folder import watch_folder

KIDS = [["Child", "Weight", "Age"], ["Mira", 12, 1.5], ["Otto", 16, 6]]
TWO = [["block 1", "", ""], ["", "A", "B"], ["C", 1, 3], ["D", 2, 4], ["", "", ""], ["block 2", "", ""], ["", "A", "B"], ["C", 10, 30], ["D", 20, 40]]
TIDY = [("1.5", "Age", "Mira"), ("12", "Weight", "Mira"), ("16", "Weight", "Otto"), ("6", "Age", "Otto")]
CSV = "Child,Weight,Age\nMira,12,1.5\nOtto,16,6\n"


def analysed(spark, rows):
    return analyze_cells(classify.numeric_values(cells.from_rows(spark, rows)))


def tidy(df, names=("N_1", "W_1")):
    return sorted((r["value"], r[names[0]], r[names[1]]) for r in df.collect())


def test_worked_example(spark):
    wide = compose_cells(analysed(spark, KIDS))
    assert tidy(wide) == TIDY
    assert {r["NW_WE_1"] for r in wide.collect()} == {"Child"}


def test_corner_of_two_by_two_loses_no_header(spark):
    rows = [["P", "Q", "A", "B"], ["R", "S", "C", "D"], ["x", "y", 1, 2], ["z", "w", 3, 4]]
    ca = analysed(spark, rows)
    wide = compose_cells(ca).collect()
    assert len(wide) == 4
    for r in wide:
        assert {"P", "Q", "R", "S"} <= set(r), r
    names = [tuple(r) for r in compose_long(ca).select("row", "col", "attr_name").collect()]
    assert len(names) == len(set(names))


def test_transposed_sheet_gives_the_same_rows(spark):
    turned = [list(r) for r in zip(*KIDS, strict=True)]
    assert tidy(compose_cells(analysed(spark, turned)), ("W_1", "N_1")) == TIDY


def test_two_blocks(spark):
    ca = analysed(spark, TWO)
    box = lambda df: sorted((r["r_min"], r["r_max"], r["c_min"], r["c_max"]) for r in df.collect())
    assert box(ca.sections) == [(3, 4, 2, 3), (8, 9, 2, 3)]
    assert box(ca.sections_full) == [(1, 4, 1, 3), (6, 9, 1, 3)] or len(box(ca.sections_full)) == 2
    found = {(r["value"], r["attr_name"]): r["attr_value"] for r in compose_long(ca).collect()}
    assert found["30", "N_1"] == "B" and found["30", "W_1"] == "C" and found["2", "W_1"] == "D"
    assert len(compose_blocks(ca)) == 2


def test_headers_on_other_sides(spark):
    rows = [[1, 2, "x"], [3, 4, "y"], ["p", "q", ""]]
    found = compose_cells(analysed(spark, rows))
    assert tidy(found, ("S_1", "E_1")) == [("1", "p", "x"), ("2", "q", "x"), ("3", "p", "y"), ("4", "q", "y")]


def test_upper_header_over_its_first_column(spark):
    rows = [["", "2001", "", "2002", ""], ["", "a", "b", "a", "b"], ["x", 1, 2, 3, 4], ["y", 5, 6, 7, 8]]
    c = cells.from_rows(spark, rows)
    typed = c.withColumn("type", classify.F.when(classify.F.col("row") > 2, classify.number_kind(classify.F.col("value"))).otherwise("attribute"))
    found = {(r["value"], r["attr_name"]): r["attr_value"] for r in compose_long(analyze_cells(typed)).collect()}
    assert [found[str(k), "N_2"] for k in (1, 2, 3, 4)] == ["2001", "2001", "2002", "2002"]


def test_blank_column_inside_a_table_joins(spark):
    rows = [["", "a", "b", "", "c"], ["x", 1, 2, "", 3], ["y", 4, 5, "", 6]]
    assert analysed(spark, rows).sections.count() == 1
    apart = analyze_cells(classify.numeric_values(cells.from_rows(spark, rows)), AnalyzeOptions(join_blocks=False))
    assert apart.sections.count() == 2


def test_traceback_names_the_header_cells(spark):
    found = {r["attr_name"]: (r["attr_row"], r["attr_col"]) for r in traceback(analysed(spark, KIDS), "sheet_1", 3, 2).collect()}
    assert found == {"N_1": (1, 2), "W_1": (3, 1), "NW_WE_1": (1, 1)}


def test_sheets_without_values_or_attributes(spark):
    assert analysed(spark, [["a", "b"]]).sections.count() == 0
    assert analysed(spark, [[1, 2]]).sections.count() == 0
    with pytest.raises(ValueError, match="type column"):
        analyze_cells(cells.from_rows(spark, KIDS))


def _xlsx():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="kids" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Child</t></si><si><t>Weight</t></si></sst>")
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        body = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>Age</t></is></c></row>'
        body += '<row><c r="A2" t="inlineStr"><is><t>Mira</t></is></c><c r="B2"><v>12</v></c><c r="C2"><v>1.5</v></c></row>'
        body += '<row><c r="A3" t="inlineStr"><is><t>Otto</t></is></c><c r="B3"><v>16</v></c><c r="C3"><v>6</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _docx():
    rows = "".join("<tr>" + "".join(f"<tc><p><r><t>{v}</t></r></p></tc>" for v in row) + "</tr>" for row in KIDS)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<document><tbl>{rows}</tbl></document>")
    return out.getvalue()


def _html():
    return "<html><table>" + "".join("<tr>" + "".join(f"<td><b>{v}</b></td>" for v in row) + "</tr>" for row in KIDS) + "</table></html>"


def _zip(name, raw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, raw)
    return out.getvalue()


def _tar(name, raw):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo(name)
        info.size = len(raw)
        t.addfile(info, io.BytesIO(raw))
    return out.getvalue()


def test_every_format_gives_the_same_rows(spark, tmp_path):
    files = {"a.csv": CSV.encode(), "b.tsv": CSV.replace(",", "\t").encode(), "c.txt": CSV.replace(",", ";").encode(), "d.csv": _html().encode(), "e.xlsx": _xlsx(), "f.docx": _docx(), "g.zip": _zip("in/k.csv", CSV), "h.tar": _tar("k.xlsx", _xlsx()), "i.bin": bytes(range(256))}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    findings = explore(spark, str(tmp_path)).persist()
    assert {r["file_type"] for r in findings.collect()} >= {"csv", "tsv", "txt", "html", "xlsx", "docx", "zip", "tar"}
    stats = finding_stats(findings).first()
    assert stats["files"] == 11
    got, errors = read_findings(findings)
    assert errors.count() == 0
    long = compose_long(analyze_cells(classify.numeric_values(got)))
    found = {}
    for r in long.where("attr_name in ('N_1', 'W_1')").collect():
        found.setdefault(r["sheet_id"], {}).setdefault((r["row"], r["col"], r["value"]), {})[r["attr_name"]] = r["attr_value"]
    assert len(found) == 8
    for name, values in found.items():
        assert sorted((k[2], v["N_1"], v["W_1"]) for k, v in values.items()) == TIDY, name
    assert {r["well_name"] for r in well_names(findings).collect()} >= {"a.csv", "g.zip/in/k.csv"}
    assert not explore(spark, str(tmp_path), max_depth=0).where("name = 'g.zip'").first()["is_explored"]


def test_read_cells_stops_resumes_and_falls_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    state = read_cells(spark, str(tmp_path), at_level="va_classify", simplify=False)
    assert isinstance(state, PipelineState) and state.stage == "va_classify"
    assert tidy(read_cells(spark, state, at_level="compose")) == TIDY
    assert "collated_1" in read_cells(spark, state, at_level="collate").columns
    with pytest.warns(UserWarning, match="could reach make_cells"):
        read_cells(spark, str(tmp_path), at_level="analyze", classifier=lambda c: 1 / 0)
    with pytest.raises(ValueError, match="at_level"):
        read_cells(spark, str(tmp_path), at_level="nothing")


def test_collation(spark):
    x = spark.createDataFrame([("1", "Mon", "Ann")], "value string, day string, name string")
    y = spark.createDataFrame([("2", "Ann", "Mon")], "value string, who string, weekday string")
    got = collate.collate_columns([x, y])
    assert sorted(tuple(r[c] for c in ("value", "collated_1", "collated_2")) for r in got.frame.collect()) == [("1", "Mon", "Ann"), ("2", "Mon", "Ann")]
    assert {m[2] for m in got.column_map} == {"n1", "n2"}
    assert collate.collate_columns([x]).frame.columns == ["value", "collated_1", "collated_2"]
    assert "uncollated_1" in collate.collate_columns([x, y], threshold=-1).frame.columns
    with pytest.raises(ValueError, match="no known format"):
        collate.collate_columns([])


def test_readers():
    assert html.tables("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == [[["a", "b"], ["", "c"]]]
    assert html.tables("no table") == []
    assert ooxml.xlsx(_xlsx())[0][0] == "kids"
    assert any(f[0] == "pdf" and f[4] == "" for f in registry.supported_formats())
    registry.register("pdf", "own", lambda raw: [])
    assert [n for n, _ in registry.readers("pdf")] == ["own"] and registry.readers("pdf", omit=("own",)) == []
    registry.READERS.pop("pdf")


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(CSV)
    got = []
    watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df, k: got.extend(df.collect())).awaitTermination()
    assert {(r["value"], r["attr_value"]) for r in got if r["attr_name"] == "N_1"} == {("12", "Weight"), ("1.5", "Age"), ("16", "Weight"), ("6", "Age")}
