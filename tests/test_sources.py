import zipfile

import pytest

from casebook.sources.docx import docx_passages, read_docx
from casebook.sources.headers import with_fields
from casebook.sources.sheets import UnsupportedFile, read_sheet

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def workbook(path, rows):
    cells = lambda row, n: "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + i)}{n}"><v>{v}</v></c>' for i, v in enumerate(row) if v is not None)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>" + "".join(f'<row r="{n}">{cells(r, n)}</row>' for n, r in enumerate(rows, 1)) + "</sheetData></worksheet>")


def test_csv_and_workbook_read_alike(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿SPS ID,Part_Number,Problem,Solution\nRX-1,0012,"a ""lid"", and\nmore",swap it\n,,,\nRX-2,1243951\n', encoding="utf-8")
    workbook(tmp_path / "a.xlsx", [["SPS ID", "Part_Number", "Problem", "Solution"], ["RX-1", "0012", 'a "lid", and\nmore', "swap it"], [None] * 4, ["RX-2", 1243951.0]])
    both = [sorted(tuple(r) for r in with_fields(read_sheet(spark, str(tmp_path / f))).select("sps_id", "part_number", "problem_description", "solution_text", "issue_type").collect()) for f in ("a.csv", "a.xlsx")]
    assert both[0] == both[1] == [("RX-1", "0012", 'a "lid", and\nmore', "swap it", ""), ("RX-2", "1243951", "", "", "")]
    with pytest.raises(UnsupportedFile):
        read_sheet(spark, "a.txt")


def document(path, body):
    styles = f'<w:styles {WORD}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {WORD}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)


def test_documents(spark, tmp_path):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Before any heading") + p("Scope", "H1") + f"<w:sdt><w:sdtContent>{p('Inside a control')}</w:sdtContent></w:sdt>"
    body += "<w:p><w:r><w:t>kept</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:tab/><w:t>added</w:t></w:r></w:ins></w:p>"
    body += f"<w:tbl><w:tr>{cell('lot')}{cell('mm')}</w:tr><w:tr>{cell('K1')}{cell('2.5')}</w:tr></w:tbl>" + p("Limits", "H1") + p("word " * 20)
    document(tmp_path / "a.docx", body)
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "b.docx").write_bytes(b"not a package")
    read = read_docx(spark, str(tmp_path))
    rows = [(r["document"], r["section"], r["kind"], r["text"]) for r in read.orderBy("document", "place").collect()]
    assert rows[:6] == [("a.docx", "", "paragraph", "Before any heading"), ("a.docx", "Scope", "heading", "Scope"), ("a.docx", "Scope", "paragraph", "Inside a control"), ("a.docx", "Scope", "paragraph", "kept added"), ("a.docx", "Scope", "table", "lot | mm\nK1 | 2.5"), ("a.docx", "Limits", "heading", "Limits")]
    assert rows[-1][0] == "b.docx" and rows[-1][2] is None
    cut = docx_passages(read.where("error IS NULL")).collect()
    assert [(r["heading"], r["n_words"]) for r in cut] == [("Limits", 20)]


def test_merged_cells_repeated_headings_and_long_tables(spark, tmp_path):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>{p(t)}</w:tc>"
    row = lambda *cells: f"<w:tr>{''.join(cells)}</w:tr>"
    start, on, wide = '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:gridSpan w:val="2"/>'
    merged = row(cell("Limits", wide), cell("Unit")) + row(cell("seam"), cell("Porosity", start), cell("2 percent")) + row(cell("edge"), cell("", on), cell("3 percent"))
    merged += row(cell("both", wide), cell("kg", start)) + row(cell("left"), cell("right"), cell("", on))
    merged += f'<w:tr><w:trPr><w:gridBefore w:val="2"/></w:trPr>{cell("", on)}</w:tr>'
    long = row(cell("number"), cell("rule")) + "".join(row(cell(f"no{i}"), cell("must hold at all times")) for i in range(100))
    document(tmp_path / "a.docx", p("Scope", "H1") + f"<w:tbl>{merged}</w:tbl>" + p("Table", "H1") + f"<w:tbl>{long}</w:tbl>" + p("Scope", "H1") + p("other words " * 10) + p("a last line"))
    read = read_docx(spark, str(tmp_path))
    lines = read.where("kind = 'table'").orderBy("place").first()["text"].split("\n")
    assert lines == ["Limits | Unit", "seam | Porosity | 2 percent", "edge | Porosity | 3 percent", "both | kg", "left | right | kg", "kg"]
    cut = docx_passages(read).orderBy("section", "chunk").collect()
    assert [(r["heading"], r["section"]) for r in cut] == [("Scope", 1), *[("Table", 2)] * 3, ("Scope", 3)]
    assert cut[0]["passage"].split("\n") == lines and cut[-1]["passage"].split("\n") == [("other words " * 10).strip(), "a last line"]
    rows = [r["passage"].split("\n") for r in cut[1:4]]
    assert all(x[0] == "number | rule" for x in rows) and [y for x in rows for y in x[1:]] == [f"no{i} | must hold at all times" for i in range(100)]


def test_workbooks_keep_their_own_headers(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["SPS ID", "Part_Number", "Problem", "Solution"], ["RX-1", "A-1", "lid", "swap"]])
    workbook(tmp_path / "b.xlsx", [["solution_text", "note", "partno", "problem", "id", "note"], ["turn", "n1", "B-2", "nut", "RX-2", "n2"], ["press", None, "B-3", "pin", "RX-3"]])
    workbook(tmp_path / "c.xlsx", [["id", "sps_id", "part_number", "partno", "problem", "solution", "file_name"], ["7", "RX-4", "C-4", "old", "cap", "file", "x"]])
    read = read_sheet(spark, str(tmp_path / "*.xlsx"))
    got = sorted(tuple(r) for r in with_fields(read).select("sps_id", "part_number", "problem_description", "solution_text").collect())
    assert got == [("RX-1", "A-1", "lid", "swap"), ("RX-2", "B-2", "nut", "turn"), ("RX-3", "B-3", "pin", "press"), ("RX-4", "C-4", "cap", "file")]
    notes = {r["SPS ID"]: (r["note"], r["note (2)"], r["id"], r["partno"], r["file_name (2)"]) for r in read.collect()}
    assert notes == {"RX-1": ("",) * 5, "RX-2": ("n1", "n2", "", "", ""), "RX-3": ("",) * 5, "RX-4": ("", "", "7", "old", "x")}


def test_csv_files_keep_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n,\n3,4\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("\ufeffy,x,\"more, of it\"\n2,1,z\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    read = read_sheet(spark, str(tmp_path / "*.csv"))
    rows = sorted((r["file_name"][-5:], r["row_no"], r["x"], r["y"], r["more, of it"]) for r in read.collect())
    assert rows == [("a.csv", 2, "1", "2", ""), ("a.csv", 4, "3", "4", ""), ("b.csv", 2, "1", "2", "z")]
    with pytest.raises(FileNotFoundError):
        read_sheet(spark, str(tmp_path / "c.csv"))


def test_documents_of_one_name_stay_apart(spark, tmp_path):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    for folder, title in (("one", "Alpha"), ("two", "Beta")):
        (tmp_path / folder).mkdir()
        document(tmp_path / folder / "s.docx", p(title, "H1") + p(f"text below {title} " * 5))
    read = read_docx(spark, f"{tmp_path}/*")
    assert sorted((r["document"], r["heading"], r["passage"]) for r in docx_passages(read).collect()) == [("s.docx", t, (f"text below {t} " * 5).strip()) for t in ("Alpha", "Beta")]
    assert {r["level"] for r in read.where("kind = 'heading'").collect()} == {1}


def test_package_names_its_parts(spark, tmp_path):
    relations = lambda *r: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{k}" Target="{t}"/>' for i, (k, t) in enumerate(r)) + "</Relationships>"
    p = lambda t, style: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("_rels/.rels", relations(("officeDocument", "/main/text.xml")))
        z.writestr("main/_rels/text.xml.rels", relations(("styles", "looks.xml")))
        z.writestr("main/text.xml", f"<w:document {WORD}><w:body>{p('Its title', 'T')}{p('Part', 'berschrift2')}<w:p><w:r><w:t>plain</w:t></w:r></w:p></w:body></w:document>")
        z.writestr("main/looks.xml", f'<w:styles {WORD}><w:style w:type="paragraph" w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:type="paragraph" w:styleId="berschrift2"><w:name w:val="heading 2"/></w:style><w:style w:type="paragraph" w:default="1" w:styleId="S"><w:name w:val="Normal"/></w:style></w:styles>')
    assert [(r["kind"], r["level"], r["text"]) for r in read_docx(spark, str(tmp_path)).orderBy("place").collect()] == [("heading", 0, "Its title"), ("heading", 2, "Part"), ("paragraph", None, "plain")]
