"""Workbooks and presentations: files of all kinds of cells against what they say, by bytes and through the data sources."""

from __future__ import annotations

import datetime as dt
import io
import random
import zipfile

import pytest

from sagebase.operators import grid
from sagebase.plans import sheets
from sagebase.sources import files, ooxml

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(bodies: dict[str, str], strings: str = "", styles: str = "", extra: str = "", order: list[int] | None = None) -> bytes:
    names = list(bodies)
    order = order or list(range(len(names)))
    parts = {f"xl/worksheets/sheet{k}.xml": f"<worksheet {MAIN}>{bodies[n]}</worksheet>" for k, n in enumerate(names)}
    parts["xl/workbook.xml"] = f"<workbook {MAIN} {REL}>{extra}<sheets>" + "".join(f'<sheet name="{names[k]}" sheetId="{k + 9}" r:id="id{k}"/>' for k in order) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="id{k}" Target="/xl/worksheets/sheet{k}.xml"/>' for k in order) + "</Relationships>"
    if strings:
        parts["xl/sharedStrings.xml"] = f"<sst {MAIN}>{strings}</sst>"
    if styles:
        parts["xl/styles.xml"] = f"<styleSheet {MAIN}>{styles}</styleSheet>"
    return sheets.zipped(parts)


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;年&quot;m"/><numFmt numFmtId="165" formatCode="&quot;day&quot; 0.0[Red]"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
CELLS = """<sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="E2"/></row>
<row><c t="inlineStr"><is><t>in</t></is></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1&amp;"x"</f><v>fx</v></c></row>
<row r="9"><c r="A9"><v>42</v></c><c r="B9"><v>1.5</v></c><c r="C9" s="1"><v>60</v></c><c r="D9" s="2"><v>45000.75</v></c><c r="E9" s="3"><v>7</v></c><c r="F9" t="d"><v>2024-02-29T10:00:00</v></c><c r="AA9" s="1"><v>59</v></c><c r="AB9"><f>1+1</f><v>2</v></c></row></sheetData>
<mergeCells><mergeCell ref="A9:A11"/><mergeCell ref="B2:C2"/></mergeCells>"""
STRINGS = "<si><t> plain </t></si><si><r><rPr><b/></rPr><t>two </t></r><r><t>runs</t></r><rPh><t>reading</t></rPh></si>"


def values(rows):
    cells, merges = ooxml.sheets(rows)
    return {(r.path, r.sheet_no, r.sheet, r.r, r.c): r.value for r in cells.collect()}, {tuple(r) for r in merges.collect()}


def test_cells_of_every_kind(spark):
    data = [("a.xlsx", book({"later": "<sheetData/>", "s & t".replace("&", "&amp;"): CELLS}, STRINGS, STYLES, order=[1, 0])), ("b.xlsx", book({"x": CELLS.replace('s="2"', 's="0"')}, STRINGS, STYLES, '<workbookPr date1904="1"/>')), ("c.xlsx", b"not a file"), ("d.xlsx", None), ("e.xlsx", book({"x": '<sheetData><row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>5</v></c></row></sheetData>'}))]
    broken = io.BytesIO(data[0][1][:-40])
    rows = ooxml.parsed(spark.createDataFrame([*data, ("f.xlsx", broken.getvalue())], "path string, bytes binary"), "xlsx")
    got, merges = values(rows)
    first = {k[3:]: v for k, v in got.items() if k[0] == "a.xlsx"}
    assert {k[1:3] for k in got if k[0] == "a.xlsx"} == {(1, "s & t")}
    assert first == {(1, 1): "plain", (1, 2): "two runs", (1, 4): "", (2, 0): "in", (2, 1): "true", (2, 2): "", (2, 3): "fx", (8, 0): "42", (8, 1): "1.5", (8, 2): "1900-02-28", (8, 3): "2023-03-15", (8, 4): "7", (8, 5): "2024-02-29", (8, 26): "1900-02-28", (8, 27): "2"}
    second = {k[3:]: v for k, v in got.items() if k[0] == "b.xlsx"}
    assert second[8, 2] == "1904-03-01" and second[8, 3] == "45000.75"
    assert {m[3:] for m in merges if m[0] == "a.xlsx"} == {(8, 0, 10, 0), (1, 1, 1, 2)}
    assert {r.path for r in ooxml.failures(rows).collect()} == {"c.xlsx", "d.xlsx", "e.xlsx", "f.xlsx"}
    assert got["e.xlsx", 1, "x", 0, 0] == "1"
    assert ooxml.parsed(spark.createDataFrame([], "path string, bytes binary"), "xlsx").count() == 0


def test_days():
    assert ooxml.day(1, False) == dt.date(1900, 1, 1) and ooxml.day(61, False) == dt.date(1900, 3, 1) and ooxml.day(45292, False) == dt.date(2024, 1, 1)
    assert ooxml.day(0, True) == dt.date(1904, 1, 1) and ooxml.day(1e12, False) is None
    assert [ooxml.shows_date(x) for x in ("yyyy-mm-dd", "0.00", "h:mm", '"d"0', "[Red]0", "General", r"\d0", "0;yyyy", "[$-409]d-mmm")] == [True, False, True, False, False, False, False, False, True]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.xlsx").write_bytes(book({"x": CELLS}, STRINGS, STYLES))
    (tmp_path / "in" / "B.XLSX").write_bytes(book({"y": CELLS}, STRINGS, STYLES))
    (tmp_path / "in" / "c.txt").write_text("no")
    (tmp_path / "bad.xlsx").write_bytes(b"PK")
    import pandas as pd

    deck = pd.DataFrame({"page_num": [2, 1, 3], "title": ["公司", "公司", "公司"], "markdown": ["two & <2>", "one", ""]})
    (tmp_path / "d.pptx").write_bytes(sheets.presentation_file(deck))
    return str(tmp_path)


def test_data_sources(spark, folder, monkeypatch):
    """The same rows as from bytes, in as many partitions as the size asks for."""
    ooxml.register(spark)
    by_bytes = ooxml.parsed(files.read_files(spark, folder).where("kind = 'xlsx'"), "xlsx")
    name = lambda rows: sorted((r.path.rsplit("/", 1)[1], *[str(x) for x in r[1:-1]], r.error is None) for r in rows.collect())
    by_source = spark.read.format("workbook").load(folder)
    assert name(by_source) == name(by_bytes) and by_source.count() > 30
    assert spark.read.format("workbook").load("file://" + folder).where("kind = 'MERGE'").count() == 4
    assert {r.path.rsplit("/", 1)[1] for r in ooxml.failures(by_source).collect()} == {"bad.xlsx"}
    monkeypatch.setattr(ooxml, "PARTITION_BYTES", 1)
    assert len(ooxml.FilesReader("xlsx", folder).partitions()) == 3
    monkeypatch.undo()
    assert len(ooxml.FilesReader("xlsx", folder).partitions()) == 1
    slides = {r.page_num: r.markdown for r in spark.read.format("presentation").load(folder).collect()}
    assert slides == {1: "# 公司\none", 2: "# 公司\ntwo & <2>", 3: "# 公司\n"}
    pieces = ooxml.presentation_pieces(spark.read.format("presentation").load(folder + "/d.pptx")).collect()
    assert {(r.page_num, r.title) for r in pieces} == {(1, "one"), (2, "two & <2>"), (3, "公司")}


def test_slides_with_tables_and_groups(spark):
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell('k')}{cell('v')}</a:tr><a:tr>{cell('1')}{cell('2')}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    group = "<p:grpSp><p:sp><p:txBody><a:p><a:r><a:t>in a </a:t></a:r><a:r><a:t>group</a:t></a:r><a:br/><a:r><a:t>next</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp>"
    parts = {
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" {REL}><p:sldIdLst><p:sldId id="256" r:id="q"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="q" Target="slides/one.xml"/><Relationship Id="w" Target="https://example.org" TargetMode="External"/></Relationships>',
        "ppt/slides/one.xml": f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{group}{table}</p:spTree></p:cSld></p:sld>',
    }
    rows = ooxml.parsed(spark.createDataFrame([("x.pptx", sheets.zipped(parts)), ("y.pptx", b"")], "path string, bytes binary"), "pptx").collect()
    assert {(r.path, r.markdown) for r in rows} == {("x.pptx", "in a group\nnext\n| k | v |\n| --- | --- |\n| 1 | 2 |"), ("y.pptx", None)}


def brute_pieces(cells, merges):
    """A sheet's table by plain loops over a matrix: caption, header, rows."""
    height = max([r for r, _ in cells] + [m[2] for m in merges]) + 1
    width = max([c for _, c in cells] + [m[3] for m in merges]) + 1
    grid_ = [[cells.get((r, c), "") for c in range(width)] for r in range(height)]
    full = lambda row: [v for v in row if v.strip()]
    header = next((r for r, row in enumerate(grid_) if len(full(row)) > 1), None)
    frozen = set()
    for r1, c1, r2, c2 in merges:
        for r in range(r1, r2 + 1):
            for c in range(c1, c2 + 1):
                if (r, c) != (r1, c1):
                    grid_[r][c] = grid_[r1][c1] if c1 == c2 else ""
                    frozen |= {(r, c)} if c1 != c2 else set()
    for r in range(1, height):
        for c in range(width):
            if r - 1 != header and (r, c) not in frozen and grid_[r][c] == "":
                grid_[r][c] = grid_[r - 1][c]
    caption, head, rows = "", None, []
    for row in grid_:
        if not full(row):
            continue
        if head is None:
            if len(full(row)) == 1:
                caption = full(row)[0]
            else:
                head = [v.strip() or f"列{k + 1}" for k, v in enumerate(row)]
        else:
            rows.append(row)
    return (caption, head, rows) if head and rows else None


def test_workbooks_to_tables_by_brute_force(spark):
    rng = random.Random(3)
    data, want = [], {}
    for k in range(60):
        cells = {(r, c): rng.choice(["a", "b c", "x"]) for r in range(rng.randint(1, 7)) for c in range(rng.randint(1, 4)) if rng.random() < 0.6} or {(0, 0): "z"}
        merges, taken = [], set()
        for _ in range(rng.randint(0, 3)):
            r1, c1 = rng.randint(0, 6), rng.randint(0, 3)
            r2, c2 = rng.choice([(r1 + rng.randint(1, 2), c1), (r1, c1 + 1), (r1 + 1, c1 + 1)])
            spot = {(r, c) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)}
            if not spot & taken:
                taken |= spot
                merges.append((r1, c1, r2, c2))
        rows = {}
        for (r, c), v in sorted(cells.items()):
            rows.setdefault(r, []).append(f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>')
        body = "<sheetData>" + "".join(f'<row r="{r + 1}">{"".join(x)}</row>' for r, x in rows.items()) + "</sheetData><mergeCells>" + "".join(f'<mergeCell ref="{chr(65 + a)}{b + 1}:{chr(65 + y)}{x + 1}"/>' for b, a, x, y in merges) + "</mergeCells>"
        data.append((f"{k}.xlsx", book({"s": body})))
        want[f"{k}.xlsx"] = brute_pieces(cells, merges)
    rows = ooxml.parsed(spark.createDataFrame(data, "path string, bytes binary"), "xlsx")
    found = {r.path: (r.caption, list(r.header), [list(x) for x in r.rows]) for r in grid.parsed_sheets(*ooxml.sheets(rows), ["path", "sheet_no", "sheet"]).collect()}
    assert found == {k: v for k, v in want.items() if v}
    pieces = {r.path: (r.title, r.page_num) for r in ooxml.workbook_pieces(rows).collect()}
    assert pieces == {k: (f"{k[:-5]} - s", 1) for k, v in want.items() if v}


def test_parsers_of_files(spark, folder):
    found = files.parsed(files.read_files(spark, folder), ooxml.PARSERS).collect()
    assert {r.path.rsplit("/", 1)[1] for r in found} == {"a.xlsx", "B.XLSX", "c.txt", "d.pptx"}


def test_blobs_by_their_store(spark, tmp_path):
    roots = {"local": str(tmp_path / "a"), "minio": "file://" + str(tmp_path / "b")}
    blobs = files.Blobs(spark, roots)
    for store, key, content in ((None, "1/raw/x.txt", b"one"), ("local", "1/raw/y.txt", b"two"), ("minio", "1/raw/x.txt", b"three"), ("minio", "z", b"")):
        blobs.put(store, key, content)
    blobs.put("local", "1/raw/y.txt", b"new")
    assert blobs.get("local", "1/raw/x.txt") == b"one" and blobs.get(None, "1/raw/y.txt") == b"new" and blobs.get("minio", "none") is None
    with pytest.raises(ValueError):
        blobs.put("ftp", "x", b"")
    rows = spark.createDataFrame([(1, None, "1/raw/x.txt"), (2, "local", "1/raw/y.txt"), (3, "minio", "1/raw/x.txt"), (4, "minio", "gone"), (5, "ftp", "x"), (6, "minio", "z")], "id int, storage_type string, key string")
    assert {r.id: None if r.bytes is None else bytes(r.bytes) for r in blobs.read(rows).collect()} == {1: b"one", 2: b"new", 3: b"three", 4: None, 5: None, 6: None}
    assert blobs.delete("minio", "z") and not blobs.delete("minio", "z")


def test_files_of_plain_rows():
    """Rows in any order, without a table of their own for each sheet."""
    rows = [(7, 2, 1, None, None, "NUMBER", None, 2.5, None, None), (7, 0, 0, None, None, "STRING", " a & b ", None, None, None), (3, 0, 0, None, None, "BOOLEAN", None, None, True, None)]
    rows += [(7, 2, 2, None, None, "NUMBER", None, 1.0, None, dt.date(1996, 9, 13)), (7, 2, 0, 3, 0, "MERGE", None, None, None, None)]
    got = [r[1:] for r in ooxml.workbook(io.BytesIO(sheets.workbook_file(iter(rows))))]
    assert got == [("3", 0, 0, None, None, "BOOLEAN", None, None, True, None), ("7", 0, 0, None, None, "STRING", " a & b ", None, None, None), ("7", 2, 1, None, None, "NUMBER", None, 2.5, None, None), ("7", 2, 2, None, None, "NUMBER", None, 35321.0, None, dt.date(1996, 9, 13)), ("7", 2, 0, 3, 0, "MERGE", None, None, None, None)]
    deck = sheets.deck_file(iter([(2, "t2", "b"), (1, "t1", "a\nc")]))
    assert list(ooxml.presentation(io.BytesIO(deck))) == [(1, "# t1\na\nc"), (2, "# t2\nb")]
