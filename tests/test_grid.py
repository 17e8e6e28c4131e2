"""Grids in one pass: a sheet's cells move once, whatever is made of them."""

from __future__ import annotations

import pytest

from sagebase.operators import grid, segment
from sagebase.plans import sheets

SF, KEYS = "/root/testdata/sf0.001", ["sheet"]
rows = lambda df: sorted(map(tuple, df.collect()))


def test_laid_as_expanded(spark):
    """Gaps, rows and columns that only regions reach, regions down, across and of one place, blank and null first cells: as the joins by place have them."""
    cells = spark.createDataFrame([(1, 0, 1, "a"), (1, 2, 0, None), (1, 2, 3, "b"), (1, 2, 2, "d"), (1, 5, 1, "x"), (2, 0, 0, "c"), (2, 1, 1, "e"), (2, 1, 0, " "), (3, 4, 2, "only"), (5, 1, 0, "p"), (5, 1, 1, "q")], "sheet long, r int, c int, value string")
    merges = spark.createDataFrame([(2, 0, 0, 1, 0), (1, 0, 1, 3, 1), (1, 2, 2, 4, 3), (1, 5, 1, 7, 1), (3, 0, 0, 0, 0), (3, 4, 1, 6, 1), (4, 1, 1, 2, 4), (5, 1, 0, 2, 0), (5, 3, 0, 4, 0)], "sheet long, r1 int, c1 int, r2 int, c2 int")
    at_once = grid.laid(grid.marks(cells, merges, KEYS), KEYS)
    joined = grid.expanded(grid.dense(cells, merges, KEYS), merges, KEYS, cells)
    assert rows(at_once.select("sheet", "r", "c", "value", "frozen")) == rows(joined)
    headers = grid.header_rows(cells, KEYS)
    assert rows(at_once.where("header is not null").select("sheet", "header").distinct()) == rows(headers)
    assert rows(grid.run_down(at_once, KEYS)) == rows(grid.filled(joined, headers, KEYS))
    twice = cells.unionByName(cells)
    assert rows(grid.laid(grid.marks(twice, merges, KEYS), KEYS)) == rows(at_once)


@pytest.mark.parametrize("name", ["sheet_merged_cells", "sheet_filled", "sheet_tables", "sheet_pieces"])
def test_orders_move_once(spark, name):
    plan = sheets.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Join") == 0


@pytest.mark.parametrize(("name", "moves"), [("workbook_cells", 1), ("workbook_pieces", 2)])
def test_workbooks_move_once(spark, name, moves):
    """Lines to files; for pieces, what is read from them to sheets."""
    plan = sheets.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == moves


def test_pieces_as_in_plain_python(spark):
    """Whole tables are put together by expressions: as segment.table_pieces does, also for blank captions, wide characters and sizes at the limit."""
    found = [(" cap", ["a", "b"], [["1", "2"], ["", "4"]]), ("　", ["a"], [["x"]]), ("", ["列1", "𝄞"], [["y" * k, "z"] for k in range(30)]), (" ", ["n"], [["m"]])]
    tables = spark.createDataFrame([(k, *t) for k, t in enumerate(found)], "sheet long, caption string, header array<string>, rows array<array<string>>")
    sizes = [len(segment.table_pieces(t, 10_000)[0]) for t in found]
    for size in (200, *sizes, sizes[0] - 1):
        want = sorted((k, n, p) for k, t in enumerate(found) for n, p in enumerate(segment.table_pieces(t, size)))
        assert rows(grid.sheet_pieces(tables, KEYS, size)) == want


def test_parts_read_whole_or_by_element(monkeypatch):
    """Small parts become one tree; rows are those read element by element, also up to where a part breaks off or its checksum is wrong."""
    import io
    import zipfile

    from sagebase.sources import ooxml

    book = [(k, r, c, None, None, "STRING", f"x{k}{r}{c}", None, None, None) for k in range(3) for r in range(20) for c in range(3)] + [(1, 2, 0, 3, 0, "MERGE", None, None, None, None)]
    data = sheets.workbook_file(iter(book))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    cut = sheets.zipped(parts | {"xl/worksheets/sheet2.xml": parts["xl/worksheets/sheet2.xml"][:700]})
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_STORED) as z:
        for n, text in parts.items():
            z.writestr(n, text)
    wrong = stored.getvalue().replace(b'r="C20"', b'r="C21"')
    read = lambda: [list(ooxml.rows_of("xlsx", "p", io.BytesIO(d))) for d in (data, cut, wrong)]
    whole = read()
    assert whole[0] and len(whole[0]) == len(book) and [x[-1][-1] is None for x in whole] == [True, False, False] and 120 < len(whole[1]) < len(book)
    monkeypatch.setattr(ooxml, "SMALL", -1)
    assert read() == whole
