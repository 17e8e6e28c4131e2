"""Workbooks and presentations (zipped XML) as tables: cells with their types and merged regions, slides as markdown.

Only what a file says is read here; what it means (regions, headers, fills, titles, pieces) is up to the operators on these tables. Files come either as
rows of bytes (any store that Spark reads) or through the data sources `workbook` and `presentation`.
"""

from __future__ import annotations

import datetime as dt
import functools
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sagebase.operators import grid as G
from sagebase.operators import segment as S
from sagebase.sources import files as L

#: kind is STRING, NUMBER, BOOLEAN, BLANK (a cell that is there without a value), MERGE (r, c to r2, c2) or ERROR (a file that can't be read; error says why).
CELLS = "path string, sheet_no int, sheet string, r int, c int, r2 int, c2 int, kind string, s string, n double, b boolean, d date, error string"
SLIDES = "path string, page_num int, markdown string, error string"
# The built-in formats that show days (times of day alone are numbers of the first day).
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Bytes of files that a partition of a data source reads, and rows of a batch.
PARTITION_BYTES, BATCH = 16 << 20, 4096
#: Bytes of a part that becomes one tree: that takes a third of the time, and larger parts are read element by element.
SMALL = 1 << 20


@functools.lru_cache(4096)
def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def elements(member: IO[bytes], *names: str) -> Iterator[ElementTree.Element]:
    """Elements of these names as they end; what was given is forgotten, so memory follows one element, not the file."""
    above: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(member, ("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if local(e.tag) in names:
            yield e
            if above:
                above[-1].remove(e)


def part_elements(book: zipfile.ZipFile, part: str, *names: str) -> Iterator[ElementTree.Element]:
    """Elements of a part by name. One that breaks off gives what stands before the break and then the error, whatever its size."""
    if book.getinfo(part).file_size <= SMALL:
        try:
            root = ElementTree.fromstring(book.read(part))
        except (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, EOFError):
            pass  # element by element, up to the break
        else:
            yield from (e for e in root.iter() if local(e.tag) in names)
            return
    with book.open(part) as f:
        yield from elements(f, *names)


def targets(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The parts that a part refers to, by the id of the reference."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in book.namelist():
        return {}
    return {e.get("Id"): posixpath.normpath(posixpath.join("/" + folder, e.get("Target"))).lstrip("/") for e in part_elements(book, rels, "Relationship") if e.get("TargetMode") != "External"}


def reference(e: ElementTree.Element) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == "id" and k != "id"), None)


def plain(e: ElementTree.Element) -> str:
    """The text of a string with runs, without the readings above its characters."""
    if len(e) == 1 and local(e[0].tag) == "t" and not len(e[0]):
        return e[0].text or ""
    return "".join(t.text or "" for child in e if local(child.tag) != "rPh" for t in child.iter() if local(t.tag) == "t")


def shows_date(code: str) -> bool:
    """Whether a number format shows a day or time: one of its letters outside quotes, brackets and escapes."""
    return re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "", code.split(";")[0]), re.I) is not None


def date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    own, styles = {}, []
    with book.open("xl/styles.xml") as f:
        root = ElementTree.parse(f).getroot()
    for e in root.iter():
        if local(e.tag) == "numFmt":
            own[int(e.get("numFmtId"))] = shows_date(e.get("formatCode") or "")
        elif local(e.tag) == "cellXfs":
            styles = [int(x.get("numFmtId") or 0) for x in e]
    return [own.get(k, k in DATE_FORMATS) for k in styles]


@functools.lru_cache(1 << 14)
def day(serial: float, since_1904: bool) -> dt.date | None:
    """The day of a serial number; the system of 1900 counts a 29th of February that year."""
    whole = int(serial // 1)
    first = dt.date(1904, 1, 1) if since_1904 else dt.date(1899, 12, 31 if whole < 60 else 30)
    try:
        return first + dt.timedelta(days=whole)
    except OverflowError:
        return None


@functools.lru_cache(1 << 16)
def place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    c = 0
    for x in letters:
        c = 26 * c + ord(x) - 64
    return int(digits) - 1, c - 1


def workbook(file: IO[bytes]) -> Iterator[tuple]:
    """Sheets in order: sheet_no, sheet, r, c, r2, c2, kind, s, n, b, d. A formula counts as the value that is stored with it."""
    with zipfile.ZipFile(file) as book:
        with book.open("xl/workbook.xml") as f:
            found = list(elements_kept(f, "sheet", "workbookPr"))
        since_1904 = any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in found)
        sheets = [(e.get("name"), reference(e)) for e in found if local(e.tag) == "sheet"]
        parts, dates, strings = targets(book, "xl/workbook.xml"), date_styles(book), []
        if "xl/sharedStrings.xml" in book.namelist():
            strings = [plain(e) for e in part_elements(book, "xl/sharedStrings.xml", "si")]
        for k, (name, ref) in enumerate(sheets, 1):
            if "worksheet" not in parts[ref]:
                continue  # a chart
            for row in sheet_rows(part_elements(book, parts[ref], "row", "mergeCell"), strings, dates, since_1904):
                yield k, name, *row


def elements_kept(member: IO[bytes], *names: str) -> Iterator[ElementTree.Element]:
    return (e for e in ElementTree.parse(member).getroot().iter() if local(e.tag) in names)


def sheet_rows(found: Iterator[ElementTree.Element], strings: list[str], dates: list[bool], since_1904: bool) -> Iterator[tuple]:
    r = -1
    for e in found:
        if local(e.tag) == "mergeCell":
            a, _, z = e.get("ref").partition(":")
            yield (*place(a), *place(z or a), "MERGE", None, None, None, None)
            continue
        r, c = int(e.get("r")) - 1 if e.get("r") else r + 1, -1
        for cell in e:
            ref, kind, raw = cell.get("r"), cell.get("t") or "n", None
            c = place(ref)[1] if ref else c + 1
            for x in cell:
                if local(x.tag) == "v":
                    raw = x.text
                    break
            text = number = flag = date = None
            if kind == "inlineStr":
                text = "".join(plain(x) for x in cell if local(x.tag) == "is")
            elif raw is None or kind == "e":
                yield r, c, None, None, "BLANK", None, None, None, None
                continue
            elif kind == "s":
                text = strings[int(raw)]
            elif kind == "b":
                flag = raw.strip() in ("1", "true")
            elif kind == "d":
                number, date = 0.0, dt.date.fromisoformat(raw[:10])
            elif kind == "n":
                number, style = float(raw), int(cell.get("s") or 0)
                date = day(number, since_1904) if style < len(dates) and dates[style] and number >= 0 else None
            else:
                text = raw
            yield r, c, None, None, "STRING" if text is not None else "BOOLEAN" if flag is not None else "NUMBER", text, number, flag, date


def presentation(file: IO[bytes]) -> Iterator[tuple[int, str]]:
    """Slides in order, from 1, as markdown: titles as headings, paragraphs as lines, tables with bars."""
    with zipfile.ZipFile(file) as deck:
        with deck.open("ppt/presentation.xml") as f:
            order = [reference(e) for e in elements_kept(f, "sldId")]
        parts = targets(deck, "ppt/presentation.xml")
        for k, ref in enumerate(order, 1):
            with deck.open(parts[ref]) as f:
                yield k, slide(ElementTree.parse(f).getroot())


def slide(root: ElementTree.Element) -> str:
    paragraphs = lambda e: ["".join((t.text or "") if local(t.tag) == "t" else "\n" for t in p.iter() if local(t.tag) in ("t", "br")) for p in e.iter() if local(p.tag) == "p"]
    lines: list[str] = []
    for shape in root.iter():
        if local(shape.tag) == "sp":
            title = any(local(e.tag) == "ph" and e.get("type") in ("title", "ctrTitle") for e in shape.iter())
            found = paragraphs(shape)
            lines += ["# " + " ".join(found).replace("\n", " ")] if title and any(found) else found
        elif local(shape.tag) == "tbl":
            rows = [[" ".join(paragraphs(c)).replace("\n", " ") for c in row if local(c.tag) == "tc"] for row in shape if local(row.tag) == "tr"]
            for k, row in enumerate(rows):
                lines += ["| " + " | ".join(row) + " |", *(["|" + " --- |" * len(row)] if k == 0 else [])]
    return "\n".join(lines)


KINDS: dict[str, tuple[str, Callable[[IO[bytes]], Iterator[tuple]], Callable[[str, str], tuple]]] = {
    "xlsx": (CELLS, workbook, lambda path, why: (path, *[None] * 6, "ERROR", *[None] * 4, why)),
    "pptx": (SLIDES, presentation, lambda path, why: (path, None, None, why)),
}


def rows_of(kind: str, path: str, file: IO[bytes]) -> Iterator[tuple]:
    """All rows of a file; of one that breaks off, those before it and an error row."""
    _, read, error = KINDS[kind]
    try:
        for row in read(file):
            yield (path, *row, None)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, AttributeError, TypeError, OSError, EOFError, RuntimeError) as e:
        yield error(path, f"{type(e).__name__}: {e}"[:200])


def batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32()}


def layout(kind: str) -> tuple[list[str], list[pa.DataType]]:
    pairs = [x.split() for x in KINDS[kind][0].split(", ")]
    return [n for n, _ in pairs], [ARROW[t] for _, t in pairs]


def parsed(files: DataFrame, kind: str) -> DataFrame:
    """Cells (xlsx) or slides (pptx) of files as bytes: path, bytes. A null or broken file gives an error row, an empty table no rows; nothing moves."""
    names, types = layout(kind)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            files_ = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            yield from batches((row for path, content in files_ for row in rows_of(kind, path, io.BytesIO(content.as_buffer() if content.is_valid else b""))), names, types)

    return files.select("path", "bytes").mapInArrow(run, KINDS[kind][0])


class Bundle(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class FilesReader(DataSourceReader):
    """Each partition reads files of PARTITION_BYTES together, or one larger file."""

    def __init__(self, kind: str, path: str):
        self.kind, self.path = kind, path

    def found(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(inner)
        all_ = [info] if info.is_file else store.get_file_info(fs.FileSelector(inner, recursive=True))
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        return sorted((scheme + f.path, f.size) for f in all_ if f.is_file and (info.is_file or f.extension.lower() == self.kind))

    def partitions(self) -> list[InputPartition]:
        out, size = [Bundle([])], 0
        for path, n in self.found():
            if out[-1].paths and size + n > PARTITION_BYTES:
                out.append(Bundle([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names, types = layout(self.kind)
        for path in partition.paths:
            store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with store.open_input_file(inner) as file:
                yield from batches(rows_of(self.kind, path, file), names, types)


class WorkbookSource(DataSource):
    """spark.read.format("workbook").load(path): the cells of all xlsx files of a folder, or of one file."""

    kind = "xlsx"

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return KINDS[self.kind][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return FilesReader(self.kind, self.options["path"])


class PresentationSource(WorkbookSource):
    """spark.read.format("presentation").load(path): the slides of all pptx files of a folder, or of one file."""

    kind = "pptx"

    @classmethod
    def name(cls) -> str:
        return "presentation"


def register(spark: SparkSession) -> None:
    for source in (WorkbookSource, PresentationSource):
        spark.dataSource.register(source)


def sheets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (path, sheet_no, sheet, r, c, value) and merged regions (path, sheet_no, sheet, r1, c1, r2, c2) of a workbook table."""
    value = G.cell_text(F.col("kind"), F.col("s"), F.col("n"), F.col("b"), F.col("d"))
    cells = rows.where(F.col("kind").isin("STRING", "NUMBER", "BOOLEAN", "BLANK")).select("path", "sheet_no", "sheet", "r", "c", value.alias("value"))
    return cells, rows.where("kind = 'MERGE'").select("path", "sheet_no", "sheet", F.col("r").alias("r1"), F.col("c").alias("c1"), "r2", "c2")


def workbook_pieces(rows: DataFrame, size: int = S.SIZE) -> DataFrame:
    """Pieces of all sheets with a table: path, page_num (the sheet's number), seq, title, content. Files are read once, and what they say moves once."""
    keys = ["path", "sheet_no", "sheet"]
    value = G.cell_text(F.col("kind"), F.col("s"), F.col("n"), F.col("b"), F.col("d"))
    marked = rows.where("kind <> 'ERROR'").select(*keys, "r", "c", "r2", "c2", value.alias("value")).repartition(*keys)
    pieces = G.sheet_pieces(G.sheet_tables(G.run_down(G.laid(marked, keys), keys), keys), keys, size)
    title = G.sheet_title(F.regexp_extract("path", r"([^/]*)$", 1), F.col("sheet"))
    return pieces.select("path", F.col("sheet_no").alias("page_num"), "seq", title.alias("title"), "content")


def presentation_pieces(rows: DataFrame) -> DataFrame:
    """One piece for each slide that isn't blank: path, page_num, seq, title, content."""
    pieces = L.slide_pieces(rows.where("error is null").select("path", "page_num", "markdown"), "path")
    return pieces.select("path", "page_num", F.lit(0).alias("seq"), "title", "content")


def failures(rows: DataFrame) -> DataFrame:
    """Files that can't be read, or not to their end: path, error."""
    return rows.where("error is not null").select("path", "error")


#: For files.parsed: sheets and slides without an outside parser. Files that can't be read give no pieces here; failures() names them.
PARSERS = {
    "sheets": lambda files: workbook_pieces(parsed(files, "xlsx")).select("path", "seq", "page_num", "title", "content"),
    "slides": lambda files: presentation_pieces(parsed(files, "pptx")).select("path", "seq", "page_num", "title", "content"),
}
