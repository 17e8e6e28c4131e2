"""Text to pieces: hard cuts, pages, paragraphs, sentences, tables, code and the structure-aware splitter."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sagebase.functions import text as T

# Separators by priority, the sentence ends, limits of titles.
SEPARATORS = ("\n## ", "\n### ", "\n#### ", "\n##### ", "\n###### ", "\n# ", "\n\n", "\n", "。", "！", "？", "；", ";", ".", "!", "?", " ")
SENTENCE_END = "(?<=[。！？!?；;])"
SIZE, OVERLAP, PATH_CHARS, LEVEL_CHARS = 800, 120, 200, 100
PAGE_MARK = r"<!-- PAGE (\d+) -->"
TABLE_RULE = r"\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?"
TABLE_CAPTION = r"\*{0,2}表\s*\d+([-.．]\d+)*[^\n]*"
#: Rows of a batch that are Python objects at once, and characters of results that a task keeps before it gives them on.
STEP_ROWS, STEP_CHARS = 64, 2_000_000
#: What trimming removes (up to U+0020), and what counts as blank: no-break spaces do not.
TRIM = "".join(map(chr, range(33)))
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"


def fixed_width(rows: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Cuts of `width` characters: id, seq from 0, content. Empty and null texts give none."""
    last = F.floor((F.length(text_col) - 1) / width).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text_col), i * width + 1, F.lit(width)))
    return rows.where(F.length(text_col) > 0).select(id_col, F.posexplode(pieces).alias("seq", "content"))


def page_split(text: Column) -> Column:
    """Pages of a text with page marks, as an array of (page_num, markdown). What stands before the first mark joins the first page;
    a text without marks is page 1; blank pages are left out."""
    marks = F.regexp_extract_all(text, F.lit(PAGE_MARK), 1)
    bodies = F.split(text, r"<!-- PAGE \d+ -->")
    joined = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1))),
        lambda i: F.struct(
            F.coalesce(F.get(marks, i - 1).cast("int"), F.lit(1)).alias("page_num"),
            T.jtrim(F.when(F.size(marks) == 0, text).when(i == 1, F.concat(F.get(bodies, F.lit(0)), F.get(bodies, F.lit(1)))).otherwise(F.get(bodies, i))).alias("markdown"),
        ),
    )
    return F.filter(joined, lambda p: p["markdown"] != "")


def page_assemble(pages: DataFrame, id_col: str) -> DataFrame:
    """One text for each document from its rows (page_num, markdown), each page behind its mark."""
    parts = F.sort_array(F.collect_list(F.struct("page_num", "markdown")))
    body = F.transform(parts, lambda p: F.concat(F.lit("<!-- PAGE "), p["page_num"].cast("string"), F.lit(" -->\n"), p["markdown"]))
    return pages.groupBy(id_col).agg(F.array_join(body, "\n\n").alias("text"))


def missing_pages(pages: DataFrame, id_col: str) -> DataFrame:
    """Page numbers up to the greatest that have no text; none where a page number isn't positive."""
    seen = pages.groupBy(id_col).agg(F.max("page_num").alias("n"), F.min("page_num").alias("low"), F.collect_set(F.when(~T.blank(F.col("markdown")), F.col("page_num"))).alias("has"))
    return seen.where("low > 0").select(id_col, F.explode(F.array_except(F.sequence(F.lit(1), F.col("n")), "has")).alias("page_num"))


def forward_fill(cells: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Blank cells take the last cell above that isn't blank, in each column of a table."""
    from pyspark.sql import Window

    above = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("filled", F.last(F.when(~T.blank(F.col(value)), F.col(value)), ignorenulls=True).over(above))


# ---- one document's text in plain Python; the segmenters below run it on Arrow batches ----


def blank(text: str) -> bool:
    return not text.strip(BLANK)


def heading(line: str) -> tuple[int, str] | None:
    t = line.strip(TRIM)
    if re.fullmatch(T.MD_HEADING[1:-1], t, re.ASCII):
        marks = len(t) - len(t.lstrip("#"))
        return marks, t[marks:].strip(TRIM)
    for pattern, level in ((T.CN_CHAPTER, 1), (T.CN_ITEM, 2)):
        if re.fullmatch(pattern[1:-1], t, re.ASCII):
            return level, t
    if re.fullmatch(T.NUM_ITEM[1:-1], t, re.ASCII):
        return min(max(1, len(re.findall(r"\d{1,3}", re.match(T.NUM_PREFIX, t, re.ASCII)[0], re.ASCII))), T.LEVELS), t
    return None


def pushed(stack: tuple, found: tuple[int, str]) -> tuple:
    """The headings above a line after a new heading: deeper and equal ones end."""
    keep = next((i for i, (level, _) in enumerate(stack) if level >= found[0]), len(stack))
    return (*stack[:keep], (found[0], found[1][:LEVEL_CHARS]))[-T.LEVELS :]


def path(stack: tuple) -> str:
    names = [name for _, name in stack]
    while len(names) > 1 and len(" > ".join(names)) > PATH_CHARS:
        names.pop(0)
    return " > ".join(names)


def fences(text: str) -> list[tuple[str, str]]:
    """Runs of lines: ("prose", text) and ("code", text with its fences). An open fence runs to the end."""
    out: list[tuple[str, list[str]]] = []
    mark = ""
    for line in text.split("\n"):
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if mark:
            out[-1][1].append(line)
            if m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
                mark = ""
                out.append(("prose", []))
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            mark = m[1]
            out.append(("code", [line]))
        elif out and out[-1][0] == "prose":
            out[-1][1].append(line)
        else:
            out.append(("prose", [line]))
    return [(kind, "\n".join(lines)) for kind, lines in out if lines]


def cells_of(line: str) -> list[str]:
    line = line.strip(TRIM)
    return [c.strip(TRIM) for c in line.removeprefix("|").removesuffix("|").split("|")]


def is_rule(line: str) -> bool:
    return "-" in line and re.fullmatch(TABLE_RULE, line.strip(TRIM), re.ASCII) is not None


def caption_at(plain: list[str]) -> int | None:
    """Where the lines before a table end in a caption; blank lines may stand between."""
    last = next((k for k in range(len(plain) - 1, -1, -1) if plain[k]), None)
    return last if last is not None and re.fullmatch(TABLE_CAPTION, plain[last], re.ASCII) else None


def table_of(caption: str, header: list[str], rows: list[list[str]]) -> tuple[str, list[str], list[list[str]]]:
    """Rows of one width; unnamed columns get a number, blank cells what stands above."""
    width = max(len(header), *map(len, rows))
    names = [(header[c] if c < len(header) else "") for c in range(width)]
    above, filled = [""] * width, []
    for row in rows:
        above = [a if blank(c) else c for c, a in zip(row + [""] * (width - len(row)), above, strict=True)]
        filled.append(above)
    return caption, [f"列{c + 1}" if blank(n) else n for c, n in enumerate(names)], filled


def tables(text: str) -> list[tuple[str, object]]:
    """("text", text) and ("table", (caption, header, rows)).

    A table is a run of lines with a bar in front, one of them a rule, with rows below it; the line just above the rule is its header (none if the rule is
    the first), what stands higher in the run is dropped, and a caption above joins it. Lines of text are trimmed, runs without a table are not.
    """
    lines, out, plain, i = re.split(r"\r?\n", text), [], [], 0

    def flush() -> None:
        if not blank(body := "\n".join(plain)):
            out.append(("text", body))
        plain.clear()

    barred = [len(t := x.strip(TRIM)) > 1 and t[0] == "|" for x in lines]
    while i < len(lines):
        if not barred[i]:
            plain.append(lines[i].strip(TRIM))
            i += 1
            continue
        j = next((k for k in range(i, len(lines)) if not barred[k]), len(lines))
        rule = next((k for k in range(i, j) if is_rule(lines[k])), j)
        if rule + 1 >= j:
            plain += lines[i:j]
        else:
            at = caption_at(plain)
            caption = "" if at is None else plain[at]
            del plain[len(plain) if at is None else at :]
            flush()
            out.append(("table", table_of(caption, cells_of(lines[rule - 1]) if rule > i else [], [cells_of(x) for x in lines[rule + 1 : j]])))
        i = j
    flush()
    return out


def bar(row: list[str]) -> str:
    return "| " + " | ".join(row) + " |"


def table_pieces(table: tuple, size: int) -> list[str]:
    """A table whole if it fits, else groups of rows that each repeat caption and header, a line end behind each row."""
    caption, header, rows = table
    head = ([] if blank(caption) else [caption]) + [bar(header), bar(["---"] * len(header))]
    bars = list(map(bar, rows))
    if len(whole := "\n".join([*head, *bars]).strip(TRIM)) <= size:
        return [whole]
    out: list[list[str]] = []
    room = size - sum(len(x) + 1 for x in head)
    used = 0
    for row in bars:
        if not out or used + len(row) + 1 > room:
            out.append([])
            used = 0
        out[-1].append(row)
        used += len(row) + 1
    return ["\n".join([*head, *g]).strip(TRIM) for g in out]


def code_pieces(block: str, size: int) -> list[str]:
    """A code block whole if it fits, else groups of lines that each have the fences: cut at the last blank line of a full group where there is one,
    without blank lines at their ends. A block of blank lines is none."""
    lines = block.split("\n")
    start = lines[0]
    mark = re.match(r"\s*(`{3,}|~{3,})", start)[1]
    body = lines[1:-1] if len(lines) > 1 and lines[-1].strip() == mark else lines[1:]
    if all(map(blank, body)):
        return []
    if len(block) <= size:
        return [block]
    room, out, at = max(1, size - len(start) - len(mark) - 2), [], 0
    while True:
        at = next((k for k in range(at, len(body)) if not blank(body[k])), len(body))
        if at == len(body):
            return out
        sizes = itertools.accumulate(len(x) + 1 for x in body[at:])
        end = at + max(1, sum(1 for n in sizes if n <= room))
        if end < len(body):
            end = next((k for k in range(end - 1, at, -1) if blank(body[k])), end)
        group = "\n".join(body[at:end]).rstrip(BLANK)
        out.append(f"{start}\n{group}\n{mark}")
        at += group.count("\n") + 1


def recursive(text: str, size: int, level: int = 0) -> list[str]:
    """Pieces of up to `size` characters: at the first separator by priority that occurs, longer pieces at later ones; a hard cut ends it."""
    if blank(text):
        return []
    text = text.strip(TRIM)
    if len(text) <= size:
        return [text]
    at = next((i for i in range(level, len(SEPARATORS)) if SEPARATORS[i] in text), None)
    if at is None:
        return [p for i in range(0, len(text), size) if (p := text[i : i + size].strip(TRIM))]
    return [p for part in text.split(SEPARATORS[at]) for p in recursive(part, size, at + 1)]


def chunk_page(text: str, size: int = SIZE, overlap: int = OVERLAP, carry: str = "", stack: tuple = ()) -> tuple[list[tuple[str, str]], str, tuple]:
    """(title, content) of a page's pieces, the tail for the next page and the headings above it.

    Code and tables are pieces of their own; prose is packed into windows that keep the last `overlap` characters of the one before. The tail of the
    page before goes in front unless the page starts with a heading.
    """
    if not text or blank(text):
        return [], carry, stack
    text = text.removeprefix("﻿")
    overlap = max(0, min(overlap, size // 2))
    first = next((x for x in text.split("\n") if x.strip(TRIM)), "")
    carry = "" if heading(first) or blank(carry) else carry.strip(TRIM)
    out: list[tuple[str, str]] = []
    window = ""

    def flush() -> None:
        nonlocal window, stack
        if not window:
            return
        block = window.strip(TRIM)
        for line in re.split(r"\r?\n", block):
            if line.strip(TRIM) and (found := heading(line)):
                stack = pushed(stack, found)
        if block:
            out.append((path(stack), block))
        window = window[-overlap:] + "\n" if overlap and len(window) > overlap else ""

    for kind, part in fences(f"{carry}\n{text}" if carry else text):
        if kind == "code":
            flush()
            out += [(path(stack), p) for p in code_pieces(part, size)]
            continue
        for sort, block in tables(part):
            if sort == "table":
                flush()
                out += [(path(stack), p) for p in table_pieces(block, size)]
                continue
            for piece in recursive(block, size):
                if window and len(window) + len(piece) > size:
                    flush()
                window += piece + "\n"
    flush()
    return out, window.strip(TRIM), stack


def plain_pieces(text: str, size: int = SIZE, overlap: int = OVERLAP, carry: str = "") -> tuple[list[tuple[str, str]], str]:
    """(title, content) of plain text's pieces and the tail for the next page.

    Lines are trimmed; blank lines end paragraphs, which are packed into windows of `size`; long ones go by sentences. A heading ends paragraph and window, drops the
    tail of the page before and names what follows. A window keeps the last `overlap` characters of the one before; where these and the next paragraph exceed
    `size`, its beginning goes.
    """
    if not text or blank(text):
        return [], carry
    overlap = max(0, min(overlap, size // 2))
    out: list[tuple[str, str]] = []
    window, para, stack = "", [], ()
    carry = carry.strip(TRIM)

    def flush() -> None:
        nonlocal window
        if block := window.strip(TRIM):
            out.append((path(stack), block))
        window = window[-overlap:] + "\n" if overlap and len(window) > overlap else ""

    def add(part: str) -> None:
        nonlocal window, carry
        if carry:
            part, carry = f"{carry}\n{part}", ""
        if window and len(window) + len(part) > size:
            flush()
        window = f"{window}{part}\n"[-size:]

    def end_paragraph() -> None:
        if para:
            whole = "\n".join(para)
            for part in sentences(whole, size) if len(whole) > size else [whole]:
                add(part)
            para.clear()

    for line in re.split(r"\r?\n", text.removeprefix("﻿")):
        line = line.strip(TRIM)
        found = heading(line) if line else None
        if found or not line:
            end_paragraph()
        else:
            para.append(line)
        if found:
            carry = ""
            flush()
            stack = pushed(stack, found)
            add(line)
    end_paragraph()
    flush()
    return out, window.strip(TRIM)


def sentences(text: str, size: int = SIZE) -> list[str]:
    """Sentences packed up to `size`; a longer one is cut hard into pieces of its own."""
    out, window = [], ""
    for s in re.split(SENTENCE_END, text):
        if window and len(window) + len(s) > size:
            out.append(window)
            window = ""
        if len(s) > size:
            out += [s[i : i + size] for i in range(0, len(s), size)]
        else:
            window += s
    return [p for x in [*out, window] if (p := x.strip(TRIM))]


def in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches, of which STEP_ROWS are Python objects at once."""
    for batch in batches:
        for a in range(0, batch.num_rows, STEP_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, STEP_ROWS).columns), strict=True)


def packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about STEP_CHARS characters (of the last column), so that memory doesn't depend on how many rows come of a batch."""
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += len(row[-1] or "") + 64
        if chars >= STEP_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def segmented(rows: DataFrame, id_col: str, text_col: str, split) -> DataFrame:
    """id, seq, title, content from a function of one text; row-local, so nothing is shuffled. A task holds STEP_CHARS of its pieces and one text's."""
    kind = rows.select(id_col).schema
    schema = pa.schema([pa.field(id_col, to_arrow_type(kind[0].dataType)), ("seq", pa.int32()), ("title", pa.string()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((i, k, title, content) for i, text in in_steps(batches) for k, (title, content) in enumerate(split(text or ""))), schema)

    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind[0].dataType.simpleString()}, seq int, title string, content string")


def chunk_documents(pages: DataFrame, id_col: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of documents given as pages (id, page_num, markdown): tail and headings go from page to page. One shuffle by document.

    Pages are walked in order: a task holds one batch of them, STEP_CHARS of pieces and one document's tail and headings, however long the document is. Pages without a number come last.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    result = f"{id_col} {kind}, seq int, page_num int, title string, content string"
    own = pages.select(id_col, F.col("page_num").cast("int").alias("page_num"), "markdown")
    schema = pa.schema([pa.field(id_col, to_arrow_type(pages.schema[id_col].dataType)), ("seq", pa.int32()), ("page_num", pa.int32()), ("title", pa.string()), ("content", pa.string())])

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, carry, stack, seq = (), "", (), 0  # () is no document
        for doc, page, markdown in in_steps(batches):
            if doc != now:
                now, carry, stack, seq = doc, "", (), 0
            pieces, carry, stack = chunk_page(markdown or "", size, overlap, carry, stack)
            for title, content in pieces:
                yield doc, seq, page, title, content
                seq += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(pieces_of(batches), schema)

    ordered = own.repartition(id_col).sortWithinPartitions(F.col(id_col), F.col("page_num").asc_nulls_last(), F.col("markdown"))
    return ordered.mapInArrow(run, result)
