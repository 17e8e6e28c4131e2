"""Files of a folder as documents and pieces, by their kind."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sagebase.functions import text as T
from sagebase.operators import html as H
from sagebase.operators import segment as S
from sagebase.sources import store

# How each kind is read. Cloud kinds need a parser of the caller's.
ROUTES = {"txt": "plain", "md": "markdown", "html": "html", "pdf": "cloud", "docx": "cloud", "pptx": "slides", "xlsx": "sheets", "xls": "sheets"}
FOOTER_CHARS = 8
PIECES = "path string, seq int, page_num int, title string, content string"


def route(file_type: Column) -> Column:
    """How a file is read, by its kind in lower case; null for kinds that aren't read."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), F.lower(file_type))


def kind_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def storage_path(storage_type: Column, key: Column, roots: dict[str, str]) -> Column:
    """Where a blob lies: under the root of its store; rows without a store are local. An unknown store is null."""
    root = F.try_element_at(F.create_map(*[F.lit(x) for kv in roots.items() for x in kv]), F.coalesce(storage_type, F.lit("local")))
    return F.concat(root, F.lit("/"), key)


class Blobs:
    """Blobs by the store of their row and their key. A store that isn't configured is an error; nothing falls back to another one."""

    def __init__(self, spark: SparkSession, roots: dict[str, str]):
        self.spark, self.roots = spark, roots

    def path(self, storage_type: str | None, key: str) -> str:
        root = self.roots.get(storage_type or "local")
        if root is None:
            raise ValueError(f"no such store: {storage_type}")
        return f"{root}/{key}"

    def put(self, storage_type: str | None, key: str, content: bytes) -> None:
        """Writes a blob, in place of one that is there."""
        store.put(self.spark, self.path(storage_type, key), content, overwrite=True)

    def get(self, storage_type: str | None, key: str) -> bytes | None:
        return store.get(self.spark, self.path(storage_type, key))

    def delete(self, storage_type: str | None, key: str) -> bool:
        """Removes a blob; one that isn't there is no error."""
        return store.delete(self.spark, self.path(storage_type, key))

    def read(self, rows: DataFrame) -> DataFrame:
        """Rows (storage_type, key and more) with the bytes of their blobs, null where there is none or an empty one (which Spark's reader passes over). Only paths are joined."""
        named = rows.withColumn("path", storage_path(F.col("storage_type"), F.col("key"), self.roots))
        held = None
        for root in dict.fromkeys(self.roots.values()):
            part = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root).select("path", F.col("content").alias("bytes"))
            held = part if held is None else held.unionByName(part)
        plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")  # noqa: E731  file:/x, file:///x and /x are one
        held = held.select(plain(F.col("path")).alias("found"), "bytes")
        return named.join(held, plain(F.col("path")) == F.col("found"), "left").drop("found", "path")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, route and content (UTF-8; null for binary kinds) of every file below a folder. Files of unknown kinds have no route."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select("path", kind_of(F.col("path")).alias("kind"), F.col("content").alias("bytes")).withColumn("route", route(F.col("kind")))
    return rows.withColumn("content", F.when(F.col("route").isin("plain", "markdown", "html"), F.decode("bytes", "UTF-8")))


def unread(files: DataFrame) -> DataFrame:
    """Files that can't be read here, with the reason."""
    return files.where("route is null or route in ('cloud', 'slides', 'sheets')").select("path", F.when(F.col("route").isNull(), F.concat(F.lit("不支持的文件类型: "), "kind")).otherwise(F.concat(F.lit("needs a parser for "), "kind")).alias("reason"))


def pieces_of(kind: str, text: str, size: int, overlap: int) -> list[tuple[str, str]]:
    if kind == "html":
        text = H.to_markdown(text)
    return S.chunk_page(text, size, overlap)[0] if kind == "markdown" else S.plain_pieces(text, size, overlap)[0]


def file_pieces(files: DataFrame, size: int = S.SIZE, overlap: int = S.OVERLAP) -> DataFrame:
    """Pieces of text files (page 0): plain text by paragraphs, markdown by structure, HTML as the paragraphs of its markdown. Row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, k, 0, title, body) for p, r, text in pdf.itertuples(index=False) for k, (title, body) in enumerate(pieces_of(r, text or "", size, overlap))]
            yield pd.DataFrame(out, columns=["path", "seq", "page_num", "title", "content"])

    return files.where(F.col("route").isin("plain", "markdown", "html")).select("path", "route", "content").mapInPandas(run, PIECES)


def parsed(files: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]], size: int = S.SIZE, overlap: int = S.OVERLAP) -> DataFrame:
    """Pieces of all files: text kinds here, every other route by the caller's parser, which gets path, kind and bytes and gives pieces."""
    out = file_pieces(files, size, overlap)
    for name, parse in parsers.items():
        out = out.unionByName(parse(files.where(F.col("route") == name).select("path", "kind", "bytes")))
    return out


def slide_title(markdown: str | None, footer: str | None) -> str | None:
    """The path of a slide's headings without a deck's footer in front; of a slide that has only the footer a short plain line behind it, else the footer;
    of one without headings its first line."""
    lines = [t for x in (markdown or "").replace("\r\n", "\n").split("\n") if (t := x.strip(S.TRIM))]
    found = [h for t in lines if (h := S.heading(t))]
    if not lines:
        return None
    if not found:
        return lines[0][:100]
    rest = found[1:] if footer is not None and found[0][1] == footer else found
    if not rest:
        return (plain_line(lines) or found[0][1])[:100]
    stack = ()
    for h in rest:
        stack = S.pushed(stack, h)
    return S.path(stack)


def plain_line(lines: list[str]) -> str | None:
    """The line behind the first markdown heading, if it is short and has no mark in front."""
    heads = [re.match(r"#{1,6}\s+", x, re.ASCII) is not None for x in lines]
    after = lines[heads.index(True) + 1] if True in heads and heads.index(True) + 1 < len(lines) else None
    marked = after is None or heads[heads.index(True) + 1] or after[0] in "*-+>|`[" or re.match(r"[0-9]+[.、．]|\d+\s+", after, re.ASCII)
    return None if marked or len(after) > 30 else after


def footers(slides: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A deck's footer: the most frequent markdown heading that slides begin with (the least of equally frequent ones), if it is short and frequent enough;
    decks of under three slides have none. A slide whose first line with text isn't a heading counts for none. slides: id, page_num, markdown."""
    lines = F.filter(F.transform(F.split("markdown", r"\r?\n"), T.jtrim), lambda x: x != "")
    firsts = slides.select(id_col, F.get(lines, F.lit(0)).alias("line")).where(F.col("line").rlike(r"^#{1,6}\s+.*$"))
    counted = firsts.groupBy(id_col, T.jtrim(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("footer")).agg(F.count("*").alias("times"))
    n = slides.groupBy(id_col).agg(F.count("*").alias("pages")).where("pages >= 3")
    counted = counted.where(F.length("footer") <= FOOTER_CHARS).join(n, id_col).where(F.col("times") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 10)))
    return counted.groupBy(id_col).agg(F.min_by("footer", F.struct(-F.col("times"), "footer")).alias("footer"), F.max("times").alias("times"))


def slide_pieces(slides: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One piece for each slide that isn't blank: id, page_num, title, content. Titles are made of STEP_ROWS slides at once."""
    rows = slides.where(~T.blank(F.col("markdown"))).join(footers(slides, id_col), id_col, "left").select(id_col, "page_num", "markdown", "footer")
    kinds = [f.dataType for f in rows.schema[:2]]
    schema = pa.schema([(id_col, to_arrow_type(kinds[0])), ("page_num", to_arrow_type(kinds[1])), ("title", pa.string()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from S.packed(((i, page, slide_title(markdown, footer), markdown) for i, page, markdown, footer in S.in_steps(batches)), schema)

    return rows.mapInArrow(run, f"`{id_col}` {kinds[0].simpleString()}, page_num {kinds[1].simpleString()}, title string, content string")
