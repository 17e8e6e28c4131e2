"""Spreadsheets as cell tables: text of typed cells, merged regions, filled blanks, and the tables that a sheet holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebase.functions import text as T
from sagebase.operators import segment as S

# Characters of a file's name in a title, of a title, and the integers that are written without a point.
NAME_CHARS, TITLE_CHARS, WHOLE = 80, 100, 1e15


def cell_text(kind: Column, text: Column, number: Column, flag: Column, date: Column) -> Column:
    """A cell as text. kind is STRING, NUMBER or BOOLEAN (of a formula: of its value); a number with a date is that day; all else is empty."""
    whole = (number == F.rint(number)) & (F.abs(number) < WHOLE)
    return F.coalesce(
        F.when(kind == "STRING", T.jtrim(text))
        .when((kind == "NUMBER") & date.isNotNull(), F.date_format(date, "yyyy-MM-dd"))
        .when(kind == "NUMBER", F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string")))
        .when(kind == "BOOLEAN", flag.cast("string")),
        F.lit(""),
    )


def dense(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Every place (r, c) of each sheet up to its last cell or merged region; places without a cell are empty. cells: keys, r, c, value; merges: keys, r1, c1, r2, c2."""
    edges = cells.select(*keys, "r", "c").unionByName(merges.select(*keys, F.col("r2").alias("r"), F.col("c2").alias("c")))
    size = edges.groupBy(*keys).agg(F.max("r").alias("rows"), F.max("c").alias("cols"))
    places = size.select(*keys, F.explode(F.sequence(F.lit(0), "rows")).alias("r"), "cols").select(*keys, "r", F.explode(F.sequence(F.lit(0), "cols")).alias("c"))
    return places.join(cells, [*keys, "r", "c"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def header_rows(grid: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each sheet with more than one cell that isn't blank: keys, header. Cells do for the grid, as places without one are blank."""
    full = grid.groupBy(*keys, "r").agg(F.count(F.when(~T.blank(F.col("value")), 1)).alias("n")).where("n > 1")
    return full.groupBy(*keys).agg(F.min("r").alias("header"))


def expanded(grid: DataFrame, merges: DataFrame, keys: list[str], cells: DataFrame | None = None) -> DataFrame:
    """Merged regions: one column's value goes down its rows; other regions keep their first cell, and the rest is empty and frozen.

    Regions are spread to their places, so the join is by place. Where the cells are given, first values are looked up there and the grid is made once.
    """
    m = merges.where("r1 < r2 or c1 < c2").withColumn("down", (F.col("c1") == F.col("c2")) & (F.col("r1") < F.col("r2")))
    held = grid if cells is None else cells
    top = m.join(held.select(*keys, F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("value").alias("first")), [*keys, "r1", "c1"], "inner" if cells is None else "left")
    places = top.withColumn("r", F.explode(F.sequence("r1", "r2"))).withColumn("c", F.explode(F.sequence("c1", "c2"))).where("r <> r1 or c <> c1")
    places = places.select(*keys, "r", "c", F.when(F.col("down"), F.coalesce("first", F.lit(""))).otherwise(F.lit("")).alias("new"), (~F.col("down")).alias("frozen"))
    rows = grid.join(places, [*keys, "r", "c"], "left")
    return rows.select(*keys, "r", "c", F.coalesce("new", "value").alias("value"), F.coalesce("frozen", F.lit(False)).alias("frozen"))


def filled(grid: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Empty cells take the value above, row by row; frozen ones stay empty and end the run, and the row below the header doesn't take from it."""
    return run_down(grid.join(headers, keys, "left"), keys)


def run_down(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same of rows that have their header's number: keys, r, c, value, frozen, header."""
    column = Window.partitionBy(*keys, "c").orderBy("r")
    starts = (F.col("value") != "") | F.col("frozen") | F.coalesce(F.col("r") == F.col("header") + 1, F.lit(False))
    above = F.last(F.when(starts, F.col("value")), ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("value", F.coalesce(above, F.lit(""))).select(*keys, "r", "c", "value")


def marks(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and merged regions as one table, for `laid`: keys, r, c, r2, c2 (null for a cell), value. Dealt by sheet: nothing moves after that."""
    rows = cells.select(*keys, "r", "c", F.lit(None).cast("int").alias("r2"), F.lit(None).cast("int").alias("c2"), "value")
    return rows.unionByName(merges.select(*keys, F.col("r1").alias("r"), F.col("c1").alias("c"), "r2", "c2", F.lit(None).cast("string").alias("value"))).repartition(*keys)


def laid(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Every place of each sheet up to its last cell or merged region, with its regions expanded as `expanded` has them: keys, r, c, value, frozen and header (the first row
    with more than one cell that isn't blank). marked: as `marks` gives it; of several cells at one place the greatest counts.

    Rows are arrays until they are dense, and all steps group by the sheet and more: where the sheets lie together already, nothing moves.
    """
    region = F.col("r2").isNotNull() & ((F.col("r2") > F.col("r")) | (F.col("c2") > F.col("c")))
    item = F.struct("c", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("c2", "c").alias("c2"), F.col("r2").isNull().alias("cell"), region.alias("region"), (F.col("row") == F.col("r")).alias("top"), ((F.col("c2") == F.col("c")) & (F.col("r2") > F.col("r"))).alias("down"))
    rows = marked.withColumn("row", F.explode(F.when(F.col("r2").isNull(), F.array("r")).otherwise(F.sequence("r", "r2"))))
    rows = rows.groupBy(*keys, F.col("row").alias("r")).agg(F.collect_list(item).alias("items"))
    held = F.sort_array(F.transform(F.filter("items", lambda x: x["cell"]), lambda x: F.struct(x["c"].alias("c"), x["value"].alias("value"))))
    held = F.filter(held, lambda x, i: F.coalesce(F.get(held, i + 1)["c"] != x["c"], F.lit(True)))
    rows = rows.select(*keys, "r", held.alias("held"), F.filter("items", lambda x: x["region"]).alias("regions"), F.array_max(F.transform("items", lambda x: x["c2"])).alias("edge"))
    sheet = Window.partitionBy(*keys)
    full = F.size(F.filter("held", lambda x: ~T.blank(x["value"]))) > 1
    rows = rows.withColumn("cols", F.max("edge").over(sheet)).withColumn("header", F.min(F.when(full, F.col("r"))).over(sheet)).withColumn("above", F.lag("r").over(sheet.orderBy("r")))
    # Rows that have neither cell nor region come before the row that ends the gap.
    rows = rows.withColumn("row", F.explode(F.sequence(F.coalesce(F.col("above") + 1, F.lit(0)), F.col("r"))))
    gap = F.col("row") < F.col("r")
    blanks = lambda n: F.array_repeat(F.lit(""), n)
    before = lambda i: F.coalesce(F.when(i > 0, F.get("held", i - 1)["c"]), F.lit(-1))
    values = F.concat(F.flatten(F.transform("held", lambda x, i: F.concat(blanks(x["c"] - before(i) - 1), F.array(x["value"])))), blanks(F.col("cols") - before(F.size("held"))))
    values = F.when(gap, blanks(F.col("cols") + 1)).otherwise(values)
    none = F.filter("regions", lambda x: F.lit(False))
    cells = rows.select(*keys, F.col("row").alias("r"), "header", F.when(gap, none).otherwise(F.col("regions")).alias("regions"), F.posexplode(values).alias("c", "value"))
    some = lambda held: F.when(F.size("regions") == 0, False).otherwise(F.exists("regions", held))
    first = some(lambda x: x["down"] & x["top"] & (x["c"] == F.col("c")))
    below = some(lambda x: x["down"] & ~x["top"] & (x["c"] == F.col("c")))
    wide = some(lambda x: ~x["down"] & (x["c"] <= F.col("c")) & (F.col("c") <= x["c2"]) & ~(x["top"] & (x["c"] == F.col("c"))))
    cells = cells.select(*keys, "r", "c", "value", "header", first.alias("first"), below.alias("below"), wide.alias("frozen"))
    down = F.last(F.when(F.col("first"), F.col("value")), ignorenulls=True).over(Window.partitionBy(*keys, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    return cells.select(*keys, "r", "c", F.when(F.col("frozen"), "").when(F.col("below"), F.coalesce(down, F.lit(""))).otherwise(F.col("value")).alias("value"), "frozen", "header")


def sheet_tables(grid: DataFrame, keys: list[str]) -> DataFrame:
    """caption, header and rows of each sheet that has data: the first row with more than one full cell is the header, the last lone cell above it the caption."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("c", "value"))), lambda x: x["value"])
    rows = grid.groupBy(*keys, "r").agg(cells.alias("cells")).withColumn("full", F.filter("cells", lambda v: ~T.blank(v))).where(F.size("full") > 0)
    order = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.sum((F.size("full") > 1).cast("int")).over(order))
    before = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    is_head = (F.col("head") == 1) & (F.size("full") > 1) & (F.coalesce(F.max("head").over(before), F.lit(0)) == 0)
    rows = rows.withColumn("is_head", is_head)
    past = F.coalesce(F.max(F.col("is_head").cast("int")).over(before), F.lit(0)) == 1
    rows = rows.withColumn("past", past)
    named = F.transform("cells", lambda v, i: F.when(T.blank(v), F.concat(F.lit("列"), (i + 1).cast("string"))).otherwise(T.jtrim(v)))
    out = rows.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.when(~F.col("is_head") & ~F.col("past"), F.get("full", F.lit(0))), F.when(~F.col("is_head") & ~F.col("past"), F.col("r"))), F.lit("")).alias("caption"),
        F.first(F.when(F.col("is_head"), named), ignorenulls=True).alias("header"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("past"), F.struct("r", "cells")))), lambda x: x["cells"]).alias("rows"),
    )
    return out.where(F.col("header").isNotNull() & (F.size("rows") > 0))


def sheet_title(file_name: Column, sheet: Column) -> Column:
    """The file's name without its extension, and the sheet's."""
    base = F.when(T.blank(file_name), "Excel").otherwise(F.substring(F.regexp_replace(file_name, r"(?s)^(.+)\.[^.]*$", "$1"), 1, NAME_CHARS))
    return F.substring(F.concat(base, F.lit(" - "), sheet), 1, TITLE_CHARS)


def sheet_pieces(tables: DataFrame, keys: list[str], size: int = S.SIZE) -> DataFrame:
    """Pieces of the tables: whole where they fit, else groups of rows that repeat caption and header. Only tables that don't fit become Python objects."""
    bar = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    caption = F.when(F.col("caption").rlike(f"[^{S.BLANK}]"), F.array("caption")).otherwise(F.array().cast("array<string>"))
    lines = F.concat(caption, F.array(bar(F.col("header")), bar(F.transform("header", lambda _: F.lit("---")))), F.transform("rows", bar))
    # The last character is a bar, so only the front is trimmed.
    rows = tables.withColumn("whole", F.regexp_replace(F.array_join(lines, "\n"), r"^[\x00-\x20]+", ""))
    fits = F.length("whole") <= size
    rows = rows.select(*keys, F.when(~fits, F.struct("caption", "header", "rows")).alias("table"), F.when(fits, F.col("whole")).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*[batch.schema.field(k) for k in keys], ("seq", pa.int32()), ("content", batch.schema.field("whole").type)])
            one, several = batch.filter(batch["whole"].is_valid()), batch.filter(batch["whole"].is_null())
            yield pa.RecordBatch.from_arrays([*(one[k] for k in keys), pa.array(np.zeros(one.num_rows, np.int32)), one["whole"]], schema=schema)
            yield from S.packed(((*row[:-2], k, piece) for row in S.in_steps([several]) for k, piece in enumerate(S.table_pieces(tuple(row[-2].values()), size))), schema)

    kinds = dict(tables.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", seq int, content string")


def parsed_sheets(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """From cells and merged regions to tables; the header row is looked up before regions are expanded. Cells move once."""
    return sheet_tables(run_down(laid(marks(cells, merges, keys), keys), keys), keys)
