"""Sharding by bytes: global prefix sums of sizes, cut at equal targets (operator 8, DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, table


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of `n_shards` contiguous shards of nearly equal bytes.

    Rows are ordered by id (null first), then by the text's crc32 and size, so that rows of a
    repeated id have a fixed order; rows that are equal in all three are interchangeable. The size of a row is
    the UTF-8 bytes of its text plus 1. Each partition of the order gives its total; the totals' prefix sums
    give every row its global start, and the row goes to the shard that holds its middle byte.
    Slots number the rows of a shard from 0 without gaps.

    Groups: equal texts are rows like any others. Each goes where its own id stands in the order, so equal texts may lie in different shards; only rows
    of equal id and text are neighbours (and interchangeable).

    Edge cases: a null text has size 1 and crc32 0, like an empty one; a text longer than a shard's
    target makes that shard larger, and some shards may stay empty; an empty table gives no rows. Only the
    named columns are read, so further columns of any name do no harm.

    Nothing but id, size and crc32 is shuffled. The window without partition keys runs over one
    row for each partition, never over the rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = ["doc_id", "text_crc32", "size"]
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    # Written once: the range bounds are sampled, and what follows reads the parts twice.
    ranged = scratch.write(narrow.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranged")

    parts = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*keys)
    # One row for each partition of the range exchange: a bound of the session, not of the data.
    placed = (
        ranged.join(F.broadcast(parts), "part")
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"((2 * start + size) * {n_shards}) div (2 * total)")).cast("int"))
        .select("doc_id", "size", "text_crc32", "start", "row", "shard")
    )
    placed = scratch.write(placed, "placed")
    scratch.drop(ranged)
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("start").alias("byte_start"),
    )


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


#: crc32 is computed byte by byte: ids of the table of the reversed polynomial, then a fold over each text's bytes.
OP8_SQL = """
with recursive poly(i, k, v) as (
  select i, 0, i::bigint from range(256) t(i)
  union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from poly where k < 8
), crc as (select list(v order by i) as t from poly where k = 8),
d as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, hex(encode(coalesce(text, ''))) as h from documents
), c as (
  select doc_id, size::bigint as size,
    xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(0, size - 1), lambda i: ((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)::bigint)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::bigint as text_crc32
  from d cross join crc
), s as (
  select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding)::bigint - size as byte_start,
    sum(size) over ()::bigint as total from c
), p as (
  select *, least(15, ((2 * byte_start + size) * 16) // (2 * total))::int as shard from s
)
select doc_id, size, text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by byte_start) - 1 as slot, null::int as grown_shard, byte_start
from p
"""
