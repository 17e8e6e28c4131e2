"""Upkeep of the search index as tables: what goes in, what goes out, and the states that follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebase.functions import text as T

# Texts of one call to an embedder, items of one write.
EMBED_BATCH, WRITE_BATCH = 10, 100


def waiting(chunks: DataFrame) -> DataFrame:
    """Chunks to embed: in state EMBEDDING and not suspect (a chunk that was never judged isn't)."""
    return chunks.where((F.col("status") == "EMBEDDING") & ~F.col("clean_status").eqNullSafe("SUSPECT"))


def embed_text(title: Column, content: Column) -> Column:
    return F.when(T.blank(title), content).otherwise(F.concat_ws("\n", title, content))


def batch_of(keys: list[str], order: list[str], size: int) -> Column:
    """The number of a row's batch within its key, from 0."""
    return F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("int")


def embedded(rows: DataFrame, text_col: str, embedder: Callable[[list[str]], list[list[float]]], size: int = EMBED_BATCH) -> DataFrame:
    """The rows with a vector each, from an embedder that gets `size` texts at a time in the order of the rows. Nothing moves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            vectors = [v for a in range(0, len(texts), size) for v in embedder(texts[a : a + size])]
            if len(vectors) != len(texts):
                raise ValueError("the embedder gave another number of vectors than texts")
            yield pdf.assign(embedding=vectors)

    return rows.mapInPandas(run, rows.withColumn("embedding", F.array().cast("array<float>")).schema)


def chunk_entries(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Index entries of chunks: what is null becomes 0 or empty. chunks: id, doc_id, kb_id, page_num, title, content, clean_status; documents: doc_id, file_name."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = chunks.join(documents.select("doc_id", F.col("file_name").alias("doc_name")), "doc_id", "left")
    return rows.select(
        F.col("id").cast("string").alias("entry"), F.col("id").alias("chunk_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "kb_id", empty("doc_name"),
        F.coalesce("page_num", F.lit(0)).alias("page_num"), empty("title"), F.lit("CHUNK").alias("source_type"), "content", empty("clean_status"),
    )


def source_entries(items: DataFrame) -> DataFrame:
    """Index entries of knowledge items, under TYPE-id; items without content give none. items: source_type, id, kb_id, doc_id, doc_name, title, content."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = items.where(~T.blank(F.col("content")))
    return rows.select(
        F.concat_ws("-", "source_type", F.col("id").cast("string")).alias("entry"), F.col("id").alias("chunk_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "kb_id", empty("doc_name"),
        F.lit(0).alias("page_num"), empty("title"), "source_type", "content", F.lit("").alias("clean_status"),
    )


def upserted(index: DataFrame, entries: DataFrame) -> DataFrame:
    """The index after writing entries: one row an entry, the new one where both have it. Entries must not repeat."""
    kept = index.join(entries.select("entry"), "entry", "left_anti")
    return kept.select(entries.columns).unionByName(entries)


def written(chunks: DataFrame, failed: DataFrame, lost: DataFrame) -> DataFrame:
    """Chunks after a write in batches of WRITE_BATCH by document and place: those whose item failed (failed: id) or whose whole batch was lost (lost: doc_id, batch)
    are FAILED, the others INDEXED under their id."""
    bad = failed.select("id", F.lit(True).alias("bad")).distinct()
    gone = lost.select("doc_id", "batch", F.lit(True).alias("gone")).distinct()
    rows = chunks.withColumn("batch", batch_of(["doc_id"], ["seq"], WRITE_BATCH)).join(bad, "id", "left").join(gone, ["doc_id", "batch"], "left")
    ok = F.col("bad").isNull() & F.col("gone").isNull()
    return rows.select("id", "batch", F.when(ok, "INDEXED").otherwise("FAILED").alias("status"), F.when(ok, F.col("id").cast("string")).alias("entry"))


def without_document(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the chunks (also those of no type, from before types) of some documents (doc_id); knowledge items stay."""
    hit = index.join(gone.select("doc_id").distinct().withColumn("gone", F.lit(True)), "doc_id", "left")
    chunk = F.col("source_type").isNull() | (F.col("source_type") == "CHUNK")
    return hit.where(F.col("gone").isNull() | ~chunk).drop("gone")


def without_bases(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without all entries of some knowledge bases (kb_id)."""
    return index.join(gone.select("kb_id").distinct(), "kb_id", "left_anti")


def retried(status: Column, clean_status: Column) -> Column:
    """Failed chunks wait again, unless they were filtered."""
    return F.when((status == "FAILED") & ~clean_status.eqNullSafe("FILTERED"), "EMBEDDING").otherwise(status)
