"""Streaming ingest: files that arrive become chunks and index entries by keyed writes; a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sagebase.operators import segment as S
from sagebase.operators.keyed import KeyedTable

CHUNKS = "doc_id long, seq int, content string, arrived long"
DOCUMENTS = "doc_id long, chunks int, arrived long"


class Ingest:
    """Documents (doc_id, text, arrived: a number that grows) as two keyed tables in a folder: their chunks, and one row for each document.

    The latest arrival of a document counts, whatever the order of batches: what arrives late changes nothing. A shorter version takes the place of a
    longer one as a whole. A text that is null or empty has no chunks.
    """

    def __init__(self, spark: SparkSession, folder: str, width: int = 800, buckets: int = 16):
        self.width = width
        self.chunks = KeyedTable(spark, f"{folder}/chunks", CHUNKS, ["doc_id", "seq"], buckets)
        self.documents = KeyedTable(spark, f"{folder}/documents", DOCUMENTS, ["doc_id"], buckets)

    def add(self, batch: DataFrame, write_id: str | None = None) -> None:
        """One batch. Chunks come first and the documents' rows last, so that what a broken write left behind isn't seen."""
        latest = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(F.col("arrived").cast("long").alias("arrived"), F.coalesce("text", F.lit("")).alias("text"))).alias("row"))
        new = latest.select("doc_id", "row.arrived", "row.text")
        known = self.documents.read().select("doc_id", F.col("arrived").alias("known"))
        new = new.join(known, "doc_id", "left").where("known is null or arrived > known").drop("known")
        # The arrival goes with the id, and a text's length says how many chunks it has: texts meet nothing but what is known.
        named = new.select(F.struct("doc_id", "arrived").alias("id"), "text")
        pieces = S.fixed_width(named, "id", "text", self.width).select("id.doc_id", "seq", "content", "id.arrived")
        rows = new.select("doc_id", F.ceil(F.length("text") / self.width).cast("int").alias("chunks"), "arrived")
        self.chunks.upsert(pieces, write_id=write_id)
        self.documents.upsert(rows, write_id=write_id)

    def current(self) -> DataFrame:
        """The chunks of each document's latest arrival: doc_id, seq, content."""
        rows = self.documents.read().select("doc_id", F.col("arrived").alias("latest"))
        return self.chunks.read().join(rows, "doc_id").where("arrived = latest").select("doc_id", "seq", "content")

    def stream(self, source: DataFrame, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
        """A query that adds each micro-batch under its number; after a failure Spark repeats a batch under the same number, and it counts once."""

        def write(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            try:
                self.add(batch, f"{name}-{number}")
            finally:
                batch.unpersist()

        return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
