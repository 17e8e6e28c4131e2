"""A kept inverted index: postings by term bucket in segments, with lengths, maxima, tombstones and compaction; BM25 from it.

Every write adds a segment and a manifest that names the segments that count; files of earlier segments stay as they are, so readers are never
disturbed and a lost write leaves nothing behind that counts. A row of a segment is dead once a later segment names its document.

    postings/write=<name>/segment=3/bucket=17   field, term, doc_id, tf, len   (ordered by term, so a scan skips row groups)
    maxima/write=<name>/segment=3               bucket, field, term, tf (largest), len (least)
    lengths/write=<name>/segment=3              field, doc_id, len
    dead/write=<name>/segment=3                 doc_id
    manifest/00000004                           the segments of version 4, each with the name of its write
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebase.functions import text as T
from sagebase.operators import retrieve as R
from sagebase.sources import store

#: Buckets of terms; characters of a task that makes postings.
BUCKETS, CHARS_A_TASK = 64, 3_000_000
#: What rounded scores can differ by.
SLACK = 1e-5


class Index:
    """An index under a folder. It keeps documents by doc_id (long) with some text fields."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.fields, self.buckets = spark, path.rstrip("/"), fields, buckets

    def manifest(self) -> dict:
        """The latest version: its number, the segments that count, the next segment's number."""
        found = store.names(self.spark, f"{self.path}/manifest")
        return json.loads(store.get(self.spark, f"{self.path}/manifest/{found[-1]}")) if found else {"version": 0, "segments": [], "next": 1}

    def commit(self, before: dict, segments: list[list]) -> None:
        """A manifest after `before`. If another writer was faster it is there already, and this write fails as a whole; its files have a name of their own."""
        after = {"version": before["version"] + 1, "segments": segments, "next": before["next"] + 1}
        store.put(self.spark, f"{self.path}/manifest/{after['version']:08d}", json.dumps(after).encode())

    def rows(self, kind: str, schema: str, segments: list[list]) -> DataFrame:
        """Rows of some segments, with their segment."""
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        reader = self.spark.read.schema(f"{schema}, write string, segment int").option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*[f"{self.path}/{kind}/write={name}/segment={k}" for k, name in segments]).drop("write")

    def dead(self, segments: list[list]) -> DataFrame:
        """doc_id and the last segment that names it as gone."""
        return self.rows("dead", "doc_id long", segments).groupBy("doc_id").agg(F.max("segment").alias("gone"))

    def live(self, rows: DataFrame, segments: list[list]) -> DataFrame:
        """Rows without those of documents that a later segment names. The join keeps how the rows were dealt by document."""
        gone = self.dead(segments).withColumnRenamed("doc_id", "dead_id")
        return rows.join(gone, (F.col("doc_id") == F.col("dead_id")) & (F.col("segment") < F.col("gone")), "left_anti") if len(segments) > 1 else rows

    def write(self, segment: int, postings: DataFrame, lengths: DataFrame, dead: DataFrame, n: int = 1) -> list:
        """Writes a segment that no manifest names yet, by n tasks: its number and the name of the write."""
        name = uuid.uuid4().hex[:12]
        at = lambda kind: f"{self.path}/{kind}/write={name}/segment={segment}"
        bucketed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        # A bucket may hold a term of nearly all documents: it is dealt to several tasks and files, the more the more postings there are.
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, self.spark.sparkContext.defaultParallelism // 2, 2 * n // self.buckets)))
        bucketed.repartition(n, "bucket", salt).sortWithinPartitions("bucket", "field", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        written = self.spark.read.schema("field string, term string, doc_id long, tf long, len int, bucket int").parquet(at("postings"))
        written.groupBy("bucket", "field", "term").agg(F.max("tf").alias("tf"), F.min("len").alias("len")).write.mode("overwrite").parquet(at("maxima"))
        lengths.write.mode("overwrite").parquet(at("lengths"))
        dead.write.mode("overwrite").parquet(at("dead"))
        return [segment, name]

    def upsert(self, docs: DataFrame) -> None:
        """Writes documents (doc_id and the fields; null texts are empty), in place of those with the same id. Rows without an id are left out; of
        rows with the same id one stays, the one with the greatest texts."""
        before = self.manifest()
        docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *self.fields)
        chars = docs.select(F.sum(sum(F.coalesce(F.length(f), F.lit(0)) for f in self.fields))).first()[0] or 0
        n = max(1, -(-chars // CHARS_A_TASK))
        docs = docs.repartition(n, "doc_id").groupBy("doc_id").agg(F.max(F.struct(*[F.coalesce(F.col(f), F.lit("")).alias(f) for f in self.fields])).alias("row"))
        parts = [F.struct(F.lit(f).alias("field"), T.tokens(F.col(f"row.{f}")).alias("terms")) for f in self.fields]
        sized = docs.select("doc_id", F.inline(F.array(*parts))).withColumn("len", F.size("terms"))
        terms = sized.select("field", "doc_id", "len", F.explode("terms").alias("term")).groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
        new = self.write(before["next"], terms, sized.select("field", "doc_id", "len"), docs.select("doc_id"), n)
        self.commit(before, [*before["segments"], new])

    def delete(self, gone: DataFrame) -> None:
        """Removes documents (doc_id)."""
        before = self.manifest()
        none = self.spark.createDataFrame([], "field string, term string, doc_id long, tf long, len int")
        new = self.write(before["next"], none, none.select("field", "doc_id", "len"), gone.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
        self.commit(before, [*before["segments"], new])

    def compact(self) -> None:
        """All segments as one without what is dead; the old ones stay for readers until `vacuum`."""
        before = self.manifest()
        n = R.tasks(self.postings(before["segments"]).count())
        postings = self.live(self.postings(before["segments"]).repartition(n, "doc_id"), before["segments"]).select("field", "term", "doc_id", "tf", "len")
        lengths = self.live(self.rows("lengths", "field string, doc_id long, len int", before["segments"]), before["segments"]).select("field", "doc_id", "len")
        new = self.write(before["next"], postings, lengths, self.spark.createDataFrame([], "doc_id long"), n)
        self.commit(before, [new])

    def vacuum(self) -> None:
        """Deletes segments that the latest manifest doesn't name, and older manifests. Not while others read or write."""
        now = self.manifest()
        keep = {f"write={name}" for _, name in now["segments"]}
        for kind in ("postings", "maxima", "lengths", "dead"):
            for name in store.names(self.spark, f"{self.path}/{kind}"):
                if name not in keep:
                    store.delete(self.spark, f"{self.path}/{kind}/{name}")
        for name in store.names(self.spark, f"{self.path}/manifest")[:-1]:
            store.delete(self.spark, f"{self.path}/manifest/{name}")

    def postings(self, segments: list[list]) -> DataFrame:
        return self.rows("postings", "field string, term string, doc_id long, tf long, len int, bucket int", segments)

    def hits(self, wanted: DataFrame, queries: int = 1) -> tuple[DataFrame, DataFrame]:
        """Live postings of some terms (term, distinct), with field, doc_id, tf, len and the weight that BM25 gives them; and field, term, bound: a weight that no
        posting of the term exceeds. Only buckets of these terms are read.

        Postings are dealt by document, to as many tasks as their number or the scores of so many queries ask for; up to R.TERMS terms are broadcast.
        """
        segments = self.manifest()["segments"]
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        some = [r[0] for r in wanted.select(bucket).distinct().collect()]  # as many as there are buckets, at most
        small = F.broadcast if wanted.limit(R.TERMS + 1).count() <= R.TERMS else lambda df: df
        rows = self.postings(segments).where(F.col("bucket").isin(some))
        lengths = self.rows("lengths", "field string, doc_id long, len int", segments)
        own = rows.join(small(wanted), "term").select("field", "term", "doc_id", "tf", "len", "segment").repartition(R.tasks(rows.count(), lengths.count(), queries), "doc_id")
        own = self.live(own, segments).select("field", "term", "doc_id", "tf", "len")
        stats = self.live(lengths, segments).groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
        df = own.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(stats), "field")  # stats: one row a field
        maxima = self.rows("maxima", "bucket int, field string, term string, tf long, len int", segments).where(F.col("bucket").isin(some)).groupBy("field", "term").agg(F.max("tf").alias("tf"), F.min("len").alias("len"))
        weights = own.join(small(df), ["field", "term"]).withColumn("w", R.bm25_weight()).select("field", "term", "doc_id", "w")
        return weights, df.join(maxima, ["field", "term"]).select("field", "term", R.bm25_weight().alias("bound"))

    def _asked(self, queries: DataFrame) -> tuple:
        """How queries (query_id, term) go to the postings, and their weights and bounds."""
        small = F.broadcast if queries.limit(R.PAIRS + 1).count() <= R.PAIRS else lambda df: df
        return small, *self.hits(queries.select("term").distinct(), queries.select("query_id").distinct().count())

    def bm25(self, queries: DataFrame) -> DataFrame:
        """query_id, doc_id, field and BM25 score, as retrieve.bm25_fields gives them over the live documents. queries: query_id, term."""
        small, weights, _ = self._asked(queries)
        return weights.join(small(queries), "term").groupBy("query_id", "doc_id", "field").agg(F.round(F.sum("w"), 6).alias("score"))

    def top(self, queries: DataFrame, field: str, k: int) -> DataFrame:
        """query_id, doc_id, score and rank of the k best by one field, exactly.

        The k-th best score by a query's strongest term alone is a threshold. A document that has only terms which together can't reach it (by their bounds,
        weakest first) isn't among the best and isn't ranked; such terms count for documents that another term brings.
        """
        small, weights, bounds = self._asked(queries)
        weights, bounds = weights.where(F.col("field") == field).drop("field"), bounds.where(F.col("field") == field)
        own = Window.partitionBy("query_id")
        terms = queries.distinct().join(bounds.drop("field"), "term")
        terms = terms.withColumn("nth", F.row_number().over(own.orderBy(F.desc("bound"), "term"))).withColumn("weaker", F.sum("bound").over(own.orderBy("bound", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)))
        strongest = weights.join(small(terms.where("nth = 1").select("query_id", "term")), "term")
        kth = strongest.withColumn("rank", F.row_number().over(own.orderBy(F.desc("w"), "doc_id"))).where(F.col("rank") == k).select("query_id", F.col("w").alias("least"))
        terms = terms.join(kth, "query_id", "left").withColumn("needed", F.col("least").isNull() | (F.col("weaker") >= F.col("least") - SLACK)).select("query_id", "term", "needed")
        scored = weights.join(small(terms), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"), F.max("needed").alias("needed"))
        return R.top(scored.where("needed").drop("needed"), ["query_id"], k)
