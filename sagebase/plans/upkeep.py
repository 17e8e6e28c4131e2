"""Queries over the upkeep of the search index."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebase.operators import index as X
from sagebase.plans.service import _CHUNKS, _chunks
from sagebase.plans.views import frame, oracle


def _entries(spark, sf):
    docs = frame(spark, sf, "v_document").where("id % 6 > 0").select(F.col("id").alias("doc_id"), "file_name")
    rows = _chunks(spark, sf).withColumn("doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")))
    return X.chunk_entries(rows, docs)


def _items(spark, sf):
    terms = frame(spark, sf, "v_term")
    source = F.when(F.col("id") % 2 == 0, "BUSINESS").otherwise("QA")
    return X.source_entries(terms.select(source.alias("source_type"), "id", "kb_id", F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("doc_id"), F.when(F.col("id") % 4 > 0, "d").alias("doc_name"), F.col("term").alias("title"), F.col("scope").alias("content")))


def waiting_chunks(spark, sf):
    return X.waiting(frame(spark, sf, "v_chunk_state")).select("doc_id", "seq")


def embed_batches(spark, sf):
    return X.waiting(frame(spark, sf, "v_chunk_state")).select("doc_id", "seq", X.batch_of(["doc_id"], ["seq"], X.EMBED_BATCH).alias("batch"))


def hashed(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedder: eight numbers from the letters of a text."""
    return [[float(sum(t.encode()[k::8]) % 251) for k in range(8)] for t in texts]


def embedded_chunks(spark, sf):
    rows = _chunks(spark, sf).select("id", X.embed_text(F.col("title"), F.col("content")).alias("text"))
    return X.embedded(rows, "text", hashed).select("id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"))


def index_entries(spark, sf):
    return _entries(spark, sf).select("entry", "doc_id", "kb_id", "doc_name", "page_num", "title", "source_type", F.md5(F.col("content").cast("binary")).alias("digest"), "clean_status")


def source_upsert(spark, sf):
    """An index of knowledge items after a new write of some."""
    items = _items(spark, sf)
    again = items.where("chunk_id % 5 = 0").withColumn("content", F.concat("content", F.lit(" again")))
    return X.upserted(items.where("chunk_id % 5 < 3"), again).select("entry", "doc_id", "doc_name", "title", "source_type", "content")


def bulk_write_states(spark, sf):
    rows = X.waiting(_chunks(spark, sf))
    lost = frame(spark, sf, "documents").where("doc_id % 11 = 0").select("doc_id", F.lit(0).alias("batch"))
    return X.written(rows, rows.where("id % 13 = 0").select("id"), lost)


def document_chunks_removed(spark, sf):
    index = _entries(spark, sf).withColumn("source_type", F.when(F.col("chunk_id") % 3 == 0, F.lit("CHUNK")).when(F.col("chunk_id") % 3 == 1, F.lit("QA")))
    return X.without_document(index, frame(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id")).select("entry", "doc_id", "source_type")


def bases_removed(spark, sf):
    return X.without_bases(_items(spark, sf), frame(spark, sf, "documents").where("doc_id in (1, 3)").select(F.col("doc_id").alias("kb_id"))).select("entry", "kb_id")


def retry_failed_chunks(spark, sf):
    return frame(spark, sf, "v_chunk_state").select("doc_id", "seq", X.retried(F.col("status"), F.col("clean_status")).alias("status"))


QUERIES = {f.__name__: f for f in (waiting_chunks, embed_batches, embedded_chunks, index_entries, source_upsert, bulk_write_states, document_chunks_removed, bases_removed, retry_failed_chunks)}

_WAIT = "status = 'EMBEDDING' and coalesce(clean_status, '') <> 'SUSPECT'"
_ENTRIES = f"{_CHUNKS}, en as (select id::varchar as entry, id as chunk_id, case when doc_id % 7 > 0 then doc_id else 0 end as doc_id, kb_id, case when doc_id % 7 > 0 and doc_id % 6 > 0 then (select source from documents d where d.doc_id = ck.doc_id) || '-' || doc_id::varchar || '.md' else '' end as doc_name, coalesce(page_num, 0) as page_num, coalesce(title, '') as title, content, coalesce(clean_status, '') as clean_status from ck)"
_ITEMS = "it as (select case when id % 2 = 0 then 'BUSINESS' else 'QA' end as source_type, id, kb_id, case when id % 3 > 0 then id % 50 else 0 end as doc_id, case when id % 4 > 0 then 'd' else '' end as doc_name, term as title, scope as content from v_term where trim(coalesce(scope, '')) <> '')"

ORACLE_SQL = {
    "waiting_chunks": oracle(f"select doc_id, seq from v_chunk_state where {_WAIT}"),
    "embed_batches": oracle(f"select doc_id, seq, ((row_number() over (partition by doc_id order by seq) - 1) // 10)::int as batch from v_chunk_state where {_WAIT}"),
    "index_entries": oracle(f"with {_ENTRIES} select entry, doc_id, kb_id, doc_name, page_num, title, 'CHUNK' as source_type, md5(content) as digest, clean_status from en"),
    "source_upsert": oracle(f"with {_ITEMS} select source_type || '-' || id::varchar as entry, doc_id, doc_name, title, source_type, content || case when id % 5 = 0 then ' again' else '' end as content from it where id % 5 < 3"),
    "bulk_write_states": oracle(f"with {_CHUNKS}, w as (select *, ((row_number() over (partition by doc_id order by seq) - 1) // 100)::int as batch from ck where {_WAIT}), x as (select *, id % 13 = 0 or (doc_id % 11 = 0 and batch = 0) as bad from w) select id, batch, case when bad then 'FAILED' else 'INDEXED' end as status, case when not bad then id::varchar end as entry from x"),
    "document_chunks_removed": oracle(f"with {_ENTRIES}, t as (select *, case chunk_id % 3 when 0 then 'CHUNK' when 1 then 'QA' end as source_type from en) select entry, doc_id, source_type from t where not (doc_id in (select doc_id from documents where doc_id % 2 = 0) and coalesce(source_type, 'CHUNK') = 'CHUNK')"),
    "bases_removed": oracle(f"with {_ITEMS} select source_type || '-' || id::varchar as entry, kb_id from it where kb_id not in (1, 3)"),
    "retry_failed_chunks": oracle("select doc_id, seq, case when status = 'FAILED' and coalesce(clean_status, '') <> 'FILTERED' then 'EMBEDDING' else status end as status from v_chunk_state"),
}
