"""Queries over kept tables and jobs: keyed merges, ingest, extraction, answering rounds, rules of tables, near vectors, collations."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from sagebase.functions import text as T
from sagebase.operators import answering as A
from sagebase.operators import constraints as N
from sagebase.operators import knowledge as K
from sagebase.operators import retrieve as R
from sagebase.operators.extraction import Job
from sagebase.operators.keyed import KeyedTable
from sagebase.operators.nearest import VectorIndex
from sagebase.plans.views import frame, oracle
from sagebase.sources.store import shared_folder
from sagebase.streaming.ingest import Ingest

TERMS = "kb_id long, id long, term string, status string, deleted boolean"


def _terms(spark, sf):
    return frame(spark, sf, "v_term").select(F.col("kb_id").cast("long").alias("kb_id"), F.col("id").cast("long").alias("id"), "term", "status", "deleted")


def keyed_merge(spark, sf):
    """A table of terms after a load, a merge of a third of it twice (under one name) and a deletion."""
    terms = _terms(spark, sf)
    held = KeyedTable(spark, shared_folder(spark, "terms"), TERMS, ["kb_id", "id"], 8)
    held.upsert(terms.where("id % 5 > 0"))
    merge = terms.where("id % 3 = 0").withColumn("status", F.lit("MERGED"))
    for _ in range(2):
        held.upsert(merge, write_id="merge-1")
    held.delete(terms.where("id % 7 = 0"))
    return held.read()


def ingested_chunks(spark, sf):
    """Chunks of documents that came in three batches, one of them twice, and of which some came late in an old version."""
    docs = frame(spark, sf, "documents").select("doc_id", "text")
    held = Ingest(spark, shared_folder(spark, "ingest"))
    now = docs.select("doc_id", "text", F.lit(5).alias("arrived"))
    old = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("an older text "), "text", "text").alias("text"), F.lit(3).alias("arrived"))
    held.add(old.where("doc_id % 4 = 0"), "0")
    for _ in range(2):
        held.add(now.where("doc_id % 3 > 0"), "1")
    held.chunks.vacuum()  # nobody else reads this table
    held.add(now.where("doc_id % 3 = 0").unionByName(old), "2")
    return held.current()


def _failing(text: str) -> str:
    if len(text) % 101 == 7:
        raise ValueError(f"no reply for {len(text)} characters")
    return f'[{", ".join(chr(123) + chr(34) + "question" + chr(34) + ": " + chr(34) + f"q{k}" + chr(34) + ", " + chr(34) + "answer" + chr(34) + ": " + chr(34) + "a" + chr(34) + chr(125) for k in range(len(text) % 4))}]'


def _extraction(spark, sf):
    docs = frame(spark, sf, "documents").select("doc_id")
    state = docs.where("doc_id % 13 > 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "FAILED").otherwise("SUCCESS").alias("parse_status"))
    job = Job(shared_folder(spark, "extraction"), 7, docs, state, frame(spark, sf, "v_chunk"), {"BUSINESS": _failing, "QA": lambda t: _failing(t[1:])}, 4, docs.where("doc_id % 17 = 0"))
    job.run()
    return job


def extraction_log(spark, sf):
    """The log of an extraction job in which single items fail."""
    return _extraction(spark, sf).log()


def extraction_summary(spark, sf):
    return _extraction(spark, sf).summary()


RULES = [
    N.Unique("documents", ("doc_id",)), N.Unique("labels", ("doc_id",)), N.Unique("conversations", ("conv_id", "turn")), N.Unique("lineitem", ("l_orderkey", "l_linenumber")), N.Unique("clicks", ("click_id",)),
    N.Unique("clients", ("client_id",)), N.Unique("clients", ("email",)), N.Unique("sale_lines", ("sale_id", "line_no")), N.Unique("sales", ("sale_id",)), N.Unique("client_changes", ("client_id", "seq")),
    N.Reference("labels", ("doc_id",), "documents", ("doc_id",)), N.Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), N.Reference("clicks", ("client_id",), "clients", ("client_id",)),
    N.Reference("sales", ("client_id",), "clients", ("client_id",)), N.Reference("sale_lines", ("sale_id",), "sales", ("sale_id",)), N.Reference("sale_lines", ("item_id",), "items", ("item_id",)), N.Reference("sale_lines", ("vendor_id",), "vendors", ("vendor_id",)), N.Reference("clients", ("nation_id",), "nation", ("n_nationkey",)), N.Reference("clients", ("master_id",), "clients", ("client_id",)),
]


def rule_violations(spark, sf):
    """Keys that break the rules of the tables."""
    tables = {t for r in RULES for t in (r.table, *((r.target,) if isinstance(r, N.Reference) else ()))}
    return N.violations({t: spark.read.parquet(f"{sf}/{t}.parquet") for t in tables}, RULES)


def near_vectors(spark, sf):
    """The nearest vectors of every twentieth, by the stored index looking into all cells: exact."""
    vectors = frame(spark, sf, "v_vector")
    index = VectorIndex(spark, shared_folder(spark, "vectors"))
    index.build(vectors)
    return index.top(frame(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 15, probes=0).withColumnRenamed("id", "chunk_id")


def near_vectors_probed(spark, sf):
    """The same from the cells nearest to each query."""
    vectors = frame(spark, sf, "v_vector")
    index = VectorIndex(spark, shared_folder(spark, "vectors"))
    index.build(vectors)
    return index.top(frame(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 15).withColumnRenamed("id", "chunk_id")


def _accented(spark, sf):
    """Clients' names as terms, a part of them in other cases and with accents."""
    name = F.when(F.col("client_id") % 3 == 0, F.upper("name")).when(F.col("client_id") % 3 == 1, F.replace("name", F.lit("e"), F.lit("é"))).otherwise(F.col("name"))
    return spark.read.parquet(f"{sf}/clients.parquet").where("name is not null and client_id is not null").groupBy("client_id").agg(F.min("name").alias("name")).select(F.col("client_id").alias("id"), (F.col("client_id") % 4).alias("kb_id"), name.alias("term"), F.lit("DRAFT").alias("status"), F.lit(False).alias("deleted"))


def draft_dedup_collated(spark, sf):
    """Drafts whose names differ in case or accents only are one."""
    return K.draft_dedup(_accented(spark, sf), "term", K.BLIND).select("kb_id", "id", "deleted")


def _scripted(kind: str):
    """A stand-in for a model: replies that follow from the prompt's checksum."""

    def reply(p: str) -> str:
        k = zlib.crc32(p.encode())
        return {
            "route": '{"fragments": [{"text": "%s", "intent": "%s"}]}' % (" ".join(p.split()[1:9]), "BUSINESS" if k % 9 else "CHITCHAT"),
            "rewrite": f"1. {' '.join(p.split()[1 + k % 3 : 6 + k % 3])}\n2. {' '.join(p.split()[1:4])}",
            "compose": f"so [1] and [{k % 9}]", "verify": '{"score": %d, "missing": "part %d"}' % (k % 130, k % 5),
            "claims": '[{"claim": "c", "verdict": "%s", "evidence": 1}]' % ("SUPPORTED" if k % 4 else "UNSUPPORTED"), "chat": f"hello {k % 5}", "merge": f"both {k % 5}",
        }[kind]

    return lambda prompts: [reply(p) for p in prompts]


def answering_rounds(spark, sf):
    """Benchmark items as questions, answered from documents by keywords, with scripted models: how each ended, and after how many rounds."""
    docs = frame(spark, sf, "documents").select("doc_id", "text")

    def recall(queries):
        ids = queries.withColumn("query_id", F.col("question_id") * 100 + F.col("pos"))
        terms = ids.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
        best = R.top(R.bm25(docs, terms, "text"), ["query_id"], 8)
        named = best.join(docs, "doc_id").select(F.floor(F.col("query_id") / 100).cast("long").alias("question_id"), F.pmod("query_id", F.lit(100)).cast("int").alias("pos"), "rank", F.lit("CHUNK").alias("source_type"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_name"), F.lit("").alias("title"), F.substring("text", 1, 300).alias("content"), (1.0 / (60 + F.col("rank"))).alias("score"))
        return named

    models = A.Models(**{k: _scripted(k) for k in ("route", "rewrite", "compose", "verify", "claims", "chat", "merge")})
    found = A.answered(frame(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("question_id"), F.col("text").alias("question")), models, recall, shared_folder(spark, "answers"))
    return found.select("question_id", "decision", "retry", "merge", F.size("evidence").alias("evidence"), "answer")


QUERIES = {f.__name__: f for f in (keyed_merge, ingested_chunks, extraction_log, extraction_summary, rule_violations, near_vectors, near_vectors_probed, draft_dedup_collated, answering_rounds)}

_CALLS = """ch as (select doc_id, seq, length(content) as n, length(content) - 1 as m from v_chunk), st as (select doc_id, case when doc_id % 17 = 0 then '正在被其他抽取任务处理' when doc_id % 13 = 0 then '文档不存在' when doc_id % 11 = 0 then '文档未完成解析（parse_status=FAILED）' end as refused from documents),
  cl as (select doc_id, seq, 0 as nth, n as len from ch union all select doc_id, seq, 1, greatest(m, 0) from ch), bd as (select cl.doc_id, min(seq * 2 + nth) as at, arg_min(len, seq * 2 + nth) as len from cl join st using (doc_id) where refused is null and len % 101 = 7 group by 1),
  ok as (select doc_id, coalesce(sum(len % 4) filter (nth = 0), 0)::bigint as b, coalesce(sum(len % 4) filter (nth = 1), 0)::bigint as q from cl group by 1),
  lg as (select 7::bigint as task_id, st.doc_id, refused is null and bd.doc_id is null as ok, coalesce(refused, 'no reply for ' || bd.len::varchar || ' characters') as error, case when refused is null and bd.doc_id is null then coalesce(b, 0) else 0 end as "BUSINESS", case when refused is null and bd.doc_id is null then coalesce(q, 0) else 0 end as "QA"
    from st left join bd using (doc_id) left join ok on ok.doc_id = st.doc_id)"""
_NAMES = "nm as (select client_id as id, client_id % 4 as kb_id, case when client_id % 3 = 0 then upper(name) when client_id % 3 = 1 then replace(name, 'e', 'é') else name end as term from (select client_id, min(name) as name from clients where name is not null and client_id is not null group by 1))"


def _key(columns: tuple[str, ...]) -> str:
    return "'[' || " + " || ',' || ".join(f"""'"' || replace(replace({c}::varchar, '\\', '\\\\'), '"', '\\"') || '"'""" for c in columns) + " || ']'"


def _rule_sql(rule) -> str:
    full = " and ".join(f"{c} is not null" for c in rule.columns)
    if isinstance(rule, N.Unique):
        return f"select '{rule.name}' as rule, {_key(rule.columns)} as key, count(*) as n from {rule.table} where {full} group by all having count(*) > 1"
    same = " and ".join(f"o.{b} = t.{a}" for a, b in zip(rule.columns, rule.target_columns, strict=True))
    return f"select '{rule.name}' as rule, {_key(rule.columns)} as key, count(*) as n from {rule.table} t where {full} and not exists (select 1 from {rule.target} o where {same}) group by all"


_COS = """c as (select q.vec_id as query_id, v.chunk_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])), 6) as score
  from embeddings q cross join v_vector v where q.vec_id % 20 = 0)"""

ORACLE_SQL = {
    "keyed_merge": oracle("select kb_id, id, term, case when id % 3 = 0 then 'MERGED' else status end as status, deleted from v_term where (id % 5 > 0 or id % 3 = 0) and id % 7 > 0"),
    "ingested_chunks": oracle("select doc_id, seq, content from v_chunk"),
    "extraction_log": oracle(f"with {_CALLS} select * from lg"),
    "extraction_summary": oracle(f"""with {_CALLS} select task_id, count(*) as total, count(*) as processed, 100 as progress, case when bool_and(ok) then 'SUCCESS' when bool_or(ok) then 'PARTIAL_FAILED' else 'FAILED' end as status, sum("BUSINESS")::bigint as "BUSINESS", sum("QA")::bigint as "QA" from lg group by 1"""),
    "rule_violations": " union all ".join(_rule_sql(r) for r in RULES),
    "near_vectors": oracle(f"with {_COS} select query_id, chunk_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from c) where rank <= 15"),
    "draft_dedup_collated": oracle(f"with {_NAMES} select kb_id, id, row_number() over (partition by kb_id, strip_accents(lower(rtrim(term))) order by id desc) > 1 as deleted from nm"),
}
