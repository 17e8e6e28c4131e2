"""Queries over ranking, fusion and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebase.functions import text as T
from sagebase.operators import postings as P
from sagebase.operators import retrieve as R
from sagebase.plans.views import frame, oracle
from sagebase.sources.store import shared_folder


def _docs(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.col("source").alias("title"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("doc_name"))


def _terms(spark, sf):
    text = F.concat(F.col("text"), F.lit(" src"), (F.col("item_id") % 20).cast("string"))
    return frame(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.tokens(text))).alias("term"))


def _probe(spark, sf):
    return frame(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def bm25_single_field(spark, sf):
    return R.top(R.bm25(_docs(spark, sf), _terms(spark, sf), "content"), ["query_id"], 15)


def _kept_index(spark, sf):
    """An index that was written in parts: all documents with old texts, then a third again and some that go; and merged in between."""
    docs = _docs(spark, sf).select("doc_id", "content", "title")
    index = P.Index(spark, shared_folder(spark, "postings"), ["content", "title"])
    old = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("src1 src2 outdated "), "title")).otherwise(F.col("content"))
    index.upsert(docs.where("doc_id % 7 > 0").withColumn("content", old))
    index.delete(docs.where("doc_id % 5 = 1").select("doc_id"))
    index.compact()
    index.upsert(docs.where("doc_id % 3 = 0 or doc_id % 5 = 1 or doc_id % 7 = 0"))
    index.delete(docs.where("doc_id % 11 = 0").select("doc_id"))
    return index


def bm25_kept_index(spark, sf):
    return R.top(_kept_index(spark, sf).bm25(_terms(spark, sf)).where("field = 'content'").drop("field"), ["query_id"], 15)


def bm25_kept_index_top(spark, sf):
    return _kept_index(spark, sf).top(_terms(spark, sf), "content", 15)


def _multi(spark, sf):
    docs, terms = _docs(spark, sf), _terms(spark, sf)
    return R.best_field(R.bm25_fields(docs, terms, list(R.FIELDS)))


def bm25_multi_field_best(spark, sf):
    return R.top(_multi(spark, sf), ["query_id"], 15)


def _knn(spark, sf, k):
    return R.cosine_top(frame(spark, sf, "v_vector"), _probe(spark, sf), k)


def knn_cosine_topk(spark, sf):
    return _knn(spark, sf, 15)


def knn_filtered_by_kb(spark, sf):
    return R.cosine_top(frame(spark, sf, "v_vector").where("kb_id = 1").where(R.of_source("CHUNK")), _probe(spark, sf), 15)


def source_filter_chunk_or_missing(spark, sf):
    return frame(spark, sf, "v_vector").where(R.of_source("CHUNK")).groupBy("kb_id").agg(F.count("*").alias("n"), F.count("source_type").alias("typed"))


def _lists(spark, sf):
    """The two rankings for the queries that both have: benchmark items, and the vectors of the same number."""
    words = R.top(R.bm25(_docs(spark, sf), _terms(spark, sf), "content"), ["query_id"], 50)
    near = R.cosine_top(frame(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), frame(spark, sf, "embeddings").join(frame(spark, sf, "benchmark"), F.col("vec_id") == F.col("item_id")).select(F.col("vec_id").alias("query_id"), "embedding"), 50, id_col="doc_id")
    return near, words


def hybrid_search_rrf(spark, sf):
    return R.rrf(list(_lists(spark, sf)), ["query_id"], "doc_id", 15)


def rrf_two_lists(spark, sf):
    rows = frame(spark, sf, "v_evidence").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    one = R.top(rows, ["query_id"], 100, tie="chunk_id")
    two = R.top(rows.withColumn("back", -F.col("pos")), ["query_id"], 100, score="back", tie="chunk_id")
    return R.rrf([one, two], ["query_id"], "chunk_id", 10)


def multi_source_quota(spark, sf):
    near = R.cosine_top(frame(spark, sf, "v_vector"), _probe(spark, sf), 100)
    typed = near.drop("rank").join(frame(spark, sf, "v_vector").select("chunk_id", F.coalesce("source_type", F.lit("CHUNK")).alias("source")), "chunk_id")
    ranked = R.top(typed, ["query_id", "source"], max(R.SOURCE_QUOTA.values()), tie="chunk_id")
    quota = F.create_map(*[F.lit(x) for kv in R.SOURCE_QUOTA.items() for x in kv])
    return ranked.where(F.col("rank") <= F.element_at(quota, F.col("source"))).select("query_id", "source", "chunk_id", "score", "rank")


def multi_query_fusion(spark, sf):
    return R.fuse_queries(frame(spark, sf, "v_evidence").withColumn("question", F.col("query_id") % 50), ["question"])


def exclude_accumulated(spark, sf):
    rows = frame(spark, sf, "v_evidence").withColumn("question", F.col("query_id") % 50).withColumn("evidence", R.evidence_key())
    old = rows.where("round = 0").select("question", "evidence").distinct()
    return rows.where("round = 1").join(old, ["question", "evidence"], "left_anti").select("question", "query_id", "pos", "evidence")


def evidence_dedup_first(spark, sf):
    rows = frame(spark, sf, "v_evidence").withColumn("question", F.col("query_id") % 50).withColumn("pos", F.col("query_id") * 1000 + F.col("pos"))
    return R.first_of_each(rows, ["question"]).select("question", "evidence", "pos", "score")


def rerank_degraded_quota(spark, sf):
    rows = frame(spark, sf, "v_evidence").withColumn("question", F.col("query_id") % 50).withColumn("pos", F.col("query_id") * 1000 + F.col("pos"))
    return R.quota_by_group(rows, ["question"]).select("question", "part", "pos", "score", "rank")


def rerank_prefix(spark, sf):
    return frame(spark, sf, "v_evidence").select("query_id", "pos", R.rerank_prefix(F.col("doc_name"), F.col("title")).alias("prefix"))


def citation_extract(spark, sf):
    c = R.citations(F.col("answer"))
    return frame(spark, sf, "v_answer").select("id", F.array_join(c, ",").alias("cited"), F.array_max(c).alias("greatest"), F.exists(c, lambda n: (n < 1) | (n > F.col("n_refs"))).alias("out_of_range"))


def citation_strip_out_of_range(spark, sf):
    return frame(spark, sf, "v_answer").select("id", R.strip_citations(F.col("answer"), F.col("n_refs")).alias("answer"))


def evidence_index_title_fallback(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("pos")
    title = F.when(T.blank(F.col("title")), F.coalesce("doc_name", F.lit(""))).otherwise(F.col("title"))
    return frame(spark, sf, "v_evidence").select("query_id", F.row_number().over(w).alias("n"), title.alias("title"))


QUERIES = {f.__name__: f for f in (bm25_kept_index, bm25_kept_index_top, bm25_single_field, bm25_multi_field_best, knn_cosine_topk, knn_filtered_by_kb, source_filter_chunk_or_missing, rrf_two_lists, hybrid_search_rrf, multi_source_quota, multi_query_fusion, exclude_accumulated, evidence_dedup_first, rerank_degraded_quota, rerank_prefix, citation_extract, citation_strip_out_of_range, evidence_index_title_fallback)}

_TERMS = r"qt as (select distinct item_id as query_id, unnest(list_filter(string_split_regex(lower(text || ' src' || (item_id % 20)::varchar), '[^\p{L}\p{N}]+'), lambda w: w <> '')) as term from benchmark)"


def _bm25(name: str, field: str, where: str = "true") -> str:
    return rf"""{name}_s as (select doc_id, list_filter(string_split_regex(lower({field}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') as ts from documents where {where}),
{name}_p as (select doc_id, len(ts) as len, unnest(ts) as term from {name}_s),
{name}_t as (select term, doc_id, count(*) as tf, any_value(len) as len from {name}_p where term in (select term from qt) group by all),
{name}_d as (select term, count(*) as df from {name}_t group by term),
{name}_n as (select count(*) as n, avg(len(ts)) as mean from {name}_s),
{name} as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score
  from qt join {name}_t using (term) join {name}_d using (term) cross join {name}_n group by query_id, doc_id)"""


_DOC_NAME = "source || '-' || doc_id::varchar || '.md'"


def _ranked(src: str, key: str, k: int, tie: str) -> str:
    return f"select * from (select *, row_number() over (partition by {key} order by score desc, {tie}) as rank from {src}) where rank <= {k}"


def _cos(where: str = "true") -> str:
    return f"""c as (select q.vec_id as query_id, v.chunk_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])), 6) as score
  from embeddings q cross join v_vector v where q.vec_id % 20 = 0 and {where})"""


_NEAR = """e as (select vec_id, embedding::double[] as x from embeddings), c as (select q.vec_id as query_id, v.vec_id as doc_id, round(list_dot_product(q.x, v.x) / sqrt(list_dot_product(q.x, q.x)) / sqrt(list_dot_product(v.x, v.x)), 6) as score
  from e q join benchmark b on b.item_id = q.vec_id cross join e v)"""
_KEY = "coalesce(source_type, 'CHUNK') || ':' || chunk_id::varchar"

_KEPT = f"with {_TERMS}, {_bm25('f', 'text', 'doc_id % 11 <> 0')} {_ranked('f', 'query_id', 15, 'doc_id')}"

ORACLE_SQL = {
    "bm25_kept_index": _KEPT,
    "bm25_kept_index_top": _KEPT,
    "bm25_single_field": f"with {_TERMS}, {_bm25('f', 'text')} {_ranked('f', 'query_id', 15, 'doc_id')}",
    "bm25_multi_field_best": f"""with {_TERMS}, {_bm25('f', 'text')}, {_bm25('g', 'source')}, {_bm25('h', _DOC_NAME)},
      m as (select query_id, doc_id, round(max(score), 6) as score from (select * from f union all select query_id, doc_id, score * 2 from g union all select query_id, doc_id, score * 0.5 from h) group by all)
      {_ranked('m', 'query_id', 15, 'doc_id')}""",
    "knn_cosine_topk": oracle(f"with {_cos()} {_ranked('c', 'query_id', 15, 'chunk_id')}"),
    "knn_filtered_by_kb": oracle(f"with {_cos(chr(118) + '.kb_id = 1 and (v.source_type = ' + chr(39) + 'CHUNK' + chr(39) + ' or v.source_type is null)')} {_ranked('c', 'query_id', 15, 'chunk_id')}"),
    "source_filter_chunk_or_missing": oracle("select kb_id, count(*) as n, count(source_type) as typed from v_vector where source_type = 'CHUNK' or source_type is null group by kb_id"),
    "rrf_two_lists": oracle("""with r as (select query_id, chunk_id, max(score) as score, min(pos) as pos from v_evidence group by all),
      l as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r1, row_number() over (partition by query_id order by pos, chunk_id) as r2 from r),
      f as (select query_id, chunk_id, round(1.0::double / (60 + r1) + 1.0::double / (60 + r2), 6) as score, r1 from l)
      select * exclude (r1) from (select *, row_number() over (partition by query_id order by score desc, r1) as position from f) where position <= 10"""),
    "hybrid_search_rrf": f"""with {_TERMS}, {_bm25('f', 'text')}, {_NEAR}, w as ({_ranked('f', 'query_id', 50, 'doc_id')}), n as ({_ranked('c', 'query_id', 50, 'doc_id')}),
      a as (select query_id, doc_id, rank, 0 as list from n union all select query_id, doc_id, rank, 1 from w),
      s as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as score, min(list * 1000 + rank) as seen from a group by query_id, doc_id)
      select query_id, doc_id, score, position from (select *, row_number() over (partition by query_id order by score desc, seen) as position from s) where position <= 15""",
    "multi_source_quota": oracle(f"""with {_cos()}, t as ({_ranked('c', 'query_id', 100, 'chunk_id')}), y as (select t.query_id, coalesce(v.source_type, 'CHUNK') as source, t.chunk_id, t.score from t join v_vector v using (chunk_id))
      select * from (select *, row_number() over (partition by query_id, source order by score desc, chunk_id) as rank from y) where rank <= case source when 'CHUNK' then 15 else 8 end"""),
    "multi_query_fusion": oracle(f"""with f as (select query_id % 50 as question, {_KEY} as evidence, round(sum(score), 6) as score, min(pos) as first_pos from v_evidence group by all)
      select *, row_number() over (partition by question order by score desc, first_pos, evidence) as position from f"""),
    "exclude_accumulated": oracle(f"""with r as (select query_id % 50 as question, query_id, pos, round, {_KEY} as evidence from v_evidence)
      select question, query_id, pos, evidence from r where round = 1 and not exists (select 1 from r o where o.round = 0 and o.question = r.question and o.evidence = r.evidence)"""),
    "evidence_dedup_first": oracle(f"""with r as (select query_id % 50 as question, query_id * 1000 + pos as pos, score, {_KEY} as evidence from v_evidence)
      select question, evidence, pos, score from (select *, row_number() over (partition by question, evidence order by pos) as k from r) where k = 1"""),
    "rerank_degraded_quota": oracle("""with r as (select query_id % 50 as question, query_id * 1000 + pos as pos, score, case when source_type = 'CHUNK' then 'CHUNK' else 'OTHER' end as part from v_evidence)
      select question, part, pos, score, rank from (select *, row_number() over (partition by question, part order by score desc, pos) as rank from r) where rank <= case part when 'CHUNK' then 6 else 4 end"""),
    "rerank_prefix": oracle("""select query_id, pos, case when p = '' then '' else p || chr(10) end as prefix from (select query_id, pos,
      case when coalesce(doc_name, '') <> '' then '文档：' || doc_name || '；' else '' end || case when coalesce(title, '') <> '' and title is distinct from doc_name then '章节：' || title || '；' else '' end as p from v_evidence)"""),
    "citation_extract": oracle(r"""with a as (select id, n_refs, list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::int) as c from v_answer)
      select id, coalesce(array_to_string(c, ','), '') as cited, list_max(c) as greatest, len(list_filter(c, lambda n: n < 1 or n > n_refs)) > 0 as out_of_range from a"""),
    "citation_strip_out_of_range": oracle(r"""with a as (select id, n_refs, answer, list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::int), lambda n: n < 1 or n > n_refs) as c from v_answer)
      select id, list_reduce(list_prepend(answer, list_transform(c, lambda n: '[' || n::varchar || ']')), lambda t, x: replace(t, x, '')) as answer from a"""),
    "evidence_index_title_fallback": oracle("select query_id, row_number() over (partition by query_id order by pos) as n, case when title = '' then coalesce(doc_name, '') else title end as title from v_evidence"),
}
