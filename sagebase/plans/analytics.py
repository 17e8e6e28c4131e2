"""Queries over feedback, rollups, lists and session memory."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from sagebase.functions import text as T
from sagebase.operators import analytics as A
from sagebase.plans.views import frame, oracle

SINCE = datetime(2024, 1, 10)


def feedback_overview(spark, sf):
    return A.feedback_overview(frame(spark, sf, "v_message"), frame(spark, sf, "v_session"), F.lit(SINCE))


def feedback_rates(spark, sf):
    return A.feedback_rates(feedback_overview(spark, sf))


def dislike_reasons(spark, sf):
    return A.dislike_reasons(frame(spark, sf, "v_message"))


def dislike_page(spark, sf):
    rows = frame(spark, sf, "v_message").where("feedback = 'DOWN'").select("id", "created_at", F.substring("content", 1, 200).alias("content"))
    return A.page(rows, [F.desc("created_at"), F.desc("id")], 5, 20)


def question_of_answer(spark, sf):
    return A.question_of_answer(frame(spark, sf, "v_message"))


def last_message_per_session(spark, sf):
    return frame(spark, sf, "v_message").groupBy("session_id").agg(F.max("created_at").alias("at"), F.max("id").alias("id"))


def first_question_per_session(spark, sf):
    return frame(spark, sf, "v_message").where("role = 'USER'").groupBy("session_id").agg(F.min_by("content", "id").alias("question"))


def session_list_backfilled(spark, sf):
    last = frame(spark, sf, "v_message").where("role = 'ASSISTANT'").groupBy("session_id").agg(F.max("id").alias("last_id"))
    rows = frame(spark, sf, "v_session").join(last, F.col("id") == F.col("session_id"), "left")
    return rows.select("id", "kb_id", F.coalesce("last_id", F.col("id") * 1000).alias("last_id")).orderBy(F.desc_nulls_last("last_id"))


def chunk_status_counts(spark, sf):
    return A.chunk_counts(frame(spark, sf, "v_chunk_state"))


def document_vector_stats(spark, sf):
    return A.vector_stats(frame(spark, sf, "v_chunk_state"))


def document_list(spark, sf):
    stats = A.vector_stats(frame(spark, sf, "v_chunk_state"))
    rows = frame(spark, sf, "v_document").join(stats, F.col("id") == F.col("doc_id"), "left")
    return rows.select("id", "file_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("indexed", "pending", "failed", "suspect", "total")])


def vector_state_summary(spark, sf):
    return A.vector_summary(A.vector_stats(frame(spark, sf, "v_chunk_state")))


def chunk_page(spark, sf):
    return A.page(frame(spark, sf, "v_chunk_state").where("kb_id = 2"), ["doc_id", "seq"], 10, 25).select("doc_id", "seq", "status")


def chunk_page_suspect_first(spark, sf):
    return A.page(frame(spark, sf, "v_chunk_state"), [F.when(F.col("clean_status") == "SUSPECT", 0).otherwise(1), "doc_id", "seq"], 0, 40).select("doc_id", "seq", "clean_status")


def curate_queue(spark, sf):
    suspect = frame(spark, sf, "v_chunk_state").where("clean_status = 'SUSPECT'").groupBy("doc_id").agg(F.count("*").alias("n"))
    return frame(spark, sf, "v_document").join(suspect, F.col("id") == F.col("doc_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("suspect"))


def token_usage_by_type(spark, sf):
    rows = frame(spark, sf, "v_message").select(F.when(F.col("role") == "USER", "INPUT").otherwise("OUTPUT").alias("kind"), T.token_estimate(F.col("content")).alias("tokens"))
    return rows.rollup("kind").agg(F.sum("tokens").alias("tokens")).select(F.coalesce("kind", F.lit("TOTAL")).alias("kind"), "tokens")


def last_n_messages(spark, sf):
    return A.last_messages(frame(spark, sf, "v_message"), 4).select("session_id", "id", "back")


def last_r_rounds(spark, sf):
    return A.last_rounds(frame(spark, sf, "v_message"), 2).select("session_id", "id")


def interrupted_filter(spark, sf):
    return A.without_interrupted(frame(spark, sf, "v_message")).groupBy("session_id").agg(F.count("*").alias("n"))


def summary_trigger(spark, sf):
    return A.summary_due(frame(spark, sf, "v_session").select("id", "message_count", (F.col("id") % 3).alias("summarised")), 2)


def title_from_question(spark, sf):
    return frame(spark, sf, "v_message").where("role = 'USER'").select("id", T.session_title(F.concat(F.lit('"'), "content")).alias("title"))


QUERIES = {f.__name__: f for f in (feedback_overview, feedback_rates, dislike_reasons, dislike_page, question_of_answer, last_message_per_session, first_question_per_session, session_list_backfilled, chunk_status_counts, document_vector_stats, document_list, vector_state_summary, chunk_page, chunk_page_suspect_first, curate_queue, token_usage_by_type, last_n_messages, last_r_rounds, interrupted_filter, summary_trigger, title_from_question)}

_OVER = """select s.kb_id, count(*) as answers, sum(case when feedback = 'UP' then 1 else 0 end) as up, sum(case when feedback = 'DOWN' then 1 else 0 end) as down, sum(case when interrupted then 1 else 0 end) as interrupted,
  sum(case when (refs is null or refs in ('[]', '')) and verify_score is not null then 1 else 0 end) as no_evidence, count(verify_score) as scored, round(avg(verify_score), 6) as mean_score,
  round(avg(faithfulness_score), 6) as mean_faithfulness, round(avg(case when feedback = 'DOWN' then verify_score end), 6) as mean_disliked
  from v_message m join v_session s on m.session_id = s.id where m.role = 'ASSISTANT' and m.created_at >= timestamp '2024-01-10' group by s.kb_id"""
_STATS = """select doc_id, sum(case when coalesce(clean_status, '') <> 'SUSPECT' and status = 'INDEXED' then 1 else 0 end) as indexed, sum(case when coalesce(clean_status, '') <> 'SUSPECT' and status = 'EMBEDDING' then 1 else 0 end) as pending,
  sum(case when coalesce(clean_status, '') <> 'SUSPECT' and status = 'FAILED' then 1 else 0 end) as failed, sum(case when clean_status = 'SUSPECT' then 1 else 0 end) as suspect, sum(case when coalesce(clean_status, '') <> 'SUSPECT' and status <> 'FILTERED' then 1 else 0 end) as total
  from v_chunk_state {} group by doc_id"""
_EST = r"coalesce((length({0}) - length(regexp_replace({0}, '[一-鿿㐀-䶿　-〿＀-￯]', '', 'g')) + ceil(length(regexp_replace(regexp_replace({0}, '[一-鿿㐀-䶿　-〿＀-￯]', '', 'g'), '[\s\x0b]', '', 'g')) / 4.0))::int, 0)"

ORACLE_SQL = {
    "feedback_overview": oracle(_OVER),
    "feedback_rates": oracle(f"with o as ({_OVER}) select kb_id, case when up + down > 0 then round(down / (up + down), 4) else 0.0 end as dislike_rate, case when scored > 0 then round(no_evidence / scored, 4) else 0.0 end as no_evidence_rate from o"),
    "dislike_reasons": oracle("select feedback_reason, count(*) as n, case feedback_reason when 'NOT_ON_TARGET' then '没答到点上' when 'OUTDATED' then '信息过时' when 'WRONG_CITATION' then '引用不对' else '未填写原因' end as label from v_message where feedback = 'DOWN' group by feedback_reason"),
    "dislike_page": oracle("select id, created_at, substring(content, 1, 200) as content from v_message where feedback = 'DOWN' order by created_at desc, id desc limit 20 offset 5"),
    "question_of_answer": oracle("select a.id, (select max(q.id) from v_message q where q.session_id = a.session_id and q.role = 'USER' and q.id < a.id) as question_id from v_message a where a.role = 'ASSISTANT'"),
    "last_message_per_session": oracle("select session_id, max(created_at) as at, max(id) as id from v_message group by session_id"),
    "first_question_per_session": oracle("select session_id, arg_min(content, id) as question from v_message where role = 'USER' group by session_id"),
    "session_list_backfilled": oracle("select s.id, s.kb_id, coalesce((select max(m.id) from v_message m where m.session_id = s.id and m.role = 'ASSISTANT'), s.id * 1000) as last_id from v_session s"),
    "chunk_status_counts": oracle("select doc_id, status, clean_status, count(*) as n from v_chunk_state group by all"),
    "document_vector_stats": oracle(_STATS.format("")),
    "document_list": oracle(f"with st as ({_STATS.format('')}) select id, file_name, coalesce(indexed, 0) as indexed, coalesce(pending, 0) as pending, coalesce(failed, 0) as failed, coalesce(suspect, 0) as suspect, coalesce(total, 0) as total from v_document left join st on id = doc_id"),
    "vector_state_summary": oracle(f"""with st as ({_STATS.format('')}) select doc_id, case when pending > 0 or failed > 0 then '向量未完成：已索引 ' || indexed::varchar || '/' || total::varchar || case when failed > 0 then '，失败 ' || failed::varchar else '' end
      || case when pending > 0 then '，待向量化 ' || pending::varchar else '' end || case when suspect > 0 then '；另有 ' || suspect::varchar || ' 块待人工审核' else '' end || '；可在文档列表点「重建向量」修复，无需重新解析' end as summary from st"""),
    "chunk_page": oracle("select doc_id, seq, status from v_chunk_state where kb_id = 2 order by doc_id, seq limit 25 offset 10"),
    "chunk_page_suspect_first": oracle("select doc_id, seq, clean_status from v_chunk_state order by case when clean_status = 'SUSPECT' then 0 else 1 end, doc_id, seq limit 40"),
    "curate_queue": oracle("select id, coalesce(n, 0) as suspect from v_document left join (select doc_id, count(*) as n from v_chunk_state where clean_status = 'SUSPECT' group by doc_id) on id = doc_id"),
    "token_usage_by_type": oracle(f"select coalesce(kind, 'TOTAL') as kind, sum(tokens)::bigint as tokens from (select case when role = 'USER' then 'INPUT' else 'OUTPUT' end as kind, {_EST.format('content')} as tokens from v_message) group by rollup (kind)"),
    "last_n_messages": oracle("select * from (select session_id, id, row_number() over (partition by session_id order by id desc) as back from v_message) where back <= 4"),
    "last_r_rounds": oracle("select session_id, id from (select *, coalesce(sum(case when role = 'USER' then 1 else 0 end) over (partition by session_id order by id desc rows between unbounded preceding and 1 preceding), 0) as u from v_message) where u < 2"),
    "interrupted_filter": oracle("select session_id, count(*) as n from v_message where not (coalesce(interrupted, false) and role = 'ASSISTANT') group by session_id"),
    "summary_trigger": oracle("select id, message_count, id % 3 as summarised, message_count - id % 3 >= 4 as due, least(message_count - id % 3, 60) + case when id % 3 > 0 then 4 else 0 end as reads from v_session"),
    "title_from_question": oracle(r"""with a as (select id, regexp_replace('"' || content, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') as t from v_message where role = 'USER'), b as (select id, t, regexp_replace(regexp_replace(string_split(t, chr(10))[1], '[\s\x0b]+', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') as l from a),
      c as (select id, t, regexp_replace(l, '^["''“”「」『』]+|["''“”「」『』]+$', '', 'g') as l from b) select id, case when t = '' then '新会话' when length(l) > 20 then substring(l, 1, 20) || '…' else l end as title from c"""),
}
