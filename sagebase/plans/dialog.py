"""Queries over the nodes of the question-answering graph: routing, rewriting, evidence, verification, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebase.operators import qa as Q
from sagebase.operators import retrieve as R
from sagebase.plans.views import frame, oracle

def _replies(spark, sf):
    """Router replies made of messages: JSON with one or two fragments, labels, an injection, and text that says nothing."""
    return frame(spark, sf, "v_reply")


def route_json_object(spark, sf):
    return _replies(spark, sf).select("id", Q.json_object(F.col("reply")).alias("object"))


def route_fragments_parsed(spark, sf):
    rows = _replies(spark, sf).select("id", F.posexplode_outer(Q.route_fragments(F.col("reply"), F.col("question"))).alias("pos", "f"))
    return rows.select("id", "pos", "f.text", "f.intent", "f.injection")


def route_with_retry(spark, sf):
    rows = _replies(spark, sf).select("id", Q.routed(F.lit("no idea"), F.col("reply"), F.col("question")).alias("f"))
    return rows.select("id", F.size("f").alias("n"), F.exists("f", lambda x: x["injection"]).alias("injection"), F.exists("f", lambda x: x["intent"] == "BUSINESS").alias("business"))


def router_escalation(spark, sf):
    return frame(spark, sf, "benchmark").select("item_id", Q.escalated(F.element_at(F.array(*map(F.lit, (256, 512, 1024))), (F.col("item_id") % 3 + 1).cast("int"))).alias("cap"))


def resolved_question(spark, sf):
    queries = F.when(F.col("item_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("item_id") % 4 == 1, F.array("text")).otherwise(F.array(F.concat(F.lit("about "), F.col("text")), F.lit("more")))
    return frame(spark, sf, "benchmark").select("item_id", Q.resolved_question(queries, F.col("text"), (F.col("item_id") % 3 - 1).cast("int")).alias("resolved"))


def _by_query(spark, sf):
    """The evidence of each query as one array in its order."""
    items = F.sort_array(F.collect_list(F.struct("pos", "chunk_id", "source_type", "doc_name", "title", "content", F.lit(None).cast("int").alias("page_num"))))
    return frame(spark, sf, "v_evidence").groupBy("query_id").agg(items.alias("items"))


def rewrite_retry_hint(spark, sf):
    titles = F.transform("items", lambda c: F.coalesce(F.when(c["title"] != "", c["title"]), c["doc_name"], F.lit("")))
    missing = F.when(F.col("query_id") % 3 == 0, "").otherwise(F.concat(F.lit(" gap "), F.col("query_id").cast("string"), F.lit(" ")))
    return _by_query(spark, sf).select("query_id", Q.retry_hint((F.col("query_id") % 4).cast("int"), titles, missing).alias("hint"))


def evidence_json_new(spark, sf):
    items = F.transform("items", lambda c: c.withField("new", c["pos"] % 2 == 1))
    parsed = F.from_json(Q.evidence_json(items), "array<struct<index:int,sourceType:string,docName:string,page:int,title:string,content:string,new:boolean>>")
    return _by_query(spark, sf).select("query_id", F.explode(parsed).alias("e")).select("query_id", "e.index", "e.sourceType", "e.docName", "e.page", "e.title", F.md5(F.col("e.content").cast("binary")).alias("digest"), "e.new")


def reference_json(spark, sf):
    rows = frame(spark, sf, "v_evidence").withColumn("snippet", Q.ref_snippet(F.col("content")))
    items = F.sort_array(F.collect_list(F.struct("pos", "chunk_id", F.lit(7).cast("long").alias("doc_id"), "source_type", "doc_name", F.lit(None).cast("int").alias("page_num"), "title", "snippet")))
    parsed = F.from_json(Q.refs_json(F.col("items")), "array<struct<chunkId:long,docName:string,page:int,sourceType:string,title:string,docId:long,content:string>>")
    rows = rows.groupBy("query_id").agg(items.alias("items")).select("query_id", F.posexplode(parsed).alias("pos", "e"))
    return rows.select("query_id", "pos", "e.chunkId", "e.docName", "e.page", "e.sourceType", "e.title", "e.docId", F.length("e.content").alias("n"))


def reference_snippets(spark, sf):
    """Whole documents: a cut inside a table or a fence gives that block."""
    table = F.concat(F.col("text"), F.lit("\n"), F.repeat(F.lit("| a | b |\n"), 80))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("| k | v |\n"), table)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("intro\n```py\n"), "text", F.lit("\n```\nend"))).otherwise(F.col("text"))
    return frame(spark, sf, "documents").select("doc_id", F.md5(Q.ref_snippet(text).cast("binary")).alias("digest"))


def verify_combined(spark, sf):
    """Scores of a verification: evidence keys that are new since the round before decide whether a retry helped."""
    a = frame(spark, sf, "v_answer")
    new = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("k")))
    v = Q.verified(F.col("has_evidence"), F.col("score"), (F.col("id") % 5) / 4, F.col("retry"), new, F.col("no_improvement"))
    return a.select("id", v.alias("v")).select("id", F.round("v.score", 6).alias("score"), F.round("v.faithfulness", 6).alias("faithfulness"), "v.no_improvement")


def evidence_new_keys(spark, sf):
    """Keys of a query's evidence that the round before didn't have."""
    key = R.evidence_key()
    rows = frame(spark, sf, "v_evidence").withColumn("key", key)
    sets = rows.groupBy("query_id").agg(F.collect_set(F.when(F.col("pos") % 2 == 0, F.col("key"))).alias("before"), F.collect_set(F.when(F.col("pos") % 3 > 0, F.col("key"))).alias("now"))
    return sets.select("query_id", F.explode(F.array_except("now", "before")).alias("key"))


def missing_info_merge(spark, sf):
    a = frame(spark, sf, "v_answer")
    claims = F.transform(F.sequence(F.lit(1), (F.col("id") % 4 + 1).cast("int")), lambda i: Q.claim(F.concat(F.lit(" claim\n"), i.cast("string"), F.lit(" "), F.col("answer"))))
    wrong = F.when(F.col("contradicted"), claims).otherwise(F.array().cast("array<string>"))
    return a.select("id", Q.merged_missing(F.when(F.col("id") % 2 == 0, F.lit("old gap")), wrong, claims).alias("missing"))


def verify_reply(spark, sf):
    a = frame(spark, sf, "v_answer")
    number = (F.col("id") % 130).cast("string")
    reply = (
        F.when(F.col("id") % 5 == 0, F.concat(F.lit('ok {"score": '), number, F.lit(', "missing": " parts。； ", "noImprovement": true}')))
        .when(F.col("id") % 5 == 1, F.concat(F.lit("Score "), number, F.lit(" of 100\n缺失：dates；\nmore 7")))
        .when(F.col("id") % 5 == 2, F.concat(F.lit('{"score": "'), number, F.lit('"}')))
        .when(F.col("id") % 5 == 3, F.lit(" "))
        .otherwise(F.lit("缺失：无"))
    )
    return a.select("id", Q.verify_reply(reply).alias("v")).select("id", F.round("v.score", 6).alias("score"), "v.missing", "v.no_improvement")


def partial_answers(spark, sf):
    a = frame(spark, sf, "v_answer")
    missing = F.when(F.col("id") % 3 == 0, F.lit(" 无 ")).when(F.col("id") % 3 == 1, F.lit(" dates ")).otherwise(F.lit(None).cast("string"))
    return a.select("id", Q.partial_answer(F.when(~F.col("no_answer"), F.col("answer")), missing).alias("text"))


def final_answers(spark, sf):
    """Chat replies refuse injections; both answers merge by the model's text or one above the other; the first that exists is final."""
    a = frame(spark, sf, "v_answer")
    chat = Q.chat_answer(F.col("contradicted"), F.when(F.col("n_chitchat") > 0, F.lit("hello")))
    both = Q.merged_answer(F.when(F.col("retry") == 0, F.lit("merged")), chat, F.col("answer"))
    return a.select("id", chat.alias("chat"), both.alias("merged"), Q.final_answer(F.when(F.col("n_chitchat") > 0, chat), F.when(~F.col("no_answer"), F.col("answer"))).alias("final"))


def prompt_render(spark, sf):
    template = F.concat(F.lit("Q {{ question }} of {{kb|this base}}{{gone}}; {{who | nobody }} {{kb}}"), F.when(F.col("item_id") % 2 == 0, " {{question}}").otherwise(""))
    values = F.map_from_arrays(F.when(F.col("item_id") % 3 == 0, F.array(F.lit("question"), F.lit("kb"))).otherwise(F.array(F.lit("question"))), F.when(F.col("item_id") % 3 == 0, F.array(F.col("text"), F.lit("{{who}}"))).otherwise(F.array(F.col("text"))))
    return frame(spark, sf, "benchmark").select("item_id", Q.rendered(template, values).alias("text"))


def prompt_override(spark, sf):
    """A stored template goes before the built-in one."""
    built = frame(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("built_in"))
    stored = frame(spark, sf, "benchmark").where("item_id % 3 = 0").select(F.col("item_id").alias("id"), F.lit("stored").alias("stored"))
    return built.join(stored, "id", "left").select("id", F.coalesce("stored", "built_in").alias("template"))


def rerank_scored(spark, sf):
    """Evidence by an outside scorer: groups beyond their quota are cut to so many documents by score, scored again, and cut."""
    scored = R.reranked(frame(spark, sf, "v_evidence").withColumn("source_type", F.coalesce("source_type", F.lit("CHUNK"))), ["query_id"], lambda texts: [float(len(t) % 17) / 16 for t in texts])
    return scored.select("query_id", "pos", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


def rerank_response_scores(spark, sf):
    """Scores of a reranker's reply, of any of three shapes, back in the order of its documents; what it leaves out is 0."""
    b = frame(spark, sf, "benchmark")
    items = F.concat(F.lit('[{"index": 2, "relevance_score": 0.5}, {"index": 0, "score": '), (F.col("item_id") % 7 / 8).cast("string"), F.lit('}, {"index": 9, "score": 1}, {"score": 1}]'))
    reply = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('{"output": {"results": '), items, F.lit("}}"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit('{"data": '), items, F.lit("}"))).otherwise(F.concat(F.lit('{"results": '), items, F.lit("}")))
    return b.select("item_id", F.posexplode(R.rerank_scores(reply, F.lit(4))).alias("pos", "score"))


QUERIES = {f.__name__: f for f in (route_json_object, route_fragments_parsed, route_with_retry, router_escalation, resolved_question, rewrite_retry_hint, evidence_json_new, reference_json, reference_snippets, verify_combined, evidence_new_keys, missing_info_merge, verify_reply, partial_answers, final_answers, prompt_render, prompt_override, rerank_scored, rerank_response_scores)}

_EV = "ev as (select *, row_number() over (partition by query_id order by pos) as k, coalesce(source_type, 'CHUNK') as st from v_evidence)"
_REFUSED = Q.REFUSED_INJECTION

ORACLE_SQL = {
    "rerank_scored": oracle("""with e as (select query_id, pos, score, case when coalesce(source_type, 'CHUNK') = 'CHUNK' then 'CHUNK' else 'OTHER' end as part,
        case when coalesce(doc_name, '') <> '' then '文档：' || doc_name || '；' else '' end || case when coalesce(title, '') <> '' and title is distinct from doc_name then '章节：' || title || '；' else '' end as prefix, content from v_evidence),
      r as (select *, row_number() over (partition by query_id, part order by score desc, pos) as old, count(*) over (partition by query_id, part) as n, case when part = 'CHUNK' then 6 else 4 end as quota from e),
      s as (select *, case when n <= quota then score else (length(case when prefix = '' then '' else prefix || chr(10) end || coalesce(content, '')) % 17) / 16 end as again from r where old <= 20)
      select query_id, pos, rank::int as rank, round(again, 6) as score from (select *, row_number() over (partition by query_id, part order by again desc, old) as rank from s) where rank <= quota"""),
    "route_json_object": oracle("select id, case k when 0 then '{\"fragments\": [{\"text\": \"' || t || '\", \"intent\": \"business\"}, {\"text\": \" {hi} \", \"intent\": \"Chitchat\"}, {\"text\": 3, \"intent\": \"BUSINESS\"}]}' when 1 then '{\"fragments\": [{\"text\": \"' || t || '\", \"intent\": \"INJECTED\"}]}' when 4 then '{\"a\": {\"b\": \"}\"}}' end as object from v_reply"),
    "route_fragments_parsed": oracle("""select id, 0 as pos, t as text, 'BUSINESS' as intent, false as injection from v_reply where k = 0 and trim(t) <> ''
      union all select id, case when trim(t) <> '' then 1 else 0 end, '{hi}', 'CHITCHAT', false from v_reply where k = 0
      union all select id, 0, t, 'CHITCHAT', true from v_reply where k = 1 and trim(t) <> '' union all select id, 0, question, 'CHITCHAT', true from v_reply where k = 1 and trim(t) = ''
      union all select id, 0, question, 'BUSINESS', true from v_reply where k = 2 union all select id, null, null, null, null from v_reply where k in (3, 4)"""),
    "route_with_retry": oracle("select id, case when k = 0 and trim(t) <> '' then 2 else 1 end as n, k in (1, 2) or k in (3, 4) and hostile as injection, k = 0 and trim(t) <> '' or k = 2 or k in (3, 4) and not hostile as business from v_reply"),
    "router_escalation": "select item_id, case item_id % 3 when 0 then 512 else 1024 end as cap from benchmark",
    "resolved_question": "select item_id, case when item_id % 3 = 1 and item_id % 4 in (2, 3) then 'about ' || text end as resolved from benchmark",
    "rewrite_retry_hint": oracle(f"""with t as (select query_id, substring(coalesce(nullif(title, ''), doc_name, ''), 1, 30) as t, min(pos) as p from v_evidence group by all), n as (select *, row_number() over (partition by query_id order by p) as k from t where t <> ''),
      c as (select query_id, string_agg(t, '；' order by k) as covered from n where k <= 8 group by 1)
      select q.query_id, case when q.query_id % 4 = 0 then '' when q.query_id % 3 = 0 then chr(10) || '{Q.WIDER_HINT.strip()}' else chr(10) || '{Q.HINT_COVERED.strip()}' || coalesce(covered, '无') || '{Q.HINT_MISSING}gap ' || q.query_id::varchar || '{Q.HINT_END}' end as hint
      from (select distinct query_id from v_evidence) q left join c using (query_id)"""),
    "evidence_json_new": oracle(f"with {_EV} select query_id, k::int as index, st as \"sourceType\", coalesce(doc_name, '') as \"docName\", 0 as page, case when title = '' then doc_name else title end as title, md5(coalesce(content, '')) as digest, pos % 2 = 1 as new from ev"),
    "reference_json": oracle(f"with {_EV} select query_id, (k - 1)::int as pos, chunk_id as \"chunkId\", doc_name as \"docName\", 0 as page, st as \"sourceType\", coalesce(title, '') as title, 7 as \"docId\", length(case when length(content) <= 300 then content else substring(content, 1, 300) || '…' end)::int as n from ev"),
    "verify_combined": oracle("select id, case when has_evidence then round(least(score, id % 5 / 4.0), 6) else 0.0 end as score, case when has_evidence then round(id % 5 / 4.0, 6) else 1.0 end as faithfulness, has_evidence and retry >= 1 and (id % 3 = 0 or no_improvement) as no_improvement from v_answer"),
    "evidence_new_keys": oracle(f"with {_EV} select distinct query_id, st || ':' || chunk_id::varchar as key from ev e where pos % 3 > 0 and not exists (select 1 from ev x where x.query_id = e.query_id and x.pos % 2 = 0 and x.st = e.st and x.chunk_id = e.chunk_id)"),
    "missing_info_merge": oracle(f"""with a as (select id, contradicted, case when id % 2 = 0 then 'old gap' else '' end as old, regexp_replace('claim 1 ' || answer, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') as c1, regexp_replace('claim 2 ' || answer, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') as c2, id % 4 + 1 as n from v_answer),
      f as (select id, old, case when contradicted then '{Q.CONTRADICTS}' else '{Q.UNSUPPORTED}' end || case when length(c1) > 60 then substring(replace(c1, chr(10), ' '), 1, 60) || '…' else replace(c1, chr(10), ' ') end as f1,
        case when n = 1 and contradicted then '{Q.UNSUPPORTED}' || case when length(c1) > 60 then substring(replace(c1, chr(10), ' '), 1, 60) || '…' else replace(c1, chr(10), ' ') end when n > 1 then case when contradicted then '{Q.CONTRADICTS}' else '{Q.UNSUPPORTED}' end || case when length(c2) > 60 then substring(replace(c2, chr(10), ' '), 1, 60) || '…' else replace(c2, chr(10), ' ') end end as f2 from a),
      g as (select *, case when length(old) + length(f1) + 3 > 120 then old when old = '' then f1 else old || '；' || f1 end as one, length(old) + length(f1) + 3 > 120 as full1 from f)
      select id, case when full1 or f2 is null or length(one) + length(f2) + 3 > 120 then one else one || '；' || f2 end as missing from g"""),
    "verify_reply": oracle("select id, case id % 5 when 0 then least(id % 130, 100) / 100.0 when 1 then least(id % 130, 100) / 100.0 when 2 then least(id % 130, 100) / 100.0 else 0.0 end::double as score, case id % 5 when 0 then 'parts' when 1 then 'dates' else '' end as missing, id % 5 = 0 as no_improvement from v_answer"),
    "partial_answers": oracle(f"select id, '{Q.PARTIAL_PREFIX.strip()}' || chr(10) || case when no_answer then '' else answer end || case when id % 3 = 1 then chr(10) || chr(10) || '{Q.PARTIAL_MISSING.strip()}dates' else '' end as text from v_answer"),
    "final_answers": oracle(f"""with c as (select *, case when contradicted then '{_REFUSED}' when n_chitchat > 0 then 'hello' end as chat from v_answer)
      select id, chat, case when chat is null then answer when retry = 0 then 'merged' else chat || chr(10) || chr(10) || answer end as merged, coalesce(case when n_chitchat > 0 then chat end, case when not no_answer then answer end, '{Q.NO_ANSWER}') as final from c"""),
    "prompt_render": "select item_id, 'Q ' || text || ' of ' || case when item_id % 3 = 0 then '{{who}}' else 'this base' end || '; nobody ' || case when item_id % 3 = 0 then '{{who}}' else '' end || case when item_id % 2 = 0 then ' ' || text else '' end as text from benchmark",
    "prompt_override": "select item_id as id, case when item_id % 3 = 0 then 'stored' else text end as template from benchmark",
    "rerank_response_scores": "select item_id, p as pos, case p when 0 then item_id % 7 / 8.0 when 2 then 0.5 else 0.0 end::double as score from benchmark, unnest([0, 1, 2, 3]) u(p)",
}
