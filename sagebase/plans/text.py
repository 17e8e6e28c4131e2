"""Queries over structure, segmentation and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebase.functions import text as T
from sagebase.operators import html as H
from sagebase.operators import segment as S
from sagebase.sources import files as L
from sagebase.plans.views import frame, oracle


def _marked(spark, sf):
    """Lines with heading marks of all kinds in front, by document and line number."""
    mark = F.when(F.col("line_no") % 7 == 0, F.lit("## ")).when(F.col("line_no") % 7 == 1, F.lit("第3章 ")).when(F.col("line_no") % 7 == 2, F.lit("一、")).when(F.col("line_no") % 7 == 3, F.lit("1.2 ")).when(F.col("line_no") % 7 == 4, F.lit("3 ")).otherwise(F.lit(""))
    return frame(spark, sf, "v_line").select("doc_id", "line_no", F.concat(mark, "line").alias("line"))


def _pages(spark, sf):
    return frame(spark, sf, "v_line").groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def heading_level(spark, sf):
    return _marked(spark, sf).select("doc_id", "line_no", T.heading_level(F.col("line")).alias("level"))


def fixed_width_chunks(spark, sf):
    return S.fixed_width(frame(spark, sf, "documents"), "doc_id", "text", 800)


def sentence_chunks(spark, sf):
    return S.segmented(frame(spark, sf, "documents"), "doc_id", "text", lambda t: [("", p) for p in S.sentences(t)])


def paragraph_chunks(spark, sf):
    return S.segmented(frame(spark, sf, "documents"), "doc_id", "text", lambda t: S.plain_pieces(t)[0])


def recursive_chunks(spark, sf):
    return S.chunk_documents(_pages(spark, sf))


def code_fences(spark, sf):
    text = F.concat(F.lit("intro\n```py\n"), "text", F.lit("\n```\nend"))
    return S.segmented(frame(spark, sf, "documents").select("doc_id", text.alias("text")), "doc_id", "text", S.fences)


def tables_extracted(spark, sf):
    """Tables behind whole documents: with a caption and blank cells, with the rule first, with lines above the header."""
    k = F.col("doc_id") % 3
    table = F.when(k == 0, F.lit("\n表1-2 units\n\n| a | |\n|---|:-:|\n| 1 | 2 |\n| | 3 |\nend")).when(k == 1, F.lit("\n\n|---|---|\n| x | y | z |\n")).otherwise(F.lit("\n\n| up |\n| h | i |\n| --- | --- |\n| 1 |\n|---|---|"))
    rows = frame(spark, sf, "documents").select("doc_id", F.concat(F.replace("text", F.lit("|"), F.lit("/")), table).alias("text"))
    return S.segmented(rows, "doc_id", "text", lambda t: [("", p) for kind, block in S.tables(t) if kind == "table" for p in S.table_pieces(block, S.SIZE)])


def _cells(spark, sf):
    return frame(spark, sf, "v_line").select("doc_id", "line_no", (F.col("line_no") % 3).alias("col"), F.when((F.col("doc_id") + F.col("line_no")) % 4 == 0, F.col("line")).otherwise(F.lit(" ")).alias("value"))


def table_forward_fill(spark, sf):
    return S.forward_fill(_cells(spark, sf), ["doc_id", "col"], "line_no", "value").select("doc_id", "line_no", "filled")


def page_assemble(spark, sf):
    return S.page_assemble(_pages(spark, sf), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("n"))


def page_mark_split(spark, sf):
    text = S.page_assemble(_pages(spark, sf), "doc_id")
    return text.select("doc_id", F.explode(S.page_split(F.col("text"))).alias("p")).select("doc_id", "p.page_num", "p.markdown")


def missing_pages(spark, sf):
    pages = _pages(spark, sf).withColumn("markdown", F.when((F.col("doc_id") + F.col("page_num")) % 3 == 0, F.lit(" ")).otherwise(F.col("markdown")))
    return S.missing_pages(pages, "doc_id")


def _slides(spark, sf):
    """Pages as slides: most begin with the heading that the deck shares, some have it further down, the others begin with one of their own; every ninth is blank."""
    head = F.when(F.col("page_num") % 4 == 0, F.concat(F.lit("# p"), F.col("page_num").cast("string"), F.lit("\n## 目录页\n"))).when(F.col("page_num") % 5 == 2, "\n 正文\n## 目录页\n").otherwise("\n## 目录页\n")
    return _pages(spark, sf).select("doc_id", "page_num", F.when(F.col("page_num") % 9 == 0, F.lit(" \n ")).otherwise(F.concat(head, "markdown")).alias("markdown"))


def slide_footer(spark, sf):
    """The heading that a deck's slides share."""
    return L.footers(_slides(spark, sf)).select("doc_id", F.col("footer").alias("head"), "times")


def slide_chunks(spark, sf):
    """Slides with the path of their own headings as title."""
    return L.slide_pieces(_slides(spark, sf)).select("doc_id", "page_num", "title", F.md5(F.col("content").cast("binary")).alias("digest"))


def file_dispatch(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("txt", "MD", "Html", "pdf", "docx", "pptx", "xlsx", "xls", "zip"))), (F.col("id") % 9 + 1).cast("int"))
    return frame(spark, sf, "v_document").select("id", L.route(kind).alias("route"))


def blob_paths(spark, sf):
    store = F.when(F.col("id") % 3 == 0, "minio").when(F.col("id") % 3 == 1, "local")
    return frame(spark, sf, "v_document").select("id", L.storage_path(store, F.col("file_name"), {"local": "/data", "minio": "s3://bucket"}).alias("path"))


def reader_markdown(spark, sf):
    """Replies of an image reader made of whole documents."""
    text = F.concat(F.lit("以下是识别结果："), "text", F.lit(" ## head\n\n \n\nend"))
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```markdown\n"), text, F.lit("\n```"))).otherwise(text)
    return frame(spark, sf, "documents").select("doc_id", F.md5(T.reader_markdown(reply).cast("binary")).alias("digest"))


def text_poor_pages(spark, sf):
    return _pages(spark, sf).where(T.text_poor(F.col("markdown"))).select("doc_id", "page_num")


def html_to_markdown(spark, sf):
    return H.html_to_markdown(frame(spark, sf, "pages"))


def token_estimate(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def router_cap(spark, sf):
    return frame(spark, sf, "benchmark").select("item_id", T.router_cap(T.token_estimate(F.repeat("text", (F.col("item_id") % 16).cast("int")))).alias("cap"))


def content_hash(spark, sf):
    return frame(spark, sf, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))


def parse_cache_lookup(spark, sf):
    """The latest parse of equal content, or none."""
    from pyspark.sql import Window

    docs = frame(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    cache = docs.where("doc_id % 2 = 0").withColumn("k", F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("doc_id")))).where("k = 1").select("digest", F.col("doc_id").alias("cached_as"))
    return docs.join(cache, "digest", "left").select("doc_id", "cached_as")


def parse_cache_put(spark, sf):
    """The cache after new parses: the latest of a digest stays, parses without text are none."""
    docs = frame(spark, sf, "documents").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), (F.col("doc_id") % 7).alias("parsed_at"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("content"))
    return docs.where(~T.blank(F.col("content"))).groupBy("digest").agg(F.max_by("id", F.struct("parsed_at", "id")).alias("id"))


def embed_text(spark, sf):
    chunks = frame(spark, sf, "v_chunk").withColumn("title", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("t"), F.col("doc_id").cast("string"))))
    return chunks.select("doc_id", "seq", F.md5(F.when(T.blank(F.col("title")), F.col("content")).otherwise(F.concat_ws("\n", "title", "content")).cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (heading_level, fixed_width_chunks, sentence_chunks, paragraph_chunks, recursive_chunks, code_fences, tables_extracted, table_forward_fill, page_assemble, page_mark_split, missing_pages, slide_footer, slide_chunks, file_dispatch, blob_paths, reader_markdown, text_poor_pages, html_to_markdown, token_estimate, router_cap, content_hash, parse_cache_lookup, parse_cache_put, embed_text)}

_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_PAGES = "pg as (select doc_id, page_num, string_agg(line, chr(10) order by line_no) as md from v_line group by doc_id, page_num)"
_EST = r"coalesce((length({0}) - length(regexp_replace({0}, '[一-鿿㐀-䶿　-〿＀-￯]', '', 'g')) + ceil(length(regexp_replace(regexp_replace({0}, '[一-鿿㐀-䶿　-〿＀-￯]', '', 'g'), '[\s\x0b]', '', 'g')) / 4.0))::int, 0)"

ORACLE_SQL = {
    "sentence_chunks": rf"""with s as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+') as ss from documents),
      p as (select doc_id, list_filter(list_transform(list_reduce(list_prepend([''], list_transform(ss, lambda x: [x])), lambda a, b:
        case when length(b[1]) > {S.SIZE} then list_concat(list_concat(a, list_transform(range(0, ceil(length(b[1]) / {S.SIZE})::bigint), lambda i: substring(b[1], i * {S.SIZE} + 1, {S.SIZE}))), [''])
          when a[-1] <> '' and length(a[-1]) + length(b[1]) > {S.SIZE} then list_concat(a, b) else list_concat(a[1:len(a) - 1], [a[-1] || b[1]]) end), lambda x: {_TRIM.format('x')}), lambda x: x <> '') as ps from s)
      select doc_id, (k - 1)::int as seq, '' as title, ps[k] as content from p, unnest(range(1, len(ps) + 1)) u(k)""",
    "tables_extracted": "select doc_id, 0 as seq, '' as title, case doc_id % 3 when 0 then '表1-2 units' || chr(10) || '| a | 列2 |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |' || chr(10) || '| 1 | 3 |' when 1 then '| 列1 | 列2 | 列3 |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| x | y | z |' else '| h | i |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 |  |' || chr(10) || '| --- | --- |' end as content from documents where text is not null",
    "code_fences": "select doc_id, s as seq, case s when 1 then 'code' else 'prose' end as title, case s when 0 then 'intro' when 1 then '```py' || chr(10) || text || chr(10) || '```' else 'end' end as content from documents, unnest([0, 1, 2]) u(s)",
    "heading_level": oracle(rf"""with x as (select doc_id, line_no, case line_no % 7 when 0 then '## ' when 1 then '第3章 ' when 2 then '一、' when 3 then '1.2 ' when 4 then '3 ' else '' end || line as line from v_line), y as (select *, {_TRIM.format('line')} as t from x)
      select doc_id, line_no, case when regexp_matches(t, '^#{{1,6}}\s+\S[^。！？!?；;]*$') then length(regexp_extract(t, '^(#+)', 1))
        when regexp_matches(t, '^第[0-9一二三四五六七八九十百千]+[章节篇部分条款][^。！？!?；;]*$') then 1 when regexp_matches(t, '^[一二三四五六七八九十]+[、.．][^。！？!?；;]*$') then 2
        when regexp_matches(t, '^\d{{1,3}}([.．、]\d{{1,3}})*[.．、]?\s*\S[^。！？!?；;]*$') then least(greatest(len(regexp_extract_all(regexp_extract(t, '^\d{{1,3}}([.．、]\d{{1,3}})*'), '\d{{1,3}}')), 1), 6) end::int as level from y"""),
    "fixed_width_chunks": oracle("select doc_id, seq, content from v_chunk"),
    "table_forward_fill": oracle(f"""with x as (select doc_id, line_no, line_no % 3 as col, case when (doc_id + line_no) % 4 = 0 then line else ' ' end as value from v_line)
      select doc_id, line_no, last_value(case when {_TRIM.format('value')} <> '' then value end ignore nulls) over (partition by doc_id, col order by line_no rows unbounded preceding) as filled from x"""),
    "page_assemble": oracle(f"with {_PAGES}, t as (select doc_id, string_agg('<!-- PAGE ' || page_num::varchar || ' -->' || chr(10) || md, chr(10) || chr(10) order by page_num) as text from pg group by doc_id) select doc_id, md5(text) as digest, length(text) as n from t"),
    "page_mark_split": oracle(f"with {_PAGES} select doc_id, page_num, {_TRIM.format('md')} as markdown from pg where {_TRIM.format('md')} <> ''"),
    "missing_pages": oracle(f"""with {_PAGES}, x as (select doc_id, page_num, case when (doc_id + page_num) % 3 = 0 then ' ' else md end as md from pg), n as (select doc_id, max(page_num) as n from x group by doc_id)
      select doc_id, g::int as page_num from n, unnest(range(1, n + 1)) u(g) where not exists (select 1 from x where x.doc_id = n.doc_id and x.page_num = g and {_TRIM.format('x.md')} <> '')"""),
    "slide_footer": oracle(f"with {_PAGES}, n as (select doc_id, count(*) as pages, sum(case when page_num % 4 > 0 and page_num % 5 <> 2 and page_num % 9 > 0 then 1 else 0 end) as times from pg group by 1) select doc_id, '目录页' as head, times from n where pages >= 3 and times >= greatest(3, pages // 10)"),
    "file_dispatch": oracle("select id, ['plain', 'markdown', 'html', 'cloud', 'cloud', 'slides', 'sheets', 'sheets', null][id % 9 + 1] as route from v_document"),
    "blob_paths": oracle("select id, case when id % 3 = 0 then 's3://bucket/' else '/data/' end || file_name as path from v_document"),
    "text_poor_pages": oracle(f"with {_PAGES} select doc_id, page_num from pg where length({_TRIM.format('md')}) < 50"),
    "token_estimate": f"select doc_id, {_EST.format('text')} as tokens from documents",
    "router_cap": f"with e as (select item_id, ceil({_EST.format('repeat(text, (item_id % 16)::int)')} * 1.35) + 40 as need from benchmark) select item_id, case when need <= 256 then 256 when need <= 512 then 512 else 1024 end as cap from e",
    "content_hash": "select page_id, sha256(coalesce(html, '')) as digest from pages",
    "parse_cache_lookup": "with c as (select sha256(text) as digest, max(doc_id) as cached_as from documents where doc_id % 2 = 0 group by 1) select doc_id, cached_as from documents left join c on sha256(text) = digest",
    "parse_cache_put": f"with c as (select sha256(coalesce(text, '')) as digest, doc_id as id, doc_id % 7 as t from documents where doc_id % 5 > 0 and {_TRIM.format('text')} <> '') select digest, arg_max(id, t * 1000000000 + id) as id from c group by 1",
    "embed_text": oracle("select doc_id, seq, md5(case when seq % 2 = 0 then 't' || doc_id::varchar || chr(10) || content else content end) as digest from v_chunk"),
}
