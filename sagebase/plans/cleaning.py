"""Queries over the cleaning rules of pages and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebase.functions import text as T
from sagebase.operators import clean as C
from sagebase.plans.views import frame, oracle


def _pages(spark, sf):
    lines = frame(spark, sf, "v_line")
    return lines.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def _chunks(spark, sf):
    return frame(spark, sf, "v_chunk").withColumn("title", F.when(F.col("doc_id") % 50 == 0, F.lit("Sheet 1")).when(F.col("doc_id") % 50 == 1, F.col("content")))


def line_template_ratio(spark, sf):
    return C.line_shares(frame(spark, sf, "v_line")).where("pages >= 2 and share >= 0.5").select("doc_id", "key", "on_pages", "pages", "share")


def strip_header_footer(spark, sf):
    return C.strip_headers(frame(spark, sf, "v_line"))


def _noisy(spark, sf):
    """Pages of which some documents begin with a blank one, a cover or a list of contents."""
    k, n = F.col("doc_id") % 4, F.col("page_num")
    markdown = F.when((n == 1) & (k == 0), F.lit(" \n ")).when((n == 1) & (k == 1), F.concat(F.lit("Manual "), F.col("doc_id").cast("string"))).when((n == 2) & (k < 2), F.lit("目录\nPart one..... 3\n- Part two 12")).otherwise(F.col("markdown"))
    return _pages(spark, sf).withColumn("markdown", markdown)


def head_noise_pages(spark, sf):
    return C.head_noise(_noisy(spark, sf))


def toc_page_ratio(spark, sf):
    lines = frame(spark, sf, "v_line").withColumn("line", T.jtrim(F.col("line"))).where("line <> ''")
    toc = F.col("line").rlike(C.TOC_LINE) | (F.col("line").startswith("-") & F.col("line").rlike(r"\d+\s*$"))
    return lines.groupBy("doc_id", "page_num").agg(F.round(F.avg(toc.cast("int")), 6).alias("ratio"), F.count("*").alias("n"))


def tail_disclaimer(spark, sf):
    return C.disclaimers(_pages(spark, sf).withColumn("markdown", F.when(F.col("doc_id") % 9 == 0, F.concat("markdown", F.lit(" 版权所有"))).otherwise(F.col("markdown"))))


def protect_table(spark, sf):
    return _chunks(spark, sf).where(C.protect_table(F.col("content"), F.col("title"))).select("doc_id", "seq")


def protect_key_value(spark, sf):
    """Chunks with a word, a colon and digits anywhere; every seventh gets one."""
    text = F.when((F.col("doc_id") + F.col("seq")) % 7 == 0, F.concat("content", F.lit(" 温度：25 度"))).otherwise(F.col("content"))
    return _chunks(spark, sf).where(text.rlike(C.KEY_VALUE)).select("doc_id", "seq")


def protect_title_line(spark, sf):
    short = _chunks(spark, sf).withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## "), F.regexp_replace("content", "\n", " "))).otherwise(F.col("content")))
    return short.where(C.protect_title(F.col("content"), F.col("title"))).select("doc_id", "seq")


def protect_overlap_neighbor(spark, sf):
    return C.overlaps(_overlapping(spark, sf)).where("overlap").select("doc_id", "seq")


def _overlapping(spark, sf):
    from pyspark.sql import Window

    before = F.lag("content").over(Window.partitionBy("doc_id").orderBy("seq"))
    chunks = frame(spark, sf, "v_chunk").select("doc_id", "seq", "content")
    return chunks.withColumn("content", F.when((F.col("doc_id") % 4 == 0) & before.isNotNull(), F.concat(F.substring(before, 761, 40), "content")).otherwise(F.col("content")))


def _fragments(spark, sf):
    """Lines as fragments, a third of them short."""
    return frame(spark, sf, "v_line").select("doc_id", "line_no", F.when(F.col("doc_id") % 11 == 0, F.lit("https://example.org/a")).when(F.col("doc_id") % 13 == 0, F.lit("--- *** ---")).when(F.col("doc_id") % 17 == 0, F.concat("line", F.lit("�"))).when(F.col("line_no") % 3 == 1, F.concat(F.lit("n "), F.col("line_no").cast("string"))).otherwise(F.col("line")).alias("content"))


def fragment_a1_a5(spark, sf):
    return _fragments(spark, sf).select("doc_id", "line_no", C.fragment_rule(F.col("content")).alias("rule"))


def figure_table_titles(spark, sf):
    rows = frame(spark, sf, "v_line").select("doc_id", "line_no", F.concat(F.when(F.col("line_no") % 2 == 0, F.lit("图 1 ")).otherwise(F.lit("表 2 ")), F.when(F.col("line_no") % 3 > 0, F.lit("overview")).otherwise(F.col("line"))).alias("content"))
    return rows.select("doc_id", "line_no", C.caption_rule(F.col("content")).alias("rule"))


def image_only(spark, sf):
    rows = frame(spark, sf, "v_line").select("doc_id", "line_no", F.concat(F.lit("![x](y.png) "), F.when(F.col("line_no") % 2 == 0, F.lit("<img src='a'>")).otherwise(F.col("line"))).alias("content"))
    return rows.where(C.caption_rule(F.col("content")) == "B3").select("doc_id", "line_no")


def _repeating(spark, sf):
    """Lines as chunks: documents with repeated lines have repeated chunks."""
    return frame(spark, sf, "v_line").select("doc_id", F.col("line_no").alias("seq"), F.col("line").alias("content"))


def template_c1(spark, sf):
    return C.templates(_repeating(spark, sf).withColumn("content", F.when((F.col("doc_id") % 5 == 0) & (F.col("seq") % 3 > 0), F.concat(F.lit("page "), F.col("seq").cast("string"))).otherwise(F.col("content"))))


def near_duplicate_c2(spark, sf):
    return C.near_duplicates(_repeating(spark, sf))


def long_line_duplicate_c3(spark, sf):
    return C.long_line_duplicates(_repeating(spark, sf))


def disposition_counts(spark, sf):
    rows = _fragments(spark, sf).select(C.fragment_rule(F.col("content")).alias("rule"))
    return rows.select("rule", C.disposition(F.col("rule")).alias("disposition")).groupBy("rule", "disposition").agg(F.count("*").alias("n"))


def kept_dropped_seq(spark, sf):
    rows = _fragments(spark, sf).select("doc_id", F.col("line_no").alias("seq"), C.disposition(C.fragment_rule(F.col("content"))).alias("disposition"))
    return C.numbered(rows)


def judged_chunks(spark, sf):
    return C.judged(frame(spark, sf, "v_chunk").select("doc_id", "seq", "content")).groupBy("rule", "disposition").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (line_template_ratio, strip_header_footer, head_noise_pages, toc_page_ratio, tail_disclaimer, protect_table, protect_key_value, protect_title_line, protect_overlap_neighbor, fragment_a1_a5, figure_table_titles, image_only, template_c1, near_duplicate_c2, long_line_duplicate_c3, disposition_counts, kept_dropped_seq, judged_chunks)}

_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_KEY = "regexp_replace(" + _TRIM.format("{}") + ", '[0-9]+', '<NUM>', 'g')"
_TITLED = "ch as (select *, case when doc_id % 50 = 0 then 'Sheet 1' when doc_id % 50 = 1 then content end as title from v_chunk)"
_SHARES = f"""k as (select *, {_KEY.format('line')} as key from v_line), p as (select doc_id, count(distinct page_num) as pages from k group by doc_id),
  s as (select doc_id, key, count(distinct page_num) as on_pages from k where key <> '' group by doc_id, key), sh as (select *, round(on_pages / pages, 6) as share from s join p using (doc_id))"""
_FRAG = "fr as (select doc_id, line_no, case when doc_id % 11 = 0 then 'https://example.org/a' when doc_id % 13 = 0 then '--- *** ---' when doc_id % 17 = 0 then line || '�' when line_no % 3 = 1 then 'n ' || line_no::varchar else line end as content from v_line)"
_RULE = rf"""case when {_TRIM.format('content')} = '' then 'A1' when not regexp_matches({_TRIM.format('content')}, '[\p{{L}}\p{{Nd}}]') then 'A2'
  when regexp_matches({_TRIM.format('content')}, '^((https?|ftp)://\S+|www\.\S+)$') then 'A3'
  when length({_TRIM.format('content')}) < 10 and (not regexp_matches(content, '[一-龥]') or not regexp_matches(content, '[0-9]')) then 'A4'
  when regexp_matches({_TRIM.format('content')}, '[�\x00-\x08\x0b\x0c\x0e-\x1f]') then 'A5' end"""
_DISP = "case when rule in ('A1','A2','A5','C1') then 'AUTO_DROP' when rule in ('A3','A4','B1','B2','B3','C2','C3','P5') then 'SUSPECT' else 'KEEP' end"
_LINES = "rc as (select doc_id, line_no as seq, line as content from v_line)"

ORACLE_SQL = {
    "line_template_ratio": oracle(f"with {_SHARES} select doc_id, key, on_pages, pages, share from sh where pages >= 2 and share >= 0.5"),
    "strip_header_footer": oracle(f"""with {_SHARES}, t as (select doc_id, key from sh where pages >= 2 and on_pages / pages >= 0.8 and length(key) <= 50),
      r as (select *, row_number() over (partition by doc_id, page_num order by line_no) as pos, count(*) over (partition by doc_id, page_num) as n from k)
      select doc_id, page_num, line_no, line from r where not ((pos <= 3 or pos > n - 3) and exists (select 1 from t where t.doc_id = r.doc_id and t.key = r.key))"""),
    "head_noise_pages": oracle(rf"""with p0 as (select doc_id, page_num, string_agg(line, chr(10) order by line_no) as md from v_line group by doc_id, page_num),
      pg as (select doc_id, page_num, {_TRIM.format("case when page_num = 1 and doc_id % 4 = 0 then ' ' when page_num = 1 and doc_id % 4 = 1 then 'Manual ' || doc_id::varchar when page_num = 2 and doc_id % 4 < 2 then '目录' || chr(10) || 'Part one..... 3' || chr(10) || '- Part two 12' else md end")} as md from p0),
      r as (select *, list_filter(list_transform(string_split(md, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x <> '') as full_lines from pg),
      q as (select *, case when md = '' then 'P4' when length(md) <= 50 and not regexp_matches(md, '[#。，|]') and len(string_split(md, chr(10))) <= 3 then 'P2'
        when contains(md, '目录') and len(list_filter(full_lines, lambda x: regexp_matches(x, '^.+?\.{{2,}}\s*\d+\s*$') or (starts_with(x, '-') and regexp_matches(x, '\d+\s*$')))) >= 0.6 * len(full_lines) then 'P3' end as rule from r),
      w as (select *, row_number() over (partition by doc_id order by page_num) as nth, count(*) over (partition by doc_id) as n, sum(case when rule is null then 1 else 0 end) over (partition by doc_id order by page_num) as plain from q)
      select doc_id, page_num, rule from w where plain = 0 and nth <= 5 and nth < n"""),
    "toc_page_ratio": oracle(rf"""with l as (select doc_id, page_num, {_TRIM.format('line')} as line from v_line)
      select doc_id, page_num, round(avg(case when regexp_matches(line, '^.+?\.{{2,}}\s*\d+\s*$') or (starts_with(line, '-') and regexp_matches(line, '\d+\s*$')) then 1 else 0 end), 6) as ratio, count(*) as n from l where line <> '' group by all"""),
    "tail_disclaimer": oracle("""with pg as (select doc_id, page_num, string_agg(line, chr(10)) || case when doc_id % 9 = 0 then ' 版权所有' else '' end as md from v_line group by doc_id, page_num)
      select doc_id, page_num from (select *, row_number() over (partition by doc_id order by page_num desc) as back from pg) where back = 1 and regexp_matches(md, '免责声明|版权声明|著作权|版权所有|版权归|未经许可|机密|联系方式')"""),
    "protect_table": oracle(f"with {_TITLED} select doc_id, seq from ch where contains(content, '|') or coalesce(regexp_matches(title, 'sheet|Sheet|表格'), false)"),
    "protect_key_value": oracle(r"select doc_id, seq from v_chunk where regexp_matches(case when (doc_id + seq) % 7 = 0 then content || ' 温度：25 度' else content end, '[A-Za-z一-龥]{2,}\s*[：:]\s*\d+')"),
    "protect_title_line": oracle(rf"""with {_TITLED}, x as (select doc_id, seq, title, case when doc_id % 3 = 0 then '## ' || replace(content, chr(10), ' ') else content end as content from ch)
      select doc_id, seq from x where coalesce({_TRIM.format('content')} = title and {_TRIM.format('title')} <> '', false) or regexp_matches({_TRIM.format('content')}, '^(#{{1,6}}\s+[^\n]+|\*\*[^\n]+\*\*[ \t]*)$')"""),
    "protect_overlap_neighbor": oracle("""with b as (select doc_id, seq, content, lag(content) over (partition by doc_id order by seq) as pr from v_chunk),
      c as (select doc_id, seq, case when doc_id % 4 = 0 and pr is not null then substring(pr, 761, 40) || content else content end as content from b),
      d as (select *, lag(content) over w as pr, lead(content) over w as nx from c window w as (partition by doc_id order by seq))
      select doc_id, seq from d where coalesce(pr <> '' and length(right(pr, 40)) < length(content) and starts_with(content, right(pr, 40)), false) or coalesce(content <> '' and length(right(content, 40)) < length(nx) and starts_with(nx, right(content, 40)), false)"""),
    "fragment_a1_a5": oracle(f"with {_FRAG} select doc_id, line_no, {_RULE} as rule from fr"),
    "figure_table_titles": oracle(rf"""with x as (select doc_id, line_no, case when line_no % 2 = 0 then '图 1 ' else '表 2 ' end || case when line_no % 3 > 0 then 'overview' else line end as content from v_line), y as (select *, {_TRIM.format('content')} as t from x)
      select doc_id, line_no, case when regexp_matches(t, '^表\s*\d+') and length(t) <= 20 and not contains(content, '|') then 'B2' when regexp_matches(t, '^(图|Fig\.?|表|Table)\s*\d+[.、:：\-]?\s*\S+') and length(t) <= 30 then 'B1' end as rule from y"""),
    "image_only": oracle(rf"""with x as (select doc_id, line_no, '![x](y.png) ' || case when line_no % 2 = 0 then '<img src=''a''>' else line end as content from v_line)
      select doc_id, line_no from x where {_TRIM.format(r"regexp_replace(content, '!\[[^\]]*\]\([^)]*\)|<img[^>]*>', '', 'g')")} = ''"""),
    "template_c1": oracle(f"""with {_LINES}, x as (select doc_id, seq, {_KEY.format("case when doc_id % 5 = 0 and seq % 3 > 0 then 'page ' || seq::varchar else content end")} as key from rc),
      y as (select *, count(*) over (partition by doc_id) as n, count(*) over (partition by doc_id, key) as times, row_number() over (partition by doc_id, key order by seq) as nth from x)
      select doc_id, seq from y where key <> '' and times / n >= 0.6 and nth > 1"""),
    "near_duplicate_c2": oracle(f"""with {_LINES}, g as (select doc_id, seq, length(content) as n, list_distinct(list_transform(range(1, length(content) - 1), lambda i: substring(content, i, 3))) as g from rc where length(content) >= 3)
      select distinct a.doc_id, a.seq from g a join g b on a.doc_id = b.doc_id and b.seq < a.seq and abs(a.n - b.n) * 10 <= a.n * 3
      where len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.9"""),
    "long_line_duplicate_c3": oracle(f"""with {_LINES}, t as (select doc_id, seq, {_TRIM.format('content')} as line from rc)
      select distinct t.doc_id, t.seq from t join rc b on t.doc_id = b.doc_id and b.seq < t.seq and length(t.line) >= 80 and contains(b.content, t.line)"""),
    "judged_chunks": oracle(rf"""with rc as (select doc_id, seq, content from v_chunk), w as (select *, lag(content) over (partition by doc_id order by seq) as pr, lead(content) over (partition by doc_id order by seq) as nx, {_TRIM.format('content')} as t from rc),
      sh as (select doc_id, seq, content, t, contains(content, '|') or regexp_matches(content, '[A-Za-z一-龥]{{2,}}\s*[：:]\s*\d+') or (regexp_matches(t, '^(图|Fig\.?|表|Table)\s*\d+[.、:：\-]?\s*\S+') and length(t) >= 40) or regexp_matches(t, '^(#{{1,6}}\s+[^\n]+|\*\*[^\n]+\*\*[ \t]*)$')
        or coalesce(pr <> '' and length(right(pr, 40)) < length(content) and starts_with(content, right(pr, 40)), false) or coalesce(content <> '' and length(right(content, 40)) < length(nx) and starts_with(nx, right(content, 40)), false) as shielded,
        coalesce({_RULE}, case when regexp_matches(t, '^表\s*\d+') and length(t) <= 20 and not contains(content, '|') then 'B2' when regexp_matches(t, '^(图|Fig\.?|表|Table)\s*\d+[.、:：\-]?\s*\S+') and length(t) <= 30 then 'B1'
          when t <> '' and {_TRIM.format(r"regexp_replace(content, '!\[[^\]]*\]\([^)]*\)|<img[^>]*>', '', 'g')")} = '' then 'B3' end) as early from w),
      x as (select doc_id, seq, {_KEY.format('content')} as key from rc), y as (select *, count(*) over (partition by doc_id) as n, count(*) over (partition by doc_id, key) as times, row_number() over (partition by doc_id, key order by seq) as nth from x),
      g as (select doc_id, seq, length(content) as n, list_distinct(list_transform(range(1, length(content) - 1), lambda i: substring(content, i, 3))) as g from rc where length(content) >= 3),
      ln as (select doc_id, seq, {_TRIM.format('line')} as line from (select doc_id, seq, unnest(string_split(content, chr(10))) as line from rc)),
      late as (select doc_id, seq, min(rule) as late from (select doc_id, seq, 'C1' as rule from y where key <> '' and times / n >= 0.6 and nth > 1
        union all select a.doc_id, a.seq, 'C2' from g a join g b on a.doc_id = b.doc_id and b.seq < a.seq and abs(a.n - b.n) * 10 <= a.n * 3 where len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.9
        union all select l.doc_id, l.seq, 'C3' from ln l join rc b on l.doc_id = b.doc_id and b.seq < l.seq and length(l.line) >= 80 and contains(b.content, l.line)) group by all),
      jd as (select case when not coalesce(shielded, false) then coalesce(early, late) end as rule from sh left join late using (doc_id, seq))
      select rule, {_DISP} as disposition, count(*) as n from jd group by all"""),
    "disposition_counts": oracle(f"with {_FRAG}, r as (select {_RULE} as rule from fr) select rule, {_DISP} as disposition, count(*) as n from r group by all"),
    "kept_dropped_seq": oracle(f"with {_FRAG}, r as (select doc_id, line_no as seq, {_RULE} as rule from fr), d as (select doc_id, seq, {_DISP} as disposition from r) select *, row_number() over (partition by doc_id order by case disposition when 'AUTO_DROP' then 1 else 0 end, seq) as new_seq from d"),
}
