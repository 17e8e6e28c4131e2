from __future__ import annotations

from sagebase.operators import html, segment

TABLE = "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_small_table_is_one_piece():
    out, _, _ = segment.chunk_page(TABLE)
    assert [c for _, c in out] == [TABLE]


def test_large_table_repeats_its_header():
    rows = "\n".join(f"| {i} | value {i} |" for i in range(60))
    pieces, _, _ = segment.chunk_page(f"| k | v |\n| --- | --- |\n{rows}", 200, 0)
    assert len(pieces) >= 3
    assert all(len(c) <= 200 and c.startswith("| k | v |\n| --- | --- |") for _, c in pieces)
    assert sum(c.count("value") for _, c in pieces) == 60


def test_blank_cells_take_the_value_above():
    (_, (_, header, rows)), = segment.tables("| x | |\n|---|---|\n| a | 红 |\n| | 黄 |\n| b | 绿 |\n| | 黑 |")
    assert header == ["x", "列2"]
    assert [r[0] for r in rows] == ["a", "a", "b", "b"]


def test_titles_follow_headings():
    text = "## 3.1 设备清单\n\n" + TABLE + "\n\ntext\n\n## 3.2 部署\n\nmore"
    out, _, stack = segment.chunk_page(text, 60, 0)
    assert [t for t, c in out if c.startswith("| a")] == ["3.1 设备清单"]
    assert segment.path(stack) == "3.2 部署"


def test_carry_and_stack_go_to_the_next_page():
    _, carry, stack = segment.chunk_page("# A\n" + "word " * 60, 100, 20)
    assert carry and segment.path(stack) == "A"
    out, _, _ = segment.chunk_page("tail text", 100, 20, carry, stack)
    assert out[0][0] == "A" and out[0][1].startswith(carry)
    out, _, _ = segment.chunk_page("# B\ntext", 100, 20, carry, stack)
    assert out[0] == ("B", "# B\ntext")
    assert segment.chunk_page(" ", 100, 20, carry, stack) == ([], carry, stack)


def test_code_stays_whole_or_keeps_its_fences():
    code = "```py\n" + "\n".join(f"line {i}" for i in range(40)) + "\n```"
    pieces, _, _ = segment.chunk_page(f"before\n{code}\nafter", 120, 0)
    parts = [c for _, c in pieces if c.startswith("```py")]
    assert len(parts) > 1 and all(p.endswith("```") and len(p) <= 120 for p in parts)
    assert [x for p in parts for x in p.split("\n")[1:-1]] == [f"line {i}" for i in range(40)]


def test_long_text_without_separators_is_cut_hard():
    assert segment.recursive("x" * 1700, 800) == ["x" * 800, "x" * 800, "x" * 100]


def test_headings():
    assert segment.heading("### a") == (3, "a")
    assert segment.heading("第3章 总则") == (1, "第3章 总则")
    assert segment.heading("一、概述") == (2, "一、概述")
    assert segment.heading("1.2.3 x") == (3, "1.2.3 x")
    assert segment.heading("1. 完成。") is None
    assert segment.heading("plain") is None


def test_html():
    page = "<html><body><nav>n</nav><main><h2>T</h2><p>a&nbsp;b</p><ul><li>x</li></ul><ol><li>y</li></ol><pre>c\nd</pre><img alt='p'><table><tr><th>h</th></tr><tr><td>1</td></tr></table></main></body></html>"
    out = html.to_markdown(page)
    assert out.startswith("## T\na b\n")  # blocks end one line, not two
    assert "- x" in out and "1. y" in out and "```\nc\nd\n```" in out and "[图片: p]" in out
    assert "| h |\n| --- |\n| 1 |" in out
    assert html.to_markdown(None) == ""


def test_rule_as_first_line_names_columns():
    assert segment.tables("|---|\n| 值 |") == [("table", ("", ["列1"], [["值"]]))]
    assert segment.tables("| a | b |\n|---|---|") == [("text", "| a | b |\n|---|---|")]
    assert segment.tables("| x | y |\n| a | b |\n|---|---|\n| 1 |\n| --- | --- |") == [("table", ("", ["a", "b"], [["1", ""], ["---", "---"]]))]


def test_captions_join_over_blank_lines():
    (kind, (caption, _, _)), = segment.tables("表1-1 设备清单\n\n| 设备 |\n|------|\n| 路由 |")
    assert (kind, caption) == ("table", "表1-1 设备清单")
    assert segment.tables("**表 2 参数说明**\n\n| x |\n|---|\n| 1 |")[0][1][0] == "**表 2 参数说明**"
    assert segment.tables("表1-1 设备清单\n\n  正文描述。") == [("text", "表1-1 设备清单\n\n正文描述。")]


def test_trimming_keeps_wide_spaces():
    assert segment.recursive("　甲。\n", 100) == ["　甲。"]
    assert segment.heading("１２ 标题") is None and segment.heading("12 标题") == (1, "12 标题")


def test_plain_text_follows_headings():
    out, _ = segment.plain_pieces("# 员工手册\n考勤需每日打卡。\n## 报销规则\n报销需提供发票。\n## 年假规定\n入职满一年享五天年假。", 800, 0)
    assert [t for t, _ in out] == ["员工手册", "员工手册 > 报销规则", "员工手册 > 年假规定"]
    assert segment.plain_pieces("第一条知识内容。\n\n第二条知识内容，需要被正确分块。")[0] == [("", "第一条知识内容。\n第二条知识内容，需要被正确分块。")]
    assert segment.plain_pieces("   \n  ", carry="x") == ([], "x")


def test_plain_text_carries_its_tail():
    text = "\n\n".join(f"第{i}段，这是第一页的内容，用于制造多个分块。" for i in range(40))
    out, carry = segment.plain_pieces(text, 150, 40)
    assert len(out) > 1 and all(len(c) <= 150 for _, c in out) and carry and out[-1][1].endswith(carry)
    assert segment.plain_pieces("第二页正文。", 150, 40, carry)[0][0][1].startswith(carry)
    assert segment.plain_pieces("# 新章\n\n正文。", 150, 40, carry)[0][0][1].startswith("# 新章")


def test_code_groups_have_no_blank_ends():
    body = "\n".join("" if i % 8 == 7 else f"int value{i} = {i};" for i in range(40))
    pieces = segment.code_pieces(f"```java\n{body}\n```", 200)
    assert all(len(p) <= 200 and p.startswith("```java\nint") and not p.endswith("\n\n```") for p in pieces)
    assert "\n".join(x for p in pieces for x in p.split("\n")[1:-1] if x) == "\n".join(x for x in body.split("\n") if x)
    assert segment.code_pieces("```\n\n \n```", 200) == []


def test_long_sentences_stand_alone():
    assert segment.sentences("短。" + "长" * 25 + "。又短。", 10) == ["短。", "长" * 10, "长" * 10, "长" * 5 + "。", "又短。"]


def test_pages_of_documents_are_walked_in_order(spark):
    """Documents of many pages, dealt over partitions and batches, give what one walk over their pages gives."""
    pages = [(d, p, f"# Head {p % 5}\n\n" + " ".join(f"w{d}.{p}.{i}" for i in range(60 + 40 * (p % 4)))) for d in (3, 1, None) for p in range(40)]
    pages += [(7, None, "the last page"), (7, 1, "the first page"), (8, 1, None), (9, 1, "")]
    df = spark.createDataFrame(pages, "doc_id long, page_num int, markdown string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((tuple(r) for r in segment.chunk_documents(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for d in (1, 3, 7, 8, 9, None):
        carry, stack, n = "", (), 0
        for _, page, text in sorted((p for p in pages if p[0] == d), key=lambda p: (p[1] is None, p[1] or 0)):
            pieces, carry, stack = segment.chunk_page(text or "", segment.SIZE, segment.OVERLAP, carry, stack)
            for title, content in pieces:
                want.append((d, n, page, title, content))
                n += 1
    assert got == want and len(want) > 100


def test_pieces_leave_in_bounded_batches(monkeypatch):
    """However many pieces a batch of texts gives, a task has a part of them at once."""
    import pyarrow as pa

    monkeypatch.setattr(segment, "STEP_CHARS", 1000)
    given = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 300)), pa.array(["x" * 50] * 299 + [None])], names=["id", "text"]) for a in (0, 300)]
    taken = []
    rows = (taken.append(i) or (i, k, text) for i, text in segment.in_steps(iter(given)) for k in range(3))
    out = segment.packed(rows, pa.schema([("id", pa.int64()), ("k", pa.int32()), ("text", pa.string())]))
    first = next(out)
    assert first.num_rows <= 10 and len(taken) <= 10
    rest = [first, *out]
    assert max(b.num_rows for b in rest) <= 16 and sum(b.num_rows for b in rest) == 1800
    assert [r for b in rest for r in zip(*(c.to_pylist() for c in b.columns))] == [(i, k, None if i % 300 == 299 else "x" * 50) for i in range(600) for k in range(3)]
