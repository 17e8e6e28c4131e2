"""Operators that SQL can't express, against plain loops and literal cases."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebase.operators import clean, grid, index, knowledge, qa, retrieve, segment
from sagebase.sources import files


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None),
        ("none", None),
        ('a {"b": {"c": 1}} {"d": 2}', '{"b": {"c": 1}}'),
        ('{"t": "}\\"{"}x', '{"t": "}\\"{"}'),
        ("} {1", None),
    ],
)
def test_first_object(text, want):
    assert qa.first_object(text) == want


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        (" ", None),
        ("hm", None),
        ("INTENT: chitchat", [("q", "CHITCHAT", False)]),
        ("business, injected", [("q", "BUSINESS", True)]),
        ("injection!", [("q", "CHITCHAT", True)]),
        ('{"fragments": [{"text": " a ", "intent": "business"}, {"text": "b", "intent": "none"}, {"intent": "BUSINESS"}, 3]}', [("a", "BUSINESS", False)]),
        ('{"fragments": [{"text": "x", "intent": "injected business"}]}', [("x", "CHITCHAT", True)]),
        ('{"fragments": "BUSINESS"}', [("q", "BUSINESS", False)]),
    ],
)
def test_fragments_of_replies(reply, want):
    assert qa.fragments_of(reply, "q") == want


def test_snippets():
    table = "".join(f"| r{i} | v |\n" for i in range(60))
    code = "```py\n" + "x = 1\n" * 80 + "```\n"
    assert qa.snippet(None) == "" and qa.snippet("short") == "short"
    assert qa.snippet("a" * 400) == "a" * 300 + "…"
    assert qa.snippet("intro\n" + table + "end") == table
    assert qa.snippet("intro\n" + code + "end " * 50) == code
    assert qa.snippet("| a |\n" * 3 + "plain " * 100) == ("| a |\n" * 3 + "plain " * 100)[:300] + "…"
    assert qa.snippet("x\n~~~\n" + "y\n" * 300) == "~~~\n" + "y\n" * 300  # an open fence runs to the end


def test_rendering_looks_at_values_once(spark):
    row = spark.range(1).select(qa.rendered(F.lit("{{a}}-{{ b | d }}-{{c}}"), F.create_map(F.lit("a"), F.lit("{{b}}"))).alias("x")).first()
    assert row.x == "{{b}}-d-"


def test_reranking_by_plain_loops(spark):
    rng = random.Random(3)
    rows = [(q, p, rng.choice(["CHUNK", "QA", "BUSINESS"]), rng.randint(0, 9) / 10, f"doc{p % 3}", "" if p % 2 else "t", f"text {rng.random()}") for q in range(6) for p in range(rng.choice([3, 9, 40]))]
    df = spark.createDataFrame(rows, "query_id int, pos int, source_type string, score double, doc_name string, title string, content string")
    scorer = lambda texts: [sum(t.encode()) % 101 / 100 for t in texts]
    got = {(r.query_id, r.part, r.rank): (r.pos, round(r.score, 6)) for r in retrieve.reranked(df, ["query_id"], scorer).collect()}
    want = {}
    for q in range(6):
        for part, quota in (("CHUNK", 6), ("OTHER", 4)):
            own = sorted((r for r in rows if r[0] == q and (r[2] == "CHUNK") == (part == "CHUNK")), key=lambda r: (-r[3], r[1]))
            best = [(r[1], r[3]) for r in own]
            if len(own) > quota:
                head = lambda r: f"文档：{r[4]}；" + (f"章节：{r[5]}；" if r[5] else "") + "\n"
                best = sorted(((r[1], scorer([head(r) + r[6]])[0]) for r in own[:20]), key=lambda x: -x[1])
            want |= {(q, part, k + 1): (p, round(s, 6)) for k, (p, s) in enumerate(best[:quota])}
    assert got == want


def test_embedder_sees_batches_in_order(spark):
    def embedder(texts):
        assert len(texts) <= index.EMBED_BATCH
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(k, "x" * k if k % 7 else None) for k in range(35)], "id int, text string")
    assert {r.id: r.embedding for r in index.embedded(df, "text", embedder).collect()} == {k: [float(k if k % 7 else 0)] for k in range(35)}


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# 一章\n第一段。\n\n第二段。", encoding="utf-8")
    (tmp_path / "B.MD").write_text("## h\n\n| a | b |\n|---|---|\n| 1 | 2 |", encoding="utf-8")
    (tmp_path / "c.html").write_text("<h1>t</h1><p>body", encoding="utf-8")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.zip").write_bytes(b"PK")
    found = files.read_files(spark, str(tmp_path))
    pieces = {(r.path.rsplit("/", 1)[1], r.seq): (r.title, r.content) for r in files.file_pieces(found).collect()}
    assert pieces == {("a.txt", 0): ("一章", "# 一章\n第一段。\n第二段。"), ("B.MD", 0): ("h", "## h"), ("B.MD", 1): ("h", "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("c.html", 0): ("t", "# t\nbody")}
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in files.unread(found).collect()} == {"d.pdf": "needs a parser for pdf", "e.zip": "不支持的文件类型: zip"}
    parse = lambda df: df.select("path", F.lit(0).alias("seq"), F.lit(1).alias("page_num"), F.lit("p").alias("title"), F.lit("cloud").alias("content"))
    assert files.parsed(found, {"cloud": parse}).where("content = 'cloud'").count() == 1


def test_slide_titles():
    assert files.slide_title("# 目录\n## 背景\n正文", "目录") == "背景"
    assert files.slide_title("# 目录\n短句", "目录") == "短句"
    assert files.slide_title("# 目录\n- 列表", "目录") == "目录"
    assert files.slide_title("# 一\n## 二", None) == "一 > 二"
    assert files.slide_title("第一行文字。\n更多", "x") == "第一行文字。"
    assert files.slide_title(" \n", None) is None


def test_footers_and_slides(spark):
    rows = [(1, p, f"# 公司\n## 第{p}页题\n文") for p in range(1, 5)] + [(1, 5, " "), (2, 1, "# 公司\n一"), (2, 2, "# 公司\n二"), (3, 1, "# 一个很长很长的标题\n文"), (3, 2, "# 一个很长很长的标题"), (3, 3, "# 一个很长很长的标题")]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, markdown string")
    assert [(r.doc_id, r.footer) for r in files.footers(df).collect()] == [(1, "公司")]
    later = [(1, 1, "plain\n# A\n# A"), (1, 2, "plain\n# A"), (1, 3, "# B"), (2, 1, " \r\n# A \r\nx"), (2, 2, "\n\n## A"), (2, 3, "# A"), (2, 4, None), (3, 1, "#A"), (3, 2, "#A"), (3, 3, "#A")]
    assert [(r.doc_id, r.footer, r.times) for r in files.footers(spark.createDataFrame(later, "doc_id int, page_num int, markdown string")).collect()] == [(2, "A", 3)]
    got = {(r.doc_id, r.page_num): r.title for r in files.slide_pieces(df).collect()}
    assert got[1, 2] == "第2页题" and (1, 5) not in got and got[2, 1] == "公司"


def test_large_sheets_repeat_their_header(spark):
    cells = [("s", 0, 0, "caption"), ("s", 1, 0, "k"), ("s", 1, 1, "v")] + [("s", r, c, f"{'k' if c == 0 else 'value'}{r}") for r in range(2, 90) for c in (0, 1) if c or r % 5 == 2]
    grid_ = spark.createDataFrame(cells, "sheet string, r int, c int, value string")
    merges = spark.createDataFrame([("s", 2, 0, 4, 0), ("s", 7, 0, 7, 1)], "sheet string, r1 int, c1 int, r2 int, c2 int")
    pieces = [r.content for r in grid.sheet_pieces(grid.parsed_sheets(grid_, merges, ["sheet"]), ["sheet"], 200).orderBy("seq").collect()]
    assert len(pieces) > 5 and all(len(p) <= 200 and p.startswith("caption\n| k | v |\n| --- | --- |\n") for p in pieces)
    body = [x for p in pieces for x in p.split("\n")[3:]]
    assert body[:7] == ["| k2 | value2 |", "| k2 | value3 |", "| k2 | value4 |", "| k2 | value5 |", "| k2 | value6 |", "| k7 |  |", "| k7 | value8 |"]


def test_saved_markdown_is_cleaned_and_chunked(spark):
    page = lambda n, body: f"<!-- PAGE {n} -->\nRunning head\n{body}\nfoot {n}"
    text = "\n\n".join(["<!-- PAGE 1 -->\n封面", *(page(n, f"# 章{'甲乙丙丁'[n - 2]}\n{'子丑寅卯'[n - 2]}行。\n" + f"{'子丑寅卯'[n - 2]}内容一二三四五六七八九十。" * 5) for n in range(2, 6))])
    pages, chunks = knowledge.rechunked(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, 4), (1, 2)], "doc_id long, version int"))
    got = pages.orderBy("page_num").collect()
    assert [(r.version, r.page_num) for r in got] == [(5, n) for n in range(2, 6)] and not any("Running" in r.markdown or "foot" in r.markdown for r in got)
    kept = chunks.orderBy("new_seq").collect()
    assert kept[0].content.startswith("# 章甲") and [r.new_seq for r in kept] == list(range(1, len(kept) + 1))
    assert {r.disposition for r in kept} <= {"KEEP", "SUSPECT", "AUTO_DROP"}


def test_repeats_and_long_lines_by_plain_loops(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 200))) for _ in range(8)]
    rows = []
    for d in (1, 2):
        for seq in range(40):
            t = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            rows.append((d, seq, "".join(t) + (("\n" + rng.choice(base)) if rng.random() < 0.3 else "")))
    df = spark.createDataFrame(rows, "doc_id long, seq int, content string")
    grams = {(d, s): {t[i : i + 3] for i in range(len(t) - 2)} for d, s, t in rows}
    text = {(d, s): t for d, s, t in rows}
    c2, c3 = set(), set()
    for a in text:
        for b in text:
            if a[0] == b[0] and b[1] < a[1]:
                both = len(grams[a] & grams[b])
                if abs(len(text[a]) - len(text[b])) * 10 <= 3 * len(text[a]) and both >= 0.9 * (len(grams[a]) + len(grams[b]) - both):
                    c2.add(a)
                if any(len(x.strip()) >= 80 and x.strip() in text[b] for x in text[a].split("\n")):
                    c3.add(a)
    assert {tuple(r) for r in clean.near_duplicates(df).collect()} == c2 and len(c2) > 10
    assert {tuple(r) for r in clean.long_line_duplicates(df).collect()} == c3 and len(c3) > 10


def test_near_duplicates_move_sketches(spark, monkeypatch):
    """Short and long documents give the same by sketches and by first trigrams; a chunk gives one row to be paired, not one for each of its first trigrams."""
    rng = random.Random(9)
    rows = []
    for d in range(12):
        base = ["".join(rng.choice("abcdefghij é字𝄞") for _ in range(rng.choice([3, 40, 800]))) for _ in range(4)]
        for seq in range(12):
            t = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 3, 12, 30])):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            rows.append((d, seq, "".join(t)))
    df = spark.createDataFrame([*rows, (1, 99, None), (1, 98, "ab")], "doc_id long, seq int, content string")
    direct = {tuple(r) for r in clean.near_duplicates(df).collect()}
    assert clean.sketched(df.where("length(content) >= 3").withColumn("key", F.xxhash64("content"))).count() == len(rows)
    monkeypatch.setattr(clean, "FEW_CHUNKS", 0)
    assert {tuple(r) for r in clean.near_duplicates(df).collect()} == direct and len(direct) > 20


def test_nearest_by_plain_loops(spark):
    rng = random.Random(5)
    rows = [(k, [round(rng.gauss(0, 1), 1) for _ in range(4)]) for k in range(3000)] + [(3000 + k, [1.0, 1.0, 0.0, 0.0]) for k in range(20)]
    df = spark.createDataFrame([*rows, (9999, None)], "chunk_id long, embedding array<double>")
    queries = [(1, [1.0, 1.0, 0.0, 0.0]), (2, [0.3, -1.0, 2.0, 0.0])]
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in retrieve.cosine_top(df.repartition(3), spark.createDataFrame(queries, "query_id long, embedding array<double>"), 15).collect()}
    for q, v in queries:
        scored = sorted((-round(sum(a * b for a, b in zip(unit(v), unit(w), strict=True)), 6), i) for i, w in rows if any(w))
        assert [got[q, k + 1] for k in range(15)] == [(i, -s) for s, i in scored[:15]]


def test_references_are_json(spark):
    row = spark.createDataFrame([(1, 2, None, None, None, None, "s")], "chunk_id long, doc_id long, source_type string, doc_name string, page_num int, title string, snippet string").select(qa.refs_json(F.array(F.struct("*"))).alias("j")).first()
    assert json.loads(row.j) == [{"chunkId": 1, "docName": None, "page": 0, "sourceType": "CHUNK", "title": "", "docId": 2, "content": "s"}]
    assert segment.chunk_page("") == ([], "", ())


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        (None, ""),
        ("```markdown\n识别结果：A ## B\n\n \n\nC\n```\nbye", "A \n## B\n\nC"),
        ("```\nx", "x"),
        ("页面内容： plain", "plain"),
        ("# top\ntext", "# top\ntext"),
    ],
)
def test_reader_markdown(spark, reply, want):
    from sagebase.functions import text

    assert spark.range(1).select(text.reader_markdown(F.lit(reply).cast("string")).alias("x")).first().x == want


def test_saved_errors_and_poor_pages(spark):
    from sagebase.functions import text

    row = spark.range(1).select(text.text_poor(F.lit(" \n")).alias("a"), text.text_poor(F.lit("x" * 50)).alias("b"), text.friendly_error(F.lit("stream 调用 I/O error")).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, "模型服务调用超时或连接中断，请稍后重试")


def test_long_lines_inside_longer_ones_of_a_long_document(spark):
    """Every chunk of one document begins alike; lines stand at the beginning, in the middle and at the end of earlier ones, or in later ones only."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    head = "2024-05-01 00:00:00 INFO the same beginning of every line of this long document, which is all of it "
    rows, planted = [], set()
    for seq in range(1500):
        rows.append((1, seq, head + word(90)))
    for k, (a, b) in enumerate([(0, 80), (0, 150), (40, 140), (100, 190), (110, 190), (5, 184)]):
        rows.append((1, 2000 + k, rows[10 * k + 7][2][a:b]))
        planted.add((1, 2000 + k))
    inside_later = word(120)
    rows += [(1, 3000, inside_later), (1, 3001, "x" + inside_later + "y"), (2, 1, rows[7][2]), (2, 0, "é𝄞" * 60), (2, 5, "  " + ("é𝄞" * 50) + "\n短"), (3, 0, None), (3, 1, "")]
    planted.add((2, 5))
    got = {tuple(r) for r in clean.long_line_duplicates(spark.createDataFrame(rows, "doc_id long, seq int, content string")).collect()}
    text = {(d, s): t or "" for d, s, t in rows}
    want = {a for a in text if any(len(x.strip()) >= 80 and any(b[0] == a[0] and b[1] < a[1] and x.strip() in text[b] for b in text) for x in text[a].split("\n"))}
    assert got == want and planted <= want


def test_nearest_of_many_queries_by_blocks(spark, monkeypatch):
    """Queries beyond one block are dealt like rows and find what one scan finds, ties and rows of equal ids included."""
    rng = random.Random(8)
    rows = [(k, [round(rng.gauss(0, 1), 1) for _ in range(4)]) for k in range(900)] + [(2000 + k, [1.0, 1.0, 0.0, 0.0]) for k in range(60)] + [(3000, None)]
    index = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([*[(k, v) for k, v in rows if k % 7 == 0], (5000, [1.0, 1.0, 0.0, 0.0]), (5001, None)], "query_id long, embedding array<double>")
    got = lambda: sorted(tuple(r) for r in retrieve.cosine_top(index, queries, 5).select("query_id", "chunk_id", "score", "rank").collect())
    one_scan = got()
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 20)
    monkeypatch.setattr(retrieve, "PART_ROWS", 100)
    assert got() == one_scan and len(one_scan) == 5 * sum(1 for k, v in rows if k % 7 == 0 and v) + 5
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert retrieve.cosine_top(index, none, 5).collect() == [] and retrieve.cosine_top(index.where("chunk_id < 0"), queries, 5).collect() == []


def test_nearest_each_block_meets_each_part_in_a_task_of_its_own(spark, monkeypatch):
    """No task has more pairs of queries and rows than a block and a part, whatever their number; in a scan, rows are dealt where splits hold too many."""
    rng = random.Random(9)
    index = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(1500)], "chunk_id long, embedding array<float>")
    queries = index.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    given, top = [], retrieve.top
    monkeypatch.setattr(retrieve, "top", lambda found, *a, **k: given.append(found) or top(found, *a, **k))
    want = sorted(tuple(r) for r in retrieve.cosine_top(index, queries, 5).collect())
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 50)
    monkeypatch.setattr(retrieve, "PART_ROWS", 500)
    assert sorted(tuple(r) for r in retrieve.cosine_top(index, queries, 5).collect()) == want and len(want) == 150 * 5
    tasks = given[1].groupBy(F.spark_partition_id().alias("task"), "query_id").count().collect()
    assert len({r.task for r in tasks}) == 9 and len(tasks) == 150 * 3 and max(r["count"] for r in tasks) == 5  # 3 blocks and 3 parts
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 150)
    assert sorted(tuple(r) for r in retrieve.cosine_top(index, queries, 5).collect()) == want
    assert given[2].select(F.spark_partition_id().alias("task")).distinct().count() == 3  # more than the session's parallelism


def test_nearest_looks_in_single_precision_and_decides_in_double(monkeypatch):
    """Scores that differ in the sixth digit, rows that are equal, far ids first, steps of any size and rows with unknown numbers."""
    monkeypatch.setattr(retrieve, "EXACT_NUMBERS", 1000)
    rng = np.random.default_rng(3)
    q = rng.normal(size=(7, 48))
    x = np.vstack([rng.normal(size=(500, 48)), q[rng.integers(0, 7, 900)] + rng.normal(scale=1e-3, size=(900, 48)), np.repeat(q[:2], 300, axis=0)])
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    q, x = unit(q), unit(x)
    x[rng.integers(0, 500, 30), 5] = np.nan
    ids = rng.permutation(len(x)) + 10**12
    score = np.round(q @ x.T, 6)
    for k in (1, 40, 250, 3000):
        want = [sorted((-s, i) for s, i in zip(row.tolist(), ids.tolist(), strict=True) if s == s)[:k] for row in score]
        for order in (np.argsort(-ids), np.argsort(ids), rng.permutation(len(x))):
            best = retrieve.Best(q, k)
            for part in np.split(order, [3, 90, 700, 701]):
                best.add(ids[part], x[part])
            found = retrieve._results(best, np.arange(7)).to_pylist()
            assert [[(-r["score"], r["id"]) for r in found if r["query_id"] == j] for j in range(7)] == want


def test_grid_is_made_once(spark):
    """Headers and first values of regions come from the cells, fills take one window; results are those from the grid."""
    cells = spark.createDataFrame([(1, 0, 1, "a"), (1, 2, 0, None), (1, 2, 3, "b"), (1, 2, 2, "d"), (2, 0, 0, "c"), (2, 1, 1, "e"), (2, 1, 0, " ")], "sheet long, r int, c int, value string")
    merges = spark.createDataFrame([(2, 0, 0, 1, 0), (1, 0, 1, 2, 1), (1, 1, 0, 3, 0), (1, 3, 2, 4, 3)], "sheet long, r1 int, c1 int, r2 int, c2 int")
    dense, keys = grid.dense(cells, merges, ["sheet"]), ["sheet"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(grid.header_rows(cells, keys)) == rows(grid.header_rows(dense, keys)) == [(1, 2)]
    spread = grid.expanded(dense, merges, keys, cells)
    assert rows(spread) == rows(grid.expanded(dense, merges, keys)) and {(1, 1, 1, "a", False), (1, 2, 0, "", False), (1, 4, 3, "", True), (2, 1, 0, "c", False)} <= set(rows(spread))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    filled = grid.filled(spread, grid.header_rows(cells, keys), keys)
    assert plan(filled).count("Window [") == 1 and plan(filled).count("sequence(0, rows") == 1
    above, want = {}, []
    for sheet, c, r, value, frozen in sorted((s, c, r, v, f) for s, r, c, v, f in rows(spread)):
        above[sheet, c] = value if value or frozen or (sheet, r) == (1, 3) or (sheet, c) not in above else above[sheet, c]
        want.append((sheet, r, c, above[sheet, c]))
    assert rows(filled) == sorted(want)
