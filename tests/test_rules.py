from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sagebase.functions import text as T
from sagebase.operators import analytics, clean, retrieve
from sagebase.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_token_estimates_and_caps(spark):
    for text, want in (("", 0), ("你好", 2), ("你好world你好", 6), ("a" * 100, 25), ("字" * 200, 200)):
        assert one(spark, T.token_estimate(F.lit(text))) == want
    for n, want in ((150, 256), (200, 512), (600, 1024), (3000, 1024)):
        assert one(spark, T.router_cap(F.lit(n))) == want


def test_han_tokens_are_pairs(spark):
    assert one(spark, T.tokens(F.lit("端口Abc 三 x_1"))) == ["端口abc", "三", "x", "1"]
    assert one(spark, T.tokens(F.lit("设备清单"))) == ["设备", "备清", "清单"]
    assert one(spark, T.tokens(F.lit("Plain text, 2"))) == ["plain", "text", "2"]


def test_fragments(spark):
    for text, want in (("https://example.com/download", "A3"), ("abc", "A4"), ("10", "A4"), ("端口 3306", None), ("端口", "A4"), ("", "A1"), ("***", "A2")):
        assert one(spark, clean.fragment_rule(F.lit(text))) == want


def test_headers_need_two_pages(spark):
    rows = [(1, p, 10 * p + i, line) for p in (1, 2, 3) for i, line in enumerate(["Manual", f"body {p} text", f"page {p}"])]
    rows += [(2, 1, 0, "Manual"), (2, 1, 1, "body")]
    kept = clean.strip_headers(spark.createDataFrame(rows, "doc_id long, page_num int, line_no int, line string"))
    assert sorted(r.line for r in kept.where("doc_id = 2").collect()) == ["Manual", "body"]
    assert {r.line for r in kept.where("doc_id = 1").collect()} == set()  # "body <n> text" and "page <n>" are templates too


def test_near_duplicate_keeps_the_first(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away " * 3
    rows = [(1, 0, text), (1, 1, text + "x"), (1, 2, "something else entirely, of another kind"), (2, 0, text)]
    got = clean.near_duplicates(spark.createDataFrame(rows, "doc_id long, seq int, content string"))
    assert [tuple(r) for r in got.collect()] == [(1, 1)]


def test_fusion_of_queries(spark):
    rows = [(1, 0, 1, "CHUNK", 0.9), (1, 1, 2, "CHUNK", 0.8), (1, 2, 3, "BUSINESS", 0.7), (1, 3, 4, "QA", 0.6), (1, 4, 2, "CHUNK", 0.8), (1, 5, 5, "CHUNK", 0.5), (1, 6, 4, "QA", 0.6)]
    df = spark.createDataFrame(rows, "question int, pos int, chunk_id int, source_type string, score double")
    got = retrieve.fuse_queries(df, ["question"]).orderBy("position").collect()
    assert [(r.evidence.split(":")[1], r.score) for r in got] == [("2", 1.6), ("4", 1.2), ("1", 0.9), ("3", 0.7), ("5", 0.5)]


def test_rates(spark):
    df = spark.createDataFrame([(1, 1, 3, 0, 0)], "kb_id int, up int, down int, no_evidence int, scored int")
    assert tuple(analytics.feedback_rates(df).first()) == (1, 0.75, 0.0)


def test_vector_stats(spark):
    rows = [(1, s, c) for s, c, n in (("INDEXED", None, 6), ("EMBEDDING", None, 1), ("FAILED", None, 1), ("INDEXED", "SUSPECT", 3), ("FILTERED", None, 2)) for _ in range(n)]
    r = analytics.vector_stats(spark.createDataFrame(rows, "doc_id int, status string, clean_status string")).first()
    assert (r.indexed, r.pending, r.failed, r.suspect, r.total) == (6, 1, 1, 3, 8)


def test_window_opens_with_the_first_request():
    ts = pd.to_datetime([f"2024-01-01 00:00:{s:02d}" for s in range(32)] + ["2024-01-01 00:01:00"])
    out = windows.first_open(pd.DataFrame({"ts": ts}))
    assert list(out["allowed"]) == [True] * 30 + [False] * 2 + [True]


def test_lock_after_failures():
    ts = pd.to_datetime([f"2024-01-01 00:0{m}:00" for m in range(7)] + ["2024-01-01 00:25:00"])
    out = windows.locked(pd.DataFrame({"ts": ts, "failed": [True] * 7 + [False]}))
    assert list(out["refused"]) == [False] * 5 + [True] * 2 + [False]


@pytest.mark.parametrize(("kind", "key", "answer", "value"), [(windows.RATE, ["user_id"], "allowed", None), (windows.DUPLICATE, ["user_id", "digest"], "duplicate", None), (windows.LOCK, ["user_id"], "refused", "failed")])
def test_stream_equals_batch(spark, tmp_path, kind, key, answer, value):
    rows = [(u, i * 10 + u, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i), f"d{i % 3}", i % 9 > 0) for i in range(60) for u in (1, 2)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["user_id", "event_id", "ts", "digest", "failed"]))
    for k in range(2):  # two micro-batches
        df.where(f"event_id % 600 {'<' if k == 0 else '>='} 300").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.stream_folded(spark.readStream.option("maxFilesPerTrigger", 1).schema(df.schema).parquet(str(tmp_path / "in")), key, kind, answer, value)
    name = f"got_{answer}"
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {r.event_id: r[answer] for r in spark.table(name).collect()}
    want = {r.event_id: r[answer] for r in windows.folded(df, key, kind, answer, value).collect()}
    assert got == want and len(set(want.values())) == 2


def test_duplicates_by_hand(spark):
    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    rows = [(1, 1, at(0), "a"), (1, 2, at(4), "a"), (1, 3, at(5), "a"), (1, 4, at(6), "b"), (2, 5, at(6), "a"), (1, 6, at(9.5), "a")]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["user_id", "event_id", "ts", "digest"]))
    got = {r.event_id for r in windows.folded(df, ["user_id", "digest"], windows.DUPLICATE, "duplicate").where("duplicate").collect()}
    assert got == {2, 6}


def test_code_fences_of_whole_texts(spark, tmp_path):
    from sagebase.plans import text

    rows = [(k, "\n".join(f"line {j} of {k}" for j in range(n))) for k, n in enumerate((1, 30, 400))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.title): r.content for r in text.code_fences(spark, str(tmp_path)).collect()}
    assert got == {k: v for i, t in rows for k, v in {(i, "prose"): "intro", (i, "code"): f"```py\n{t}\n```"}.items()} | {(i, "prose"): "end" for i, _ in rows}


def test_permissions_move_arrays_of_users_not_pairs(spark, monkeypatch):
    """200 bases and 3,000 users give 600,000 rows, which arise after the last join; the counts are those of the rows, also where a user is there twice or has no name."""
    from sagebase.operators import access as P

    monkeypatch.setattr(P, "BLOCK_USERS", 50)  # several arrays of a kind, several deals of bases
    monkeypatch.setattr(P, "BLOCK_BASES", 30)
    kbs = spark.range(200).selectExpr("id as kb_id", "0 as workspace_id", "id * 3 as created_by", "if(id % 2 = 0, 'RESTRICTED', 'PUBLIC') as visibility")
    members = spark.range(3000).selectExpr("if(id = 2999, null, id) as user_id", "0 as workspace_id", "case when id % 50 = 0 then 'OWNER' when id % 3 = 0 then 'EDITOR' when id % 7 = 1 then null else 'MEMBER' end as role")
    members = members.unionByName(members.where("user_id in (1, 6)"))
    grants = spark.range(4000).selectExpr("id * 7 % 200 as kb_id", "if(id % 2 = 0, 'GROUP', 'USER') as grantee_type", "if(id % 2 = 0, id % 5, id % 2900) as grantee_id", "if(id % 3 = 0, 'EDIT', 'VIEW') as permission")
    groups = spark.range(4).selectExpr("id as group_id", "cast(id div 3 as int) as workspace_id")
    own = spark.range(3000).selectExpr("id % 5 as group_id", "id as user_id").unionByName(spark.range(0, 3000, 4).selectExpr("(id + 1) % 5 as group_id", "id as user_id"))
    got = P.permissions(kbs, members, grants, groups, own)
    pairs = kbs.join(members, "workspace_id")
    level = "max(if(permission = 'EDIT', 2, 1)) as r"
    u = grants.where("grantee_type = 'USER'").groupBy("kb_id", F.col("grantee_id").alias("user_id")).agg(F.expr(level))
    g = grants.where("grantee_type = 'GROUP'").join(groups, F.col("grantee_id") == F.col("group_id")).join(own, "group_id").groupBy("kb_id", "workspace_id", "user_id").agg(F.expr(level).alias("g"))
    want = pairs.join(u, ["kb_id", "user_id"], "left").join(g, ["kb_id", "workspace_id", "user_id"], "left").selectExpr(
        "kb_id", "user_id", "case when role in ('OWNER', 'ADMIN') or created_by = user_id then 'EDIT' when visibility <> 'RESTRICTED' then if(role = 'EDITOR', 'EDIT', 'VIEW') when greatest(r, g) = 2 then 'EDIT' when greatest(r, g) = 1 then 'VIEW' end as permission")
    assert got.count() == 200 * 3002 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert P.group_grants(grants, groups, own).exceptAll(g.selectExpr("kb_id", "workspace_id", "user_id", "g as rank")).isEmpty()
    assert P.group_grants(grants, groups, own).count() == g.count()
    seen = want.where("permission is not null").groupBy("user_id").agg(F.expr("count(*) as n"), F.expr("sum(if(permission = 'EDIT', 1, 0)) as editable"))
    counts = P.permission_counts(kbs, members, grants, groups, own, by="user_id")
    assert counts.exceptAll(seen).isEmpty() and counts.count() == seen.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Join")  # pairs arise above all joins
    by_base = P.permission_counts(kbs, members, grants, groups, own, by="kb_id")
    assert by_base.agg(F.sum("n")).first()[0] == 200 * 3002
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(users" not in plan  # counts make no pairs


def test_files_of_permissions_are_small(spark, tmp_path):
    """Rows leave by runs of users, base by base: a file's rows take a fraction of what whole arrays for each base take."""
    from sagebase.operators import access as P

    groups = spark.createDataFrame([(0, 0)], "group_id long, workspace_id long")
    own = spark.range(4000).selectExpr("cast(0 as long) as group_id", "id * 37 % 100003 as user_id")
    grants = spark.range(300).selectExpr("id as kb_id", "'GROUP' as grantee_type", "cast(0 as long) as grantee_id", "'VIEW' as permission")
    P.group_grants(grants, groups, own).coalesce(1).write.parquet(str(tmp_path / "out"))
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1_200_000 and size < 0.2 * 1_200_000


def test_judged_texts_move_by_document(spark):
    """Marks move to the chunks, not texts to the marks: what is judged lies together by document, so numbering it moves nothing more."""
    from sagebase.operators import clean

    rows = [(d, k, f"chunk {'abc'[k % 3 if d else 0]} of words that are long enough " * 4) for d in range(6) for k in range(9)] + [(7, 0, None), (7, 1, "x"), (7, None, "no place"), (None, 1, "no document")]
    chunks = spark.createDataFrame(rows, "doc_id long, seq int, content string")
    judged = clean.judged(chunks)
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert joins(clean.numbered(judged)) == joins(judged)
    got = {(r.doc_id, r.seq): r.rule for r in judged.collect()}
    assert len(got) == len(rows) and judged.columns == ["doc_id", "seq", "content", "rule", "disposition"]
    late = {(r.doc_id, r.seq): c for c, f in (("C3", clean.long_line_duplicates), ("C2", clean.near_duplicates), ("C1", clean.templates)) for r in f(chunks).collect()}
    assert set(late.values()) == {"C1", "C2"} and all(got[k] == c for k, c in late.items()) and got[7, 0] == "A1" and got[7, 1] == "A4" and got[None, 1] is None
