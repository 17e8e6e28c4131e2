"""Kept tables and jobs: keyed merges, ingest as a stream, extraction that goes on, rules of tables, JDBC, collations."""

from __future__ import annotations

import hashlib
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sagebase.operators import constraints as N
from sagebase.operators import knowledge as K
from sagebase.operators.extraction import Job
from sagebase.operators.keyed import KeyedTable
from sagebase.sources import jdbc
from sagebase.streaming.ingest import Ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module
SCHEMA = "kb long, name string, value string, n int"


def files(path):
    return {os.path.join(d, f): hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(t):
    return sorted(map(tuple, t.read().collect()), key=repr)


def test_a_merge_rewrites_its_buckets_only(spark, tmp_path):
    rng = random.Random(1)
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["kb", "name"], buckets=8)
    assert held(t) == []
    want = {}
    for step in range(4):
        rows = [(rng.choice([1, 2, None]), rng.choice([f"k{rng.randrange(40)}", None]), f"v{rng.randrange(1000)}", step) for _ in range(60 if not step else 3)]
        keyed = {}
        for r in rows:
            keyed[r[:2]] = max(keyed.get(r[:2], ()), r[2:])
        before = files(t.path)
        old = t.manifest()["buckets"]
        t.upsert(table(spark, rows).withColumn("extra", F.lit(1)))
        want |= keyed
        assert held(t) == sorted(((*k, *v) for k, v in want.items()), key=repr)
        assert before.items() <= files(t.path).items()
        if step:  # a few keys touch a few buckets; the others are still the files of old versions
            now = t.manifest()["buckets"]
            assert 0 < sum(now[b] != v for b, v in old.items()) <= 3
    first = t.manifest(1)
    assert t.read(1).count() == len({r for r in map(tuple, t.rows(first["buckets"]).select("kb", "name").collect())})
    gone = [k for k in want][:5]
    t.delete(spark.createDataFrame([(*k, 1) for k in [*gone, (99, "absent")]], "kb long, name string, x int"))
    for k in gone:
        want.pop(k)
    assert held(t) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    t.vacuum()
    assert held(t) == sorted(((*k, *v) for k, v in want.items()), key=repr) and t.versions() == [5]
    assert len(files(t.path)) < len(before)


def test_order_names_and_stale_writers(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["kb"], buckets=4)
    rows = [(1, "a", "old", 1), (1, "a", "new", 2), (2, "b", "x", 1)]
    assert t.upsert(table(spark, rows), order=[-F.col("n")], write_id="one")
    assert not t.upsert(table(spark, [(1, "a", "again", 9)]), write_id="one")
    assert held(t) == [(1, "a", "new", 2), (2, "b", "x", 1)]
    stale = t.manifest()
    t.upsert(table(spark, [(3, "c", "y", 1)]))
    monkeypatch.setattr(t, "manifest", lambda version=None: stale)
    with pytest.raises(Exception, match="exist"):
        t.upsert(table(spark, [(4, "d", "z", 1)]))
    monkeypatch.undo()
    assert {r[0] for r in held(t)} == {1, 2, 3}
    with pytest.raises(ValueError):
        t.read(17)
    t.upsert(table(spark, []))
    assert t.versions() == [1, 2]


def test_streamed_ingest_equals_the_batch(spark, tmp_path):
    """Files arrive in three batches, late ones among them; a batch that Spark repeats counts once, and so does one that broke between its two tables."""
    docs = {k: [f"text {k} " * (40 * (k % 4)), f"newer {k} " * (10 * (k % 3))] for k in range(30)}
    batches = [[(k, v[1], 2) for k, v in docs.items() if k % 3 == 0], [(k, v[0], 1) for k, v in docs.items()], [(k, v[1], 2) for k, v in docs.items() if k % 3] + [(77, None, 1), (None, "x", 1)]]
    schema = "doc_id long, text string, arrived long"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    live = Ingest(spark, str(tmp_path / "live"), width=100, buckets=4)
    query = live.stream(source, str(tmp_path / "cp"))
    assert query.awaitTermination(240) and query.exception() is None
    want = sorted((k, a // 100, t[a : a + 100]) for k, v in docs.items() for t in [v[1]] for a in range(0, len(t), 100))
    assert sorted(map(tuple, live.current().collect())) == want
    versions = live.chunks.versions(), live.documents.versions()
    query = live.stream(source, str(tmp_path / "cp"))  # nothing new
    assert query.awaitTermination(240)
    live.add(spark.createDataFrame(batches[1], schema), "ingest-1")  # repeated under its number
    live.add(spark.createDataFrame(batches[2], schema), "other")  # and under another: nothing newer in it
    assert sorted(map(tuple, live.current().collect())) == want
    assert live.documents.versions() == versions[1]
    batch = Ingest(spark, str(tmp_path / "batch"), width=100, buckets=4)
    batch.chunks.upsert(spark.createDataFrame([(0, 0, "left behind by a broken write", 9)], "doc_id long, seq int, content string, arrived long"))
    for rows in batches:
        batch.add(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, batch.current().where("doc_id > 0").collect())) == [w for w in want if w[0] > 0]


def test_an_extraction_job_goes_on(spark, tmp_path):
    marks = tmp_path / "calls"
    marks.mkdir()

    def make(name, dies=False):
        def call(text):
            with open(marks / f"{name}-{text.replace(' ', '_')}", "a") as f:
                f.write("x")
            if dies and text == "doc 5 chunk 0":
                os._exit(1)  # the worker is gone, and with it the job
            if "bad" in text:
                raise RuntimeError("no answer " + "!" * 300)
            return "unreadable" if "odd" in text else f'x [{{"question": "{name} {text}", "answer": "a"}}, {{"question": " ", "answer": "b"}}]'

        return call

    docs = spark.createDataFrame([(k,) for k in range(12)] + [(3,), (None,)], "doc_id long")
    state = spark.createDataFrame([(k, "FAILED" if k == 4 else "SUCCESS") for k in range(11)], "doc_id long, parse_status string")
    texts = {k: [f"doc {k} chunk {s}" + (" bad" if k == 2 and s == 1 else " odd" if k == 6 else "") for s in range(3)] for k in range(12) if k != 7}
    chunks = spark.createDataFrame([(k, s, t) for k, v in texts.items() for s, t in enumerate(v)], "doc_id long, seq int, content string")
    kept = spark.createDataFrame([(8,)], "doc_id long")
    job = lambda dies: Job(str(tmp_path / "job"), 5, docs, state, chunks, {"BUSINESS": make("b", dies), "QA": make("q")}, waves=6, held=kept)
    with pytest.raises(Exception):  # noqa: B017
        job(True).run()
    some = job(False)
    done = some.written()
    assert 0 < len(done) < 6
    before = some.summary().first()
    assert before.status == "RUNNING" and 0 < before.progress < 100
    waves = {r.doc_id: r.wave for r in some.plan.collect()}
    size = lambda: {f: os.path.getsize(marks / f) for f in os.listdir(marks)}
    asked = size()
    some.run()
    after = size()
    assert all(after[f] == n for f, n in asked.items() if waves[int(f.split("_")[1])] in done)
    log = {r.doc_id: (r.ok, r.error, r.BUSINESS, r.QA) for r in some.log().collect()}
    assert log[0] == (True, None, 3, 3) and log[7] == (True, None, 0, 0) and log[6] == (True, None, 0, 0)
    assert log[2] == (False, ("no answer " + "!" * 300)[:200], 0, 0)
    assert log[4][:2] == (False, "文档未完成解析（parse_status=FAILED）") and log[8][:2] == (False, "正在被其他抽取任务处理") and log[11][:2] == (False, "文档不存在")
    items = {(r.doc_id, r.kind, r.seq) for r in some.items().collect()}
    assert {i for i in items if i[0] == 2} == {(2, "BUSINESS", 0), (2, "QA", 0)} and {i for i in items if i[0] in (4, 8, 11)} == set()
    end = some.summary().first()
    assert (end.total, end.processed, end.progress, end.status, end.BUSINESS) == (12, 12, 100, "PARTIAL_FAILED", sum(v[2] for v in log.values()))
    some.run()
    assert size() == after


def test_ingest_joins_texts_once(spark, tmp_path, monkeypatch):
    held, given = Ingest(spark, str(tmp_path / "in"), width=10, buckets=2), {}
    held.add(spark.createDataFrame([(1, "a" * 25, 1)], "doc_id long, text string, arrived long"))
    for table in ("chunks", "documents"):
        monkeypatch.setattr(getattr(held, table), "upsert", lambda rows, write_id=None, table=table: given.update({table: rows}))
    held.add(spark.createDataFrame([(1, "b" * 20, 2), (2, None, 1), (3, "c" * 21, 1)], "doc_id long, text string, arrived long"))
    assert all(df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1 for df in given.values())  # with what is known
    assert sorted(map(tuple, given["documents"].collect())) == [(1, 2, 2), (2, 0, 1), (3, 3, 1)]
    assert sorted(map(tuple, given["chunks"].collect())) == [(1, 0, "b" * 10, 2), (1, 1, "b" * 10, 2), (3, 0, "c" * 10, 1), (3, 1, "c" * 10, 1), (3, 2, "c", 1)]


def test_rules_by_brute_force(spark):
    rng = random.Random(4)
    value = lambda: rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9])
    a = [(value(), rng.choice([value(), 11]), rng.choice(["x", 'q"', "y\\", None])) for _ in range(60)]
    b = [(value(), rng.choice([value(), 20])) for _ in range(8)]
    tables = {"a": spark.createDataFrame(a, "i long, j int, s string"), "b": spark.createDataFrame(b, "k int, l long")}
    rules = [N.Unique("a", ("i",)), N.Unique("a", ("i", "j")), N.Unique("a", ("j", "i")), N.Unique("a", ("s", "i", "j")), N.Reference("a", ("i",), "b", ("k",)), N.Reference("a", ("i", "j"), "b", ("k", "l")), N.Reference("b", ("l",), "a", ("j",)), N.Reference("a", ("j",), "a", ("i",))]
    import json

    want = set()
    at = {"a": ["i", "j", "s"], "b": ["k", "l"]}
    data = {"a": a, "b": b}
    for rule in rules:
        pick = lambda t, cols: [tuple(str(r[at[t].index(c)]) for c in cols) for r in data[t] if all(r[at[t].index(c)] is not None for c in cols)]
        own = pick(rule.table, rule.columns)
        there = set(pick(rule.target, rule.target_columns)) if isinstance(rule, N.Reference) else None
        for key in set(own):
            if own.count(key) > 1 if there is None else key not in there:
                want.add((rule.name, json.dumps(list(key), separators=(",", ":")), own.count(key)))
    got = [tuple(r) for r in N.violations(tables, rules).collect()]
    assert set(got) == want and len(got) == len(want) and len({w[0] for w in want}) == len(rules)
    assert N.violations({k: v.limit(0) for k, v in tables.items()}, rules).count() == 0


def test_one_scan_for_all_rules_of_a_table(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 7 as x", "id % 3 as y").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    found = N.violations({"t": t}, [N.Unique("t", ("id",)), N.Unique("t", ("x",)), N.Unique("t", ("x", "y")), N.Unique("t", ("y",))])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Expand" in plan
    assert found.count() == 7 + 21 + 3


def test_keys_are_dealt_by_their_number(spark):
    rows = spark.range(4000).selectExpr("id", "id % 2 as hot", "id % 1000 as x")
    rules = [N.Unique("t", ("id",)), N.Unique("t", ("x",)), N.Reference("t", ("hot",), "u", ("k",)), N.Reference("u", ("k",), "t", ("x",))]
    tables = {"t": rows, "u": spark.createDataFrame([(0,), (5000,)], "k long")}
    dealt = N.violations(tables, rules, size=500)
    parts = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(parts) == 25 and max(parts) < 200  # 12,004 keys, however many partitions a shuffle has
    got = {tuple(r) for r in dealt.collect()}
    name = [r.name for r in rules]
    assert got == {(name[1], f'["{k}"]', 4) for k in range(1000)} | {(name[2], '["1"]', 2000), (name[3], '["5000"]', 1)}
    assert got == {tuple(r) for r in N.violations(tables, rules).collect()}


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:round;create=true"
    with jdbc.connection(spark, url) as c:
        jdbc.execute(c, 'create table things ("id" bigint not null primary key, "name" varchar(40), "n" integer)')
        c.commit()
    rows = lambda pairs: spark.createDataFrame([(k, v, k % 5) for k, v in pairs], "id long, name string, n int")
    assert jdbc.upsert(rows([(k, f"name {k}") for k in range(500)]), url, "things", ["id"], "load-1")
    assert not jdbc.upsert(rows([(1, "twice")]), url, "things", ["id"], "load-1")
    assert jdbc.upsert(rows([(k, "new") for k in range(490, 510)]), url, "things", ["id"], "load-2")
    read = jdbc.read_table(spark, url, "things", '"id"', rows_a_part=100)
    assert read.rdd.getNumPartitions() == 6
    got = {r.id: (r.name, r.n) for r in read.collect()}
    assert got == {k: ("new" if k >= 490 else f"name {k}", k % 5) for k in range(510)}
    some = read.where("n = 3 and id > 100").select("name")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(n), *IsNotNull(id), *EqualTo(n,3), *GreaterThan(id,100)]" in plan and "name" in plan
    assert some.count() == sum(k % 5 == 3 for k in range(101, 510))
    # A write with a repeated key fails as a whole, and can be made again under its name.
    with pytest.raises(Exception, match="things|duplicate|STATEMENT|key"):
        jdbc.upsert(rows([(600, "a"), (601, "b"), (600, "c")]), url, "things", ["id"], "load-3")
    assert jdbc.read_table(spark, url, "things", '"id"').where("id >= 600").count() == 0
    assert jdbc.upsert(rows([(600, "a")]), url, "things", ["id"], "load-3")
    with jdbc.connection(spark, url) as c:
        assert jdbc.values_of(c, "select count(*) from things") == [[511]]
        assert jdbc.values_of(c, "select count(*) from sys.systables where tablename like 'STAGED%'") == [[0]]
    with pytest.raises(ValueError):
        jdbc.upsert(rows([(1, "x")]), url, "things", ["id"], "x'; drop table things")


def test_names_under_a_collation(spark):
    """Case, accents and spaces at the end don't tell names apart; without a collation they do."""
    names = ["Café", "cafe", "CAFÉ ", "Cafe", "kaffee", None, "ÄRGER", "arger"]
    fold = lambda s: None if s is None else s.rstrip().lower().translate(str.maketrans("éä", "ea"))
    rows = [(k, 1, n, "DRAFT", False) for k, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id int, kb_id int, term string, status string, deleted boolean")
    for collation, key in ((K.BLIND, fold), (None, lambda s: s)):
        got = {r.id: r.deleted for r in K.draft_dedup(df, "term", collation).collect()}
        assert got == {k: any(key(names[j]) == key(n) for j in range(k + 1, len(names))) for k, n in enumerate(names)}
    docs = spark.createDataFrame([(1, 1, "Résumé.md"), (2, 1, "resume.MD"), (3, 2, "resume.md"), (4, 1, "other.md")], "id int, kb_id int, file_name string")
    uploads = spark.createDataFrame([(1, "RESUME.md"), (2, "résumé.md"), (1, "none.md")], "kb_id int, file_name string")
    assert {(r.kb_id, r.file_name, r.id) for r in K.replaced_uploads(docs, uploads, K.BLIND).collect()} == {(1, "RESUME.md", 2), (2, "résumé.md", 3)}
    assert {(r.kb_id, r.file_name, r.id) for r in K.replaced_uploads(docs, uploads).collect()} == {(1, "RESUME.md", 2)}
    terms = spark.createDataFrame([(1, 1, "Müller", '["MUELLER", "Mühle"]', False), (2, 1, "muller", "[]", False), (3, 1, "mühle", "[]", True), (4, 2, "x", None, False)], "id int, kb_id int, term string, aliases string, deleted boolean")
    words = spark.createDataFrame([(1, "MULLER"), (1, "muhle"), (1, "mueller"), (2, "X "), (2, "y")], "kb_id int, word string")
    assert {(r.word, r.id) for r in K.term_lookup(terms, words, K.BLIND).collect()} == {("MULLER", 2), ("muhle", 1), ("mueller", 1), ("X ", 4)}
    assert K.term_lookup(terms, words).count() == 0


def test_a_merge_moves_rows_once(spark, tmp_path):
    """Old and new rows meet where they are written: by one exchange, and of equal keys the new row counts, the greatest of several, also under nulls."""
    from sagebase.operators import keyed

    held, plans = keyed.KeyedTable(spark, str(tmp_path / "t"), "id long, part_no int, content string", ["id", "part_no"], 4), []
    replace = held.replace
    held.replace = lambda before, touched, rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), replace(before, touched, rows))
    held.upsert(spark.createDataFrame([(1, 1, "z"), (1, 1, "a"), (2, 1, "old"), (None, 1, "n"), (3, None, "m")], "id long, part_no int, content string"))
    held.upsert(spark.createDataFrame([(2, 1, "new"), (2, 1, "mid"), (None, 1, "a"), (4, 0, None)], "id long, part_no int, content string"))
    want = {(1, 1, "z"), (2, 1, "new"), (None, 1, "a"), (3, None, "m"), (4, 0, None)}
    assert {tuple(r) for r in held.read().collect()} == want and held.read().count() == len(want)
    assert [p.count("Exchange ") for p in plans] == [1, 1]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
