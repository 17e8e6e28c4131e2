"""The kept index: the same scores as from the documents, after any writes; old files stay, only wanted buckets are read, stale writers fail."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sagebase.operators import postings
from sagebase.operators import retrieve as R

WORDS = [f"w{k}" for k in range(40)]


def text(rng):
    return " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(40)], k=rng.randint(0, 60)))


def files(path):
    return {os.path.join(d, f): hashlib.md5(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, names in os.walk(path) for f in names if not f.startswith(".")}


def frame(spark, docs):
    return spark.createDataFrame([(k, *v) for k, v in docs.items()] or [], "doc_id long, body string, title string")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_same_scores_after_any_writes(spark, tmp_path):
    rng = random.Random(7)
    index = postings.Index(spark, str(tmp_path / "index"), ["body", "title"], buckets=8)
    queries = spark.createDataFrame([(q, w) for q in range(12) for w in rng.sample([*WORDS, "absent"], rng.randint(1, 8))], "query_id int, term string")
    held = {}

    def check():
        want = R.bm25_fields(frame(spark, held), queries, ["body", "title"])
        assert rows(index.bm25(queries), "query_id", "doc_id", "field", "score") == rows(want, "query_id", "doc_id", "field", "score")
        for k in (1, 5):
            best = R.top(want.where("field = 'body'").drop("field"), ["query_id"], k)
            assert rows(index.top(queries, "body", k), "query_id", "doc_id", "score", "rank") == rows(best, "query_id", "doc_id", "score", "rank")

    assert index.bm25(queries).count() == 0
    before = {}
    for step in range(4):
        new = {rng.randrange(150): (rng.choice([text(rng), None]) if rng.random() < 0.1 else text(rng), rng.choice(["w1 w2", "", None, "w3"])) for _ in range(80)}
        index.upsert(frame(spark, new).withColumn("len", F.lit("extra")))
        held |= new
        if step % 2:
            gone = rng.sample(range(200), 30)
            index.delete(spark.createDataFrame([(k,) for k in [*gone, None]], "doc_id long"))
            held = {k: v for k, v in held.items() if k not in gone}
        after = files(index.path)
        assert before.items() <= after.items()  # nothing that was written has changed
        before = after
        if step in (0, 3):
            check()
    index.compact()
    assert len(index.manifest()["segments"]) == 1 and before.items() <= files(index.path).items()
    check()
    index.vacuum()
    assert len(os.listdir(tmp_path / "index" / "postings")) == 1
    check()


def test_frequent_terms_are_skipped_exactly(spark, tmp_path):
    """Documents that have only a very frequent term aren't looked through; the best ones don't change."""
    docs = {k: (f"common common {'rare' if k % 97 == 0 else 'x'} filler{k % 5}", "") for k in range(600)}
    index = postings.Index(spark, str(tmp_path / "index"), ["body", "title"])
    index.upsert(frame(spark, docs))
    queries = spark.createDataFrame([(1, "common"), (1, "rare"), (2, "common")], "query_id int, term string")
    want = R.top(R.bm25(frame(spark, docs), queries, "body"), ["query_id"], 5)
    assert rows(index.top(queries, "body", 5), "query_id", "doc_id", "score", "rank") == rows(want, "query_id", "doc_id", "score", "rank")
    _, bounds = index.hits(queries.select("term").distinct())
    strongest = {r.term: r.bound for r in bounds.where("field = 'body'").collect()}
    assert strongest["common"] < strongest["rare"]


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    index = postings.Index(spark, str(tmp_path / "index"), ["body"], buckets=16)
    index.upsert(spark.createDataFrame([(k, " ".join(WORDS)) for k in range(20)], "doc_id long, body string"))
    weights, _ = index.hits(spark.createDataFrame([("w3",)], "term string"))
    plan = weights._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket#" in plan or "PartitionFilters: [isnotnull(bucket#" in plan
    assert {r.term for r in weights.collect()} == {"w3"}


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    index = postings.Index(spark, str(tmp_path / "index"), ["body"])
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (None, "a")], "doc_id long, body string")
    index.upsert(docs)
    stale = index.manifest()
    index.upsert(spark.createDataFrame([(2, "a")], "doc_id long, body string"))
    monkeypatch.setattr(index, "manifest", lambda: stale)
    with pytest.raises(Exception, match="exist"):
        index.upsert(spark.createDataFrame([(3, "a c")], "doc_id long, body string"))
    monkeypatch.undo()
    queries = spark.createDataFrame([(1, "a"), (1, "c")], "query_id int, term string")
    assert {r.doc_id for r in index.bm25(queries).collect()} == {1, 2}
    assert index.manifest()["version"] == 2


def test_documents_are_dealt_by_their_tokens(spark, tmp_path, monkeypatch):
    """However many partitions a shuffle has, a task's share of documents stays the same; scores too."""
    docs = {k: (" ".join(WORDS[: 1 + k % 40]), "w1") for k in range(400)}
    queries = spark.createDataFrame([(q, w) for q in range(6) for w in WORDS[q : q + 9]], "query_id int, term string")
    index = postings.Index(spark, str(tmp_path / "index"), ["body", "title"], buckets=4)
    index.upsert(frame(spark, docs))
    want = [rows(f(), "query_id", "doc_id", "score") for f in (lambda: R.bm25_fields(frame(spark, docs), queries, ["body"]), lambda: index.bm25(queries).where("field = 'body'"), lambda: index.top(queries, "body", 7))]
    monkeypatch.setattr(R, "TOKENS_A_TASK", 500)
    monkeypatch.setattr(postings, "CHARS_A_TASK", 1500)
    index.upsert(frame(spark, docs))
    fresh = R.bm25_fields(frame(spark, docs), queries, ["body"])
    kept = index.bm25(queries).where("field = 'body'")
    for found in (fresh, kept):
        parts = [len({r.doc_id for r in p}) for p in found.rdd.glom().collect()]
        assert len(parts) >= 16 and max(parts) < 70, parts
    assert [rows(f, "query_id", "doc_id", "score") for f in (fresh, kept, index.top(queries, "body", 7))] == want
    written = [f for d, _, names in os.walk(tmp_path / "index" / "postings") if "segment=2" in d for f in names if f.endswith(".parquet")]
    assert len(written) > 10
    index.compact()
    assert rows(index.top(queries, "body", 7), "query_id", "doc_id", "score") == want[2]
