"""Operators that learn from the corpus: held-out accuracy and planted cases; and the pipeline."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sagebase.llm import decontaminate, toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    return rng, [" ".join(rng.choice(words) for _ in range(rng.randint(20, 200))) for _ in range(n)]


def test_toxic_documents_are_found(spark):
    rng, texts = corpus(500)
    toxic = set(rng.sample(range(500), 120))
    rows = []
    for k, t in enumerate(texts):
        w = t.split()
        for _ in range(rng.randint(2, 6) if k in toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilezz", "Awfulq!", "nastyro" + rng.choice("abc")]))
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "vilezz")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in toxic), 1) for k in range(500)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    got = toxicity.toxic_segments(docs, model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(got) == 503 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert sum(r.predicted == (r.doc_id in toxic) for r in held) >= 0.97 * len(held)
    assert not any(r.predicted for r in got if r.doc_id in (900, 901))
    assert all(r.passages for r in held if r.predicted)
    assert toxicity.toxic_segments(docs.limit(0), model).count() == 0
    assert not any(r.predicted for r in toxicity.toxic_segments(docs, toxicity.fit(docs, labels.limit(0))).collect())


def test_repeated_ids_spoil_no_model(spark):
    """50 toxic documents stand eight times each; the clean ones stay clean, and both count by rows."""
    rng, texts = corpus(200, 6)
    rows = []
    for k, t in enumerate(texts):
        w = t.split()
        for _ in range(4 if k < 50 else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilezz", "awfulq", "nastyro"]))
        rows += [(k, " ".join(w))] * (8 if k < 50 else 1)
    rows += [(60, " ".join(rng.choice(texts).split()[::-1])) for _ in range(300)]  # many texts of one clean id
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, toxic string, key int")
    labels = spark.createDataFrame([(k, int(k < 50), 0) for k in range(200)] + [(5, 0, 0), (70, 0, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.toxic_segments(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    assert not any(r.predicted for r in got if r.doc_id >= 50) and sum(r.predicted for r in got if r.doc_id < 50) >= 0.97 * 400
    assert toxicity.keep_clean(docs, toxicity.fit(docs, labels)).count() <= len(rows) - 0.97 * 400


def test_very_long_texts_are_scanned_whole(spark):
    rng, texts = corpus(300, 7)
    rows = [(k, f"{t} vilezz {t} vilezz" if k % 5 == 0 else t) for k, t in enumerate(texts)]
    rows += [(1000, " ".join(texts[:300])), (1001, " ".join([*texts[:300], "vilezz vilezz vilezz vilezz", *texts[:10]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic_segments(docs, toxicity.fit(docs, labels)).collect()}
    assert not got[1000].passages and any(s.first > 30_000 for s in got[1001].passages)


def test_maximal_segments_by_brute_force():
    """A maximal segment: every proper prefix and suffix has a positive sum, and no larger stretch has that too."""
    import numpy as np

    rng = random.Random(9)
    for _ in range(300):
        n, drift = rng.randint(1, 24), rng.choice([-1.0, -0.5, -2.0])
        values = [rng.choice([1.0, 2.0, 3.5]) if rng.random() < 0.4 else drift for _ in range(n)]
        good = set()
        for a in range(n):
            for z in range(a, n):
                part = values[a : z + 1]
                if all(sum(part[: k + 1]) > 0 and sum(part[len(part) - 1 - k :]) > 0 for k in range(len(part))):
                    good.add((a, z))
        want = {(a, z) for a, z in good if not any((x, y) != (a, z) and x <= a and z <= y for x, y in good)}
        at = np.flatnonzero(np.array(values) > 0)
        found = toxicity.maximal_segments(at, np.array(values)[at], drift)
        assert {(a, z) for a, z, _ in found} == want, values
        assert all(abs(s - sum(values[a : z + 1])) < 1e-9 for a, z, s in found)


def test_maximal_segments():
    # 5, -3 (three words), 4, then far away 2: the first two join, the last stays alone.
    import numpy as np

    assert [(a, z) for a, z, _ in toxicity.maximal_segments(np.array([0, 4, 100]), np.array([5.0, 4.0, 2.0]), -1.0)] == [(0, 4), (100, 100)]


def test_leaks(spark):
    rng, texts = corpus(300, 2)
    _, items = corpus(20, 3)
    items = [" ".join(t.split()[:40]) for t in items]
    docs, want = [], set()
    for k, t in enumerate(texts):
        w = t.split()
        if k % 10 == 0:
            item = items[k // 10 % 20].split()
            if k % 20 == 0:  # a paraphrase: some words changed, some left out
                item = [rng.choice(w) if rng.random() < 0.1 else x for x in item if rng.random() > 0.05]
            at = rng.randrange(len(w))
            w[at:at] = item
            want.add((k, k // 10 % 20))
        docs.append((k, " ".join(w)))
    docs += [(1000, None), (1001, ""), (None, items[0])]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "two words")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert got == want | {(None, 0)}
    assert decontaminate.leaks(df.limit(0), bench).count() == 0
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_short_items_verbatim(spark):
    """Items of 1 to 7 words, planted as they are into texts of 20 to 200 words: all are found, and nothing else is."""
    rng, texts = corpus(300, 8)
    items = [" ".join(f"q{rng.randrange(60)}z" for _ in range(n)) for n in range(1, 8) for _ in range(6)]
    items[-1] += " 42 -"
    rows, plain = [], [t.lower().split() for t in items]
    plain[-1] = plain[-1][:-2]
    for k, t in enumerate(texts):
        w = t.split()
        if k % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in items[k // 3 % len(items)].split()]
        rows.append((k, " ".join(w)))
    rows += [(400, " ".join([*texts[0].split() * 300, items[20]])), (400, items[20]), (None, items[21])]
    bench = spark.createDataFrame([(k, t, 3) for k, t in enumerate(items)] + [(None, items[20], 3)], "item_id long, text string, doc_id int")
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, codes int, item_id int")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()), key=str)
    want = []
    for i, t in rows:
        words = [x for w in t.split() if (x := decontaminate.normal(w))]
        want += [(i, None if j == len(items) else j) for j, p in enumerate([*plain, plain[20]]) if any(words[k : k + len(p)] == p for k in range(len(words)))]
    assert got == sorted(want, key=str)


def test_recall_of_the_latent_search(spark):
    """Against the exhaustive search (every passage with every item): paraphrases with a third of the words changed or left out."""
    rng, texts = corpus(400, 9)
    _, items = corpus(30, 10)
    items = [" ".join(t.split()[: rng.randint(8, 60)]) for t in items]
    rows = []
    for k, t in enumerate(texts):
        w = t.split()
        if k % 2 == 0:
            item = [x for x in items[k // 2 % 30].split() if rng.random() > 0.15]
            item = [rng.choice(w) if rng.random() < 0.15 else x for x in item]
            at = rng.randrange(len(w))
            w[at:at] = item
        rows.append((k, " ".join(w)))
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got, all_ = ({(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench, cosine=c).collect()} for c in (decontaminate.COSINE, -1.0))
    assert got <= all_ and len(all_) > 100 and len(got) >= 0.95 * len(all_)


def test_leaks_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_A_ROUND", 2)
    _, texts = corpus(60, 4)
    bench = spark.createDataFrame([(k, " ".join(texts[k].split()[:30])) for k in range(5)], "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == {(k, k) for k in range(5)}


def test_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0] * (len(b) + 1), row
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1]

    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randint(1, 6) for _ in range(rng.randint(1, 80))], [rng.randint(0, 6) for _ in range(rng.randint(0, 80))]
        assert decontaminate.common_length(decontaminate.masks_of(np.array(a)), len(a), b) == slow(a, [x or -1 for x in b])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not __import__("os").path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n = docs.count()
        assert 0 < n and (n <= before or name in ("source_mix", "token_shards")), name
        before = n
