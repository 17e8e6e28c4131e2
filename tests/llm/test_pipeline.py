"""Stages of the corpus pipeline on their own: rows decide, not ids; nulls, repeats, empty tables and clashing columns."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from sagebase.llm import mixing, tokencount, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, row_number int"


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    return rng, [" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))) for _ in range(n)]


@pytest.fixture
def sf(spark, tmp_path):
    """A folder with labels (ids below 40 are toxic) and a benchmark of three items, one short."""
    _, items = corpus(3, 99)
    items[2] = "zebra quagga okapi"
    spark.createDataFrame([(k, int(k < 40), 1) for k in range(200)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), items


def rows_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", f"s{(i or 0) % 3}" if i != 7 else None, 5) for i, t in rows], SCHEMA)


def test_every_stage_takes_nothing(spark, sf):
    for name, stage in P.STAGES:
        docs = frame(spark, [])
        out = stage(spark, docs, sf[0])
        assert out.count() == 0 and (name == "token_shards" or out.columns == docs.columns), name


def test_toxic_rows_go(spark, sf):
    rng, texts = corpus(200, 2)
    rows = []
    for k, t in enumerate(texts):
        w = t.split()
        for _ in range(4 if k < 40 else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vilezz", "awfulq"]))
        rows += [(k, " ".join(w))] * (3 if k % 10 == 0 else 1)
    rows += [(None, None), (None, "vilezz awfulq vilezz awfulq"), (300, ""), (50, "clean text of an id that repeats")]
    docs = frame(spark, rows)
    kept = rows_of(P.toxic_out(spark, docs, sf[0]))
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf[0]}/labels.parquet"))
    scored = toxicity.toxic_segments(docs, model).collect()
    assert sum(kept.values()) == sum(not r.predicted for r in scored)
    assert all(kept[r] == rows.count(r) for r in rows if r[0] is None and r[1] is None or r[0] is not None and r[0] >= 40)
    assert sum(n for (i, _), n in kept.items() if i is not None and i < 40) <= 2 and (None, "vilezz awfulq vilezz awfulq") not in kept


def test_near_duplicates_keep_texts_of_repeated_ids(spark, sf):
    _, texts = corpus(12, 3)
    changed = texts[0].split()
    changed[3] = "other"
    rows = [(5, texts[0]), (2, " ".join(changed)), (9, texts[1]), (9, texts[2]), (9, texts[2]), (None, texts[3]), (None, texts[3]), (4, texts[3].upper()), (None, texts[4]), (None, texts[4]), (6, None), (7, ""), (7, "")]
    assert rows_of(P.near_duplicates_out(spark, frame(spark, rows), sf[0])) == collections.Counter([(2, " ".join(changed)), (9, texts[1]), (9, texts[2]), (4, texts[3].upper()), (None, texts[4]), (6, None), (7, ""), (7, "")])


def test_leaks_go_whatever_their_ids(spark, sf):
    _, texts = corpus(60, 4)
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(3, f"{texts[7]} {sf[1][0]} {texts[8]}"), (None, sf[1][1]), (None, texts[9]), (None, f"a {sf[1][2]} b"), (70, None), (71, "")]
    gone = [rows[60], rows[61], rows[63]]
    assert rows_of(P.benchmark_out(spark, frame(spark, rows), sf[0])) == collections.Counter(r for r in rows if r not in gone)


def test_the_mix_repeats_rows(spark, sf):
    _, texts = corpus(90, 5)
    rows = [(k % 70, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, None), (3, texts[3])]
    docs = frame(spark, rows)
    wanted = collections.Counter()
    for r in mixing.mix(docs.withColumnRenamed("text", "body"), text_col="body", carry=("body",)).collect():
        wanted[r.doc_id, r.body] += r.copies
    got = rows_of(P.mixed(spark, docs, sf[0]))
    assert got == +wanted and set(wanted.values()) > {0, 1}


def test_shards_hold_every_row(spark, sf):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokencount.public_vocabulary())
    _, texts = corpus(20, 6)
    rows = [(k % 15, t) for k, t in enumerate(texts)] + [(None, None), (2, texts[2])]
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    got = P.token_shards(spark, frame(spark, rows), sf[0]).orderBy("start").collect()
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == collections.Counter((i, crc(t)) for i, t in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
