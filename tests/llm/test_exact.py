"""Operators whose results are exact, held against brute force: nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sagebase.llm import common, embeddings, graph, mixing, pieces, sharding, shingles, sstable, substrings, tokencount, warc
from sagebase.llm.common import Scratch

rows_of = lambda df: sorted((tuple(r) for r in df.collect()), key=str)


class Sets:
    """Union by least element."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)


# ---- shingles ----


def brute_shingles(rows):
    sets, groups = [], Sets()
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)]) if w else frozenset())
    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    for k, s in enumerate(sets):
        if rows[k][0] is None:
            continue
        for j, n in collections.Counter(j for g in s for j in holders[g] if j < k and rows[j][0] is not None).items():
            if 100 * n >= 90 * (len(s) + len(sets[j]) - n):
                groups.join(rows[k][0], rows[j][0])
    return sorted([(i, len(s), groups.find(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)], key=str)


def shingle_rows():
    rng, words, rows = random.Random(5), [f"w{k}" for k in range(400)], []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 8, 11, 12, 13, 16, 20, 24, 30, 60, 120, 400]))]
        for _ in range(rng.choice([1, 2, 5])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(t) + 1)
                if rng.random() < 0.5 and len(t) > 1:
                    t.pop(k - 1)
                else:
                    t.insert(k, rng.choice(words))
            rows.append((len(rows) * 3 % 997, " ".join(t).upper() if rng.random() < 0.3 else "\n".join(t)))
    rows += [(3000 + n, " ".join(f"a{k}" for k in range(n))) for n in (10, 11, 12)]  # 8, 9 and 10 shingles: only the last two link
    return [*rows, (None, "a b c d"), (None, "a b c d"), (2000, "a b c d"), (2001, ""), (2002, None), (2003, "  "), (2004, "A B c  d"), (2004, "A B c  d")]


@pytest.mark.parametrize("small", [False, True])
def test_shingle_components(spark, monkeypatch, small):
    if small:  # large regions: pivots, windows and pairs of blocks
        monkeypatch.setattr(shingles, "SHINGLES_A_TASK", 300)
        monkeypatch.setattr(shingles, "BLOCK_SHINGLES", 300)
        monkeypatch.setattr(shingles, "ROUNDS", 1)
        monkeypatch.setattr(common, "HOT_ROWS", 0)
    rows = shingle_rows()
    df = spark.createDataFrame([(i, t, 9, 1) for i, t in rows], "doc_id long, text string, n int, part int")
    assert rows_of(shingles.near_duplicate_components(df)) == brute_shingles(rows)


def test_shingles_of_nothing(spark):
    assert shingles.near_duplicate_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- substrings ----


def brute_substrings(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if i is not None else ():
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], 1 << 62), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49) if i is not None else ():
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [2 << 20, 64])
def test_repeated_substrings(spark, monkeypatch, piece):
    monkeypatch.setattr(substrings, "PIECE_BYTES", piece)
    rng = random.Random(2)
    bits = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 200))) for _ in range(30)]
    rows = [(rng.randint(-50, 500), "".join(rng.choice(bits)[rng.randint(0, 10) :] for _ in range(rng.randint(0, 6)))) for _ in range(100)]
    rows += [(7, "a" * 5000), (9, "a" * 120), (9, "a" * 49), (9, "a" * 50), (None, "a" * 80), (11, None), (12, ""), (13, "sting " * 300), (14, "sting " * 400), (3, bits[0] + bits[1]), (4, bits[0] + bits[1]), (4, bits[0] + bits[1])]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, part int, triggers int")
    assert rows_of(substrings.cut_repeats(df)) == brute_substrings(rows)


def test_corpus_order_by_brute_force():
    rng = random.Random(21)
    for turn in range(60):
        letters = [b"ab", b"abcdefgh ", b"a", b"\0\1a", bytes(range(256))][turn % 5]
        bits = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(6)]
        texts = [b"".join(rng.choice(bits) for _ in range(rng.randint(1, 5)))[: rng.randint(50, 400)].ljust(50, b"a") for _ in range(rng.randint(1, 25))]
        data = np.frombuffer(b"--".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size + 2) - size - 2
        mixed = rng.sample(range(len(texts)), len(texts))  # in any order
        places, same = substrings.corpus_order(data, start[mixed], size[mixed])
        assert sorted(places.tolist()) == sorted(int(a) + k for a, n in zip(start, size, strict=True) for k in range(n - 49))
        found = [data[p : p + 50].tobytes() for p in places]
        assert found == sorted(found) and [False, *(x == y for x, y in zip(found, found[1:]))] == same.tolist()  # noqa: B905


def test_the_arrays_decide_what_repeats(spark, monkeypatch):
    rng = random.Random(22)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(k, "".join(rng.choice("ijklmnop ") for _ in range(60)) + shared + "".join(rng.choice("ijklmnop ") for _ in range(k))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    right = rows_of(substrings.cut_repeats(df))
    assert right == brute_substrings(rows)
    real = substrings.corpus_order
    monkeypatch.setattr(substrings, "corpus_order", lambda *a: (real(*a)[0], np.zeros(len(real(*a)[1]), bool)))  # no two strings equal
    data = "".join(t for _, t in rows).encode()
    group = pa.table({"doc_id": pa.nulls(1, pa.int64()), "text_key": pa.nulls(1, pa.int64()), "part": pa.array([0], pa.int32()), **dict(zip(("ints", "bytes"), ([x] for x in substrings.packed(np.zeros(12, np.uint32).tobytes() + np.array([[k for k, _ in rows], [0] * 12, [0] * 12, [len(t) - 49 for _, t in rows]]).tobytes(), data)), strict=True))})
    assert substrings.cover(group).num_rows == 0
    monkeypatch.setattr(substrings, "corpus_order", real)
    assert sorted(substrings.cover(group)["doc_id"].to_pylist()) == list(range(1, 12))


def test_substrings_of_nothing(spark):
    assert substrings.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- embeddings ----


def brute_vectors(ids, vectors):
    usable = [i for i, v in enumerate(vectors) if ids[i] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, groups = [0] * len(ids), Sets()
    for a in usable:
        for b in usable:
            if a != b and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    links[a] += 1
                    groups.join(ids[a], ids[b])
    top = [groups.find(i) if k in usable else i for k, i in enumerate(ids)]
    return sorted([(i, n, t, i is not None and t == i) for i, n, t in zip(ids, links, top, strict=True)], key=str)


@pytest.mark.parametrize("block", [4000, 7])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    rows = [(1, [1.0, 0, 0]), (2, [1.0, 0, 0]), (3, [0.0, 0, 0]), (4, None), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [1.0, 0.4, 0.0]), (8, [1.0, 0.9, 0.0]), (9, [1.0, 0.0]), (10, [2.0, 0.1]), (None, [1.0, 0, 0]), (0, [1e-30, 1e-31, 0.0]), (12, [])]
    for g in range(6):
        center = rng.standard_normal(3)
        rows += [(100 + 20 * g + k, [float(x) for x in center + 0.2 * rng.standard_normal(3)]) for k in range(15)]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", 1) for i, v in rows], "vec_id long, embedding array<double>, cell string, id int")
    assert rows_of(embeddings.near_duplicates(df)) == brute_vectors(*zip(*rows, strict=True))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_cells(spark):
    """6,000 vectors without clusters, a third of them with a partner just above or below the threshold: cells against all pairs."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((2000, 24))
    off -= (off * x[:2000]).sum(axis=1, keepdims=True) * x[:2000]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.87, 0.99, 2000)[:, None]
    x = np.concatenate([x, cos * x[:2000] + np.sqrt(1 - cos**2) * off])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in embeddings.near_duplicates(df).orderBy("vec_id").collect()])
    assert embeddings.probes_for(20) == 4 < 20  # 20 cells, most of which a vector doesn't visit
    assert (got <= near.sum(axis=1)).all() and got.sum() >= 0.97 * near.sum() > 2000
    exact = np.array([r.n_links for r in embeddings.near_duplicates(df, probes=0).orderBy("vec_id").collect()])
    assert (exact == near.sum(axis=1)).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    groups = Sets()
    for a, b in links:
        groups.join(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5), Scratch(spark, "t")).collect()}
    assert all(got.get(x, x) == groups.find(x) for x in groups.up)


# ---- tokens ----


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokencount.public_vocabulary())


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    bits = ["a", "b", " ", "  ", "\n", "'", "l", "ll", "'s", "é", " ", "　", "1", "23", "!", "<|endoftext|>", "<|endof", "the", "ing", "日本", "🙂", "\t", "'re", "\x1c", "\x85", "à"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_at_every_prefix():
    count, lib = tokencount.counter(tokencount.public_vocabulary()), library()
    for s in odd_texts(300):
        assert list(count.table(s)) == [len(lib.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)], s


def test_units_encode_like_the_text():
    lib = library()
    texts = odd_texts(300, 4)
    names, codes, bounds = pieces.units(pa.array([*texts, None]))
    for s, a, z in zip([*texts, ""], bounds[:-1], bounds[1:], strict=True):
        parts = names.take(pa.array(codes[a:z])).to_pylist()
        assert "".join(parts) == s
        assert [i for p in parts for i in lib.encode(p, add_special_tokens=False).ids] == lib.encode(s, add_special_tokens=False).ids


def test_pairs_survive_like_merging():
    counter, rng = tokencount.counter(tokencount.public_vocabulary()), random.Random(8)

    def merged(word):
        parts = list(word)
        while True:
            ranks = [(counter.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in counter.rank]  # noqa: B905
            if not ranks:
                return parts
            i = min(ranks)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    tokens = sorted(counter.vocab)
    short = [t for t in tokens if len(t) < 4]
    for k in range(4000):
        a, b = (rng.choice(tokens), rng.choice(tokens)) if k % 2 else (rng.choice(short), rng.choice(short)) if k % 4 else (rng.choice(short),) * 2
        assert counter.apart(a, b, 1 << 60) == (merged(a + b) == [a, b]), (a, b)


def test_encoded_together_like_alone():
    lib, rng = library(), random.Random(12)
    texts = [*odd_texts(200, 5), *(" ".join("".join(rng.choice("abcdé.,1<|>'") for _ in range(rng.randint(1, 12))) for _ in range(60)) for _ in range(40)), "a <|endoftext|> b", "y" * 40_000 + " z", None]
    flat, at = sstable.Encoder(tokencount.public_vocabulary())(pa.array(texts))
    for t, a, z in zip(texts, at[:-1], at[1:], strict=True):
        assert flat[a:z].tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def token_rows():
    rng = random.Random(13)
    plain = [" ".join("".join(rng.choice("abcdefgst.,-12") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(20)]
    texts = [*odd_texts(60), *plain, None, "", "word " * 3000, "x" * 5000, "ab" * 9000 + " c", " " * 300 + "\n" * 300, "<|endoftext|>" * 3]
    return [*enumerate(texts), (None, "a"), (0, texts[0])]


def test_token_counts(spark):
    rows, lib = token_rows(), library()
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_bytes int")
    want = [(k, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t in rows]
    assert rows_of(tokencount.token_counts(tokencount.prefix_tables(df, tokencount.public_vocabulary()))) == sorted(want, key=str)
    assert tokencount.prefix_tables(df.limit(0), tokencount.public_vocabulary()).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 2, 3, 4, 6, 40])
def test_budget(spark, budget):
    lib = library()
    texts = [t or "" for _, t in token_rows() if len(t or "") < 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tables = Scratch(spark, "t").write(tokencount.prefix_tables(df, tokencount.public_vocabulary()), "tables")
    for r in tables.collect():
        if budget == 0:
            want = [len(lib.encode(texts[r.doc_id][:i], add_special_tokens=False).ids) for i in range(len(texts[r.doc_id]) + 1)]
            assert tokencount.counts_of(r.steps, r.n_chars).tolist() == want, texts[r.doc_id]
    for r in tokencount.fit_budget(tables, budget).collect():
        counts = [len(lib.encode(texts[r.doc_id][:i], add_special_tokens=False).ids) for i in range(len(texts[r.doc_id]) + 1)]
        best = max(i for i, n in enumerate(counts) if n <= budget)
        assert (r.n_chars, r.n_tokens) == (best, counts[best])


def test_token_shards(spark):
    lib = library()
    rows = [(k * 7 % 50 - 5, t) for k, t in enumerate([*odd_texts(50, 8), "long text " * 2000])] + [(None, None), (None, "a"), (90, "x y"), (90, "x y"), (91, "")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, task int, start int")
    got = sstable.tokenize_to_shards(df, tokencount.public_vocabulary()).orderBy("start").collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    start = 0
    for r in got:
        at = next(k for k, x in enumerate(ids[r.doc_id]) if (len(x), zlib.crc32(x.tobytes())) == (r.n_tokens, r.ids_crc32))
        ids[r.doc_id].pop(at)
        assert r.start == start
        start += r.n_tokens
    assert not any(ids.values())
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    files = spark.read.format("binaryFile").load(got[0].path).collect()
    shards = [sstable.Shard(f.content) for f in files if f.length > 1]
    assert sum(len(x) for s in shards for x in s.get(90)) == 2 * (1 + len(lib.encode("x y", add_special_tokens=False).ids))
    assert all(s.get(12345) == [] for s in shards)
    assert sstable.tokenize_to_shards(df.limit(0), tokencount.public_vocabulary()).count() == 0


# ---- archives ----


@pytest.mark.parametrize("hot", [1000, 1])
def test_warc(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = [(1, None), (2, ""), (3, "x" * 200_000 + "é\r\n\r\nWARC/1.1\r\n"), (4, "x" * 200_000 + "é\r\n\r\nWARC/1.1\r\n"), (None, "a"), (None, "a"), (7, "a"), (7, "a"), (9, "a"), (-3, "zz"), (10, "y" * 100_000), (10, "y" * 100_000)]
    df = spark.createDataFrame([(i, None if i == 2 else "http://x\n", h, 5) for i, h in rows], "page_id long, url string, html string, origin int")
    best = {}
    for i, h in rows:
        if i is not None:
            best[h or ""] = min(best.get(h or "", i), i)
    want = [(i, len((h or "").encode()), warc.digest((h or "").encode()), "revisit" if i is not None and i > best[h or ""] else "response", best[h or ""] if i is not None and i > best[h or ""] else None) for i, h in rows]
    assert rows_of(warc.warc_round_trip(df)) == sorted(want, key=str)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_broken_segments_are_found():
    assert warc.dechunked(warc.chunked(b"abc" * 10_000, 7)) == b"abc" * 10_000
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcXX0\r\n\r\n")


# ---- shards and mixes ----


def test_byte_shards(spark):
    rows = [(k % 40 or None, "é" * (k * 7 % 90) if k % 9 else None, 1) for k in range(200)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 5).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    total = sum(r.size for r in got)
    for s in range(5):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 5) <= max(r.size for r in got)
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 5).count() == 0


def test_equal_texts_go_by_their_ids(spark):
    """Equal texts scatter by id; a text longer than a shard is a shard of its own; repeated rows are neighbours."""
    rows = [(k, "same text" if k % 2 else f"text {k:04d}") for k in range(200)] + [(60, "x" * 50_000), (61, "same text"), (61, "same text")]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.doc_id, r.text_crc32) for r in order] == sorted((i, zlib.crc32(t.encode())) for i, t in rows)
    same = {r.shard for r in got if r.text_crc32 == zlib.crc32(b"same text")}
    assert len(same) > 1 and sum(r.size for r in got if r.shard == next(x.shard for x in got if x.size > 50_000)) > 50_000


def brute_mix(rows, weights=(3, 1, 2), share=1.5, cap=2, seed=20):
    """(doc_id, size) -> copies, by plain loops; shards by the leaves' quotas, drawn in the blocks' order."""
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5("|".join([*([] if i is None else [str(i)]), str(seed)]).encode()).hexdigest()) for i, t, s in rows]
    names = sorted({s for _, s, _, _ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n, _ in docs if t == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = share * sum(size.values()) - sum(cap * size[s] for s in capped)
        target = {s: float(cap * size[s]) if s in capped else weight[s] * left / sum(weight[x] for x in free) for s in names}
        more = {s for s in free if target[s] > cap * size[s]}
        if not more:
            break
        capped |= more
    own, draws = {}, []
    for s in names:
        order = sorted((x for x in docs if x[1] == s), key=lambda x: (x[3], x[0], x[2]))
        passes = int(target[s] // size[s]) if size[s] else 0
        rest, at, rows_ = target[s] - passes * size[s], 0, []
        for i, _, n, key in order:
            rows_.append({"id": i, "n": n, "block": key[:2], "start": at, "copies": passes, "last": rest > 0 and at + n <= rest})
            at += n
        begins = {}
        for r in rows_:
            begins.setdefault(r["block"], r["start"])
        partly = [b for b in begins if begins[b] < rest]
        sequence = [*begins] * passes + partly
        gap = rest - max((r["start"] + r["n"] for r in rows_ if r["last"]), default=0)
        left = [r for r in rows_ if not r["last"] and r["n"]] if partly else []
        for _ in range(mixing.FILLS):
            total, fit = 0, [r for r in left if r["n"] <= gap]
            for r in fit:
                total += r["n"]
                if total <= gap:
                    r["fill"] = True
            gap -= sum(r["n"] for r in left if r.get("fill"))
            left = [r for r in left if not r.get("fill")]
        best = min((r for r in left if abs(r["n"] - gap) < gap), key=lambda r: (abs(r["n"] - gap), r["start"]), default=None)
        if best:
            best["fill"] = True
        own[s] = rows_, sequence, passes, begins
        draws.append(len(sequence))
    leaves = [q for _, q in mixing.split(np.array(draws), np.diff(np.arange(17) * sum(draws) // 16), np.random.default_rng(seed))]
    out = []
    for k, s in enumerate(names):
        rows_, sequence, passes, _ = own[s]
        shard = [j for j, q in enumerate(leaves) for _ in range(int(q[k]))]
        assert len(shard) == len(sequence)
        for r in rows_:
            places = [j for b, j in zip(sequence, shard, strict=True) if b == r["block"]]
            mine = places[: passes + (1 if r["last"] else 0)] + ([shard[-1]] if r.get("fill") else [])
            out.append((r["id"], r["n"], size[s], round(target[s], 6), r["n"] * len(mine), len(mine), mine))
    return sorted(out, key=str)


def mix_rows():
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 40)), f"s{rng.choice('aaabcde')}" if k % 50 else None) for k in range(400)]
    return [*rows, (None, "x y", "sa"), (3, None, "sa"), (900, "w " * 5000, "sf"), *[(901 + k, "w " * (60 + k), "sf") for k in range(40)], (990, "", "empty")]


def test_mix(spark):
    rows = mix_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, rank int")
    got = mixing.mix(df).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.copies, r.shards) for r in got), key=str) == brute_mix(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    by = collections.defaultdict(list)
    for r in got:
        assert r.taken <= 2 * r.size and len(r.shards) == r.copies and all(0 <= s < 16 for s in r.shards)
        by[r.source_size, r.target].append(r)
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6
    for (_, target), own in by.items():
        spare = [r.size for r in own if r.size and r.copies == min(x.copies for x in own if x.size)] or [0]
        assert abs(sum(r.taken for r in own) - target) <= min(max(0.02 * target + 20, min(spare)), max(r.size for r in own))
    assert mixing.mix(df.limit(0)).count() == 0


def test_the_tree_decides_the_shards(spark, monkeypatch):
    rows = mix_rows()[:300]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {(r.doc_id, r.size): r for r in mixing.mix(df).collect()}
    real = mixing.split
    # Another tree, which leaves half of the shards empty.
    monkeypatch.setattr(mixing, "quotas", lambda n, seed: lambda batches: (x.assign(dealt=[[0] * (n // 2) + [int(d)] * (n // 2) for d in x["draws"]])[["rank", "dealt"]] for x in batches))
    other = mixing.mix(df).collect()
    assert mixing.split is real and all(s == 8 for r in other for s in r.shards)
    assert any(r.shards != first[r.doc_id, r.size].shards for r in other) and all(r.copies == first[r.doc_id, r.size].copies for r in other)


def test_splitting_tree_is_exact():
    counts, room = np.array([50, 0, 7, 300]), np.array([60, 59, 60, 59, 60, 59])
    leaves = list(mixing.split(counts, room, np.random.default_rng(1)))
    assert [s for s, _ in leaves] == list(range(6))
    assert (sum(q for _, q in leaves) == counts).all() and [int(q.sum()) for _, q in leaves] == room.tolist()


def test_shingles_move_in_turns(spark, monkeypatch):
    """What texts, regions and pairs of blocks move at once is bounded: no query writes more than a turn, and the links stay the same."""
    moved, write = [], shingles.in_turns
    monkeypatch.setattr(shingles, "TURN_SHINGLES", 200)
    monkeypatch.setattr(shingles, "SHINGLES_A_TASK", 300)
    monkeypatch.setattr(shingles, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(shingles, "ROUNDS", 1)
    monkeypatch.setattr(shingles, "in_turns", lambda *a: moved.append(list(write(*a))) or iter(moved[-1]))
    rows = shingle_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(shingles.near_duplicate_components(df)) == brute_shingles(rows)
    assert len(moved) >= 4 and max(map(len, moved)) >= shingles.TURNS - 1


def test_documents_of_keys_take_a_byte():
    """Also where few keys of a document go to one task, or numbers jump: that many tasks share the keys makes no key longer."""
    for doc in (np.arange(0, 3000, 3), np.array([0, 0, 0, 254, 509, 765, 1 << 33, (1 << 33) + 1, 1 << 41]), np.zeros(0, np.int64)):
        blob = shingles.packed_docs(doc)
        assert shingles.unpacked_docs(pa.scalar(blob, pa.binary()), len(doc)).tolist() == doc.tolist()
        assert len(blob) <= len(doc) + 8 * int((np.diff(doc, prepend=0) >= 255).sum())
