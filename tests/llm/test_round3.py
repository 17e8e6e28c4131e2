"""Rolling medians, filter interactions and languages: against plain loops, and on the cases that break things."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagebase.llm import audit, language, rolling

CLICKS = "click_id long, ts timestamp_ntz, kind string, value double, series string, cents string"
START = dt.datetime(2024, 3, 31, 1, 50)


def brute_medians(rows, window=dt.timedelta(minutes=15)):
    once = {}
    for i, ts, kind, value, *_ in rows:
        cents = None if value is None or abs(value) == float("inf") else int((100 * value + 0.5) // 1)
        key = (ts is None, ts or dt.datetime.min, kind is not None, kind or "", cents is not None, cents or 0)
        if i not in once or key < once[i][0]:
            once[i] = (key, ts, kind, cents)
    out = {}
    for i, (_, ts, kind, cents) in once.items():
        if ts is None:
            continue
        held = sorted(c for _, t, k, c in once.values() if t is not None and k == kind and c is not None and ts - window < t <= ts)
        if not held:
            out[i] = (kind, 0, None, None, None)
            continue
        n = len(held)
        m2 = held[(n - 1) // 2] + held[n // 2]
        off = sorted(abs(2 * c - m2) for c in held)
        m4 = off[(n - 1) // 2] + off[n // 2]
        out[i] = (kind, n, m2, m4, None if cents is None else 2 * abs(2 * cents - m2) > 2 * m4)
    return out


def medians_of(df):
    return {r.click_id: (r.kind, r.n, r.median2, r.mad4, r.far) for r in rolling.click_medians(df).collect()}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])  # in Berlin an hour of that night doesn't exist
def test_rolling_medians(spark, zone, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        ts = START + dt.timedelta(microseconds=rng.choice([0, 15 * 60 * 10**6, 15 * 60 * 10**6 - 1, rng.randrange(2 * 3600 * 10**6)]))
        value = rng.choice([None, round(rng.uniform(-5, 5), 2), rng.uniform(-100, 100), 0.005, -0.005, 1e9, -1e12])
        rows.append((i, rng.choice([ts, ts, ts, ts, None]), rng.choice(["a", "a", "b", None, ""]), value, "x", "y"))
    rows += rng.sample(rows, 300)  # repeated rows
    rows += [(7, START, "a", 5.0, "x", "y"), (None, START, "a", 1.0, "x", "y"), (None, START, "b", 2.0, "x", "y"), (9000, START, "c", float("inf"), "x", "y")]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(rows, CLICKS)
        assert medians_of(df) == brute_medians(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert rolling.click_medians(df.limit(0)).count() == 0


def test_a_hot_time_and_many_trees(spark):
    """A third of the clicks share a time; the rest fill several trees, one cell more than one."""
    rng = random.Random(5)
    rows = [(i, START, "a", rng.choice([1.0, 2.0, 3.5]), "", "") for i in range(4000)]
    rows += [(10_000 + i, START + dt.timedelta(seconds=rng.randrange(5 * 3600)), "a", float(rng.randrange(50)), "", "") for i in range(4000)]
    rows += [(20_000 + i, START + dt.timedelta(minutes=20, microseconds=i), "b", float(i % 977), "", "") for i in range(3000)]
    df = spark.createDataFrame(rows, CLICKS)
    got = medians_of(df)
    assert len(got) == len(rows)
    times = {}
    for i, ts, kind, value, *_ in rows:
        times.setdefault(kind, []).append((ts, int(100 * value)))
    for kind in times:
        times[kind].sort()
    for i, ts, kind, value, *_ in rng.sample(rows, 300):
        held = sorted(c for t, c in times[kind] if ts - dt.timedelta(minutes=15) < t <= ts)
        n, m2 = len(held), held[(len(held) - 1) // 2] + held[len(held) // 2]
        off = sorted(abs(2 * c - m2) for c in held)
        assert got[i][:4] == (kind, n, m2, off[(n - 1) // 2] + off[n // 2])


def test_segment_tree_versions():
    rng = random.Random(6)
    for _ in range(100):
        n = rng.randint(1, 40)
        values, weights = [rng.randint(-9, 9) for _ in range(n)], [rng.randint(1, 3) for _ in range(n)]
        tree = rolling.RankTree(np.array(values), np.array(weights))
        for low, high in itertools.combinations(range(n + 1), 2):
            held = sorted(v for v, w in zip(values[low:high], weights[low:high]) for _ in range(w))
            lows, highs = np.full(len(held), low), np.full(len(held), high)
            assert tree.select(lows, highs, np.arange(len(held))).tolist() == held
            ranks = np.arange(len(tree.values) + 1)
            want = [sum(v < x for v in held) for x in [*tree.values, 100]]
            assert tree.below(np.full(len(ranks), low), np.full(len(ranks), high), ranks).tolist() == want


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(docs, labels):
    """docs: doc_id, text, source."""
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        f["E"] = t in smallest and (i is None or smallest[t] < i)
        rows.append((source or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, share = {}, {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order):
                gone = [r for r in left if k in r[0]]
                failing = sum(k in r[0] for r in own)
                left = [r for r in left if k not in r[0]]
                out[part, "".join(order), step + 1] = [len(left), len(gone), failing - len(gone), sum(r[0] == {k} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                share[part, k] = share.get((part, k), 0) + len(gone)
    return {key: (*v, share[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audited(docs, labels):
    rows = audit.filter_audit(docs, labels).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(found) == len(rows)
    return found


def test_filter_audit(spark, monkeypatch):
    monkeypatch.setattr(audit, "INDEX_ROWS", 64)  # several indexes a task
    rng = random.Random(8)
    words = [*("w%d" % i for i in range(150)), "ÀB", "X", "a#", "|"]
    docs = []
    for i in range(400):
        text = rng.choice([" ", "\n", "\x0b", "\x85", "　"]).join(rng.choice(words[: rng.choice([3, 150, 154])]) for _ in range(rng.choice([0, 5, 199, 200, 201, 300])))
        docs.append((i, rng.choice([text, f" {text}\t"]), rng.choice(["s1", "s2", None, "", "s3"])))
    docs += [(500 + i, docs[3][1], "s1") for i in range(200)]  # a hot text
    docs += [(900, None, "s2"), (901, "", None), (902, "x " * 200_000, "long"), (3, docs[3][1], "s1"), (None, docs[3][1], "s1"), (None, "only here", "s4"), (None, "only here", "s4")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 450)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    extra = [(*d, "p", 1, 2, 3) for d in docs]
    df = spark.createDataFrame(extra, "doc_id long, text string, source string, part string, bits int, h1 long, first long").repartition(7)
    ls = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    assert audited(df, ls) == brute_audit(docs, labels)
    assert audited(df.limit(0), ls) == {}
    assert audited(df, ls.limit(0)) == brute_audit(docs, [])


def test_many_parts_in_one_index(spark):
    docs = [(i, f"text {i % 50}", f"host{i % 1700}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1)
    got = audited(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert len(got) == 1700 * 600
    want = brute_audit([d for d in docs if d[2] in ("host1", "host51") or d[0] < 50], [(1, 1, 0)])
    assert all(got[k] == want[k] for k in want if k[0] == "host51" or k[0] == "host1")


def test_backpropagation_through_time():
    """Gradients against differences of the loss."""
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], units=4, dtype=np.float64)
    x, y = rng.integers(97, 110, (7, 5)).astype(np.intp), rng.integers(0, 3, 5)
    _, grads = net.gradients(x, y)
    for name, w in net.weights.items():
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) for n in w.shape)
            if name.startswith("w"):
                at = (int(rng.choice(x.ravel())), at[1])
            was, e = w[at], 1e-5
            w[at] = was + e
            above = net.gradients(x, y)[0]
            w[at] = was - e
            below = net.gradients(x, y)[0]
            w[at] = was
            assert abs((above - below) / (2 * e) - grads[name][at]) < 1e-7, name


def test_pooling_against_a_plain_loop():
    """Segments of any length give what a loop over single bytes gives."""
    net = language.Network(["a", "b", "c"], units=3, seed=5, dtype=np.float64)
    w, rng = net.weights, np.random.default_rng(3)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(side, data):
        h, out = np.zeros(3), []
        for x in data:
            z, r = (sigmoid(w[f"w{g}{side}"][x] + h @ w[f"u{g}{side}"]) for g in "zr")
            n = np.tanh(w[f"wn{side}"][x] + r * (h @ w[f"un{side}"] + w[f"c{side}"]))
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    texts = [rng.integers(0, 256, k).astype(np.uint8) for k in (0, 1, 5, 256, 257, 700, 0, 513)]
    want, marks = [], []
    for t in texts:
        total = np.zeros(3)
        for a in range(0, len(t), language.SEGMENT):
            part = t[a : a + language.SEGMENT]
            for f, b in zip(states("f", part), states("b", part[::-1])[::-1], strict=True):
                p = np.exp(w["vf"] @ f + w["vb"] @ b + w["b"][:, 0])
                total += p / p.sum()
                marks.append(int(p.argmax()))
        want.append(total / max(1, len(t)))
    labels = np.zeros(sum(map(len, texts)), np.uint16)
    got = language.pooled(net, np.concatenate(texts), np.cumsum([0, *map(len, texts)]), labels)
    assert np.allclose(got, want, atol=1e-6) and labels.tolist() == marks


def spoken(n, seed):
    """Texts of three made-up languages that differ in their syllables."""
    rng = random.Random(seed)
    syllables = {"xx": ["ba", "do", "ki", "lu"], "yy": ["str", "ön", "ich", "bel"], "zz": ["aa", "ll", "üü", "kk"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))), lang))
    return rows


def test_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 120)
    monkeypatch.setattr(language.trained, "__defaults__", (0, 120))
    rows = spoken(400, 1)
    unnamed = {i for i, _, _ in rows if i % 7 == 0}
    docs = [(i, t, None if i in unnamed else lang, "s", 0.5, "q") for i, t, lang in rows]
    long = " ".join(t for _, t, lang in rows if lang == "yy")
    docs += [(1000, None, "xx", "s", 0.5, "q"), (1001, "", "xx", "s", 0.5, "q"), (1002, "12 34 !? ×", "xx", "s", 0.5, "q"), (1003, long * 5, None, "s", 0.5, "q"), (None, "babado kilu doki " * 3, None, "s", 0.5, "q")]
    docs += docs[:20]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double, lang_pred string")
    net = language.fit(df)
    assert net.classes == ["xx", "yy", "zz"]
    got = language.languages(df, net).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    told = {r.doc_id: r.lang_pred for r in got}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1 or i in unnamed]
    assert len(held) > 100 and sum(told[i] == lang for i, lang in held) >= 0.97 * len(held)
    assert [told[i] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "yy", "xx"]
    mixed = "bakilu dobaki kido badolu " * 12 + "strichbel önstrbel ichönstr " * 12
    spans = language.languages(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), net, spans=True).collect()[0].spans
    assert spans[0].first == 0 and spans[-1].last == len(mixed.encode()) - 1 and all(a.last + 1 == b.first for a, b in itertools.pairwise(spans))
    tally = {k: [sum(s.last - s.first + 1 for s in spans if s.lang == k and part(s)) for part in (lambda s: s.last < 320, lambda s: s.first > 320)] for k in ("xx", "yy")}
    assert tally["xx"][0] > 200 and tally["yy"][1] > 200
    assert language.languages(df.limit(0), net).count() == 0
    nothing = language.languages(df, language.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_held_out_texts_teach_nothing(spark):
    rows = [(i, "text of one kind", "aa" if zlib.crc32(str(i).encode()) % 3 == 1 else "bb") for i in range(60)]
    net = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.classes == ["bb"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def brute_leak(item, text):
    """Whether a text leaks an item, by table: the best stretch of one and a half times the item's length, and the item's last quarter."""
    m = len(item)
    if m < 8:
        return any(text[a : a + m] == item for a in range(len(text) - m + 1))
    best = max((lcs(item, text[a : a + m + m // 2 + 4]) for a in range(len(text))), default=0)
    last = item[-max(3, m // 4) :]
    return best / m >= 0.8 or best / m >= 0.6 and lcs(last, text) / len(last) >= 0.5


def test_leaks_by_brute_force(spark):
    """Every pair of the exhaustive search, decided by plain tables; texts of up to 64 words are one passage."""
    from sagebase.llm import decontaminate

    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "to", "ri", "mu", "se") for b in ("n", "l", "st", "rk", "p", "x")]
    items = [[rng.choice(words) for _ in range(n)] for n in (3, 7, 8, 12, 20, 20, 33)]
    docs = []
    for k in range(160):
        item = items[k % len(items)]
        share = rng.choice([0.3, 0.55, 0.62, 0.7, 0.8, 0.9, 1.0])
        kept = [w for w in item if rng.random() < share] if len(item) >= 8 else item[: len(item) - (k % 3 == 0)]
        for _ in range(rng.randint(0, 4)):
            kept.insert(rng.randint(0, len(kept)), f"zz{rng.randrange(9)}")
        docs.append((k, ([f"qq{rng.randrange(50)}" for _ in range(rng.randint(0, 12))] + kept + [f"yy{rng.randrange(50)}" for _ in range(rng.randint(0, 8))])[:64]))
    want = {(k, i) for k, t in docs for i, item in enumerate(items) if brute_leak(item, t)}
    df = spark.createDataFrame([(k, " ".join(t).title()) for k, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench, cosine=-1).collect()}
    assert got == want and 40 < len(want) < 160


def test_leaks_of_odd_tables(spark):
    """Repeated rows, very long texts, and columns of either side that clash."""
    from sagebase.llm import decontaminate

    rng = random.Random(13)
    filler = [f"w{rng.randrange(3000)}" for _ in range(60_000)]
    item = [f"bench{k}" for k in range(30)]
    rows = [(1, " ".join(filler[:40_000] + item + filler[40_000:]), "x", 1, 0.1), (2, " ".join(filler), "x", 1, 0.1), (3, " ".join(item), "x", 1, 0.1), (3, " ".join(item), "x", 1, 0.1), (None, None, "x", 1, 0.1)]
    rows += [(10 + k, " ".join(filler[k * 200 : k * 200 + 150]), "x", 1, 0.1) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, codes int, cosine double")
    bench = spark.createDataFrame([(5, " ".join(item), 7, "c"), (5, " ".join(item), 8, "c"), (6, "", 9, "c"), (None, None, 1, "c")], "item_id long, text string, doc_id long, codes string")
    got = sorted((r.doc_id, r.item_id, r.first_word) for r in decontaminate.leaks(docs, bench).collect())
    assert {(d, i) for d, i, _ in got} == {(1, 5), (3, 5)}
    assert sum(d == 3 for d, _, _ in got) >= 2 and all(39_900 < w < 40_100 for d, _, w in got if d == 1)
