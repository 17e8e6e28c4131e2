"""Whole jobs: what a narrower threshold, a cut or a stop would lose."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sagebase.llm import decontaminate, shingles


# ---- near duplicates of the pipeline ----


def shingles_of(text, k):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute_groups(rows, k, link):
    sets, up = [shingles_of(t, k) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= link * len(sets[a] | sets[b]) and up[a] != up[b]:
                x, y = up[a], up[b]
                up = [y if u == x else u for u in up]
    return {i: min(rows[b][0] for b in range(len(rows)) if up[b] == up[a]) for a, (i, _) in enumerate(rows)}


def edited(seed=11):
    """Texts with a few changed words, of lengths at which these make similarities on both sides of 0.8."""
    rng, rows = random.Random(seed), []
    words = [f"w{k}" for k in range(500)]
    for n in (3, 5, 8, 9, 10, 12, 13, 14, 17, 20, 25, 30, 40, 50, 54, 58, 80, 94, 105, 115, 139, 160, 172, 229, 260, 286):
        for _ in range(2):
            base = [rng.choice(words) for _ in range(n)]
            for changes in (0, 1, 2, 3, 5):
                t = list(base)
                for _ in range(changes):
                    at = rng.choice([0, len(t) - 1, rng.randrange(len(t))])
                    t[at : at + 1] = rng.choice([[], [rng.choice(words)], [t[at], rng.choice(words)]])
                    t = t or ["w0"]
                rows.append((len(rows) * 7 % 1009, " ".join(t)))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_stage_of_near_duplicates(spark, monkeypatch, tmp_path, small):
    import corpus_pipeline

    if small:
        monkeypatch.setattr(shingles, "SHINGLES_A_TASK", 300)
        monkeypatch.setattr(shingles, "BLOCK_SHINGLES", 300)
        monkeypatch.setattr(shingles, "ROUNDS", 1)
    rows = edited()
    groups = brute_groups(rows, 5, 80)
    strict = brute_groups(rows, 3, 90)
    assert sum(i != g for i, g in groups.items()) > sum(i != g for i, g in strict.items())
    docs = spark.createDataFrame([*rows, (2000, None), (2001, "")], "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates_out(spark, docs, str(tmp_path)).collect())
    assert kept == sorted([*{g for g in groups.values()}, 2000, 2001])


@pytest.mark.parametrize(("words", "link"), [(1, 60), (2, 70), (5, 80), (4, 95)])
def test_components_at_other_thresholds(spark, words, link):
    rows = edited(12)
    got = shingles.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), words=words, link=link)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups(rows, words, link)


# ---- paraphrases at the end of a text ----


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, old = [0] * (len(b) + 1), row
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def test_every_stretch_counts():
    rng, ends = random.Random(6), 0
    for turn in range(150):
        m = rng.randint(8, 60)
        item = [rng.randint(1, 80) for _ in range(m)]
        kept = sorted(rng.sample(range(m), rng.randint(m // 2, m)))
        copy = [x for k in kept for x in [0] * rng.choice([0, 0, 0, 1, 2]) + [item[k]]]
        text = [rng.choice([0, 0, 0, rng.randint(1, 80)]) for _ in range(rng.randint(60, 140))] + copy + [0] * rng.choice([0, 0, 3])
        items = decontaminate.Items([])
        items.words = [np.array(item), np.arange(1, 81)]
        at = (len(text) - len(copy)) // decontaminate.HALF * decontaminate.HALF
        near = text[max(0, at - m - decontaminate.HALF) : at + 3 * decontaminate.HALF + m]
        width = m + m // 2 + 4
        share = max(common(item, near[a : a + width]) for a in range(max(1, len(near) - width + 1))) / m
        last = item[-max(3, m // 4) :]
        answer = common(last, near) / len(last)
        want = (share, answer) if share >= 0.8 or share >= 0.6 and answer >= 0.5 else (0.0, 0.0)
        assert decontaminate.Verifier(items).check(0, np.array(text), at) == want, turn
        ends += want != (0.0, 0.0)
    assert 30 < ends < 150


def test_paraphrase_at_the_end_of_a_text():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    items = [[rng.choice(words) for _ in range(59)] for _ in range(12)]
    docs = []
    for k in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(60, 150))]
        if k % 4 == 0:  # 36 of 59 words, of which 14 at the item's end, spread over 92
            item = items[k // 4 % 12]
            kept = [item[j] for j in [*sorted(rng.sample(range(45), 22)), *range(45, 59)]]
            gaps = sorted(rng.sample(range(1, 91), 34))
            own = dict(zip([0, *gaps, 91], kept, strict=True))
            text += [own.get(j, f"other{k}x{j}") for j in range(92)]
        docs.append((k, " ".join(text)))
    encoded = decontaminate.Items([(k, " ".join(t)) for k, t in enumerate(items)])
    verify = decontaminate.Verifier(encoded)
    for k, t in docs:
        if k % 4 == 0:
            codes = np.array([encoded.vocab.get(decontaminate.normal(w), 0) for w in t.split()])
            assert verify.check(k // 4 % 12, codes, (len(codes) - 92) // decontaminate.HALF * decontaminate.HALF) != (0.0, 0.0), k
