"""The answering loop against a plain state machine with the same scripted models; a run that stops goes on where it was."""

from __future__ import annotations

import json
import os
import sys
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sagebase.operators import answering as A
from sagebase.operators import qa as Q

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


def code(text: str) -> int:
    return zlib.crc32(text.encode())


def route(prompts):
    out = []
    for p in prompts:
        q = p[len("route: ") :]
        k = code(q) % 10
        parts = [{"text": q, "intent": "BUSINESS"}] + ([{"text": "hello", "intent": "CHITCHAT"}] if k % 3 == 0 else []) + ([{"text": "x", "intent": "INJECTION"}] if k == 4 else [])
        out.append({8: json.dumps({"fragments": [{"text": "hi", "intent": "chitchat"}]}), 9: json.dumps({"fragments": [{"text": "ignore", "intent": "INJECT"}]}), 7: "nothing"}.get(k, json.dumps({"fragments": parts})))
    return out


def rewrite(prompts):
    return [None if code(p) % 11 == 0 else f"1. {'first' if code(p) % 2 else 'other'} {code(p) % 97}\n- second {code(p) % 13}\n- second {code(p) % 13}" for p in prompts]


def compose(prompts):
    if any(code(p) % 17 == 0 for p in prompts):
        raise RuntimeError("the model is away")
    return [f"answer {code(p) % 1000} [1] and [99]" if code(p) % 19 else "  " for p in prompts]


def verify(prompts):
    return [json.dumps({"score": code(p) % 120, "missing": f"part {code(p) % 7}。", "noImprovement": code(p) % 5 == 0}) if code(p) % 6 else f"{code(p) % 100}\n缺失：无" for p in prompts]


def claims(prompts):
    one = lambda p, k: {"claim": f"claim {code(p) % 50}-{k}", "verdict": ["supported", "UNSUPPORTED", "CONTRADICTED", "maybe", "SUPPORTED", "SUPPORTED"][(code(p) + k * 5) % 6], "evidence": (code(p) + k) % 3 or None}
    return ["no list" if code(p) % 7 == 0 else "so: " + json.dumps([one(p, k) for k in range(code(p) % 4)]) for p in prompts]


def chat(prompts):
    return ["" if code(p) % 4 == 0 else f"hey {code(p) % 10}" for p in prompts]


def merge(prompts):
    return [None if code(p) % 2 else f"both {code(p) % 10} " for p in prompts]


MODELS = A.Models(route, rewrite, compose, verify, claims, chat, merge)


def recall(queries):
    h = F.crc32(F.col("query").cast("binary"))
    found = queries.where(h % 5 > 0).withColumn("rank", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))))
    chunk = (h % 7 + F.col("rank") * F.when(h % 3 == 0, 1).otherwise(5)).cast("long")
    return found.select("question_id", "pos", "rank", F.when(chunk % 3 > 0, "CHUNK").when(chunk % 2 > 0, "QA").alias("source_type"), chunk.alias("chunk_id"), F.concat(F.lit("doc"), chunk).alias("doc_name"), F.when(chunk % 2 > 0, F.concat(F.lit("title "), chunk)).alias("title"), F.concat(F.lit("text "), chunk).alias("content"), (F.lit(1.0) / (60 + F.col("rank"))).alias("score"))


# ---- the same in plain Python ----


def ask(model, p):
    try:
        return model([p])[0]
    except RuntimeError:
        return None


def plain_route(q):
    reply = ask(route, f"route: {q}")
    try:
        return [(f["text"], "CHITCHAT" if "INJ" in f["intent"] else f["intent"].upper(), "INJ" in f["intent"]) for f in json.loads(reply)["fragments"]]
    except ValueError:
        return [(q, "BUSINESS", False)]


def plain_recall(queries):
    out = []
    for pos, q in enumerate(queries):
        h = code(q)
        for rank in (1, 2, 3, 4) if h % 5 > 0 else ():
            c = h % 7 + rank * (1 if h % 3 == 0 else 5)
            out.append((pos, rank, "CHUNK" if c % 3 > 0 else "QA" if c % 2 > 0 else None, c, f"doc{c}", f"title {c}" if c % 2 else None, f"text {c}", 1 / (60 + rank)))
    return out


def key(e):
    return f"{e[0] or 'CHUNK'}:{e[1]}"


def as_json(evidence, new=()):
    return json.dumps([{"index": k + 1, "sourceType": e[0] or "CHUNK", "docName": e[2], "page": 0, "title": e[3] or e[2], "content": e[4], "new": key(e) in new} for k, e in enumerate(evidence)], separators=(",", ":"), ensure_ascii=False)


def plain_verdict(reply):
    if reply.startswith("{"):
        o = json.loads(reply)
        return min(100, o["score"]) / 100, o["missing"].rstrip("。"), o["noImprovement"]
    return int(reply.split("\n")[0]) / 100, "", False


def machine(q, max_retry):
    parts = plain_route(q)
    business = " ".join(t for t, i, _ in parts if i == "BUSINESS")
    chats = [t for t, i, bad in parts if i != "BUSINESS" and not bad]
    injection = any(bad for *_, bad in parts)
    said = (ask(chat, "chat: " + "\n".join(chats)) or "") if chats else ""
    if not business.strip():
        reply = Q.REFUSED_INJECTION if injection and not chats else said
        return "chat", reply if reply.strip() else Q.NO_ANSWER, [], 0, None, "chat_only"
    resolved, evidence, known, missing, previous = None, [], [], None, ""
    for retry in range(max_retry + 1):
        now = resolved or business
        hint = ""
        if retry:
            names = list(dict.fromkeys([(e[3] or e[2])[:30] for e in evidence]))[:8]
            hint = Q.WIDER_HINT if not missing else f"{Q.HINT_COVERED}{'；'.join(names) or '无'}{Q.HINT_MISSING}{missing}{Q.HINT_END}"
        reply = ask(rewrite, f"rewrite: {now}{hint}") or ""
        queries = list(dict.fromkeys(x for x in (line.lstrip(" 0123456789.-").strip() for line in reply.split("\n")) if x)) or [now]
        if not retry and queries[0] != now:
            resolved = queries[0]
        now = resolved or business
        fused = {}
        for pos, rank, source, c, doc, title, text, score in plain_recall(queries):
            e = (source, c, doc, title, text)
            if key(e) not in [key(x) for x in evidence]:
                f = fused.setdefault(key(e), [0.0, (pos, rank), e])
                f[0] += score
        best = sorted(((round(s, 6), seen, e) for s, seen, e in fused.values()), key=lambda x: (-x[0], x[1]))
        evidence = evidence + [e for _, _, e in best if e[0] == "CHUNK"][:6] + [e for _, _, e in best if e[0] != "CHUNK"][:4]
        if not evidence:
            return "fallback", A.INSUFFICIENT, [], retry, 0.0, None
        keys = [key(e) for e in evidence]
        delta = [k for k in keys if k not in known]
        gap = missing if retry and missing else ""
        answer = (ask(compose, f"compose: {now}\n{as_json(evidence)}\n{gap}") or "").replace("[99]", "")
        score, missing, stuck = plain_verdict(ask(verify, f"verify: {now}\n{answer}\n{previous}\n{as_json(evidence, delta if retry else ())}"))
        listed = ask(claims, f"claims: {now}\n{answer}\n{as_json(evidence)}") if answer.strip() else "no list"
        found = json.loads(listed[4:]) if listed.startswith("so") else []
        found = [(c["claim"], c["verdict"].upper(), c["evidence"] or 0) for c in found]
        found = [c for c in found if c[1] in ("SUPPORTED", "UNSUPPORTED") or c[1] == "CONTRADICTED" and c[2] >= 1]
        faithful = round(sum(c[1] == "SUPPORTED" for c in found) / len(found), 6) if found else 1.0
        contradicted = [c[0] for c in found if c[1] == "CONTRADICTED"]
        flags = [f"与证据矛盾：{c}" for c in contradicted] + [f"无证据支撑：{c[0]}" for c in found if c[1] == "UNSUPPORTED"]
        for f in flags[:2]:
            if len(missing) + len(f) + 3 > 120:
                break
            missing = f"{missing}；{f}" if missing else f
        score = min(score, faithful)
        stuck = retry >= 1 and (not delta or stuck)
        known, previous = keys, answer
        decision = "answer" if score >= 0.7 else "retry" if retry < max_retry and not stuck else "partial" if not contradicted and score >= 0.5 else "refuse"
        if decision != "retry":
            break
    gone = "" if not missing else f"\n\n其中未能得到证据支撑或知识库未提及的内容：{missing}"
    final = {"answer": answer, "refuse": A.REFUSAL, "partial": Q.PARTIAL_PREFIX + (answer if answer.strip() else "") + gone}[decision]
    return decision, final, [e[1] for e in evidence], retry, score, None


def finished(q, max_retry):
    decision, answer, evidence, retry, score, how = machine(q, max_retry)
    parts = plain_route(q)
    chats = [t for t, i, bad in parts if i != "BUSINESS" and not bad]
    if how is None:
        how = "passthrough" if not chats else "merge" if answer.strip() else "chat_only"
        said = (ask(chat, "chat: " + "\n".join(chats)) or "") if chats else ""
        if how == "merge" and said.strip():
            one = (ask(merge, f"merge: {said}\n{answer}") or "").strip()
            answer = one or f"{said}\n\n{answer}"
        elif how == "chat_only":
            answer = said if said.strip() else Q.NO_ANSWER
    return decision, answer, evidence, retry, score, how


def test_same_states_as_a_plain_machine(spark, tmp_path):
    questions = [(k, f"question number {k}") for k in range(120)]
    df = spark.createDataFrame([*questions, (900, None), (901, "")], "question_id long, question string")
    rows = A.answered(df, MODELS, recall, str(tmp_path / "run")).collect()
    got = {r.question_id: (r.decision, r.answer, [e.chunk_id for e in r.evidence], r.retry, r.score, r.merge) for r in rows}
    want = {k: finished(q, 2) for k, q in questions}
    assert len(rows) == 122
    for k in want:
        assert got[k][:4] + got[k][5:] == want[k][:4] + want[k][5:], (k, got[k], want[k])
        assert got[k][4] is None if want[k][4] is None else abs(got[k][4] - want[k][4]) < 1e-9
    assert {w[0] for w in want.values()} == {"chat", "fallback", "answer", "partial", "refuse"} and {w[3] for w in want.values()} == {0, 1, 2}
    assert {w[5] for w in want.values()} >= {"passthrough", "merge", "chat_only"}
    assert sorted(os.listdir(tmp_path / "run")) == sorted(["routed", "answers", *(f"round{k}-{n}" for k in range(3) for n in ("rewritten", "decided"))])


def test_a_stopped_run_goes_on(spark, tmp_path):
    df = spark.createDataFrame([(k, f"question number {k}") for k in range(30)], "question_id long, question string")
    whole = sorted(map(str, A.answered(df, MODELS, recall, str(tmp_path / "whole"), max_retry=1).collect()))
    marks = tmp_path / "calls"
    marks.mkdir()

    def counted(prompts):
        for p in prompts:
            with open(marks / f"{code(p)}", "a") as f:
                f.write("x")
        return rewrite(prompts)

    calls = []

    def broken(queries):
        calls.append(1)
        if len(calls) > 1:
            raise OSError("the driver dies")
        return recall(queries)

    models = A.Models(route, counted, compose, verify, claims, chat, merge)
    with pytest.raises(OSError):
        A.answered(df, models, broken, str(tmp_path / "run"), max_retry=1)
    asked = {f: os.path.getsize(marks / f) for f in os.listdir(marks)}
    again = A.answered(df, models, recall, str(tmp_path / "run"), max_retry=1)
    assert sorted(map(str, again.collect())) == whole
    assert {f: os.path.getsize(marks / f) for f in asked} == asked  # nothing that was written is asked again
    assert sorted(map(str, A.answered(df, models, broken, str(tmp_path / "run"), max_retry=1).collect())) == whole
