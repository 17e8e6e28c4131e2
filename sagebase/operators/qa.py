"""Nodes of the question-answering graph as columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from sagebase.functions import text as T

# Patterns of prompt injection, thresholds and the bounds of rewriting.
INJECTION = (
    "忽略[一-龥]{0,6}(指令|约束|提示词|规则)",
    "(输出|打印|显示|泄露|复述|给出)[一-龥a-zA-Z]{0,8}(系统提示词|系统指令|内部规则|人设|隐藏指令)",
    r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+instructions",
    r"(?i)\b(reveal|show|print|repeat)\b.{0,20}system prompt",
)
THRESHOLD, PARTIAL_FLOOR, MAX_RETRY = 0.7, 0.5, 2
QUERY_CHARS, QUERIES = 200, 5
BULLET = r"^[\s\d.、\-*•]+"
ROUTER_CEILING, HINT_TITLES, HINT_CHARS = 1024, 8, 30
MISSING_CHARS, CLAIM_CHARS, FLAGS = 120, 60, 2
PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_]+)\s*(?:\|([^}]*))?\s*\}\}"
SNIPPET = 300
# Fixed texts of answers and hints.
NO_ANSWER = "抱歉，暂时无法回答该问题。"
REFUSED_INJECTION = "抱歉，我无法执行该指令。我是知识库问答助手，仅回答与知识库内容相关的业务问题。请直接描述您想了解的业务内容。"
PARTIAL_PREFIX = "抱歉，检索到的知识库资料未能完全覆盖该问题。以下内容基于现有资料整理，请结合候选证据谨慎参考：\n"
PARTIAL_MISSING = "\n\n其中未能得到证据支撑或知识库未提及的内容："
WIDER_HINT = "\n（上次检索证据不足，请用更宽泛的关键词改写查询，扩大检索范围）"
HINT_COVERED, HINT_MISSING, HINT_END = "\n（上次检索已覆盖：", "；仍缺失：", "。请针对缺失的信息定向改写查询，避免重复检索已覆盖内容）"
CONTRADICTS, UNSUPPORTED, MISSING_MARK = "与证据矛盾：", "无证据支撑：", "缺失："


def injected(text: Column) -> Column:
    found = F.lit(False)
    for pattern in INJECTION:
        found = found | text.rlike(pattern)
    return found


def effective_question(resolved: Column, business: Column, raw: Column) -> Column:
    """The first of three that isn't blank."""
    return F.coalesce(F.when(~T.blank(resolved), resolved), F.when(~T.blank(business), business), raw)


def rewritten(reply: Column, fallback: Column) -> Column:
    """Queries of a rewriting reply: lines without bullets and numbers in front, not the overlong ones, each once, in order; the question itself if there is none."""
    lines = F.transform(F.split(reply, "\n"), lambda x: T.jtrim(F.regexp_replace(x, BULLET, "")))
    found = F.slice(F.array_distinct(F.filter(lines, lambda x: (x != "") & (F.length(x) <= QUERY_CHARS))), 1, QUERIES)
    return F.when(F.size(found) > 0, found).otherwise(F.array(fallback))


def faithfulness(claims: Column) -> Column:
    """Supported claims among valid ones; claims: array of (verdict, evidence). A contradiction needs evidence; without valid claims it is 1."""
    valid = F.filter(claims, lambda c: c["verdict"].isin("SUPPORTED", "UNSUPPORTED") | ((c["verdict"] == "CONTRADICTED") & (F.coalesce(c["evidence"], F.lit(0)) >= 1)))
    good = F.filter(valid, lambda c: c["verdict"] == "SUPPORTED")
    return F.when(F.size(valid) > 0, F.round(F.size(good) / F.size(valid), 6)).otherwise(1.0)


def retry_decision(has_evidence: Column, score: Column, retry: Column, no_improvement: Column, contradicted: Column, max_retry: int = MAX_RETRY) -> Column:
    """fallback without evidence; answer at the threshold; retry while tries are left and help; then partial or refuse."""
    return (
        F.when(~has_evidence, "fallback")
        .when(score >= THRESHOLD, "answer")
        .when((retry < max_retry) & ~no_improvement, "retry")
        .when(~contradicted & (score >= PARTIAL_FLOOR), "partial")
        .otherwise("refuse")
    )


def merge_decision(chitchat: Column, answer: Column) -> Column:
    return F.when(chitchat == 0, "passthrough").when(T.blank(answer), "chat_only").otherwise("merge")


def parsed_score(reply: Column) -> Column:
    """A judge's score from 0 to 1: the number in its JSON, else the first digits of the text."""
    number = F.coalesce(F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.score").cast("double"), F.regexp_extract(reply, r"(\d{1,3})", 1).try_cast("double"))
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(100.0)) / 100)


# ---- routing: replies of a model, read one by one ----


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text; braces inside quotes don't count, nor quotes behind a backslash there."""
    depth, start, quoted, skip = 0, -1, False, False
    for i, c in enumerate(text or ""):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def labelled(label: str) -> tuple[str, bool] | None:
    """Intent and injection of a label in free text."""
    up = label.upper()
    injected_ = "INJECTED" in up or "INJECTION" in up
    if "BUSINESS" in up:
        return "BUSINESS", injected_
    return ("CHITCHAT", injected_) if "CHITCHAT" in up or injected_ else None


def fragments_of(reply: str | None, question: str) -> list[tuple[str, str, bool]] | None:
    """(text, intent, injection) of a router's reply: its JSON fragments, else one label for the whole question; None if neither can be read."""
    if not reply or not reply.strip():
        return None
    out = []
    try:
        items = json.loads(first_object(reply) or "null")
        items = items.get("fragments") if isinstance(items, dict) else None
    except ValueError:
        items = None
    for item in items if isinstance(items, list) else ():
        text, intent = (item.get("text"), item.get("intent")) if isinstance(item, dict) else (None, None)
        if not isinstance(text, str) or not isinstance(intent, str) or not text.strip():
            continue
        up = intent.upper()
        kind = "CHITCHAT" if "INJECT" in up else next((k for k in ("BUSINESS", "CHITCHAT") if k in up), None)
        if kind:
            out.append((text.strip(), kind, "INJECT" in up))
    if out:
        return out
    found = labelled(reply)
    return [(question, *found)] if found else None


FRAGMENTS = ArrayType(StructType([StructField("text", StringType()), StructField("intent", StringType()), StructField("injection", BooleanType())]))


@F.pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    """The first balanced JSON object of each text."""
    return text.map(first_object)


@F.pandas_udf(FRAGMENTS)
def route_fragments(reply: pd.Series, question: pd.Series) -> pd.Series:
    """Fragments of each reply, null where it can't be read."""
    keys = ("text", "intent", "injection")
    found = [fragments_of(r, q or "") for r, q in zip(reply, question, strict=True)]
    return pd.Series([None if f is None else [dict(zip(keys, x, strict=True)) for x in f] for f in found], dtype=object)


def routed(first: Column, second: Column, question: Column) -> Column:
    """Fragments of the first reply that can be read, of two; else the whole question: refused if it looks like an injection, business if not."""
    closed = injected(question)
    default = F.array(F.struct(question.alias("text"), F.when(closed, "CHITCHAT").otherwise("BUSINESS").alias("intent"), closed.alias("injection")))
    return F.coalesce(route_fragments(first, question), route_fragments(second, question), default)


def escalated(cap: Column) -> Column:
    return F.least(cap * 2, F.lit(ROUTER_CEILING))


# ---- rewriting ----


def resolved_question(queries: Column, raw: Column, retry: Column) -> Column:
    """The first query of the first round, if it says something else than the question."""
    first = F.get(queries, F.lit(0))
    return F.when((retry == 0) & ~T.blank(first) & (first != raw), first)


def retry_hint(retry: Column, titles: Column, missing: Column) -> Column:
    """What a retry is told: titles that were covered (each once, cut, so many at most) and what is missing."""
    names = F.slice(F.array_distinct(F.filter(F.transform(titles, lambda t: F.substring(t, 1, HINT_CHARS)), lambda t: ~T.blank(t))), 1, HINT_TITLES)
    covered = F.when(F.size(names) > 0, F.array_join(names, "；")).otherwise("无")
    gap = F.coalesce(T.jtrim(missing), F.lit(""))
    return F.when(retry <= 0, "").when(gap == "", WIDER_HINT).otherwise(F.concat(F.lit(HINT_COVERED), covered, F.lit(HINT_MISSING), gap, F.lit(HINT_END)))


# ---- evidence ----


def snippet(content: str | None, most: int = SNIPPET) -> str:
    """The beginning of a text; where the cut falls into a fence or a table, that whole block instead."""
    if content is None:
        return ""
    if most <= 0 or len(content) <= most:
        return content
    blocks, begin, kind, at = [], 0, "", 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", content):
        t = line.strip("".join(map(chr, range(33))))
        if kind in ("`", "~"):
            if len(t) >= 3 and not t.strip(kind):
                blocks.append((begin, at + len(line)))
                kind = ""
        else:
            fence = t[:1] if t.startswith(("```", "~~~")) else ""
            now = fence or ("|" if t.startswith("|") else "")
            if now != kind:
                if kind:
                    blocks.append((begin, at))
                kind, begin = now, at
        at += len(line)
    if kind:
        blocks.append((begin, len(content)))
    found = next((b for b in blocks if b[0] <= most < b[1]), None)
    return content[found[0] : found[1]] if found else content[:most] + "…"


@F.pandas_udf(StringType())
def ref_snippet(content: pd.Series) -> pd.Series:
    return content.map(snippet)


def evidence_json(items: Column) -> Column:
    """A JSON list of evidence, numbered from 1: items is an array of (source_type, doc_name, page_num, title, content, new)."""
    one = lambda c, i: F.struct(
        (i + 1).alias("index"), F.coalesce(c["source_type"], F.lit("CHUNK")).alias("sourceType"), F.coalesce(c["doc_name"], F.lit("")).alias("docName"), F.coalesce(c["page_num"], F.lit(0)).alias("page"),
        F.when(T.blank(c["title"]), c["doc_name"]).otherwise(c["title"]).alias("title"), F.coalesce(c["content"], F.lit("")).alias("content"), c["new"].alias("new"),
    )
    return F.to_json(F.transform(items, one), {"ignoreNullFields": "false"})


def refs_json(items: Column) -> Column:
    """A JSON list of references: items is an array of (chunk_id, doc_id, source_type, doc_name, page_num, title, snippet)."""
    one = lambda c: F.struct(
        c["chunk_id"].alias("chunkId"), c["doc_name"].alias("docName"), F.coalesce(c["page_num"], F.lit(0)).alias("page"), F.coalesce(c["source_type"], F.lit("CHUNK")).alias("sourceType"),
        F.coalesce(c["title"], F.lit("")).alias("title"), c["doc_id"].alias("docId"), c["snippet"].alias("content"),
    )
    return F.to_json(F.transform(items, one), {"ignoreNullFields": "false"})


# ---- verification ----


def tidy_missing(text: Column) -> Column:
    """What is missing, without the signs that end it; 无 is nothing."""
    t = T.jtrim(F.regexp_replace(T.jtrim(F.coalesce(text, F.lit(""))), "[。；;]+$", ""))
    return F.when(t == "无", "").otherwise(F.substring(t, 1, MISSING_CHARS))


def verify_reply(reply: Column) -> Column:
    """(score 0 to 1, missing, no_improvement) of a judge's reply: of the JSON object in it, else the first digits before the line of what is missing."""
    obj = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "score double, missing string, noImprovement boolean")
    head = F.when(reply.contains(MISSING_MARK), F.substring_index(reply, MISSING_MARK, 1)).otherwise(reply)
    tail = F.when(reply.contains(MISSING_MARK), F.element_at(F.split(T.jtrim(F.regexp_extract(reply, f"(?s){MISSING_MARK}(.*)$", 1)), "\n"), 1))
    digits = F.regexp_extract(head, r"([0-9]{1,3})", 1).try_cast("double")
    part = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)) / 100
    from_text = F.struct(part(F.coalesce(digits, F.lit(0.0))).alias("score"), tidy_missing(tail).alias("missing"), F.lit(False).alias("no_improvement"))
    from_json = F.struct(part(obj["score"]).alias("score"), tidy_missing(obj["missing"]).alias("missing"), F.coalesce(obj["noImprovement"], F.lit(False)).alias("no_improvement"))
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("missing"), F.lit(False).alias("no_improvement"))
    return F.when(T.blank(reply), nothing).when(obj["score"].isNotNull(), from_json).otherwise(from_text)


def claim(text: Column) -> Column:
    """A claim in one line, cut."""
    return T.cut(F.replace(T.jtrim(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" ")), CLAIM_CHARS, "…")


def merged_missing(missing: Column, contradicted: Column, unsupported: Column) -> Column:
    """What is missing and the first claims against it: contradicted ones first, so many at most, as long as all fit."""
    flags = F.concat(F.transform(contradicted, lambda c: F.concat(F.lit(CONTRADICTS), c)), F.transform(unsupported, lambda c: F.concat(F.lit(UNSUPPORTED), c)))
    start = F.struct(F.coalesce(missing, F.lit("")).alias("text"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(state: Column, flag: Column) -> Column:
        full = state["full"] | (state["n"] >= FLAGS) | (F.length(state["text"]) + F.length(flag) + 3 > MISSING_CHARS)
        text = F.when(full, state["text"]).when(state["text"] == "", flag).otherwise(F.concat(state["text"], F.lit("；"), flag))
        return F.struct(text.alias("text"), (state["n"] + F.when(full, 0).otherwise(1)).alias("n"), full.alias("full"))

    return F.aggregate(flags, start, add, lambda s: s["text"])


def verified(has_evidence: Column, score: Column, faithful: Column, retry: Column, new_keys: Column, model_sees_none: Column) -> Column:
    """(score, faithfulness, no_improvement): without evidence 0, 1 and false; else the lower of both scores, and whether a retry brought nothing."""
    nothing = F.struct(F.lit(0.0).alias("score"), F.lit(1.0).alias("faithfulness"), F.lit(False).alias("no_improvement"))
    stuck = (retry >= 1) & ((F.size(new_keys) == 0) | model_sees_none)
    return F.when(~has_evidence, nothing).otherwise(F.struct(F.least(score, faithful).alias("score"), faithful.alias("faithfulness"), stuck.alias("no_improvement")))


# ---- answers ----


def partial_answer(answer: Column, missing: Column) -> Column:
    gap = T.jtrim(F.coalesce(missing, F.lit("")))
    return F.concat(F.lit(PARTIAL_PREFIX), F.when(T.blank(answer), "").otherwise(answer), F.when((gap == "") | (gap == "无"), "").otherwise(F.concat(F.lit(PARTIAL_MISSING), gap)))


def chat_answer(injection: Column, reply: Column) -> Column:
    return F.when(injection, REFUSED_INJECTION).otherwise(reply)


def merged_answer(merged: Column, chat: Column, business: Column) -> Column:
    """The model's merger of both answers, else the chat answer above the other; the other alone without a chat answer."""
    return F.when(T.blank(chat), business).otherwise(F.coalesce(merged, F.concat(chat, F.lit("\n\n"), business)))


def final_answer(chat: Column, answer: Column) -> Column:
    return F.coalesce(chat, answer, F.lit(NO_ANSWER))


def rendered(template: Column, values: Column) -> Column:
    """A template with its {{name}} and {{name|default}} replaced from a map; what neither has is empty. Values aren't searched again."""
    names, defaults = (F.regexp_extract_all(template, F.lit(PLACEHOLDER), k) for k in (1, 2))
    found = F.transform(names, lambda n, i: F.coalesce(F.try_element_at(values, n), T.jtrim(F.get(defaults, i)), F.lit("")))
    plain = F.split(template, PLACEHOLDER)
    return F.coalesce(F.concat(F.get(plain, F.lit(0)), F.array_join(F.zip_with(found, F.slice(plain, 2, 1 << 30), lambda f, p: F.concat(F.coalesce(f, F.lit("")), F.coalesce(p, F.lit("")))), "")), F.lit(""))
