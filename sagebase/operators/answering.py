"""The answering graph run over a table of questions: routing, rewriting, recall, composing, verifying, retries, merging.

Every round is a table: the questions that are still open, with all that is known about each. Rounds are written to a folder and read again, so a
run that stops goes on where it was; questions leave as they are decided, and there are `max_retry` + 1 rounds at most. Models get prompts in batches inside
the tasks; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebase.operators import qa as Q
from sagebase.operators import retrieve as R
from sagebase.sources import store

Model = Callable[[list[str]], list[str | None]]
EVIDENCE = "struct<source_type:string,chunk_id:bigint,doc_name:string,title:string,content:string,score:double>"
#: Prompts of one call to a model.
CALL = 8
# Fixed texts of answers.
NO_EVIDENCE = "抱歉，知识库中没有找到与该问题相关的资料。"
INSUFFICIENT = "抱歉，知识库中的信息不足以确定地回答该问题，建议咨询相关负责人或提供更多细节。"
REFUSAL = "抱歉，经过多轮检索与自检，知识库中的现有资料仍不足以确定地回答该问题。以下为检索到的候选证据，供您自查："


@dataclass
class Models:
    """What is asked at each node; prompts are rendered from the templates."""

    route: Model
    rewrite: Model
    compose: Model
    verify: Model
    claims: Model
    chat: Model
    merge: Model
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))


TEMPLATES = {
    "route": "route: {{question}}",
    "rewrite": "rewrite: {{question}}{{hint}}",
    "compose": "compose: {{question}}\n{{evidence}}\n{{missing}}",
    "verify": "verify: {{question}}\n{{answer}}\n{{previous}}\n{{evidence}}",
    "claims": "claims: {{question}}\n{{answer}}\n{{evidence}}",
    "chat": "chat: {{question}}",
    "merge": "merge: {{chat}}\n{{answer}}",
}


def asked(rows: DataFrame, prompt: Column, out: str, model: Model, size: int = CALL) -> DataFrame:
    """The rows with a model's reply. Null prompts aren't asked; where a call fails its prompts are asked one by one, and what fails then has no reply."""
    schema = rows.withColumn(out, F.lit(None).cast("string")).schema

    def call(prompts: list[str]) -> list[str | None]:
        try:
            replies = model(prompts)
            if len(replies) == len(prompts):
                return replies
        except Exception:  # noqa: BLE001  a model of the caller's: any failure is an item without a reply
            pass
        return call(prompts[:1]) + call(prompts[1:]) if len(prompts) > 1 else [None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = pdf.index[pdf["_prompt"].notna()]
            texts = pdf["_prompt"].loc[some].tolist()
            replies = pd.Series(None, index=pdf.index, dtype=object)
            replies.loc[some] = [r for a in range(0, len(texts), size) for r in call(texts[a : a + size])]
            yield pdf.drop(columns="_prompt").assign(**{out: replies})

    return rows.withColumn("_prompt", prompt).mapInPandas(run, schema)


def prompt(models: Models, name: str, **values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))]
    return Q.rendered(F.lit(models.templates[name]), F.create_map(*pairs))


def routed(questions: DataFrame, models: Models) -> DataFrame:
    """question_id, question, business (the business fragments, null if there are none), chat (the others, an array), injection. The router is asked once more
    where its reply can't be read."""
    first = asked(questions.select("question_id", "question"), prompt(models, "route", question=F.col("question")), "first", models.route)
    unread = Q.route_fragments(F.col("first"), F.col("question")).isNull()
    both = asked(first, F.when(unread, prompt(models, "route", question=F.col("question"))), "second", models.route)
    parts = both.withColumn("parts", Q.routed(F.col("first"), F.col("second"), F.col("question")))
    business = F.array_join(F.transform(F.filter("parts", lambda p: p["intent"] == "BUSINESS"), lambda p: p["text"]), " ")
    chat = F.transform(F.filter("parts", lambda p: (p["intent"] != "BUSINESS") & ~p["injection"]), lambda p: p["text"])
    return parts.select("question_id", "question", F.when(F.trim(business) != "", business).alias("business"), chat.alias("chat"), F.exists("parts", lambda p: p["injection"]).alias("injection"))


def fresh(rows: DataFrame) -> DataFrame:
    """The state of questions before their first round."""
    empty = {"resolved": "string", "answer": "string", "previous": "string", "missing": "string", "decision": "string", "score": "double", "faithfulness": "double", "no_improvement": "boolean", "contradicted": "array<string>"}
    state = rows.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})
    return state.withColumns({"retry": F.lit(0), "evidence": F.array().cast(f"array<{EVIDENCE}>"), "asked_keys": F.array().cast("array<string>")})


def keys(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: F.concat_ws(":", F.coalesce(e["source_type"], F.lit("CHUNK")), e["chunk_id"].cast("string")))


def recalled(open_: DataFrame, recall: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """question_id and current: what the queries of each question find, each piece once with its scores added up, without what the question has, within the quotas;
    chunks before others, the best first."""
    queries = open_.select("question_id", F.posexplode("queries").alias("pos", "query"))
    found = recall(queries).select("question_id", "pos", "rank", "source_type", F.col("chunk_id").cast("long").alias("chunk_id"), "doc_name", "title", "content", F.col("score").cast("double").alias("score"))
    row = F.struct("source_type", "chunk_id", "doc_name", "title", "content")
    fused = found.withColumn("evidence", R.evidence_key()).groupBy("question_id", "evidence").agg(F.round(F.sum("score"), 6).alias("score"), F.min(F.struct("pos", "rank")).alias("seen"), F.min_by(row, F.struct("pos", "rank")).alias("row"))
    known = open_.select("question_id", keys(F.col("evidence")).alias("known"))
    new = fused.join(known, "question_id").where(~F.array_contains("known", F.col("evidence"))).select("question_id", "seen", "score", "row.*")
    ranked = R.quota_by_group(new.withColumn("pos", F.col("seen")), ["question_id"])
    item = F.struct(F.col("part"), F.col("rank"), F.struct("source_type", "chunk_id", "doc_name", "title", "content", "score").cast(EVIDENCE).alias("item"))
    return ranked.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("current"))


CLAIMS = "array<struct<claim:string,verdict:string,evidence:double>>"


def one_round(open_: DataFrame, models: Models, recall: Callable[[DataFrame], DataFrame], max_retry: int, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The state of the open questions after another round, with a decision."""
    effective = Q.effective_question(F.col("resolved"), F.col("business"), F.col("question"))
    titles = F.transform("evidence", lambda e: F.coalesce(F.when(~F.coalesce(F.trim(e["title"]) == "", F.lit(True)), e["title"]), e["doc_name"], F.lit("")))
    rows = open_.withColumn("effective", effective)
    rows = asked(rows, prompt(models, "rewrite", question=F.col("effective"), hint=Q.retry_hint(F.col("retry"), titles, F.col("missing"))), "reply", models.rewrite)
    rows = rows.withColumn("queries", Q.rewritten(F.coalesce("reply", F.lit("")), F.col("effective")))
    rows = rows.withColumn("resolved", F.coalesce("resolved", Q.resolved_question(F.col("queries"), F.col("effective"), F.col("retry")))).withColumn("effective", effective)
    rows = write(rows.drop("reply"), "rewritten")  # what a model said is kept: it is used twice, and may differ when asked again
    rows = rows.join(recalled(rows, recall), "question_id", "left").withColumn("evidence", F.concat("evidence", F.coalesce("current", F.array().cast(f"array<{EVIDENCE}>"))))
    has, now = F.size("evidence") > 0, keys(F.col("evidence"))
    rows = rows.withColumn("delta", F.array_except(now, F.col("asked_keys")))
    as_json = lambda mark: Q.evidence_json(F.transform("evidence", lambda e: F.struct(e["source_type"].alias("source_type"), e["doc_name"].alias("doc_name"), F.lit(None).cast("int").alias("page_num"), e["title"].alias("title"), e["content"].alias("content"), mark(e).alias("new"))))
    plain = as_json(lambda e: F.lit(False))
    marked = as_json(lambda e: (F.col("retry") > 0) & F.array_contains("delta", F.concat_ws(":", F.coalesce(e["source_type"], F.lit("CHUNK")), e["chunk_id"].cast("string"))))
    gap = F.when((F.col("retry") > 0) & (F.trim(F.coalesce("missing", F.lit(""))) != ""), F.col("missing"))
    rows = asked(rows, F.when(has, prompt(models, "compose", question=F.col("effective"), evidence=plain, missing=gap)), "said", models.compose)
    rows = rows.withColumn("answer", F.when(has, R.strip_citations(F.coalesce("said", F.lit("")), F.size("evidence"))).otherwise(NO_EVIDENCE))
    rows = asked(rows, F.when(has, prompt(models, "verify", question=F.col("effective"), answer=F.col("answer"), previous=F.col("previous"), evidence=marked)), "verdict", models.verify)
    rows = asked(rows, F.when(has & (F.trim("answer") != ""), prompt(models, "claims", question=F.col("effective"), answer=F.col("answer"), evidence=plain)), "listed", models.claims)
    rows = rows.withColumn("judged", Q.verify_reply(F.coalesce("verdict", F.lit(""))))
    read = F.from_json(F.regexp_extract(F.coalesce("listed", F.lit("")), r"(?s)\[.*\]", 0), CLAIMS)
    upper = F.transform(read, lambda c: F.struct(c["claim"].alias("claim"), F.upper(F.trim(c["verdict"])).alias("verdict"), c["evidence"].cast("int").alias("evidence")))
    rows = rows.withColumn("claims", F.filter(F.coalesce(upper, F.array().cast("array<struct<claim:string,verdict:string,evidence:int>>")), lambda c: c["claim"].isNotNull() & c["verdict"].isNotNull()))
    valid = F.filter("claims", lambda c: (c["verdict"] == "UNSUPPORTED") | ((c["verdict"] == "CONTRADICTED") & (F.coalesce(c["evidence"], F.lit(0)) >= 1)))
    of = lambda verdict: F.transform(F.filter(valid, lambda c: c["verdict"] == verdict), lambda c: Q.claim(c["claim"]))
    checked = Q.verified(has, F.col("judged.score"), Q.faithfulness(F.col("claims")), F.col("retry"), F.col("delta"), F.col("judged.no_improvement"))
    nothing = F.array().cast("array<string>")
    rows = rows.withColumn("contradicted", F.when(has, of("CONTRADICTED")).otherwise(nothing)).withColumn("missing", F.when(has, Q.merged_missing(F.col("judged.missing"), of("CONTRADICTED"), of("UNSUPPORTED"))).otherwise(""))
    rows = rows.withColumn("checked", checked).withColumns({c: F.col(f"checked.{c}") for c in ("score", "faithfulness", "no_improvement")})
    decision = Q.retry_decision(has, F.col("score"), F.col("retry"), F.col("no_improvement"), F.size("contradicted") > 0, max_retry)
    return write(rows.withColumn("decision", decision).withColumn("asked_keys", now).select(open_.columns), "decided")


def again(decided: DataFrame) -> DataFrame:
    """The open questions of the next round."""
    return decided.where("decision = 'retry'").withColumn("retry", F.col("retry") + 1).withColumn("previous", F.col("answer"))


def answered(questions: DataFrame, models: Models, recall: Callable[[DataFrame], DataFrame], folder: str, max_retry: int = Q.MAX_RETRY) -> DataFrame:
    """question_id, decision, answer, evidence, retry, score, faithfulness, missing and merge (how the answer came to be) of every question.

    questions: question_id (long, each once), question. recall gets question_id, pos and query, and gives rows with question_id, pos, rank (from 1, by query), source_type,
    chunk_id, doc_name, title, content and score. Tables in `folder` that a stopped run wrote are used again, not computed.

    A null or empty question goes through like any other; without business fragments a question has a chat answer only (decision chat), and a
    refusal if it is an injection; a model's failure is a reply that can't be read.
    """
    spark, folder = questions.sparkSession, folder.rstrip("/")

    def written(prefix: str) -> Callable[[DataFrame, str], DataFrame]:
        def write(rows: DataFrame, name: str) -> DataFrame:
            path = f"{folder}/{prefix}{name}"
            if store.get(spark, f"{path}/_SUCCESS") is None:
                rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        return write

    state = written("")(fresh(routed(questions.select("question_id", F.coalesce("question", F.lit("")).alias("question")), models)), "routed")
    chat_only = state.where("business is null").withColumn("decision", F.lit("chat"))
    done, open_ = [chat_only], state.where("business is not null")
    for k in range(max_retry + 1):
        if not open_.limit(1).count():
            break
        path = f"{folder}/round{k}-decided"
        if store.get(spark, f"{path}/_SUCCESS") is not None:
            decided = spark.read.schema(open_.schema).parquet(path)
        else:
            decided = one_round(open_, models, recall, max_retry, written(f"round{k}-"))
        done.append(decided.where("decision <> 'retry'"))
        open_ = again(decided)
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    return written("")(merged(rows, models), "answers")


def merged(rows: DataFrame, models: Models) -> DataFrame:
    """Final answers: of business questions by their decision, with a chat answer above where the question had such fragments."""
    business = (
        F.when(F.col("decision") == "fallback", INSUFFICIENT)
        .when(F.col("decision") == "partial", Q.partial_answer(F.col("answer"), F.col("missing")))
        .when(F.col("decision") == "refuse", REFUSAL)
        .when(F.col("decision") == "answer", F.col("answer"))
    )
    rows = rows.withColumn("business_answer", business).withColumn("evidence", F.when(F.col("decision").isin("answer", "partial", "refuse"), F.col("evidence")).otherwise(F.array().cast(f"array<{EVIDENCE}>")))
    chats = F.when((F.size("chat") > 0), F.array_join("chat", "\n"))
    rows = asked(rows, F.when(chats.isNotNull(), prompt(models, "chat", question=chats)), "chat_reply", models.chat)
    how = F.when(F.col("decision") == "chat", "chat_only").otherwise(Q.merge_decision(F.size("chat"), F.col("business_answer")))
    rows = rows.withColumn("merge", how).withColumn("chat_reply", F.coalesce("chat_reply", F.lit("")))
    rows = asked(rows, F.when((F.col("merge") == "merge") & (F.trim("chat_reply") != ""), prompt(models, "merge", chat=F.col("chat_reply"), answer=F.col("business_answer"))), "one", models.merge)
    one = F.trim("one")
    chat = Q.chat_answer(F.col("injection") & (F.size("chat") == 0), F.col("chat_reply"))
    final = F.when(F.col("merge") == "chat_only", Q.final_answer(F.when(F.trim(chat) != "", chat), F.lit(None))).when(F.col("merge") == "merge", Q.merged_answer(F.when(one != "", one), F.col("chat_reply"), F.col("business_answer"))).otherwise(F.col("business_answer"))
    return rows.select("question_id", "decision", final.alias("answer"), "evidence", "retry", "score", "faithfulness", "missing", "merge")
