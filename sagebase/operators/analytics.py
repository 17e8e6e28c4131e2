"""Feedback, status rollups, sessions and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels of the dislike reasons; an answer without one has its own label.
REASONS = {"NOT_ON_TARGET": "没答到点上", "OUTDATED": "信息过时", "WRONG_CITATION": "引用不对", "TOO_VERBOSE": "太啰嗦", "OTHER": "其它"}
NO_REASON = "未填写原因"
# The least and most days of a report, and characters of a feedback note and of what an answer says is missing.
DAYS, NOTE_CHARS, MISSING_CHARS = (1, 365), 200, 480


def ratio(part: Column, whole: Column) -> Column:
    """Four decimals; 0 where there is nothing to divide by."""
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(0.0)


def feedback_overview(messages: DataFrame, sessions: DataFrame, since) -> DataFrame:
    """Counts and means of answers for each knowledge base; null means are of nothing."""
    joined = messages.where((F.col("role") == "ASSISTANT") & (F.col("created_at") >= since)).join(sessions.select(F.col("id").alias("session_id"), "kb_id"), "session_id")
    no_refs = F.col("refs").isNull() | F.col("refs").isin("[]", "")
    yes = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return joined.groupBy("kb_id").agg(
        F.count("*").alias("answers"),
        yes(F.col("feedback") == "UP").alias("up"),
        yes(F.col("feedback") == "DOWN").alias("down"),
        yes(F.col("interrupted")).alias("interrupted"),
        yes(no_refs & F.col("verify_score").isNotNull()).alias("no_evidence"),
        F.count("verify_score").alias("scored"),
        F.round(F.avg("verify_score"), 6).alias("mean_score"),
        F.round(F.avg("faithfulness_score"), 6).alias("mean_faithfulness"),
        F.round(F.avg(F.when(F.col("feedback") == "DOWN", F.col("verify_score"))), 6).alias("mean_disliked"),
    )


def feedback_rates(overview: DataFrame) -> DataFrame:
    return overview.select("kb_id", ratio(F.col("down"), F.col("up") + F.col("down")).alias("dislike_rate"), ratio(F.col("no_evidence"), F.col("scored")).alias("no_evidence_rate"))


def dislike_reasons(messages: DataFrame) -> DataFrame:
    """Disliked messages by reason, whatever their role."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), F.col("feedback_reason"))
    return messages.where("feedback = 'DOWN'").groupBy("feedback_reason").agg(F.count("*").alias("n")).withColumn("label", F.coalesce(label, F.lit(NO_REASON)))


def question_of_answer(messages: DataFrame) -> DataFrame:
    """For each answer, the last user message before it in its session."""
    before = Window.partitionBy("session_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("question_id", F.last(F.when(F.col("role") == "USER", F.col("id")), ignorenulls=True).over(before)).where("role = 'ASSISTANT'").select("id", "question_id")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Rows by document, status and cleaning status."""
    return chunks.groupBy("doc_id", "status", "clean_status").agg(F.count("*").alias("n"))


def vector_stats(chunks: DataFrame) -> DataFrame:
    """Indexed, pending, failed and suspect chunks of each document. Suspect ones count as such only; filtered ones and those without status not at all."""
    suspect = F.coalesce(F.col("clean_status") == "SUSPECT", F.lit(False))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    live = lambda s: ~suspect & F.coalesce(F.col("status") == s, F.lit(False))
    out = chunks.groupBy("doc_id").agg(count(live("INDEXED")).alias("indexed"), count(live("EMBEDDING")).alias("pending"), count(live("FAILED")).alias("failed"), count(suspect).alias("suspect"))
    return out.withColumn("total", F.col("indexed") + F.col("pending") + F.col("failed"))


def vector_summary(stats: DataFrame) -> DataFrame:
    """What is still open in a document's index as a sentence; null if nothing is."""
    i, p, f, s = (F.col(c) for c in ("indexed", "pending", "failed", "suspect"))
    more = lambda c, before, after="": F.when(c > 0, F.concat(F.lit(before), c.cast("string"), F.lit(after))).otherwise("")
    text = F.concat(F.lit("向量未完成：已索引 "), i.cast("string"), F.lit("/"), F.col("total").cast("string"), more(f, "，失败 "), more(p, "，待向量化 "), more(s, "；另有 ", " 块待人工审核"), F.lit("；可在文档列表点「重建向量」修复，无需重新解析"))
    return stats.select("doc_id", F.when((p > 0) | (f > 0), text).alias("summary"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


# ---- memory of a session ----


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def last_rounds(messages: DataFrame, rounds: int) -> DataFrame:
    """From the last but `rounds` user message of each session on; roles in any case."""
    after = Window.partitionBy("session_id").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    users = F.coalesce(F.sum((F.upper("role") == "USER").cast("int")).over(after), F.lit(0))
    return messages.withColumn("users_after", users).where(F.col("users_after") < rounds).drop("users_after")


def without_interrupted(messages: DataFrame) -> DataFrame:
    return messages.where(~(F.coalesce("interrupted", F.lit(False)) & (F.col("role") == "ASSISTANT")))


def summary_due(counts: DataFrame, rounds: int) -> DataFrame:
    """Whether a session has grown by 2 * rounds messages since its last summary, and how many the next one reads."""
    delta = F.col("message_count") - F.col("summarised")
    return counts.withColumn("due", delta >= 2 * rounds).withColumn("reads", F.least(delta, F.lit(60)) + F.when(F.col("summarised") > 0, 4).otherwise(0))


def clamped_days(days: Column) -> Column:
    return F.least(F.greatest(days, F.lit(DAYS[0])), F.lit(DAYS[1]))


def suspect_queue(chunks: DataFrame) -> DataFrame:
    """Chunks to review, by document and place."""
    return chunks.where("clean_status = 'SUSPECT'").orderBy("doc_id", "seq")


def counts_by(chunks: DataFrame) -> DataFrame:
    """Chunks of each base, of each document, and of each document by state and by verdict, in one pass: kind, key, value and n."""
    doc, kb = F.col("doc_id").cast("long"), F.col("kb_id").cast("long")
    mark = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    state = lambda c: F.coalesce(c, F.lit(""))
    marks = F.array(mark("kb", kb, F.lit("")), mark("doc", doc, F.lit("")), mark("status", doc, state("status")), mark("clean", doc, state("clean_status")))
    return chunks.select(F.explode(marks).alias("m")).groupBy("m.kind", "m.key", "m.value").agg(F.count("*").alias("n"))


def titled_if_auto(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Sessions with new titles (id, new_title) where the title isn't the user's own."""
    rows = sessions.join(titles, "id", "left")
    return rows.withColumn("title", F.when(F.col("title_auto") & F.col("new_title").isNotNull(), F.col("new_title")).otherwise(F.col("title"))).drop("new_title")


def pending_again(documents: DataFrame) -> DataFrame:
    """Documents that are parsed again: those not yet waiting or at work lose their error, their count and their curation."""
    go = ~F.col("parse_status").isin("PENDING", "PARSING")
    return documents.select("id", F.when(go, "PENDING").otherwise(F.col("parse_status")).alias("parse_status"), F.when(~go, F.col("error_msg")).alias("error_msg"), F.when(go, 0).otherwise(F.col("chunk_count")).alias("chunk_count"), F.when(~go, F.col("curate_status")).alias("curate_status"))


def rated(messages: DataFrame, ratings: DataFrame) -> DataFrame:
    """Outcome and stored values of ratings (id, rating, reason, note): answers only, UP, DOWN or NONE; reason and note belong to DOWN."""
    rows = ratings.join(messages.select("id", "role"), "id", "left")
    down = F.col("rating") == "DOWN"
    given = ~F.coalesce(F.trim("reason") == "", F.lit(True))
    refused = (
        F.when(F.col("role").isNull(), "missing").when(F.col("role") != "ASSISTANT", "not an answer").when(~F.coalesce(F.col("rating").isin("UP", "DOWN", "NONE"), F.lit(False)), "rating")
        .when(down & given & ~F.col("reason").isin(*REASONS), "reason")
    )
    ok = refused.isNull()
    note = F.regexp_replace("note", r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return rows.select("id", refused.alias("refused"), F.when(ok & (F.col("rating") != "NONE"), F.col("rating")).alias("feedback"), F.when(ok & down & given, F.col("reason")).alias("feedback_reason"), F.when(ok & down & (note != ""), F.substring(note, 1, NOTE_CHARS)).alias("feedback_note"))


def persisted(turns: DataFrame) -> DataFrame:
    """Messages of finished turns: the question, and the answer unless the turn broke off before any text came (answer null and interrupted).

    turns: session_id, turn, question, answer, interrupted, refs, verify_score, missing_info. An interrupted answer has no references and no scores.
    """
    kept = turns.where(F.col("answer").isNotNull() | ~F.col("interrupted"))
    broken = F.col("interrupted")
    user = turns.select("session_id", "turn", F.lit("USER").alias("role"), F.col("question").alias("content"), F.lit(None).cast("string").alias("refs"), F.lit(None).cast("double").alias("verify_score"), F.lit(None).cast("string").alias("missing_info"), F.lit(False).alias("interrupted"))
    answer = kept.select("session_id", "turn", F.lit("ASSISTANT").alias("role"), F.coalesce("answer", F.lit("")).alias("content"), F.when(broken, "[]").otherwise(F.col("refs")).alias("refs"), F.when(~broken, F.col("verify_score")).alias("verify_score"), F.when(~broken, F.substring("missing_info", 1, MISSING_CHARS)).alias("missing_info"), "interrupted")
    return user.unionByName(answer)


def message_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions (id, message_count) after messages (session_id) were added."""
    more = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("more"))
    return sessions.join(more, "id", "left").select("id", (F.col("message_count") + F.coalesce("more", F.lit(0))).alias("message_count"))


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows without those of some keys."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def found(rows: DataFrame, keys: DataFrame, by: list[str], order: list, where: Column | None = None, first: int | None = None) -> DataFrame:
    """Rows of some keys in an order, with their position from 1 in their key: all of each, or the first so many. keys: the columns `by`, each key once; nulls find nothing."""
    rows = (rows if where is None else rows.where(where)).join(keys.select(*by), by, "left_semi")
    out = rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if first is None else out.where(F.col("position") <= first)
