"""Versioned, reviewed knowledge entries; chunk review. Every update is a function from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebase.functions import text as T
from sagebase.operators import clean as C
from sagebase.operators import segment as S


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth = 1").drop("nth")


#: The collation of names and terms in a store that ignores case and accents.
BLIND = "UNICODE_CI_AI_RTRIM"


def compared(name: str, collation: str | None) -> Column:
    """A column as it is compared: by its bytes, or by a collation, in joins, groups and windows alike."""
    return F.col(name) if collation is None else F.collate(F.col(name), collation)


def draft_dedup(rows: DataFrame, key: str, collation: str | None = None) -> DataFrame:
    """The newest live draft of each (kb_id, key) stays; older ones are deleted softly. Under a collation keys that it holds equal are one."""
    draft = (F.col("status") == "DRAFT") & ~F.col("deleted")
    w = Window.partitionBy("kb_id", compared(key, collation), draft).orderBy(F.desc("id"))
    return rows.withColumn("deleted", F.col("deleted") | (draft & (F.row_number().over(w) > 1)))


def versions(rows: DataFrame) -> DataFrame:
    """Versions of each group, newest first; the one that isn't deleted is current."""
    w = Window.partitionBy("history_group_id").orderBy(F.desc("version"))
    return rows.select("history_group_id", "version", "id", F.row_number().over(w).alias("position"), (~F.col("deleted")).alias("current"))


def edited(rows: DataFrame, edits: DataFrame, next_id: Column) -> DataFrame:
    """Edits (history_group_id, answer) delete the current version softly and add the next one as a draft."""
    e = edits.select("history_group_id", F.col("answer").alias("new_answer"))
    now = rows.join(e, "history_group_id", "left")
    hit = F.col("new_answer").isNotNull() & ~F.col("deleted")
    old = now.withColumn("deleted", F.col("deleted") | hit).select(rows.columns)
    new = now.where(hit).select(*[{"id": next_id, "version": F.col("version") + 1, "answer": F.col("new_answer"), "status": F.lit("DRAFT"), "deleted": F.lit(False)}.get(c, F.col(c)).alias(c) for c in rows.columns])
    return old.unionByName(new)


def rolled_back(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The target version (history_group_id, to_version) lives again as approved; the others of its group are deleted."""
    joined = rows.join(targets, "history_group_id", "left")
    hit, target = F.col("to_version").isNotNull(), F.col("version") == F.col("to_version")
    return joined.select(*[{"deleted": F.when(hit, ~target).otherwise(F.col("deleted")), "status": F.when(hit & target, "APPROVED").otherwise(F.col("status"))}.get(c, F.col(c)).alias(c) for c in rows.columns])


def reviewed(status: Column, action: Column) -> Column:
    """Status after a review: drafts are approved or rejected, approved entries disabled, disabled ones enabled; else as it was."""
    return (
        F.when((action == "approve") & (status == "DRAFT"), "APPROVED")
        .when((action == "reject") & (status == "DRAFT"), "REJECTED")
        .when((action == "disable") & (status == "APPROVED"), "DISABLED")
        .when((action == "enable") & (status == "DISABLED"), "APPROVED")
        .otherwise(status)
    )


def names(json: Column) -> Column:
    """A JSON list as an array; what can't be read is empty."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def merged_terms(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges (source_id, target_id): the target gets the source's aliases behind its own, and its texts where its own are blank; sources go."""
    s = rows.select(F.col("id").alias("source_id"), F.col("aliases").alias("s_aliases"), F.col("definition").alias("s_definition"), F.col("scope").alias("s_scope"))
    joined = merges.join(s, "source_id").join(rows, F.col("target_id") == F.col("id"))
    fill = lambda own, other: F.when(T.blank(F.col(own)), F.col(other)).otherwise(F.col(own)).alias(own)
    return joined.select("id", "source_id", F.array_union(names(F.col("aliases")), names(F.col("s_aliases"))).alias("aliases"), fill("definition", "s_definition"), fill("scope", "s_scope"))


def qa_index_text(question: Column, normal: Column, synonyms: Column, answer: Column) -> Column:
    line = lambda mark, c, ok: F.when(ok, F.concat(F.lit(mark), c))
    return F.concat_ws("\n", F.concat(F.lit("问题："), question), line("标准问法：", normal, ~T.blank(normal)), line("同义问法：", F.array_join(synonyms, "、"), F.size(synonyms) > 0), F.concat(F.lit("答案："), answer))


def term_index_text(term: Column, aliases: Column, definition: Column, scope: Column) -> Column:
    line = lambda mark, c, ok: F.when(ok, F.concat(F.lit(mark), c))
    return F.concat_ws("\n", F.concat(F.lit("术语："), term), line("别名：", F.array_join(aliases, "、"), F.size(aliases) > 0), line("定义：", definition, ~T.blank(definition)), line("适用范围：", scope, ~T.blank(scope)))


def index_sync(entries: DataFrame, indexed: DataFrame) -> DataFrame:
    """What the index has to add and to remove so that it holds just the live approved entries."""
    want = entries.where("not deleted and status = 'APPROVED'").select("id", F.lit(True).alias("want"))
    have = indexed.select("id", F.lit(True).alias("have"))
    both = want.join(have, "id", "full_outer")
    return both.select("id", F.when(F.col("have").isNull(), "ADD").when(F.col("want").isNull(), "REMOVE").otherwise("KEEP").alias("action"))


def extracted_items(rows: DataFrame, json_col: str) -> DataFrame:
    """Question and answer items of a model's reply: the outermost list in the text, items without a blank field."""
    body = F.regexp_extract(json_col, r"(?s)\[.*\]", 0)
    items = F.from_json(body, "array<struct<question:string,answer:string>>")
    out = rows.select("*", F.posexplode(items).alias("pos", "item"))
    return out.select("id", "pos", T.jtrim(F.col("item.question")).alias("question"), T.jtrim(F.col("item.answer")).alias("answer")).where("question <> '' and answer <> ''")


def task_rollup(results: DataFrame) -> DataFrame:
    """Progress and status of tasks from one row for each document: task_id, total, ok (null while it is open)."""
    done = F.count("ok")
    good = F.sum(F.coalesce(F.col("ok").cast("int"), F.lit(0)))
    out = results.groupBy("task_id").agg(F.count("*").alias("total"), done.alias("processed"), good.alias("succeeded"))
    failed = F.col("processed") - F.col("succeeded")
    return out.select("task_id", F.floor(F.col("processed") * 100 / F.col("total")).cast("int").alias("progress"), F.when((failed > 0) & (F.col("succeeded") > 0), "PARTIAL_FAILED").when(failed > 0, "FAILED").otherwise("SUCCESS").alias("status"))


def merged_chunks(chunks: DataFrame, merges: DataFrame, indexed: bool = False) -> DataFrame:
    """Merges (doc_id, source, target: places that differ by one, none twice): the target gets both texts in their order and the lower page, the source is filtered.

    Before indexing both have to wait for it (status EMBEDDING, no entry), and the target is suspect until it is reviewed; with `indexed` neither may be
    filtered, and the target is kept and embedded again. Other merges change nothing. chunks: doc_id, seq, page_num, content, status, clean_status, entry.
    """
    columns = ["page_num", "content", "status", "clean_status", "entry"]
    side = lambda name: chunks.select("doc_id", F.col("seq").alias(name), F.struct(*columns).alias(f"{name}_row"))
    both = merges.where(F.abs(F.col("source") - F.col("target")) == 1).join(side("source"), ["doc_id", "source"]).join(side("target"), ["doc_id", "target"])
    free = lambda r: ~F.col(r)["clean_status"].eqNullSafe("FILTERED") if indexed else (F.col(r)["status"] == "EMBEDDING") & F.col(r)["entry"].isNull()
    both = both.where(free("source_row") & free("target_row"))
    first = F.col("source") < F.col("target")
    text = F.concat(F.when(first, F.col("source_row.content")).otherwise(F.col("target_row.content")), F.lit("\n"), F.when(first, F.col("target_row.content")).otherwise(F.col("source_row.content")))
    page = F.least(F.coalesce("source_row.page_num", F.lit(0)), F.coalesce("target_row.page_num", F.lit(0)))
    both = both.withColumn("text", text).where(~T.blank(F.col("text")))
    into = both.select("doc_id", F.col("target").alias("seq"), "text", page.alias("page"), F.lit(True).alias("into"))
    changes = into.unionByName(both.select("doc_id", F.col("source").alias("seq"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("page"), F.lit(False).alias("into")))
    hit, out = F.col("into").isNotNull(), chunks.join(changes, ["doc_id", "seq"], "left")
    return out.select(
        "doc_id", "seq", F.coalesce("page", "page_num").alias("page_num"), F.coalesce("text", "content").alias("content"),
        F.when(F.col("into"), "EMBEDDING").when(hit, "FILTERED").otherwise(F.col("status")).alias("status"),
        F.when(F.col("into"), "KEEP" if indexed else "SUSPECT").when(hit, "FILTERED").otherwise(F.col("clean_status")).alias("clean_status"),
        F.when(~hit, F.col("entry")).alias("entry"),
    )


def inserted(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks (doc_id, seq, content), one for a document at most: later ones move on by one."""
    at = new.select("doc_id", F.col("seq").alias("at"))
    moved = chunks.join(at, "doc_id", "left").select("doc_id", F.when(F.col("seq") >= F.col("at"), F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"), "content")
    return moved.unionByName(new.select("doc_id", "seq", "content"))


def page_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages that two versions of a document don't share: added, removed or changed."""
    a, b = before.select("doc_id", "page_num", F.col("markdown").alias("old")), after.select("doc_id", "page_num", F.col("markdown").alias("new"))
    both = a.join(b, ["doc_id", "page_num"], "full_outer")
    return both.select("doc_id", "page_num", F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(F.col("old") != F.col("new"), "CHANGED").alias("change")).where("change is not null")


def confirmable(chunks: DataFrame) -> DataFrame:
    """Documents that can be confirmed: nothing suspect, and something not filtered."""
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return chunks.groupBy("doc_id").agg((~some(F.col("clean_status") == "SUSPECT") & some(~F.coalesce(F.col("clean_status") == "FILTERED", F.lit(False)))).alias("ok"))


def renamed(index: DataFrame, names_: DataFrame) -> DataFrame:
    """The index with new document names (doc_id, new_name)."""
    return index.join(names_, "doc_id", "left").withColumn("doc_name", F.coalesce("new_name", "doc_name")).drop("new_name")


def detached(index: DataFrame, gone: DataFrame) -> DataFrame:
    """Knowledge entries of deleted documents lose their document (0); their chunks are removed."""
    g = gone.select("doc_id", F.lit(True).alias("gone"))
    rows = index.join(g, "doc_id", "left")
    structured = F.coalesce(F.col("source_type").isin("BUSINESS", "QA"), F.lit(False))
    rows = rows.where(F.col("gone").isNull() | structured)
    return rows.withColumn("doc_id", F.when(F.col("gone").isNotNull(), F.lit(0).cast("long")).otherwise(F.col("doc_id"))).drop("gone")


def chunk_transition(status: Column, clean: Column, action: Column) -> Column:
    """(status, clean_status) after keep, drop or unkeep."""
    return (
        F.when((action == "keep") & (clean == "SUSPECT"), F.struct(F.lit("EMBEDDING").alias("status"), F.lit("KEEP").alias("clean_status")))
        .when((action == "drop") & (F.coalesce(clean, F.lit("")) != "FILTERED"), F.struct(F.lit("FILTERED").alias("status"), F.lit("FILTERED").alias("clean_status")))
        .when((action == "unkeep") & (clean == "KEEP"), F.struct(F.lit("EMBEDDING").alias("status"), F.lit("SUSPECT").alias("clean_status")))
        .otherwise(F.struct(status.alias("status"), clean.alias("clean_status")))
    )


def edited_chunk(content: Column, title: Column, clean: Column, new_content: Column, new_title: Column) -> Column:
    """(content, title, clean_status, ok) after an edit: blank texts and filtered chunks are refused, else the chunk is kept with the new text and title."""
    ok = ~T.blank(new_content) & ~clean.eqNullSafe("FILTERED")
    return F.struct(F.when(ok, new_content).otherwise(content).alias("content"), F.when(ok, new_title).otherwise(title).alias("title"), F.when(ok, "KEEP").otherwise(clean).alias("clean_status"), ok.alias("ok"))


def batch_review(chunks: DataFrame, actions: DataFrame) -> DataFrame:
    """Outcome of each action (id, action): keep and drop succeed on chunks that exist, also where they change nothing."""
    known = chunks.select("id", "status", "clean_status", F.lit(True).alias("known"))
    rows = actions.join(known, "id", "left")
    after = chunk_transition(F.col("status"), F.col("clean_status"), F.col("action"))
    ok = F.col("known").isNotNull() & F.col("action").isin("keep", "drop")
    return rows.select("id", "action", ok.alias("success"), F.when(F.col("known").isNull(), "missing").when(~F.col("action").isin("keep", "drop"), "action").alias("reason"), F.when(ok, after["clean_status"]).alias("clean_status"))


def listed(entries: DataFrame, status: str | None = None) -> DataFrame:
    """Entries that aren't deleted, of one status if one is given, newest first."""
    rows = entries.where("not deleted")
    return (rows if not status else rows.where(F.col("status") == status)).orderBy(F.desc("id"))


def created(requests: DataFrame) -> DataFrame:
    """New entries: drafts of version 1, each in a group of its own that its request names (id)."""
    return requests.select("*", F.concat(F.lit("g-"), F.col("id").cast("string")).alias("history_group_id"), F.lit(1).alias("version"), F.lit("DRAFT").alias("status"), F.lit(False).alias("deleted"))


def normalized(reply: Column) -> Column:
    """(question, synonyms) of a model's reply: of the outermost JSON object in it."""
    obj = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "normalized string, synonyms array<string>")
    return F.struct(obj["normalized"].alias("question"), F.coalesce(obj["synonyms"], F.array().cast("array<string>")).alias("synonyms"))


def json_fields(reply: Column) -> Column:
    """The outermost JSON object of a text as a map of texts; what can't be read is empty."""
    return F.coalesce(F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "map<string,string>"), F.create_map().cast("map<string,string>"))


def without_drafts(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """Live drafts that came from some documents (doc_id) are deleted softly, before these are extracted again."""
    again = documents.select(F.col("doc_id").alias("source_doc_id")).distinct().withColumn("again", F.lit(True))
    rows = entries.join(again, "source_doc_id", "left")
    return rows.withColumn("deleted", F.col("deleted") | (F.col("again").isNotNull() & (F.col("status") == "DRAFT"))).drop("again")


def named(column: str, collation: str | None) -> Column:
    """A file's name as it is compared: in lower case, or by a collation."""
    return F.lower(column) if collation is None else compared(column, collation)


def replaced_uploads(documents: DataFrame, uploads: DataFrame, collation: str | None = None) -> DataFrame:
    """The newest document of the same name (in any case, or by a collation) that each upload (kb_id, file_name) replaces: kb_id, file_name, id."""
    held = documents.select("kb_id", named("file_name", collation).alias("key"), "id").groupBy("kb_id", "key").agg(F.max("id").alias("id"))
    return uploads.withColumn("key", named("file_name", collation)).join(held, ["kb_id", "key"]).select("kb_id", "file_name", "id")


def term_lookup(terms: DataFrame, words: DataFrame, collation: str | None = None) -> DataFrame:
    """The live term of a base that each word (kb_id, word) names, itself or by an alias, the newest of several: kb_id, word, id."""
    every = F.array_union(F.array("term"), names(F.col("aliases")))
    held = terms.where("not deleted").select("kb_id", F.explode(every).alias("name"), "id")
    held = held.groupBy("kb_id", compared("name", collation).alias("key")).agg(F.max("id").alias("id"))
    return words.withColumn("key", compared("word", collation)).join(held, ["kb_id", "key"]).select("kb_id", "word", "id")


def rename_verdicts(documents: DataFrame, renames: DataFrame) -> DataFrame:
    """What becomes of each rename (id, new_name): extension and name have to differ as they should, and no other document of the base may have the name."""
    extension = lambda c: F.lower(F.regexp_extract(c, r"\.([^.]*)$", 1))
    rows = renames.join(documents.select("id", "kb_id", "file_name"), "id")
    held = documents.select("kb_id", F.lower("file_name").alias("key"), F.col("id").alias("other"))
    counts = held.groupBy("kb_id", "key").agg(F.count("*").alias("n"))
    rows = rows.withColumn("key", F.lower("new_name")).join(counts, ["kb_id", "key"], "left")
    others = F.coalesce("n", F.lit(0)) - (F.lower("file_name") == F.col("key")).cast("int")
    return rows.select("id", F.when(extension(F.col("new_name")) != extension(F.col("file_name")), "extension").when(F.col("new_name") == F.col("file_name"), "same").when(others > 0, "duplicate").otherwise("renamed").alias("verdict"))


def rechunked(text: DataFrame, versions_: DataFrame, size: int = S.SIZE, overlap: int = S.OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Edited markdown (doc_id, text) as a new version of pages and as judged chunks.

    The text is split at its page marks, leading noise pages and running headers go; pages get the version behind the last (versions_: doc_id, version), and
    the pages' chunks are judged and numbered, kept ones first.
    """
    pages = text.select("doc_id", F.explode(S.page_split(F.col("text"))).alias("p")).select("doc_id", "p.page_num", "p.markdown")
    noise = C.head_noise(pages).select("doc_id", "page_num")
    kept = pages.join(noise, ["doc_id", "page_num"], "left_anti")
    lines = C.strip_headers(kept.select("doc_id", "page_num", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    clean = lines.groupBy("doc_id", "page_num").agg(body.alias("markdown"))
    last = versions_.groupBy("doc_id").agg(F.max("version").alias("version"))
    numbered = clean.join(last, "doc_id", "left").select("doc_id", (F.coalesce("version", F.lit(0)) + 1).alias("version"), "page_num", "markdown")
    chunks = C.numbered(C.judged(S.chunk_documents(clean, size=size, overlap=overlap).select("doc_id", "seq", "page_num", "title", "content"), "title"))
    return numbered, chunks
