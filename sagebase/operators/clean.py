"""Cleaning rules for pages and chunks, as columns and windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sagebase.functions import text as T

# Patterns and thresholds of the rules.
KEY_VALUE = r"[A-Za-z一-龥]{2,}\s*[：:]\s*\d+"
URL_ONLY = r"^((https?|ftp)://\S+|www\.\S+)$"
FIGURE_TITLE = r"^(图|Fig\.?|表|Table)\s*\d+[.、:：\-]?\s*\S+"
TABLE_TITLE = r"^表\s*\d+"
TOC_LINE = r"^.+?\.{2,}\s*\d+\s*$"
DISCLAIMER = "免责声明|版权声明|著作权|版权所有|版权归|未经许可|机密|联系方式"
TITLE_LINE = r"^(#{1,6}\s+[^\n]+|\*\*[^\n]+\*\*[ \t]*)$"
GARBLED = "[�\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
IMAGES = r"!\[[^\]]*\]\([^)]*\)|<img[^>]*>"
HEADER_SHARE, HEADER_CHARS, HEADER_WINDOW = 0.8, 50, 3
SHORT, FIGURE_TITLE_CHARS, FIGURE_CONTENT, TABLE_TITLE_CHARS = 10, 30, 40, 20
TEMPLATE_SHARE, SIMILARITY, LONG_LINE, TAIL, HEAD_PAGES = 0.6, 0.9, 80, 40, 5
#: Long lines of a document that are compared with all its earlier chunks, at most.
FEW_LINES = 1000
#: Chunks of a document that are told apart in pairs, at most; bins of a sketch (a power of two), and the most that one counts.
FEW_CHUNKS, SKETCH, MOST = 256, 32, 32_767
#: Characters whose hash can be an anchor of a long line; factors of the hash (odd numbers).
ANCHOR, FACTOR, MIX = 32, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
AUTO_DROP, SUSPECT = ("A1", "A2", "A5", "C1"), ("A3", "A4", "B1", "B2", "B3", "C2", "C3", "P5")


def line_shares(lines: DataFrame) -> DataFrame:
    """For each document and normalised line, the share of pages that have it (once a page); lines: doc_id, page_num, line_no, line."""
    key = T.template_key(F.col("line"))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages"))
    seen = lines.withColumn("key", key).where("key <> ''").groupBy("doc_id", "key").agg(F.count_distinct("page_num").alias("on_pages"))
    return seen.join(pages, "doc_id").withColumn("share", F.round(F.col("on_pages") / F.col("pages"), 6))


def strip_headers(lines: DataFrame) -> DataFrame:
    """Lines without running headers and footers: short lines that most pages have, near a page's top or bottom. Documents of one page keep all."""
    templates = line_shares(lines).where((F.col("pages") >= 2) & (F.col("on_pages") / F.col("pages") >= HEADER_SHARE) & (F.length("key") <= HEADER_CHARS)).select("doc_id", "key", F.lit(True).alias("template"))
    page = Window.partitionBy("doc_id", "page_num")
    placed = lines.withColumn("key", T.template_key(F.col("line"))).withColumn("at", F.row_number().over(page.orderBy("line_no"))).withColumn("n", F.count("*").over(page))
    near = (F.col("at") <= HEADER_WINDOW) | (F.col("at") > F.col("n") - HEADER_WINDOW)
    return placed.join(templates, ["doc_id", "key"], "left").where(~(near & F.coalesce("template", F.lit(False)))).select("doc_id", "page_num", "line_no", "line")


def page_rule(markdown: Column) -> Column:
    """P4 blank, P2 cover, P3 contents, else null."""
    text = F.coalesce(T.jtrim(markdown), F.lit(""))
    lines = F.split(text, "\n")
    full = F.filter(F.transform(lines, T.jtrim), lambda t: t != "")
    toc = F.filter(full, lambda t: t.rlike(TOC_LINE) | (t.startswith("-") & t.rlike(r"\d+\s*$")))
    cover = (F.length(text) <= 50) & ~text.rlike("[#。，|]") & (F.size(lines) <= 3)
    return F.when(text == "", "P4").when(cover, "P2").when(text.contains("目录") & (F.size(toc) >= 0.6 * F.size(full)), "P3")


def head_noise(pages: DataFrame) -> DataFrame:
    """Leading noise pages of each document that are deleted, with their rule: HEAD_PAGES at most, never the last page. pages: doc_id, page_num, markdown."""
    order = Window.partitionBy("doc_id").orderBy("page_num")
    ruled = pages.withColumn("rule", page_rule(F.col("markdown"))).withColumn("nth", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    leading = F.sum(F.col("rule").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 0
    return ruled.withColumn("leading", leading).where((F.col("leading")) & (F.col("nth") <= HEAD_PAGES) & (F.col("nth") < F.col("n"))).select("doc_id", "page_num", "rule")


def disclaimers(pages: DataFrame) -> DataFrame:
    """Last pages that match the disclaimer pattern; they are recorded, not deleted."""
    last = Window.partitionBy("doc_id").orderBy(F.desc("page_num"))
    return pages.withColumn("back", F.row_number().over(last)).where((F.col("back") == 1) & F.col("markdown").rlike(DISCLAIMER)).select("doc_id", "page_num")


def protect_table(content: Column, title: Column) -> Column:
    return content.contains("|") | F.coalesce(title.rlike("sheet|Sheet|表格"), F.lit(False))


def protect_title(content: Column, title: Column) -> Column:
    text = T.jtrim(content)
    return F.coalesce((text == title) & ~T.blank(title), F.lit(False)) | text.rlike(TITLE_LINE)


def overlaps(chunks: DataFrame) -> DataFrame:
    """Adds `overlap`: a chunk begins with its neighbour's tail (and is longer), or the next begins with its own."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    tail = lambda c: F.when(F.length(c) > TAIL, F.substring(c, -TAIL, TAIL)).otherwise(c)
    starts = lambda c, t: F.coalesce((t != "") & (F.length(t) < F.length(c)) & c.startswith(t), F.lit(False))
    before, after, own = F.lag("content").over(order), F.lead("content").over(order), F.col("content")
    return chunks.withColumn("overlap", starts(own, tail(before)) | starts(after, tail(own)))


def fragment_rule(content: Column) -> Column:
    """A1 to A5 by order, else null."""
    text = T.jtrim(content)
    return (
        F.when(content.isNull() | (text == ""), "A1")
        .when(~text.rlike(r"[\p{L}\p{Nd}]"), "A2")
        .when(text.rlike(URL_ONLY), "A3")
        .when((F.length(text) < SHORT) & (~text.rlike("[一-龥]") | ~text.rlike("[0-9]")), "A4")
        .when(text.rlike(GARBLED), "A5")
    )


def caption_rule(content: Column) -> Column:
    """B2 lone table title, B1 lone figure title, B3 images only, else null."""
    text = T.jtrim(content)
    return (
        F.when(text.rlike(TABLE_TITLE) & (F.length(text) <= TABLE_TITLE_CHARS) & ~content.contains("|"), "B2")
        .when(text.rlike(FIGURE_TITLE) & (F.length(text) <= FIGURE_TITLE_CHARS), "B1")
        .when((text != "") & (T.jtrim(F.regexp_replace(content, IMAGES, "")) == ""), "B3")
    )


def templates(chunks: DataFrame) -> DataFrame:
    """C1: chunks whose normalised text makes up TEMPLATE_SHARE of their document, but for the first."""
    rows = chunks.withColumn("key", T.template_key(F.col("content"))).where("key <> ''").select("doc_id", "seq", F.md5(F.col("key").cast("binary")).alias("key"))  # texts stay
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    same = Window.partitionBy("doc_id", "key")
    rows = rows.withColumn("times", F.count("*").over(same)).withColumn("nth", F.row_number().over(same.orderBy("seq"))).join(n, "doc_id")
    return rows.where((F.col("times") / F.col("n") >= TEMPLATE_SHARE) & (F.col("nth") > 1)).select("doc_id", "seq")


def sketched(chunks: DataFrame) -> DataFrame:
    """Of chunks (doc_id, seq, key, content) of three characters or more: doc_id, seq, key, len, n (different trigrams) and sketch (how many of them fall into each of
    SKETCH bins); row-local. Sketches differ by no more than the sets do."""

    def one(text: str) -> tuple[int, int, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        grams = np.unique(points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:])
        with np.errstate(over="ignore"):
            bins = (grams * FACTOR) >> np.uint64(64 - SKETCH.bit_length() + 1)
        return len(points), len(grams), np.minimum(np.bincount(bins.astype(np.int64), minlength=SKETCH), MOST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in batch.column(3).to_pylist()]
            values = np.concatenate([f[2] for f in found]) if found else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCH * len(found) + 1, SKETCH, dtype=np.int32)), pa.array(values.astype(np.int16)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), lists], names=["doc_id", "seq", "key", "len", "n", "sketch"])

    kinds = dict(chunks.dtypes)
    return chunks.select("doc_id", "seq", "key", "content").mapInArrow(run, f"doc_id {kinds['doc_id']}, seq {kinds['seq']}, key long, len int, n int, sketch array<smallint>")


def near_duplicates(chunks: DataFrame) -> DataFrame:
    """C2: chunks whose character trigrams have a Jaccard similarity of SIMILARITY with an earlier chunk of the document.

    Repeats of equal content are found by counting; of each content only the first chunk is compared. In documents of up to FEW_CHUNKS such chunks, pairs are told apart by
    their sizes and by sketches of their trigrams, which rule out none that is similar; in longer ones candidates share one of the first trigrams in hash
    order, as many as a pair of that similarity can't all miss, so chunks of a long document aren't all paired. Texts and sets of trigrams move for what is left.
    Lengths may differ by 30 % of the chunk's own.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("seq"))
    texts = chunks.where(F.length("content") >= 3).select("doc_id", "seq", F.xxhash64("content").alias("key"), "content")
    placed = texts.select("doc_id", "seq", "key").withColumn("nth", nth)
    repeats = placed.where("nth > 1").select("doc_id", "seq")
    # Ids of long documents: one for each FEW_CHUNKS chunks at most.
    long = F.broadcast(texts.groupBy("doc_id").agg(F.count("*").alias("chunks")).where(F.col("chunks") > FEW_CHUNKS).select("doc_id"))
    near = (F.col("seq2") < F.col("seq")) & (F.abs(F.col("len") - F.col("len2")) * 10 <= F.col("len") * 3) & (F.least("n", "n2") >= SIMILARITY * F.greatest("n", "n2") - 1e-9)
    apart = F.aggregate(F.zip_with("sketch", "sketch2", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    # The sketches of a document move once and lie together, FEW_CHUNKS at most: texts are read and sketched once.
    few = sketched(texts.join(long, "doc_id", "left_anti")).repartition("doc_id").withColumn("nth", nth).where("nth = 1")
    few = few.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "len", "n", "sketch")).alias("all")).select("doc_id", "all", F.explode("all").alias("one")).select("doc_id", "one.*", F.explode("all").alias("two"))
    direct = few.select("doc_id", "seq", "len", "n", "sketch", *[F.col(f"two.{c}").alias(f"{c}2") for c in ("seq", "len", "n", "sketch")]).where(near)
    direct = direct.where(apart * (1 + SIMILARITY) <= (1 - SIMILARITY) * (F.col("n") + F.col("n2")) + 1e-9).select("doc_id", "seq", "seq2")
    # 64-bit hashes stand for the trigrams: set operations on long arrays are hashed.
    grams = F.sort_array(F.array_distinct(F.transform(T.windows(F.col("content"), 3), lambda g: F.xxhash64(g)))).alias("grams")
    firsts = placed.where("nth = 1").select("doc_id", "seq").join(long, "doc_id", "left_semi")
    held = texts.join(long, "doc_id", "left_semi").select("doc_id", "seq", "content").join(firsts, ["doc_id", "seq"])
    held = held.select("doc_id", "seq", F.length("content").alias("len"), grams).withColumn("n", F.size("grams"))
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9).cast("int") + 1
    keyed = held.select("doc_id", "seq", "len", "n", F.posexplode(F.slice("grams", 1, prefix)).alias("at", "key"))
    a, b = keyed, keyed.select("doc_id", "key", *[F.col(c).alias(f"{c}2") for c in ("seq", "len", "n", "at")])
    # Equal sets share all; else what stands behind the shared trigram bounds the overlap, which has to reach t / (1 + t) of both sizes.
    most = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + F.least("at", "at2")
    close = near & (most * (1 + SIMILARITY) >= SIMILARITY * (F.col("n") + F.col("n2")) - 1e-9)
    pairs = direct.unionByName(a.join(b, ["doc_id", "key"]).where(close).select("doc_id", "seq", "seq2").distinct())
    wanted = pairs.select("doc_id", F.explode(F.array("seq", "seq2")).alias("seq")).distinct()
    own = texts.select("doc_id", "seq", "content").join(wanted, ["doc_id", "seq"], "left_semi").select("doc_id", "seq", grams)
    other = own.select("doc_id", F.col("seq").alias("seq2"), F.col("grams").alias("grams2"))
    both = F.size(F.array_intersect("grams", "grams2"))
    scored = pairs.join(own, ["doc_id", "seq"]).join(other, ["doc_id", "seq2"]).where(both / (F.size("grams") + F.size("grams2") - both) >= SIMILARITY)
    return scored.select("doc_id", "seq").distinct().unionByName(repeats).distinct()


def anchors_of(text: str) -> np.ndarray:
    """Hashes that stand for a line of LONG_LINE characters or more: of each stretch of LONG_LINE the least hash of its runs of ANCHOR characters.

    A line that holds another has all of the other's anchors, and neighbouring stretches mostly have the same one, so they are few.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes = np.zeros(len(points) - ANCHOR + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ANCHOR):  # Horner's rule for all places at once
            hashes = hashes * FACTOR + points[k : len(points) - ANCHOR + 1 + k]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * MIX  # so that the least ones aren't those of certain characters
    wide, filled = LONG_LINE - ANCHOR + 1, 1
    while filled < wide:  # least of stretches that double, up to `wide`
        step = min(filled, wide - filled)
        hashes = np.minimum(hashes[:-step], hashes[step:])
        filled += step
    return np.unique(hashes).view(np.int64)


def anchored(lines: DataFrame, text: str) -> DataFrame:
    """Adds the array `anchors` to lines of LONG_LINE characters or more; row-local."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors_of(t) for t in batch.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = np.concatenate([*found, np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "anchors"])

    return lines.mapInArrow(run, StructType([*lines.schema.fields, StructField("anchors", ArrayType(LongType()))]))


def long_line_duplicates(chunks: DataFrame) -> DataFrame:
    """C3: chunks with a line of LONG_LINE characters or more that occurs inside an earlier chunk of the document.

    Whole lines that occur before are found by their hashes. In documents of up to FEW_LINES such lines the others are looked for in all earlier chunks that have a
    longer line. In documents of more they are looked for by their anchors: a line of which one anchor is in no earlier longer line is in none; what is left meets the
    earlier chunks that have its rarest anchor. Both ways find the same, but lines of a long document aren't compared with all its chunks.
    """
    raw = chunks.select("doc_id", "seq", F.explode(F.split("content", "\n")).alias("raw")).where(F.length("raw") >= LONG_LINE)
    lines = raw.select("doc_id", "seq", T.jtrim(F.col("raw")).alias("line")).where(F.length("line") >= LONG_LINE)
    # A document's lines move together once; hashes say which of them repeat.
    keyed = lines.where("doc_id is not null and seq is not null").select("doc_id", "seq", "line", F.xxhash64("line").alias("key"))
    known_at = F.min("seq").over(Window.partitionBy("doc_id", "key"))
    equal = keyed.select("doc_id", "seq", "key").withColumn("first", known_at).where(F.col("first") < F.col("seq")).select("doc_id", "seq").distinct()
    rest = keyed.repartition("doc_id").groupBy("doc_id", "key").agg(F.min(F.struct("seq", "line")).alias("one")).select("doc_id", "one.seq", "one.line", "key")
    longest = F.array_max(F.transform(F.split("content", "\n"), F.length))
    earlier = chunks.select("doc_id", F.col("seq").alias("seq2"), F.col("content").alias("other"), longest.alias("longest")).where(F.col("longest") > LONG_LINE)
    long = raw.groupBy("doc_id").agg(F.count("*").alias("lines")).where(F.col("lines") > FEW_LINES).select("doc_id")
    direct = rest.join(long, "doc_id", "left_anti").join(earlier, "doc_id").where((F.col("seq2") < F.col("seq")) & (F.col("longest") > F.length("line")) & F.col("other").contains(F.col("line")))
    rest, raw = rest.join(long, "doc_id", "left_semi"), raw.join(long, "doc_id", "left_semi")
    places = anchored(raw.where(F.length("raw") > LONG_LINE), "raw").select("doc_id", "seq", F.explode("anchors").alias("anchor")).distinct()
    places = places.where("doc_id is not null and seq is not null and anchor is not null")  # said here, so that both uses are one exchange
    known = places.groupBy("doc_id", "anchor").agg(F.count("*").alias("times"), F.min("seq").alias("earliest"))
    sought = anchored(rest, "line").withColumn("n", F.size("anchors"))
    met = sought.select("doc_id", "seq", "key", "n", F.explode("anchors").alias("anchor")).join(known, ["doc_id", "anchor"]).where(F.col("earliest") < F.col("seq"))
    rarest = met.groupBy("doc_id", "seq", "key").agg(F.count("*").alias("found"), F.first("n").alias("n"), F.min(F.struct("times", "anchor"))["anchor"].alias("anchor")).where("found = n")
    at = places.withColumnRenamed("seq", "seq2")
    pairs = rarest.join(at, ["doc_id", "anchor"]).where(F.col("seq2") < F.col("seq")).select("doc_id", "seq", "key", "seq2")
    other = chunks.select("doc_id", F.col("seq").alias("seq2"), F.col("content").alias("other"))
    inside = pairs.join(rest, ["doc_id", "seq", "key"]).join(other, ["doc_id", "seq2"]).where(F.col("other").contains(F.col("line")))
    return equal.unionByName(direct.select("doc_id", "seq")).unionByName(inside.select("doc_id", "seq")).distinct()


def judged(chunks: DataFrame, title: str | None = None) -> DataFrame:
    """Adds rule and disposition to chunks (doc_id, seq, content): protections, fragments, captions, then repetitions."""
    head = F.col(title) if title else F.lit(None).cast("string")
    content = F.col("content")
    shielded = protect_table(content, head) | content.rlike(KEY_VALUE) | (T.jtrim(content).rlike(FIGURE_TITLE) & (F.length(T.jtrim(content)) >= FIGURE_CONTENT)) | protect_title(content, head)
    marks = None
    for rule, found in (("C1", templates(chunks)), ("C2", near_duplicates(chunks)), ("C3", long_line_duplicates(chunks))):
        one = found.withColumn("late", F.lit(rule))
        marks = one if marks is None else marks.unionByName(one)
    marks = marks.where("doc_id is not null and seq is not null").select("doc_id", "seq", "late", F.lit(False).alias("own"))
    # Marks move to the chunks of their document, so texts move once; whatever goes by document after that finds them together.
    rows = chunks.withColumn("shielded", F.coalesce(shielded, F.lit(False))).withColumn("early", F.coalesce(fragment_rule(content), caption_rule(content)))
    rows = rows.withColumn("late", F.lit(None).cast("string")).withColumn("own", F.lit(True)).unionByName(marks, allowMissingColumns=True).repartition("doc_id")
    rows = rows.withColumn("late", F.min("late").over(Window.partitionBy("doc_id", "seq"))).where("own").drop("own")
    rows = overlaps(rows)
    rule = F.when(content.isNull(), "A1").when(~(F.col("shielded") | F.col("overlap")), F.coalesce("early", "late"))
    rows = rows.withColumn("rule", rule)
    return rows.withColumn("disposition", disposition(F.col("rule"))).drop("overlap", "shielded", "early", "late")


def disposition(rule: Column) -> Column:
    return F.when(rule.isin(*AUTO_DROP), "AUTO_DROP").when(rule.isin(*SUSPECT), "SUSPECT").otherwise("KEEP")


def numbered(chunks: DataFrame) -> DataFrame:
    """Kept chunks numbered from 1, dropped ones behind them."""
    dropped = (F.col("disposition") == "AUTO_DROP").cast("int")
    return chunks.withColumn("new_seq", F.row_number().over(Window.partitionBy("doc_id").orderBy(dropped, "seq")))


# Fixed texts of the rules' reasons.
REASONS = {
    "A1": "A1 空白碎片", "A2": "A2 纯符号碎片", "A3": "A3 纯 URL", "A4": f"A4 超短碎片（<{SHORT} 字且无中文/无数字）", "A5": "A5 OCR 乱码",
    "B1": f"B1 孤立图题（≤{FIGURE_TITLE_CHARS} 字）", "B2": "B2 孤立表格标题", "B3": "B3 纯图片引用",
    "C1": f"C1 页眉页脚模板（出现率≥{TEMPLATE_SHARE}，保留首个）", "C2": f"C2 近重复（3-gram Jaccard≥{SIMILARITY}，保留首个）", "C3": f"C3 跨 chunk 长重复（≥{LONG_LINE} 字，保留首个）",
}


def reason(rule: Column, content: Column) -> Column:
    """Why a chunk was marked: the rule's text and the beginning of the chunk."""
    names = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.when(rule.isNotNull(), F.concat(F.coalesce(F.try_element_at(names, rule), rule), F.lit("：「"), T.cut(T.jtrim(F.coalesce(content, F.lit(""))), 30, "…"), F.lit("」")))


def failed_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents of which neither a kept chunk nor an outcome of the rules came: their parsing failed. chunks: doc_id, one row for each piece that was judged."""
    return documents.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
