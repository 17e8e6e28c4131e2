"""Keyword and vector ranking, fusion over lists, sources and queries, quotas and evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebase.functions import text as T

# BM25 and fusion constants, weights of the fields, quotas.
K1, B, RRF_K = 1.2, 0.75, 60
FIELDS = {"content": 1.0, "title": 2.0, "doc_name": 0.5}
SOURCE_QUOTA = {"CHUNK": 15, "BUSINESS": 8, "QA": 8}
RERANK_CHUNKS, RERANK_OTHERS, RERANK_DOCS = 6, 4, 20
#: Query terms that go to the tasks inside the plan, at most; pairs of a query and a term that are broadcast, at most.
TERMS, PAIRS = 20_000, 100_000
#: Tokens or postings of a task, and its pairs of a query and a document, about.
TOKENS_A_TASK, SCORES_A_TASK = 500_000, 1_000_000
#: Query vectors that a task has at once, rows of the index that they are scored with, rows of a part of the index, and tasks of blocks and parts at most.
QUERY_BLOCK, STEP_ROWS, PART_ROWS, PAIR_TASKS = 4096, 1024, 65_536, 20_000
#: Numbers of vectors that are scored again in double precision at once.
EXACT_NUMBERS = 2 << 20


def bm25_weight() -> Column:
    """The weight of a posting (tf, len) of a term that df of n documents have, whose mean length is mean."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))


def tasks(tokens: int, docs: int = 0, queries: int = 0) -> int:
    """Tasks that so many tokens of documents, or scores of documents for queries, are dealt to by document."""
    return max(1, -(-tokens // TOKENS_A_TASK), -(-docs * queries // SCORES_A_TASK))


def bm25_fields(docs: DataFrame, queries: DataFrame, fields: list[str]) -> DataFrame:
    """query_id, doc_id, field and BM25 score. Statistics are over all documents; docs: doc_id and the fields; queries: query_id, term.

    All fields go through one scan for the statistics and one for the postings. Only postings of query terms move, counted for each document and field
    before the join with the queries, which is the small side; up to TERMS different terms are told inside the rows, before tokens become rows. There are as many
    tasks as the tokens ask for, so what a task holds doesn't grow with the documents.
    """
    parts = [F.struct(F.lit(f).alias("field"), T.tokens(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for f in fields]
    sized = docs.select("doc_id", F.explode(F.array(*parts)).alias("p")).select("doc_id", "p.field", "p.terms", F.size("p.terms").alias("len"))
    counted = sized.groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("mean"), F.sum("len").alias("tokens")).collect()  # one row a field
    stats = docs.sparkSession.createDataFrame([(r.field, r.n, r.mean) for r in counted], "field string, n long, mean double")
    wanted = queries.select("term").distinct()
    few = [r.term for r in wanted.limit(TERMS + 1).collect()]  # TERMS and one at most
    if len(few) <= TERMS:
        # Dealt by document once, terms still in arrays: counts, weights and sums of a document need no other exchange.
        n = tasks(sum(r.tokens for r in counted), sum(r.n for r in counted), queries.select("query_id").distinct().count())
        own = sized.withColumn("terms", F.filter("terms", lambda t: t.isin(few))).where(F.size("terms") > 0).repartition(n, "doc_id")
        hits = own.select("doc_id", "field", "len", F.explode("terms").alias("term"))
    else:
        hits = sized.select("doc_id", "field", "len", F.explode("terms").alias("term")).join(wanted, "term")
    postings = hits.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    frequency = postings.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(stats), "field")
    small = len(few) <= TERMS and queries.limit(PAIRS + 1).count() <= PAIRS
    if len(few) <= TERMS:
        frequency = F.broadcast(frequency)  # TERMS rows a field at most
    weights = postings.join(frequency, ["field", "term"]).select("field", "term", "doc_id", bm25_weight().alias("w"))
    scored = weights.join(F.broadcast(queries) if small else queries, "term")
    return scored.groupBy("query_id", "doc_id", "field").agg(F.round(F.sum("w"), 6).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, text_col: str) -> DataFrame:
    """query_id, doc_id and BM25 score of one field."""
    return bm25_fields(docs, queries, [text_col]).select("query_id", "doc_id", "score")


def best_field(scores: DataFrame) -> DataFrame:
    """The best weighted score of a document over its fields."""
    boost = F.element_at(F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv]), F.col("field"))
    return scores.groupBy("query_id", "doc_id").agg(F.round(F.max(F.col("score") * boost), 6).alias("score"))


def top(rows: DataFrame, key: list[str], k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each key with their rank; ties by id. Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best rows of each query so far: by score in six digits, then by id.

    Products in single precision tell which rows may be among them, with what they can be off at most; only those are scored in double precision. They wait until
    there are as many as the best themselves, so sorting stays small beside the products.
    """

    def __init__(self, unit: np.ndarray, k: int):
        self.unit, self.k, self.single = unit, k, unit.astype(np.float32)
        self.slack = (unit.shape[1] + 4) * 2.0**-23 + 1e-6  # unit vectors: twice the bound of a product in single precision, and of rounding to six digits
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, id, score
        self.new, self.waiting, self.most_waiting = [], 0, max(STEP_ROWS, len(unit) * k)
        self.least, self.last = np.full(len(unit), -2.0), np.full(len(unit), np.iinfo(np.int64).max)  # what a row needs to be among the best: this score, and this id at most if equal

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        real = np.isfinite(x).all(axis=1)
        if not real.all():  # of these every score is unknown
            ids, x = ids[real], x[real]
        score = self.single @ x.astype(np.float32).T
        if len(ids) > self.k and self.least.min(initial=0) < -1.5:  # the first rows
            self.least = np.maximum(self.least, np.partition(score, -self.k, axis=1)[:, -self.k] - self.slack)
        near = np.flatnonzero(score >= (self.least - self.slack).astype(np.float32)[:, None])
        step = max(1, EXACT_NUMBERS // x.shape[1])
        for a in range(0, len(near), step):
            q, r = np.divmod(near[a : a + step], len(ids))
            s, i = np.round(np.einsum("ij,ij->i", self.unit[q], x[r]), 6), ids[r]
            keep = (s > self.least[q]) | (s == self.least[q]) & (i <= self.last[q])
            self.new.append((q[keep], i[keep], s[keep]))
            self.waiting += np.count_nonzero(keep)
            if self.waiting > self.most_waiting:
                self.merge()

    def merge(self) -> None:
        q, i, s = (np.concatenate(c) for c in zip(self.rows, *self.new, strict=True))
        key = (q << 21) + (1_000_000 - np.rint(s * 1e6).astype(np.int64))  # by query, then the greatest score first
        order = np.argsort(key, kind="stable")
        if ((key[order][1:] == key[order][:-1]) & (i[order][1:] < i[order][:-1])).any():  # never where rows come by id
            order = np.lexsort((i, key))
        q, i, s = q[order], i[order], s[order]
        own = np.bincount(q, minlength=len(self.unit))
        nth = np.arange(len(q)) - np.repeat(np.cumsum(own) - own, own)
        keep = nth < self.k
        full = nth == self.k - 1
        self.least[q[full]], self.last[q[full]] = s[full], i[full]
        self.rows, self.new, self.waiting = (q[keep], i[keep], s[keep]), [], 0


def unit_rows(vectors: pa.Array) -> np.ndarray:
    x = np.asarray(vectors.flatten(), dtype=float).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosine_top(index: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score and rank of the k nearest by cosine, exactly: every query against all rows, each task gives its k best for each.

    queries: query_id and a vector; ids are whole numbers; rows and queries without a vector find nothing. Up to QUERY_BLOCK queries go to the tasks of one scan.
    More are rows like others: dealt to blocks, of which each meets every part of the index in a task of its own. A task has one block in memory and walks the part's
    rows behind it, so its pairs are QUERY_BLOCK times PART_ROWS, about, however many rows and queries there are.
    """
    names = queries.columns
    floats = {df.select(c).dtypes[0][1] for df, c in ((index, vector), (queries, names[1]))} == {"array<float>"}
    kind = "array<float>" if floats else "array<double>"  # as they move
    asked = queries.select(F.col(names[0]).cast("long").alias("id"), F.col(names[1]).cast(kind).alias("vector")).where("vector is not null")
    rows = index.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector")).where("vector is not null")
    n = asked.count()
    found = _dealt(rows, asked, n, k) if n > QUERY_BLOCK else _scanned(rows, asked.toArrow().combine_chunks(), k)  # a block at most
    return top(found.withColumnRenamed("id", id_col), ["query_id"], k, tie=id_col)


def _steps(best: Best, batch: pa.RecordBatch) -> None:
    for a in range(0, batch.num_rows, STEP_ROWS):
        part = batch.slice(a, STEP_ROWS)
        best.add(np.asarray(part.column("id"), dtype=np.int64), unit_rows(part.column("vector")))


def _results(best: Best, ids: np.ndarray) -> pa.RecordBatch:
    best.merge()
    q, i, s = best.rows
    return pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])


def _scanned(rows: DataFrame, few: pa.Table, k: int) -> DataFrame:
    """One block of queries in every task of one scan; where that would be more pairs than the cluster's tasks should have, rows are dealt first."""
    n = -(-rows.count() * few.num_rows // (QUERY_BLOCK * PART_ROWS))
    if n > rows.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(n)
    ids = np.asarray(few["id"].combine_chunks(), dtype=np.int64)
    unit = unit_rows(few["vector"].combine_chunks()) if few.num_rows else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(unit, k)
        for batch in batches:
            if len(ids):
                _steps(best, batch)
        yield _results(best, ids)

    return rows.mapInArrow(run, "query_id long, id long, score double")


def _dealt(rows: DataFrame, asked: DataFrame, n: int, k: int) -> DataFrame:
    """Blocks of n queries against parts of the index: sorted so that a block's queries come before the part's rows, which are walked and not kept."""
    blocks, parts = (max(1, -(-count // most)) for count, most in ((n, QUERY_BLOCK), (rows.count(), PART_ROWS)))

    def spread(df: DataFrame, side: int, own: str, n: int, other: str, m: int) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return dealt.select("block", "part", F.lit(side).alias("side"), "id", "vector")

    both = spread(asked, 0, "block", blocks, "part", parts).unionByName(spread(rows, 1, "part", parts, "block", blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked_here, best, ids = None, [], None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("block", "part", "side")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pair, side, run_of = (keys[0, a], keys[1, a]), keys[2, a], batch.slice(a, b - a)
                if pair != now:
                    if best is not None:
                        yield _results(best, ids)
                    now, asked_here, best = pair, [], None
                if side == 0:
                    asked_here.append(run_of)
                elif asked_here:
                    if best is None:
                        ids = np.concatenate([np.asarray(r.column("id"), dtype=np.int64) for r in asked_here])
                        best = Best(np.concatenate([unit_rows(r.column("vector")) for r in asked_here]), k)
                    _steps(best, run_of)
        if best is not None:
            yield _results(best, ids)

    # A pair of a block and a part is a task by its number, as hashes of few pairs fall together; beyond a bound a task takes several pairs one after the other.
    tasks = min(blocks * parts, PAIR_TASKS)
    own = F.pmod(F.col("block").cast("long") * parts + F.col("part"), F.lit(tasks)).cast("int")
    sorted_ = both.repartitionById(tasks, own).sortWithinPartitions("block", "part", "side", "id")
    return sorted_.mapInArrow(run, "query_id long, id long, score double")


def of_source(source: str) -> Column:
    """Rows of a source; what has no type is an old chunk."""
    st = F.col("source_type")
    return st.isNull() | (st == "CHUNK") if source == "CHUNK" else st == source


def evidence_key() -> Column:
    return F.concat_ws(":", F.coalesce("source_type", F.lit("CHUNK")), F.col("chunk_id").cast("string"))


def rrf(lists: list[DataFrame], key: list[str], item: str, k: int) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (key, item, rank): items seen earlier win ties."""
    rows = None
    for i, one in enumerate(lists):
        part = one.select(*key, item, "rank", F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy(*key, item).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "seen")
    return fused.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).drop("seen")


def fuse_queries(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Scores of one piece of evidence from several queries add up; the best first, then the first seen."""
    fused = evidence.withColumn("evidence", evidence_key()).groupBy(*key, "evidence").agg(F.round(F.sum("score"), 6).alias("score"), F.min("pos").alias("first_pos"))
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "first_pos", "evidence")
    return fused.withColumn("position", F.row_number().over(w))


def first_of_each(evidence: DataFrame, key: list[str]) -> DataFrame:
    """The first occurrence of each piece of evidence."""
    w = Window.partitionBy(*key, "evidence").orderBy("pos")
    return evidence.withColumn("evidence", evidence_key()).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def quota_by_group(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Without a scorer: chunks and other evidence are cut to their quotas by score."""
    group = F.when(F.col("source_type") == "CHUNK", "CHUNK").otherwise("OTHER")
    w = Window.partitionBy(*key, "part").orderBy(F.desc("score"), "pos")
    ranked = evidence.withColumn("part", group).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= F.when(F.col("part") == "CHUNK", RERANK_CHUNKS).otherwise(RERANK_OTHERS))


def reranked(evidence: DataFrame, key: list[str], scorer: Callable[[list[str]], list[float]], max_docs: int = RERANK_DOCS) -> DataFrame:
    """Evidence by an outside scorer: of each group (chunks, others) within its quota all by score; else the `max_docs` best are scored as texts with
    their names in front, and the quota's best stay. Rows come with their new score and their rank in the group.

    The scorer gets texts in batches; nothing but a group's best rows reaches it.
    """
    group = F.when(F.col("source_type") == "CHUNK", "CHUNK").otherwise("OTHER")
    w = Window.partitionBy(*key, "part")
    quota = F.when(F.col("part") == "CHUNK", RERANK_CHUNKS).otherwise(RERANK_OTHERS)
    rows = evidence.withColumn("part", group).withColumn("old", F.row_number().over(w.orderBy(F.desc("score"), "pos"))).withColumn("n", F.count("*").over(w)).where(F.col("old") <= max_docs)
    few = F.col("n") <= F.least(quota, F.lit(max_docs))
    text = F.concat(rerank_prefix(F.col("doc_name"), F.col("title")), F.coalesce("content", F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(score=scorer(pdf["rerank_text"].tolist()))

    wide = rows.where(~few).withColumn("score", F.col("score").cast("double")).withColumn("rerank_text", text)
    scored = wide.mapInPandas(run, wide.schema).drop("rerank_text")
    both = rows.where(few).withColumn("score", F.col("score").cast("double")).unionByName(scored)
    return both.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "old"))).where(F.col("rank") <= quota).drop("old", "n")


def rerank_scores(reply: Column, size: Column) -> Column:
    """Scores of a reranker's reply in the order of its documents: output.results, data or results hold (index, relevance_score or score); what is missing is 0."""
    item = "array<struct<index:int,relevance_score:double,score:double>>"
    parsed = F.from_json(reply, f"output struct<results:{item}>, data {item}, results {item}")
    items = F.coalesce(parsed["output"]["results"], parsed["data"], parsed["results"])
    value = lambda x: F.coalesce(x["relevance_score"], x["score"], F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.try_element_at(F.transform(F.filter(items, lambda x: x["index"] == i), value), F.lit(-1)), F.lit(0.0)))


def rerank_prefix(doc_name: Column, title: Column) -> Column:
    name, head = F.coalesce(T.jtrim(doc_name), F.lit("")), F.coalesce(T.jtrim(title), F.lit(""))
    text = F.concat(F.when(name != "", F.concat(F.lit("文档："), name, F.lit("；"))).otherwise(""), F.when((head != "") & (head != name), F.concat(F.lit("章节："), head, F.lit("；"))).otherwise(""))
    return F.when(text == "", "").otherwise(F.concat(text, F.lit("\n")))


def citations(answer: Column) -> Column:
    """The numbers cited in an answer as [n], in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda n: n.cast("int"))


def strip_citations(answer: Column, n_refs: Column) -> Column:
    """The answer without citations of references that don't exist."""
    wrong = F.array_distinct(F.filter(citations(answer), lambda c: (c < 1) | (c > n_refs)))
    return F.aggregate(wrong, answer, lambda text, c: F.replace(text, F.concat(F.lit("["), c.cast("string"), F.lit("]")), F.lit("")))
