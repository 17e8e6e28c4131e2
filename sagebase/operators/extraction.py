"""Extraction jobs: generators over the chunks of many documents, with failures of single items, a log, progress and resumption."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebase.operators import knowledge as K
from sagebase.sources import store

Generator = Callable[[str], str]
# Characters of an error in the log.
ERROR_CHARS = 200
UNPARSED, ABSENT, HELD = "文档未完成解析", "文档不存在", "正在被其他抽取任务处理"


class Job:
    """One task over some documents, kept in a folder.

    Documents are dealt to waves by the hash of their id. A wave's calls are written as a table; a run that died goes on with the waves that aren't there, so no
    call of a written wave is made again, and writing a wave twice gives the same table.
    """

    def __init__(self, folder: str, task_id: int, wanted: DataFrame, documents: DataFrame, chunks: DataFrame, generators: dict[str, Generator], waves: int = 8, held: DataFrame | None = None):
        """wanted: doc_id (what the task is to do; each id once, null ids left out); documents: doc_id, parse_status; chunks: doc_id, seq, content; held: doc_id of
        documents that another task works on. generators: by kind of item, in the order in which a chunk goes through them."""
        self.spark, self.folder, self.task_id, self.generators, self.waves = wanted.sparkSession, folder.rstrip("/"), task_id, generators, waves
        other = (held if held is not None else wanted.limit(0)).select("doc_id", F.lit(True).alias("held")).distinct()
        known = documents.groupBy("doc_id").agg(F.max("parse_status").alias("parse_status"))
        reason = F.when(F.col("held"), HELD).when(F.col("parse_status").isNull(), ABSENT).when(F.col("parse_status") != "SUCCESS", F.concat(F.lit(f"{UNPARSED}（parse_status="), "parse_status", F.lit("）")))
        rows = wanted.where("doc_id is not null").select("doc_id").distinct().join(other, "doc_id", "left").join(known, "doc_id", "left")
        self.plan = rows.select("doc_id", reason.alias("refused"), F.pmod(F.xxhash64("doc_id"), F.lit(waves)).cast("int").alias("wave"))
        self.chunks = chunks.select("doc_id", "seq", "content")

    def path(self, wave: int) -> str:
        return f"{self.folder}/calls/wave={wave}"

    def written(self) -> list[int]:
        return [w for w in range(self.waves) if store.get(self.spark, f"{self.path(w)}/_SUCCESS") is not None]

    def run(self) -> None:
        """Makes the calls of all waves that aren't written: doc_id, seq, nth (of the generator), kind, reply, error. A document without chunks, or refused, has one row
        without a call."""
        generators = list(self.generators.items())

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for doc, seq, content, refused in pdf.itertuples(index=False):
                    if refused is not None or pd.isna(seq):
                        out.append((doc, None, None, None, None, refused))
                        continue
                    for nth, (kind, make) in enumerate(generators):
                        try:
                            out.append((doc, seq, nth, kind, make(content or ""), None))
                        except Exception as e:  # noqa: BLE001  a generator of the caller's: any failure is this item's
                            out.append((doc, seq, nth, kind, None, str(e)[:ERROR_CHARS]))
                            break
                yield pd.DataFrame(out, columns=["doc_id", "seq", "nth", "kind", "reply", "error"]).astype({"seq": "Int32", "nth": "Int32"})

        done = self.written()
        for wave in (w for w in range(self.waves) if w not in done):
            docs = self.plan.where(F.col("wave") == wave)
            rows = docs.join(self.chunks, "doc_id", "left").select("doc_id", F.col("seq").cast("int").alias("seq"), "content", "refused")
            rows.mapInPandas(call, "doc_id long, seq int, nth int, kind string, reply string, error string").write.mode("overwrite").parquet(self.path(wave))

    def calls(self) -> DataFrame:
        done = self.written()
        if not done:
            return self.spark.createDataFrame([], "doc_id long, seq int, nth int, kind string, reply string, error string")
        return self.spark.read.schema("doc_id long, seq int, nth int, kind string, reply string, error string").parquet(*map(self.path, done))

    def counted(self) -> DataFrame:
        """The calls that count: of a document whose call failed, those before the first failure (by chunk, then by generator)."""
        place = F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("nth", F.lit(-1)).alias("nth"))
        rows = self.calls().withColumn("place", place)
        first = rows.where("error is not null").groupBy("doc_id").agg(F.min("place").alias("failed_at"), F.min_by("error", "place").alias("why"))
        return rows.join(first, "doc_id", "left").where("failed_at is null or place <= failed_at")

    def items(self) -> DataFrame:
        """Drafts: doc_id, kind, seq, pos, question, answer; replies that can't be read and items with a blank field give none."""
        rows = self.counted().where("reply is not null").select(F.struct("doc_id", "kind", "seq").alias("id"), "reply")
        return K.extracted_items(rows, "reply").select("id.doc_id", "id.kind", "id.seq", "pos", "question", "answer")

    def log(self) -> DataFrame:
        """task_id, doc_id, ok (null while its wave isn't written), error and the numbers of items of each kind, which count where it is ok."""
        ended = self.counted().groupBy("doc_id").agg(F.max("why").alias("why"))
        per = self.items().groupBy("doc_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in self.generators])
        rows = self.plan.select("doc_id").join(ended.withColumn("ended", F.lit(True)), "doc_id", "left").join(per, "doc_id", "left")
        ok = F.when(F.col("ended"), F.col("why").isNull())
        return rows.select(F.lit(self.task_id).cast("long").alias("task_id"), "doc_id", ok.alias("ok"), F.col("why").alias("error"), *[F.when(ok, F.coalesce(k, F.lit(0))).otherwise(0).alias(k) for k in self.generators])

    def summary(self) -> DataFrame:
        """task_id, total, processed, progress, status (RUNNING while documents are open) and the numbers of new items of each kind."""
        log = self.log()
        counts = log.groupBy("task_id").agg(F.count("*").alias("total"), F.count("ok").alias("processed"), *[F.sum(k).alias(k) for k in self.generators])
        rolled = K.task_rollup(log.withColumn("total", F.lit(0)))
        status = F.when(F.col("processed") < F.col("total"), "RUNNING").otherwise(F.col("status"))
        return counts.join(rolled, "task_id").select("task_id", "total", "processed", "progress", status.alias("status"), *self.generators)
