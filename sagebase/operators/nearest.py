"""A stored inverted-file index of vectors: cells around centres, bytes instead of floats, and an exact second look.

    centres.npy-like file   the centres, at most CENTRES rows of the sample
    codes/cell=12           id, part, code (a byte for each dimension, of the residual), low, step (of the vector's code)
    vectors/part            id, vector (unit length), for the second look
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebase.operators import retrieve as R
from sagebase.sources import store

#: Rows and bytes that centres are fitted on (those with the least hashes of their ids), turns of the fit, and centres at most.
SAMPLE_ROWS, SAMPLE_BYTES, TURNS, CENTRES = 20_000, 32 << 20, 8, 4096
#: Rows of a part of a cell: what a task multiplies at once.
PART_ROWS = 4096
#: Candidates of a query for its second look: so many, or so many times k.
LEAST_CANDIDATES, CANDIDATES_A_RESULT = 50, 5
#: When every row is looked at: queries and rows (or bytes of rows) that meet in a task, and what rounding to six digits may move.
EXACT_QUERIES, EXACT_ROWS, EXACT_BYTES, SLACK = 4096, 65_536, 32 << 20, 2e-6


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)


def fitted(sample: np.ndarray, centres: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell begins anew at a row that is far from its centre."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(centres, len(sample)), replace=False)]
    for _ in range(TURNS):
        near = sample @ found.T
        home, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, home, sample)
        empty = np.flatnonzero(np.bincount(home, minlength=len(found)) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        found = unit(sums)
    return found


class VectorIndex:
    """An index in a folder. Vectors that are null, zero, or hold null or non-finite components aren't in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def centres(self) -> np.ndarray:
        content = store.get(self.spark, f"{self.path}/centres")
        if content is None:
            raise ValueError(f"there is no index in {self.path}")
        return np.load(io.BytesIO(content))

    def build(self, rows: DataFrame, id_col: str = "chunk_id", vector: str = "embedding", centres: int | None = None) -> None:
        """Writes the index of rows (id: whole numbers, each once). Every row is indexed; only the centres come from a sample."""
        real = F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null").where(real)
        n = own.count()
        width = own.select(F.max(F.size("vector"))).first()[0] or 1
        take = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
        sample = np.array([r.vector for r in own.orderBy(F.xxhash64("id"), "id").limit(take).collect()], dtype=np.float64).reshape(-1, width)  # SAMPLE_BYTES at most
        found = fitted(unit(sample), centres or min(CENTRES, max(1, round(math.sqrt(n))), max(1, len(sample) // 8))) if len(sample) else np.zeros((1, width))
        held = io.BytesIO()
        np.save(held, found)
        store.put(self.spark, f"{self.path}/centres", held.getvalue(), overwrite=True)
        shared = self.spark.sparkContext.broadcast(found)  # CENTRES rows at most

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(matrix(batch.column(1)))
                cell = (x @ shared.value.T).argmax(axis=1)
                rest = x - shared.value[cell]
                low = rest.min(axis=1)
                step = np.maximum((rest.max(axis=1) - low) / 255, 1e-12)
                code = np.rint((rest - low[:, None]) / step[:, None]).astype(np.uint8)
                blobs = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), blobs, pa.array(low), pa.array(step), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "cell", "code", "low", "step", "vector"])

        codes = own.mapInArrow(coded, "id long, cell int, code binary, low double, step double, vector array<double>")
        codes.write.mode("overwrite").parquet(f"{self.path}/placed")
        placed = self.spark.read.schema(codes.schema).parquet(f"{self.path}/placed")
        # A large cell is dealt to parts, so that no task and no file has more than about PART_ROWS of it.
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
        parts.write.mode("overwrite").parquet(f"{self.path}/parts")
        dealt = placed.drop("vector").join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")  # a row a cell, CENTRES at most
        dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/codes")

    def top(self, queries: DataFrame, k: int, probes: int = 8, only: DataFrame | None = None) -> DataFrame:
        """query_id, id, score (cosine, six digits) and rank of about the k nearest of each query (query_id: whole numbers; a vector); probes=0 looks into all
        cells and at all rows, which is exact. `only`: ids that may be found.

        Queries are rows like others: each goes to the cells nearest to it, meets their parts there by key, and each part gives its best candidates. Ties go by id.
        """
        shared = self.spark.sparkContext.broadcast(self.centres())
        many = max(LEAST_CANDIDATES, CANDIDATES_A_RESULT * k)
        names = queries.columns
        asked = queries.select(F.col(names[0]).cast("long").alias("query_id"), F.col(names[1]).cast("array<double>").alias("vector")).where("vector is not null")

        def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(matrix(batch.column(1)))
                near = x @ shared.value.T
                n = min(probes, near.shape[1])
                cells = np.argpartition(-near, n - 1, axis=1)[:, :n]
                at = np.repeat(np.arange(len(x)), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cells.ravel().astype(np.int32)), pa.array(list(x), pa.list_(pa.float64())).take(pa.array(at))], names=["query_id", "cell", "vector"])

        def met(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            if not left.num_rows or not right.num_rows:
                return empty
            q = matrix(left["vector"].combine_chunks())
            code = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(right.num_rows, -1)
            low, step = (np.asarray(right[c].combine_chunks())[:, None] for c in ("low", "step"))
            x = shared.value[int(key[0].as_py())] + low + code * step
            ids, own = np.asarray(right["id"].combine_chunks()), np.asarray(left["query_id"].combine_chunks())
            out = []
            for a in range(0, len(q), 256):
                score = q[a : a + 256] @ x.T
                if score.shape[1] > many:
                    best = np.argpartition(-score, many - 1, axis=1)[:, :many]
                else:
                    best = np.broadcast_to(np.arange(score.shape[1]), score.shape)
                out.append((np.repeat(own[a : a + 256], best.shape[1]), ids[best].ravel(), np.take_along_axis(score, best, axis=1).ravel()))
            return pa.table({"query_id": np.concatenate([o[0] for o in out]), "id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

        parts = self.spark.read.schema("cell int, parts int").parquet(f"{self.path}/parts")
        targets = asked.mapInArrow(aimed, "query_id long, cell int, vector array<double>").join(F.broadcast(parts), "cell")
        targets = targets.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
        codes = self.spark.read.schema("id long, code binary, low double, step double, part int, cell int").parquet(f"{self.path}/codes")
        if only is not None:
            codes = codes.join(only.select(F.col(only.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
        if probes:
            found = targets.groupBy("cell", "part").cogroup(codes.groupBy("cell", "part")).applyInArrow(met, "query_id long, id long, score double")
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
            candidates = found.withColumn("place", rank).where(F.col("place") <= many)
        else:
            candidates = self.possible(asked, codes, shared, k)
        vectors = self.spark.read.schema("id long, vector array<double>").parquet(f"{self.path}/placed")
        unit_queries = asked.select("query_id", F.col("vector").alias("asked"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        looked = candidates.select("query_id", "id").join(unit_queries, "query_id").join(vectors, "id")
        exact = looked.select("query_id", "id", F.round(dot(F.col("asked"), F.col("vector")) / F.sqrt(dot(F.col("asked"), F.col("asked"))), 6).alias("score"))
        return R.top(exact, ["query_id"], k, tie="id")

    def possible(self, asked: DataFrame, codes: DataFrame, shared: Broadcast, k: int) -> DataFrame:
        """query_id and id of every row that may be among the k nearest of a query. Blocks of queries meet parts of all rows; a row's code is off by half a step in each
        dimension at most, so what its score could be at best is below what k others have at least, or it is given."""
        n, wide = asked.count(), shared.value.shape[1]
        blocks = max(1, math.ceil(n / EXACT_QUERIES))
        parts = max(1, math.ceil(codes.count() / max(1, min(EXACT_ROWS, EXACT_BYTES // (8 * max(1, wide))))))

        def met(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            names = ("query_id", "id", "least", "most")
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], pa.int64() if c.endswith("id") else pa.float64()) for c in names})
            q = unit(matrix(left["vector"].combine_chunks()))
            code = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(right.num_rows, -1)
            low, step = (np.asarray(right[c].combine_chunks())[:, None] for c in ("low", "step"))
            x = shared.value[np.asarray(right["cell"].combine_chunks())] + low + code * step
            off = math.sqrt(wide) * step[:, 0] / 2 + SLACK
            ids, own, out = np.asarray(right["id"].combine_chunks()), np.asarray(left["query_id"].combine_chunks()), []
            for a in range(0, len(q), 64):
                score = q[a : a + 64] @ x.T
                least = score - off
                floor = np.partition(least, -k, axis=1)[:, -k][:, None] if least.shape[1] > k else np.full((len(score), 1), -np.inf)
                at, row = np.nonzero(~(score + off < floor))
                out.append((own[a + at], ids[row], least[at, row], score[at, row] + off[row]))
            return pa.table({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(names)})

        block, part = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        left = asked.withColumn("block", block).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = codes.select("id", "code", "low", "step", "cell", part.alias("share")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(met, "query_id long, id long, least double, most double")
        own = Window.partitionBy("query_id")
        found = found.withColumn("place", F.row_number().over(own.orderBy(F.desc("least"))))
        return found.withColumn("floor", F.min(F.when(F.col("place") == k, F.col("least"))).over(own)).where("floor is null or most >= floor").select("query_id", "id")
