"""Near duplicates among embeddings: spherical k-means cells and blocked cosine products (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, column, small_batches, table
from sagebase.llm.graph import components, roots

COSINE = 0.9
#: Cells that a vector goes to: so many, and one more for each doubling of the cells beyond 16.
PROBES = 3
#: Vectors, and bytes of vectors, that the cells' centres are fitted on; rows of a block of products.
SAMPLE_ROWS, SAMPLE_BYTES, BLOCK_ROWS, STEP_ROWS = 20_000, 32 << 20, 4000, 1000


def centres(rows: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors; an empty cell restarts at a drawn row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(rows))
    at = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        own = (rows @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), rows[rng.integers(0, len(rows), k)])
    return at


def vectors(values: pa.Array, width: int) -> np.ndarray:
    """Unit rows in double precision of vectors of one width."""
    flat = np.asarray(values.flatten(), dtype=np.float64).reshape(-1, width)
    # Scaled first: squares of very small or very large components would leave the range.
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def probes_for(cells: int) -> int:
    return min(cells, PROBES + max(0, math.ceil(math.log2(max(1, cells))) - 4))


def near_duplicates(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """Links of cosine `cosine` or more among all vectors: vec_id, n_links, component_id, kept.

    Equal vectors are reduced to one with its number. Every distinct vector goes to the `probes` cells whose centres are
    nearest (by default as many as PROBES says; with 0 all vectors are one cell and every pair is compared: exact, at the square of the
    rows); two vectors are compared if they share a cell, and counted in the least cell they share. A cell of
    many rows is cut into blocks, and pairs of blocks are tasks. Tasks return link counts and one link for each vector
    to the least one it reaches there, never pairs. Cells grow in number with the root of the rows, up to an eighth of the sample; centres are fitted on
    that bounded sample, all else covers all rows.

    Edge cases: a vector that is null, empty or zero or holds null or non-finite components has no links and is its own
    component, as is one with a null id (its component is null and it isn't kept); vectors of different lengths never link; rows of
    a repeated id are one node of the components, and rows with equal vectors link; an empty table gives no rows; only the two named columns are read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "embeddings")
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    base = base.withColumn("usable", F.coalesce(F.col("vec_id").isNotNull() & v.isNotNull() & finite, F.lit(False)))
    keys = ["k1", "k2", "width"]
    keyed = base.select("vec_id", "usable", F.when(F.col("usable"), v).alias("v"), F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"), F.size("v").alias("width"))
    distinct = keyed.where("usable").groupBy(*keys).agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.first("v").alias("v"))
    distinct = scratch.write(distinct, "distinct")
    sizes = {r.width: r.n for r in distinct.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()}
    if not sizes:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    (width, n), = sizes.items()
    bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    drawn = distinct.where(F.col("width") == width).orderBy("k1", "id").limit(bound).select("v").toArrow()
    k = 1 if probes == 0 else max(1, min(math.ceil(math.sqrt(n) / 4), len(drawn) // 8))
    at = centres(vectors(drawn["v"].combine_chunks(), width), k)
    own_cells = min(probes or probes_for(len(at)), len(at))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(column(batch, "width"), dtype=np.int64)
            cells = np.zeros((len(lengths), 0), np.int64)
            picks: list[np.ndarray] = [np.zeros(1, np.int64)] * len(lengths)
            usual = np.flatnonzero(lengths == width)
            if len(usual):
                x = vectors(column(batch, "v").take(pa.array(usual)), width)
                p = own_cells
                cells = np.sort(np.argpartition(-(x @ at.T), p - 1, axis=1)[:, :p], axis=1)
                for i, c in zip(usual.tolist(), cells, strict=True):
                    picks[i] = c
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in picks])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(picks), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("id", "times", "width", "v")), lists], names=["id", "times", "width", "v", "cells"])

    kind = rows.schema[vector_col].dataType.simpleString()
    placed = scratch.write(distinct.select("id", "times", "width", "v").mapInArrow(assign, f"id long, times long, width int, v {kind}, cells array<int>"), "placed")
    exploded = placed.withColumn("cell", F.explode("cells"))
    # One row for each cell: their number is the root of the rows' at most.
    blocks = placed.select("width", F.explode("cells").alias("cell")).groupBy("width", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = scratch.write(blocks, "cells")
    pairs = exploded.join(blocks, ["width", "cell"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = pairs.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def compare(group: pa.Table) -> pa.Table:
        size, cell = group["width"][0].as_py(), group["cell"][0].as_py()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        group = group.sort_by("mine")
        mine, ids, times = (np.asarray(group[c].combine_chunks(), dtype=np.int64) for c in ("mine", "id", "times"))
        x = vectors(group["v"].combine_chunks(), size)
        first = group["cells"].combine_chunks()
        cells = [np.asarray(c.values) for c in first] if size == width else [np.zeros(1, np.int64)] * len(ids)
        table_ = np.full((len(ids), max(map(len, cells))), -1, np.int64)
        for r, c in enumerate(cells):
            table_[r, : len(c)] = c
        left = np.flatnonzero(mine == i)
        right = np.flatnonzero(mine == j)
        links = np.zeros(len(ids), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in range(0, len(left), STEP_ROWS):
            l = left[s : s + STEP_ROWS]
            for t in range(0, len(right), STEP_ROWS):
                r = right[t : t + STEP_ROWS]
                p, q = np.nonzero(x[l] @ x[r].T >= cosine)
                p, q = l[p], r[q]
                if i == j:
                    p, q = p[p < q], q[p < q]
                if not len(p):
                    continue
                # The least cell that both have must be this one, else another group counts the pair.
                least = np.full(len(p), 1 << 40)
                for c in range(table_.shape[1]):
                    own = table_[p, c]
                    shared = (own >= 0) & (table_[q] == own[:, None]).any(axis=1)
                    least = np.where(shared, np.minimum(least, own), least)
                here = least == cell
                p, q = p[here], q[here]
                links += np.bincount(p, times[q], len(ids)).astype(np.int64) + np.bincount(q, times[p], len(ids)).astype(np.int64)
                a, b = roots(np.concatenate([a, ids[p]]), np.concatenate([b, ids[q]]))
        least_of = dict(zip(a.tolist(), b.tolist(), strict=True))
        some = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[some]), "links": pa.array(links[some]), "root": pa.array([least_of[k] for k in ids[some].tolist()], pa.int64())})

    found = pairs.select("width", "cell", "i", "j", "mine", "id", "times", "v", "cells").groupBy("width", "cell", "i", "j").applyInArrow(compare, "id long, links long, root long")
    found = scratch.write(found, "found")
    tree = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    of = distinct.select(*keys, "id", "times").join(counts, "id", "left").join(tree, F.col("id") == F.col("node"), "left")
    of = scratch.write(of.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("root", "id").alias("top")).where("n > 0"), "linked")
    out = keyed.select("vec_id", *[F.when(F.col("usable"), F.col(k)).alias(k) for k in keys]).join(of, keys, "left")
    top = F.coalesce("top", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), F.coalesce(F.col("vec_id") == top, F.lit(False)).alias("kept"))


def op4_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
