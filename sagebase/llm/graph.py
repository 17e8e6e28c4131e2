"""Connected components of links, without bringing links or labels to the driver or into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, column


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links, and the least node that each can reach through them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):  # hook larger labels to smaller ones, then shorten all paths
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while (label[label] != label).any():
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[label]


def contract(edges: DataFrame) -> DataFrame:
    """Each partition's links as links between a node and the least node it reaches inside the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x = np.concatenate([a, np.asarray(column(batch, "a"), dtype=np.int64)])
            y = np.concatenate([b, np.asarray(column(batch, "b"), dtype=np.int64)])
            a, b = roots(x, y)
            a, b = a[a != b], b[a != b]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, reduced: bool = False) -> DataFrame:
    """node and root (the least node it reaches) for every node of the links (a, b).

    Rounds of hooking and contraction: each node takes its least smaller neighbour as parent, paths are
    shortened by joining parents to parents, links are rewritten to roots, and links that are left go another round.
    Links of a hot node are reduced to one for each partition before they move (unless they come `reduced` so), and equal links of several partitions to one.
    """
    mapping = None
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = scratch.write(contract((links if reduced else contract(links)).distinct()), "links")
    while True:
        parents = scratch.write(links.groupBy("a").agg(F.min("b").alias("b")), "parents")
        while True:  # b is a root once no link goes on from it
            up = parents.select(F.col("a").alias("m"), F.col("b").alias("root"))
            jumped = scratch.write(parents.join(up, F.col("b") == F.col("m"), "left").select("a", F.coalesce("root", "b").alias("b"), F.col("root").isNotNull().alias("moved")), "jumped")
            moved = jumped.where("moved").limit(1).count()
            scratch.drop(parents)
            parents = jumped
            if not moved:
                break
        flat = parents.select(F.col("a").alias("m"), F.col("b").alias("root"))
        if mapping is None:
            mapping = flat
        else:
            again = flat.select(F.col("m").alias("old"), F.col("root").alias("new"))
            mapping = scratch.write(mapping.join(again, F.col("root") == F.col("old"), "left").select("m", F.coalesce("new", "root").alias("root")).unionByName(flat), "mapping")
        one = links.join(flat, F.col("a") == F.col("m")).select(F.col("root").alias("x"), "b")
        two = one.join(flat, F.col("b") == F.col("m"), "left").select("x", F.coalesce("root", "b").alias("y")).where("x <> y")
        left = scratch.write(contract(two.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))), "left")
        scratch.drop(links)
        links = left
        if not links.limit(1).count():
            break
    # Roots that no link leaves point to themselves.
    tops = mapping.select(F.col("root").alias("m"), "root").distinct()
    return scratch.write(mapping.unionByName(tops).groupBy("m").agg(F.min("root").alias("root")).select(F.col("m").alias("node"), "root"), "components")
