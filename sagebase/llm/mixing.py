"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebase.llm.common import WHITESPACE_WORD, Scratch, table

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Documents that a permuted block holds at most, about; the number of blocks follows the rows.
BLOCK_ROWS = 1024
#: Turns in which later documents that fit fill what the last pass leaves open.
FILLS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WHITESPACE_WORD)), F.lit(0)).cast("long")


def targets(per_source: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """Target words of each source: by weight, at most `cap` times its size, the excess reshared by weight.

    Ordered by the ratio of cap to weight, the sources that stop at their cap come first. For each position the
    level that the others would get is known from running sums; the first position whose own ratio isn't
    below it gives the level of all that follow. Windows here run over one row for each source.
    """
    kinds = F.array(*[F.lit(w) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = per_source.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.element_at(kinds, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    rows = (
        rows.withColumn("all_words", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left", F.col("all_words") * share - F.col("capped"))
        .withColumn("fits", F.col("most") * F.col("open") >= F.col("left") * F.col("weight"))
        .withColumn("nth", F.row_number().over(by_ratio))
    )
    fitting = F.when(F.col("fits"), F.col("nth"))
    at = F.min_by(F.struct("left", "open", "nth"), fitting).over(Window.partitionBy())
    rows = rows.withColumn("level", at)
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("level").isNull() | (F.col("nth") < F.col("level.nth")), F.col("most").cast("double"))
        .otherwise(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level.left") / F.col("level.open")))
        .alias("target"),
    )


def draw(counts: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `want` blocks, drawn without replacement, come from each source: a multivariate hypergeometric draw."""
    if int(counts.sum()) < 10**9:
        return rng.multivariate_hypergeometric(counts, want, method="marginals")
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts):  # the chain of univariate draws, which has no such limit
        rest -= int(n)
        out[i] = got = rng.hypergeometric(int(n), rest, want) if want and n else 0
        want -= int(got)
    return out


def split(counts: np.ndarray, capacities: np.ndarray, rng: np.random.Generator, first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """The splitting tree: shard number and exact block quotas of the sources, for each leaf.

    A node halves its shards; how many blocks of each source go left is a multivariate hypergeometric
    draw of as many blocks as the left shards hold, so every leaf is a uniform sample without replacement.
    """
    if len(capacities) == 1:
        yield first, counts
        return
    half = len(capacities) // 2
    left = draw(counts, int(capacities[:half].sum()), rng)
    yield from split(left, capacities[:half], rng, first)
    yield from split(counts - left, capacities[half:], rng, first + half)


def quotas(n_shards: int, seed: int):
    """rank and, for each shard, how many of the source's blocks that shard and those before it draw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"rank": [], "draws": []})]).sort_values("rank")
        counts = rows["draws"].to_numpy(np.int64)
        total = int(counts.sum())
        capacities = np.diff(np.arange(n_shards + 1) * total // n_shards)
        leaves = np.zeros((n_shards, len(counts)), np.int64)
        for shard, quota in split(counts, capacities, np.random.default_rng(seed)):
            leaves[shard] = quota
        yield pd.DataFrame({"rank": rows["rank"].to_numpy(np.int64), "dealt": list(np.cumsum(leaves, axis=0).T)})

    return run


def running(blocks: DataFrame, scratch: Scratch, sums: dict[str, str]) -> DataFrame:
    """Sums over a source's earlier blocks: within coarse ranges of blocks, and over the ranges before. No window has all blocks of a large source."""
    fine = Window.partitionBy("rank", "coarse").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    top = Window.partitionBy("rank").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("coarse", F.expr("substring(block, 1, length(block) - 2)"))
    ranges = blocks.groupBy("rank", "coarse").agg(*[F.sum(c).alias(f"{name}_all") for name, c in sums.items()])
    ranges = ranges.select("rank", "coarse", *[F.coalesce(F.sum(f"{name}_all").over(top), F.lit(0)).alias(f"{name}_base") for name in sums])
    blocks = blocks.select("*", *[F.coalesce(F.sum(c).over(fine), F.lit(0)).alias(name) for name, c in sums.items()])
    found = blocks.join(ranges, ["rank", "coarse"]).withColumns({name: F.col(name) + F.col(f"{name}_base") for name in sums})
    return scratch.write(found.drop("coarse", *[f"{name}_base" for name in sums]), "running")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    n_shards: int = 16,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often the mix takes each document, and into which output shards.

    Every source's documents are permuted by the md5 of id and seed and cut into blocks of that order. A
    source whose target is p sizes and a rest draws each block p times and once more those that begin within the rest: its exact block
    quota. `split` deals the quotas to the shards; a shard draws the next blocks of each source's order, as many as its leaf says, and takes their
    documents (of the last pass those that end within the rest). What is then open is filled by later documents that fit, in their order, in FILLS
    turns, and by the one whose size is nearest to the remainder where that brings the words nearer to the target; they go to the shard that drew the
    source's last block. No document is taken more than `cap` times. `order_key` shuffles a shard.

    Returns doc_id, size, source_size, target, taken, copies, shards (one for each copy, from the leaves), order_key, and the columns of `carry`
    (which order rows that are equal in id and size). Everything depends on ids, sizes, sources and the seed only, so reruns agree.

    Edge cases: a null text counts 0 words; null is a source of its own, last; rows of a repeated id
    are separate documents (equal ones are interchangeable); a document without words is taken as often as its
    neighbours in the order and adds nothing; very long texts are documents like others; a table without words has targets 0; an empty table gives no rows;
    only the named columns are read.

    Windows and tasks see blocks of documents, ranges of blocks, or one row for each source (targets and the tree), never all rows of a source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary")).alias("order_key"),
        F.struct(*[F.col(c) for c in carry], F.lit(0).alias("none_")).alias("carry"),
    )
    narrow = scratch.write(narrow, "sizes")
    digits = 2
    while narrow.count() > BLOCK_ROWS * 16**digits:
        digits += 1
    narrow = narrow.withColumn("block", F.substring("order_key", 1, digits))

    per_source = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    per_source = per_source.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per_source = per_source.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    per_source = scratch.write(per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")), "targets")

    blocks = narrow.groupBy("source", "block").agg(F.sum("size").alias("words"), F.lit(1).cast("long").alias("one"))
    blocks = blocks.alias("b").join(per_source.alias("s"), F.expr("b.source <=> s.source")).select("b.*", "s.source_size", "s.target", "s.passes", "s.rest", "s.rank")
    blocks = running(blocks, scratch, {"before": "words", "place": "one"})
    # A rest beyond the block's start can take some of its documents.
    blocks = blocks.withColumn("partly", (F.col("before") < F.col("rest")).cast("long"))
    draws = blocks.groupBy("rank").agg(F.count("*").alias("n_blocks"), F.sum(F.col("passes") + F.col("partly")).alias("draws"), F.sum("partly").alias("n_partly"))
    # One task sees one row for each source, never blocks or documents.
    leaves = draws.select("rank", "draws").coalesce(1).mapInPandas(quotas(n_shards, seed), "rank long, dealt array<long>")
    leaves = scratch.write(draws.join(leaves, "rank"), "leaves")
    blocks = blocks.join(leaves, "rank")
    # The shard of a draw is the first whose leaf reaches it: pass after pass, the source's blocks in order.
    shard_of = "size(filter(dealt, h -> h <= {}))"
    passes = F.expr(f"case when passes + partly > 0 then transform(sequence(0, cast(passes + partly as int) - 1), p -> {shard_of.format('p * n_blocks + place')}) else array() end")
    blocks = blocks.withColumn("drawn", passes).withColumn("last_shard", F.expr(shard_of.format("draws - 1")))
    blocks = scratch.write(blocks.select("rank", "source", "block", "source_size", "target", "passes", "rest", "before", "drawn", "n_partly", "last_shard"), "blocks")

    within = Window.partitionBy("rank", "block").orderBy("order_key", "doc_id", "size", "carry").rowsBetween(Window.unboundedPreceding, 0)
    rows = narrow.alias("n").join(blocks.alias("b"), F.expr("n.source <=> b.source and n.block = b.block"))
    rows = rows.select("n.doc_id", "n.size", "n.order_key", "n.carry", "b.rank", "b.block", "b.source_size", "b.target", "b.passes", "b.rest", "b.before", "b.drawn", "b.n_partly", "b.last_shard")
    rows = rows.withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size"))
    rows = rows.withColumn("end", F.col("start") + F.col("size")).withColumn("whole", (F.col("end") <= F.col("rest")) & (F.col("rest") > 0))
    rows = scratch.write(rows, "ordered")
    picked = fillers(rows, scratch)
    rows = rows.join(picked, ["rank", "block", "start"], "left")
    fills = F.coalesce((F.col("picked")) & (F.col("size") > 0), F.lit(False))
    shards = F.expr("slice(drawn, 1, cast(passes as int) + cast(whole as int))")
    rows = rows.withColumn("shards", F.when(fills, F.concat(shards, F.array("last_shard"))).otherwise(shards)).withColumn("copies", F.size("shards"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "shards", "order_key", *[f"carry.{c}" for c in carry])


def fillers(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rank, block and start of the documents beyond the last pass that fill what it leaves open."""
    gaps = rows.where("n_partly > 0").groupBy("rank").agg((F.first("rest") - F.coalesce(F.max(F.when(F.col("whole"), F.col("end"))), F.lit(0))).alias("gap"))
    places = scratch.write(rows.select("rank", "block").distinct(), "places")

    def with_gap(candidates: DataFrame, gaps: DataFrame) -> DataFrame:
        # By blocks: documents are never dealt by their source alone.
        return candidates.join(places.join(gaps, "rank"), ["rank", "block"])

    gaps = scratch.write(gaps.where("gap > 0"), "gaps")
    left = with_gap(rows.where("not whole and size > 0").select("rank", "block", "start", "size"), gaps).where("size < 2 * gap").drop("gap")
    left = scratch.write(left, "open")
    taken = None
    for _ in range(FILLS):
        fitting = with_gap(left, gaps).where("size <= gap")
        blocks = running(fitting.groupBy("rank", "block").agg(F.sum("size").alias("words")), scratch, {"before": "words"})
        order = Window.partitionBy("rank", "block").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
        fitting = fitting.join(blocks.select("rank", "block", "before"), ["rank", "block"]).withColumn("end", F.col("before") + F.sum("size").over(order))
        new = scratch.write(fitting.where("end <= gap").select("rank", "block", "start", "end"), "fitting")
        taken = new if taken is None else taken.unionByName(new)
        used = new.groupBy("rank").agg(F.max("end").alias("used"))
        gaps = scratch.write(gaps.join(used, "rank", "left").select("rank", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
        left = scratch.write(left.join(new.select("rank", "block", "start"), ["rank", "block", "start"], "left_anti"), "open")
    miss = F.abs(F.col("size") - F.col("gap"))
    last = with_gap(left, gaps).where(miss < F.col("gap")).groupBy("rank").agg(F.min_by(F.struct("block", "start"), F.struct(miss, "start")).alias("at")).select("rank", "at.block", "at.start")
    return taken.select("rank", "block", "start").unionByName(last).withColumn("picked", F.lit(True))


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")
