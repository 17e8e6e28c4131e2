"""How filters interact, from a packed bitmap index (operator 11)."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebase.llm.common import HOT_ROWS, Scratch, column, map_arrow, null_safe_text, small_batches, strings, sums_by_run, table, tidied

#: The filters of the query, in the order of their bits. The last one needs the whole table.
FILTERS = "ABCDE"
SIGNS = b"#$%&*|"
#: Rows whose bits are packed together: 8 KiB a bitmap.
INDEX_ROWS = 65_536


def failures(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails (no nulls)."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    words = lists.flatten().dictionary_encode()
    codes = np.asarray(words.indices, dtype=np.int64)
    empty = np.asarray(pc.binary_length(words.dictionary)) == 0  # what stands before or after space at an end
    real = ~empty[codes] if len(codes) else np.zeros(0, bool)
    offsets -= offsets[0]
    n = sums_by_run(real.astype(np.int64), offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[real]
    pairs = np.sort(owner * (len(words.dictionary) + 1) + codes[real])
    first = np.append(True, pairs[1:] != pairs[:-1]) if len(pairs) else np.zeros(0, bool)
    distinct = np.bincount(pairs[first] // (len(words.dictionary) + 1), minlength=len(texts))
    at, data = strings(texts)
    at, data = at - at[0], data[at[0] : at[-1]]
    kind = np.zeros(256, np.int64)
    kind[ord("A") : ord("Z") + 1] = 1
    upper = sums_by_run(kind[data], at)
    kind[:] = 0
    kind[list(SIGNS)] = 1
    signs = sums_by_run(kind[data], at)
    points = np.asarray(pc.utf8_length(texts), dtype=np.int64)
    return (n < 200) + 2 * (100 * distinct < 50 * n) + 4 * (100 * upper > 2 * points) + 8 * (signs > 0)


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, bits (of A to D), and 128 bits of the text's hash as two longs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = column(batch, "text")
            at, data = strings(texts)
            view = memoryview(np.ascontiguousarray(data))
            digest = np.frombuffer(b"".join(hashlib.blake2b(view[a:z], digest_size=16).digest() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64)
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "part"), pa.array(failures(texts).astype(np.int32)), pa.array(digest[0::2]), pa.array(digest[1::2])], names=["doc_id", "part", "bits", "h1", "h2"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), null_safe_text(text_col).alias("text"))
    return map_arrow(rows, make, f"doc_id {kind}, part string, bits int, h1 long, h2 long")


class BitmapIndex:
    """Packed bitmaps of some rows: one for each filter, label and part."""

    def __init__(self, part: pa.Array, fails: np.ndarray, good: np.ndarray, toxic: np.ndarray, n_filters: int):
        encoded = part.dictionary_encode()
        self.parts = encoded.dictionary.to_pylist()
        code = np.asarray(encoded.indices, dtype=np.int64)
        order = np.argsort(code, kind="stable")  # a part's rows lie together, so its bitmap is a few words long
        self.bound = np.searchsorted(code[order], np.arange(len(self.parts) + 1))
        self.filters = [self.packed((fails[order] >> k) & 1) for k in range(n_filters)]
        self.good, self.toxic = self.packed(good[order]), self.packed(toxic[order])

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        raw = np.packbits(bits.astype(bool), bitorder="little")
        return np.pad(raw, (0, -len(raw) % 8)).view(np.uint64)

    def counts(self, k: int) -> np.ndarray:
        """Of part k, for each set of filters (bit i: filter i is in it): rows that pass all of them, and how many of these are good and toxic."""
        a, z = int(self.bound[k]), int(self.bound[k + 1])
        words = slice(a >> 6, (z + 63) >> 6)
        own = np.full(words.stop - words.start, ~np.uint64(0))
        own[0] &= ~np.uint64(0) << np.uint64(a & 63)
        own[-1] &= ~np.uint64(0) >> np.uint64(-z & 63)
        left, out = [own], np.zeros((1 << len(self.filters), 3), np.int64)
        for s in range(1 << len(self.filters)):
            if s:  # what the set without its last filter leaves, AND NOT that filter
                last = s.bit_length() - 1
                left.append(left[s ^ (1 << last)] & ~self.filters[last][words])
            out[s] = [int(np.bitwise_count(x).sum()) for x in (left[s], left[s] & self.good[words], left[s] & self.toxic[words])]
        return out


def subset_counts(rows: DataFrame, n_filters: int) -> DataFrame:
    """part, subset, kept, kept_good, kept_toxic: rows that pass all filters of a subset. rows: part, fails (bits), good, toxic (booleans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def add(held: list[pa.RecordBatch]) -> None:
            block = pa.concat_batches(held)
            plain = lambda name: np.asarray(column(block, name), dtype=np.int64)
            index = BitmapIndex(column(block, "part"), plain("fails"), plain("good"), plain("toxic"), n_filters)
            for k, part in enumerate(index.parts):
                total[part] = total.get(part, 0) + index.counts(k)

        def given() -> Iterator[pa.RecordBatch]:
            for part, counts in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(counts)), pa.array(range(len(counts)), pa.int32()), *map(pa.array, counts.T)], names=["part", "subset", "kept", "kept_good", "kept_toxic"])
            total.clear()

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= INDEX_ROWS:
                add(held)
                held, size = [], 0
                if len(total) > 1000:  # of many parts, partial sums leave the task early
                    yield from given()
        if size:
            add(held)
        yield from given()

    found = rows.select("part", "fails", F.col("good").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic"))
    found = found.mapInArrow(tidied(run), "part string, subset int, kept long, kept_good long, kept_toxic long")
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "kept_good", "kept_toxic")])


def interactions(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """What each filter does at each step of every order, by part, from the counts of subsets.

    Orders and steps are those of the filters' names (5 filters: 600 rows a part). An order's prefix is a subset, so removed rows are the
    difference of two counts, and nothing is counted again.
    """
    n, every = len(names), (1 << len(names)) - 1
    steps = []
    for order in itertools.permutations(range(n)):
        for i, k in enumerate(order):
            before = sum(1 << x for x in order[:i])
            steps.append({"filter_order": "".join(names[x] for x in order), "step": i + 1, "filter": k, "before": before})
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:int,before:int>>")
    maps = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("subset", c))).alias(c) for c in ("kept", "kept_good", "kept_toxic")])
    bit = F.expr("shiftleft(1, filter)")
    lost = lambda c: F.col(c)[F.col("before")] - F.col(c)[F.col("before").bitwiseOR(bit)]
    return maps.select("*", F.inline(steps)).select(
        "part",
        "filter_order",
        "step",
        "filter",
        F.col("kept")[F.col("before").bitwiseOR(bit)].alias("kept"),
        lost("kept").alias("removed"),
        (F.col("kept")[F.lit(0)] - F.col("kept")[bit] - lost("kept")).alias("redundant"),
        (F.col("kept")[F.lit(every) - bit] - F.col("kept")[F.lit(every)]).alias("unique_fails"),
        lost("kept_good").alias("good_lost"),
        lost("kept_toxic").alias("toxic_lost"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For every part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A text fails A with under 200 words, B if under half of its words are different, C if over 2 % of its characters are
    A-Z, D if it holds one of `#$%&*|`, E if a row with a smaller id has the same text. Texts are compared by 128 bits of their hash; only
    ids, parts, bits and hashes are shuffled.

    Edge cases: a null text is an empty one, a null part the empty string; rows of a repeated id count each and don't repeat one another;
    a null id is larger than all others; an id with several labels has each that any of its rows gives; an empty table gives no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "audit")
    rows = scratch.write(measured(docs, id_col, text_col, part_col), "measured")
    firsts = scratch.write(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    # Texts of more than a thousandth of the rows are fewer than a thousand and go by broadcast.
    often = F.col("n") > max(HOT_ROWS, rows.count() // 1000)
    hot = firsts.where(often).drop("n")
    seldom = rows.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(firsts.where(~often).drop("n").hint("merge"), ["h1", "h2"], "left")
    found = seldom.unionByName(rows.join(F.broadcast(hot), ["h1", "h2"]))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = found.join(marks.hint("merge"), "doc_id", "left")
    again = F.coalesce((F.col("first") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("first").isNotNull()), F.lit(False))
    joined = joined.select("part", (F.col("bits") + F.when(again, 16).otherwise(0)).alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    counts = scratch.write(subset_counts(joined, len(FILTERS)), "counts")
    scratch.drop(rows, firsts)
    found = interactions(counts)
    shares = found.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return found.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, coalesce(source, '') as part,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), f as (
  select part, coalesce(good, 0) as good, coalesce(l.toxic, 0) as toxic,
    case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when min(d.doc_id) over (partition by t) < d.doc_id then 16 else 0 end as fails
  from d left join l on l.doc_id = d.doc_id
), p as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all
), x(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from x a, x b, x c, x d, x e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s as (
  select filter_order, k::int as step, bits[k] as bit, coalesce(list_sum(bits[1 : k - 1]), 0)::int as earlier from o, range(1, 6) r(k)
), r as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (fails & (earlier + bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (fails & earlier = 0 and fails & bit > 0), 0)::bigint as removed,
    coalesce(sum(n) filter (fails & earlier > 0 and fails & bit > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (fails = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (fails & earlier = 0 and fails & bit > 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (fails & earlier = 0 and fails & bit > 0), 0)::bigint as toxic_lost
  from p, s group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, bit)::bigint as shapley
from r
"""
