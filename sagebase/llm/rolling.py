"""Rolling exact median and median absolute deviation by persistent segment trees (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebase.llm.common import column, small_batches, table, tidied

WINDOW_US = 15 * 60 * 1_000_000
#: Rows from which on collected cells get a tree; small trees stay in the processor's caches.
TREE_ROWS = 8192
#: Cents beyond this count as none: four times a value has to fit into a long.
MOST_CENTS = float(1 << 59)


class RankTree:
    """A persistent segment tree over the ranks of values: one version after each insertion.

    Insertion i copies the path to its rank: node i * (depth + 1) + d + 1 at depth d; node 0 is the empty tree. The other child of a copied node is
    that of the latest earlier path through the same node, so it is found for all insertions of a depth at once.
    """

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        self.values, rank = np.unique(values, return_inverse=True)
        self.depth = max(1, int(len(self.values) - 1).bit_length())
        n, stride = len(values), self.depth + 1
        self.child = np.zeros((2, n * stride + 1), np.int64)
        self.count = np.zeros(n * stride + 1, np.int64)
        order, at = np.arange(n), np.arange(n)  # by prefix, then by insertion
        for d in range(stride):
            node = order * stride + d + 1
            prefix = rank[order] >> (self.depth - d)
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if n else at
            begin = np.repeat(first, np.diff(np.append(first, n)))
            total = np.cumsum(weights[order])
            self.count[node] = total - (total - weights[order])[begin]
            if d == self.depth:
                break
            bit = (rank[order] >> (self.depth - d - 1)) & 1
            for side in (0, 1):
                last = np.maximum.accumulate(np.where(bit == side, at, -1))
                self.child[side, node] = np.where(last >= begin, order[last] * stride + d + 2, 0)
            # The next depth: each prefix falls into its two halves, insertions stay in order.
            order = order[np.lexsort((bit, begin))]
        self.root = np.concatenate([[0], np.arange(n) * stride + 1])  # of the version after so many insertions

    def size(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Weight that versions `high` have above versions `low`."""
        return self.count[self.root[high]] - self.count[self.root[low]]

    def select(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value at place k (from 0) of what was inserted between two versions."""
        a, b, rank, k = self.root[low], self.root[high], np.zeros(len(k), np.int64), k.copy()
        for _ in range(self.depth):
            left_a, left_b = self.child[0, a], self.child[0, b]
            left = self.count[left_b] - self.count[left_a]
            right = k >= left
            k -= np.where(right, left, 0)
            a, b = np.where(right, self.child[1, a], left_a), np.where(right, self.child[1, b], left_b)
            rank = 2 * rank + right
        return self.values[rank]

    def below(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Weight of the ranks under `rank` between two versions."""
        a, b, out = self.root[low], self.root[high], np.zeros(len(rank), np.int64)
        for d in range(self.depth):
            left_a, left_b = self.child[0, a], self.child[0, b]
            right = (rank >> (self.depth - d - 1)) & 1 == 1
            out += np.where(right, self.count[left_b] - self.count[left_a], 0)
            a, b = np.where(right, self.child[1, a], left_a), np.where(right, self.child[1, b], left_b)
        return np.where(rank >= 1 << self.depth, self.size(low, high), out)


def medians(tree: RankTree, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the median, and four times the median deviation from it, of each window (versions low to high, none empty)."""
    n = tree.size(low, high)
    k = (n + 1) // 2  # the lower middle value, from 1
    even = n % 2 == 0
    lower = tree.select(low, high, k - 1)
    middle = lower + np.where(even, tree.select(low, high, n // 2), lower)
    # Any k neighbours in order hold the k-th smallest deviation below their largest: a bound that outliers don't move.
    start = (n - k) // 2
    most = np.maximum(middle - 2 * tree.select(low, high, start), 2 * tree.select(low, high, start + k - 1) - middle)

    def within(radius: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight below, and weight below and inside, of |2 * value - middle| <= radius."""
        first = np.searchsorted(tree.values, -((radius - middle[at]) // 2), "left")
        last = np.searchsorted(tree.values, (middle[at] + radius) // 2, "right")
        return tree.below(low[at], high[at], first), tree.below(low[at], high[at], last)

    least = np.full(len(n), -1, np.int64)  # radius that is too small
    open_ = np.arange(len(n))
    while len(open_ := open_[most[open_] - least[open_] > 1]):
        radius = (most[open_] + least[open_]) // 2
        under, upto = within(radius, open_)
        enough = upto - under >= k[open_]
        most[open_] = np.where(enough, radius, most[open_])
        least[open_] = np.where(enough, least[open_], radius)
    under, upto = within(most, np.arange(len(n)))
    # For an even number the next deviation counts too: the same one again, or the nearest value outside.
    far = np.iinfo(np.int64).max
    before = np.where(under > 0, middle - 2 * tree.select(low, high, np.maximum(under - 1, 0)), far)
    after = np.where(upto < n, 2 * tree.select(low, high, np.minimum(upto, n - 1)) - middle, far)
    following = np.where(upto - under > k, most, np.minimum(before, after))
    return middle, most + np.where(even, following, most)


def windows(cell: np.ndarray, ts: np.ndarray, value: np.ndarray, weight: np.ndarray, own: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """For each different time that is its cell's own: its last row, n, median2, mad4 (0 where n is 0).

    cell: numbers of the cells, ascending; ts ascends inside a cell. Rows of weight 0 have no value. All cells share one tree: windows don't
    reach over a cell's first row.
    """
    last = np.append((ts[1:] != ts[:-1]) | (cell[1:] != cell[:-1]), True)
    at = np.flatnonzero(last & own)
    begin = np.searchsorted(cell, cell[at], "left")
    # One ascending key of cell and time, to find the first row later than the window's open end.
    gap = np.concatenate([[0], np.where(cell[1:] != cell[:-1], 2 * span + 1, np.minimum(ts[1:] - ts[:-1], 2 * span + 1))]).cumsum()
    low = np.maximum(begin, np.searchsorted(gap, gap[at] - span, "right"))
    real = np.concatenate([[0], np.cumsum(weight > 0)])
    low, high = real[low], real[at + 1]
    some = weight > 0
    n = middle = spread = np.zeros(len(at), np.int64)
    if some.any():
        tree = RankTree(value[some], weight[some])
        n = tree.size(low, high)
        full = np.flatnonzero(n)
        middle, spread = np.zeros((2, len(at)), np.int64)
        middle[full], spread[full] = medians(tree, low[full], high[full])
    return at, n, middle, spread


def micros(df: DataFrame, name: str) -> F.Column:
    """Microseconds since 1970; of timestamps without a zone as they stand, whatever the session's zone."""
    c = f"`{name}`"
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        since = f"({c} - timestamp_ntz'1970-01-01 00:00:00')"
        return F.expr(f"((extract(day from {since}) * 24L + extract(hour from {since})) * 60 + extract(minute from {since})) * 60000000 + cast(extract(second from {since}) * 1000000 as bigint)")
    return F.unix_micros(c)


def rolling_median(rows: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """series, ts, n, median2, mad4 of every different time of a series.

    rows: series (string, null is one), ts (long, microseconds), cents (long or null). A window holds the series' cents later than its time minus
    `window_us` and up to it.

    Equal rows are counted before anything is sorted, so a time or value that many rows share is one row. Time is cut into cells as
    long as the window; a cell's task also gets the cell before it (the halo), and nothing else of the series. Cells are
    hash-partitioned and read in order; a task holds as many as fill a tree, or one with its halo if that is larger. No row goes through the
    driver, a broadcast, or a task for all.

    Edge cases: rows without cents ask and don't count; a window without cents has n 0 and null results; rows with a null ts
    have to be left out before; an empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    points = rows.groupBy("series", "ts", "cents").agg(F.count("cents").alias("weight"))
    own = F.expr(f"(ts - pmod(ts, {window_us})) div {window_us}")
    cells = points.select("series", F.explode(F.array(own, own + 1)).alias("cell"), "ts", "cents", "weight")
    cells = cells.repartition("series", "cell").sortWithinPartitions("series", "cell", "ts")
    schema = pa.schema([("series", pa.string()), ("ts", pa.int64()), ("n", pa.int64()), ("median2", pa.int64()), ("mad4", pa.int64())])

    def measured(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        """The windows of whole cells."""
        rows = pa.concat_batches(held)
        series, plain = column(rows, "series"), lambda name: np.asarray(column(rows, name).fill_null(0))
        cell, ts, weight = plain("cell"), plain("ts"), plain("weight")
        if not len(ts):
            return None
        number = np.cumsum(changes(None, rows))
        at, n, middle, spread = windows(number, ts, plain("cents"), weight, ts >= cell * window_us, window_us)
        if not len(at):
            return None
        none = n == 0
        return pa.RecordBatch.from_arrays([series.take(pa.array(at)), pa.array(ts[at]), pa.array(n), pa.array(middle, mask=none), pa.array(spread, mask=none)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(changes(before, batch))
            if size + batch.num_rows >= TREE_ROWS and len(starts):
                cut = int(starts[-1])  # the last cell waits for the rest of its rows
                if (out := measured([*held, batch.slice(0, cut)])) is not None:
                    yield out
                held, size = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
            before = batch.slice(batch.num_rows - 1)
        if held and (out := measured(held)) is not None:
            yield out

    return cells.mapInArrow(tidied(run), "series string, ts long, n long, median2 long, mad4 long")


def changes(before: pa.RecordBatch | None, rows: pa.RecordBatch) -> np.ndarray:
    """Where another series or cell begins than that of the row before; without a row before, the first begins none."""
    both = pa.Table.from_batches([b for b in (before, rows) if b is not None])
    code, cell = np.asarray(both["series"].combine_chunks().dictionary_encode("encode").indices), np.asarray(both["cell"])
    new = (code[1:] != code[:-1]) | (cell[1:] != cell[:-1])
    return new if before is not None else np.append(False, new)


def click_medians(clicks: DataFrame, window_us: int = WINDOW_US, id_col: str = "click_id", time_col: str = "ts", series_col: str = "kind", value_col: str = "value") -> DataFrame:
    """Each click once with its window's n, median2 and mad4, and whether its own cents are far from the median.

    Edge cases: of an id's rows that differ the least (time, series, cents; a null time last, other nulls first) counts, and null is an id like others;
    clicks with a null time are dropped; a null series is a series; a null, infinite or NaN value (or one over 2^59 cents) has no
    cents; an empty table gives no rows. Only the four named columns are read.
    """
    scaled = F.floor(F.lit(100) * F.col(value_col).cast("double") + F.lit(0.5))
    fits = F.abs(F.lit(100) * F.col(value_col).cast("double")) < F.lit(MOST_CENTS)
    once = clicks.select(
        F.col(id_col).alias("click_id"), F.col(series_col).alias("series"), micros(clicks, time_col).alias("ts"), F.when(fits, scaled).cast("long").alias("cents")
    ).groupBy("click_id").agg(F.min(F.struct(F.col("ts").isNull().alias("no_time"), "ts", "series", "cents")).alias("row"))
    rows = once.select("click_id", F.col("row.ts").alias("ts"), F.col("row.series").alias("series"), F.col("row.cents").alias("cents")).where("ts is not null")
    found = rolling_median(rows, window_us).withColumnsRenamed({"series": "of_series", "ts": "of_ts"})
    # Many clicks may share a time; its window is one row, so a hot time is split by the adaptive join on the clicks' side alone.
    out = rows.join(found.hint("merge"), (F.col("ts") == F.col("of_ts")) & F.col("series").eqNullSafe(F.col("of_series")))
    return out.select("click_id", F.col("series").alias("kind"), "n", "median2", "mad4", F.when(F.col("n") > 0, F.expr("2 * abs(2 * cents - median2) > 2 * mad4")).alias("far"))


def op13_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_medians(table(spark, sf_dir, "clicks"))


OP13_SQL = """
with c as (
  select click_id, ts, kind, case when abs(100 * value) < 576460752303423488 then floor(100 * value + 0.5)::bigint end as cents from clicks
), e as (
  select * from c qualify row_number() over (partition by click_id order by ts nulls last, kind nulls first, cents nulls first) = 1
), w as (
  select click_id, kind, cents, list_sort(list(cents) filter (cents is not null) over (
    partition by kind order by ts range between interval '899.999999 seconds' preceding and current row)) as l
  from e where ts is not null
), m as (
  select *, coalesce(len(l), 0) as n, l[(len(l) + 1) // 2] + l[len(l) // 2 + 1] as median2 from w
), d as (
  select *, list_sort(list_transform(l, lambda x: abs(2 * x - median2))) as deviations from m
), f as (
  select *, deviations[(n + 1) // 2] + deviations[n // 2 + 1] as mad4 from d
)
select click_id, kind, n, median2, mad4, case when n > 0 then 2 * abs(2 * cents - median2) > 2 * mad4 end as far from f
"""
