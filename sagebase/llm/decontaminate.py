"""Benchmark decontamination by latent semantic retrieval (operator 1).

Texts become word numbers over the benchmark's vocabulary. A randomised SVD of the corpus' TF-IDF passages gives a
latent basis; passages near a benchmark item in it are candidates, and a longest common subsequence of words and a check
of the item's last part decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, column, small_batches, table, tidied
from sagebase.llm.toxicity import normal as normal_words
from sagebase.llm.toxicity import tokens

#: Words of half a passage; passages are two neighbouring halves, so each overlaps the next by one.
HALF = 32
RANK, AXIS_PASSAGES, SEED, COSINE, SCALING = 64, 8, 7, 0.55, 0.25
#: Words in a larger share of the passages, and in four times as many as the median word of the items, have no weight in the latent
#: space (they count in the subsequence like any other).
COMMON = 0.05
#: Share of an item's words in order that counts as a leak; the lower one needs the item's last part too.
LCS_SURE, LCS_PARAPHRASE, ANSWER = 0.8, 0.6, 0.5
#: Items with fewer words leak only where all of them stand one after another; these are looked up word by word, not through the latent space.
SHORT_ITEM = 8
#: Items, and words of items, that one round over the corpus looks for; more take more rounds.
ITEMS_A_ROUND, WORDS_A_ROUND = 20_000, 2_000_000


def normal(word: str) -> str:
    return normal_words(pa.array([word]))[0].as_py()


class Items:
    """A round's items as word numbers (from 1; 0 is any other word). Words that are signs or digits alone don't count, here and in documents."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        words, codes, bounds = tokens(pa.array([text for _, text in rows], pa.string()))
        names = normal_words(words).to_pylist()
        self.vocab: dict[str, int] = {}
        self.ids, self.words = [], []
        for (item_id, _), a, z in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = [self.vocab.setdefault(n, len(self.vocab) + 1) for k in codes[a:z].tolist() if (n := names[k])]
            if own:
                self.ids.append(item_id)
                self.words.append(np.array(own, np.int64))
        self.kind = np.uint16 if len(self.vocab) < 1 << 16 else np.uint32

    def passages(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Item numbers and words of the longer items' passages of up to 2 * HALF words."""
        owner, out = [], []
        for i, words in enumerate(self.words):
            for a in () if len(words) < SHORT_ITEM else range(0, max(1, len(words) - HALF), HALF):
                owner.append(i)
                out.append(words[a : a + 2 * HALF])
        return np.array(owner, np.int64), out


def encode(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id and the word numbers of each text that has any word of the benchmark."""
    kind, vocab = items.kind, docs.sparkSession.sparkContext.broadcast(items.vocab)  # a round's words: bounded by ITEMS_A_ROUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.array(list(vocab.value), pa.string())
        for batch in batches:
            words, codes, bounds = tokens(column(batch, "text"))
            names = normal_words(words).cast(pa.string())
            own = (np.asarray(pc.fill_null(pc.index_in(names, value_set=numbers), -1), dtype=np.int64) + 1).astype(kind)
            real = np.asarray(pc.greater(pc.binary_length(names), 0).cast(pa.int8()), dtype=np.int8).astype(bool)
            keep = real[codes] if len(codes) else np.zeros(0, bool)
            flat = own[codes[keep]] if len(codes) else np.zeros(0, kind)
            at = np.concatenate([[0], np.cumsum(keep)])[bounds]
            any_ = np.concatenate([[0], np.cumsum(flat > 0)])
            some = np.flatnonzero(any_[at[1:]] > any_[at[:-1]])
            size, raw = flat.itemsize, flat.tobytes()
            blobs = [raw[a * size : z * size] for a, z in zip(at[some].tolist(), at[some + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(pa.array(some)), pa.array(blobs, pa.binary())], names=["doc_id", "codes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidied(run), "doc_id long, codes binary")


def halves(blobs: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All word numbers, their half-passage, the first half of each text (one more at the end), and the word offsets of the texts."""
    parts = [np.frombuffer(b.as_py(), kind) for b in blobs]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    bounds = np.concatenate([[0], np.cumsum(n)])
    count = -(-n // HALF)
    first = np.concatenate([[0], np.cumsum(count)])
    codes = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    half = np.repeat(first[:-1], n) + (np.arange(len(codes)) - np.repeat(bounds[:-1], n)) // HALF
    return codes, half, first, bounds


def summed(df: DataFrame, work, shape: tuple[int, int]) -> np.ndarray:
    """The sum of a matrix that each task gathers over its batches. Rows of the matrix are added up on the executors, in groups."""
    rows, cols = shape
    each = max(1, (1 << 20) // (8 * cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            work(batch, total)
        if total.any():
            for a in range(0, rows, each):
                yield pa.RecordBatch.from_arrays([pa.array([a // each]), pa.array([total[a : a + each].tobytes()], pa.binary())], names=["part", "matrix"])

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in group:
            for part, matrix in zip(column(batch, "part").to_pylist(), column(batch, "matrix"), strict=True):
                m = np.frombuffer(matrix.as_buffer(), np.float64)
                sums[part] = sums[part] + m if part in sums else m.copy()
        for part, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["part", "matrix"])

    partial = df.mapInArrow(tidied(run), "part long, matrix binary")
    # First within groups of tasks, then by part: no task adds more than the square root of all, about.
    grouped = partial.withColumn("salt", F.spark_partition_id() % 16).repartition(16, "part", "salt").select("part", "matrix").mapInArrow(add, "part long, matrix binary")
    out = np.zeros(shape)
    for r in grouped.repartition("part").mapInArrow(add, "part long, matrix binary").collect():  # vocabulary times rank
        out[r.part * each : (r.part + 1) * each] += np.frombuffer(r.matrix, np.float64).reshape(-1, cols)
    return out


def weighted(codes: np.ndarray, half: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a weight and their half-passages, in order; a run of one word counts once."""
    hit = weight[codes] > 0
    if len(codes):
        hit[1:] &= (codes[1:] != codes[:-1]) | (half[1:] != half[:-1])
    return codes[hit], half[hit]


def latent_basis(encoded: DataFrame, items: Items) -> np.ndarray:
    """Maps words to the leading latent space of the corpus' TF-IDF passages, one row for each word number.

    Document frequencies and the sketch Y = A'(A Omega) run over all half-passages and the items. The small problem
    Omega'Y gives the leading right singular vectors and values of A (the Nystrom form of the randomised SVD).
    Axes are divided by their singular values to the power SCALING: with 0, what all texts of a language share outweighs the rest;
    with 1, weak axes that only copies of one item span set these copies apart.
    A word weighs the square of its IDF times its runs in a half-passage.
    """
    n, kind = len(items.vocab) + 1, items.kind
    _, passages = items.passages()

    def frequency(batch: pa.RecordBatch, total: np.ndarray) -> None:
        codes, half, first, _ = halves(column(batch, "codes"), kind)
        hit = codes > 0
        keys = half[hit] * n + codes[hit]
        total[:, 0] += np.bincount(np.unique(keys.astype(np.uint32) if first[-1] * n < 1 << 32 else keys) % n, minlength=n)
        total[0, 0] += first[-1]

    counts = summed(encoded, frequency, (n, 1))[:, 0]
    passages_in_all = max(counts[0], len(passages), 1)
    counts[0] = passages_in_all
    for words in passages:
        counts[np.unique(words)] += 1
    weight = np.where(counts <= max(COMMON * passages_in_all, 4 * np.median(counts[1:])), np.log((1 + passages_in_all) / (1 + np.minimum(counts, passages_in_all))) ** 2 + 1e-3, 0)
    weight[0] = 0
    # Far fewer axes than passages: with as many, scaling by singular values would set all passages apart.
    rank = max(1, min(RANK, n - 1, int(passages_in_all) // AXIS_PASSAGES))
    omega = np.random.default_rng(SEED).standard_normal((n, rank))
    seen = (omega * weight[:, None]).astype(np.float32)

    def sketch(batch: pa.RecordBatch, total: np.ndarray) -> None:
        codes, half, first, _ = halves(column(batch, "codes"), kind)
        add_outer(*weighted(codes, half, weight), int(first[-1]), seen, weight, total)

    y = summed(encoded, sketch, (n, rank))
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    own = weighted(np.concatenate([np.zeros(0, np.int64), *passages]), np.repeat(np.arange(len(passages)), sizes), weight)
    add_outer(*own, len(passages), seen, weight, y)
    inner = omega.T @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > max(values[-1], 1e-300) * 1e-10
    u, s, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    strong = s > s[0] * 1e-6 if len(s) else np.zeros(0, bool)
    return (u[:, strong] / s[strong] ** SCALING * weight[:, None]).astype(np.float32)


def sums_of_rows(codes: np.ndarray, group: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    """For each group, the sum of rows[code] over its words; groups ascend."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    step = 1 << 17
    edges = np.searchsorted(group, np.arange(0, n + 1))
    a = 0
    while a < n:  # in slices of about `step` words
        z = max(a + 1, int(np.searchsorted(edges, edges[a] + step, "right")) - 1)
        z = min(z, n)
        lo, hi = edges[a], edges[z]
        if hi > lo:
            full = np.flatnonzero(np.diff(edges[a : z + 1])) + a
            out[full] = np.add.reduceat(rows[codes[lo:hi]], edges[full] - lo, axis=0)
        a = z
    return out


def add_outer(codes: np.ndarray, group: np.ndarray, n: int, omega: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
    """Add A'(A Omega) of these passages."""
    if not len(codes):
        return
    sums = sums_of_rows(codes, group, n, omega)
    order = np.argsort(codes, kind="stable")
    word, where = codes[order], group[order]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    for a in range(0, len(starts), 256):
        lo, hi = starts[a], starts[a + 256] if a + 256 < len(starts) else len(word)
        total[word[starts[a : a + 256]]] += np.add.reduceat(sums[where[lo:hi]], starts[a : a + 256] - lo, axis=0) * weight[word[starts[a : a + 256]], None]


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def common_length(masks: dict[int, int], m: int, words: list[int]) -> int:
    """Longest common subsequence of an item (as bit masks of its words' places) and a run of words, bit-parallel."""
    full = (1 << m) - 1
    v = full
    for w in words:
        if w and (u := v & masks.get(w, 0)):
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def masks_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Verifier:
    def __init__(self, items: Items):
        self.words = items.words
        self.masks = [masks_of(w) for w in items.words]
        self.last = [w[-max(3, len(w) // 4) :] for w in items.words]
        self.last_masks = [masks_of(w) for w in self.last]
        self.most = max((int(w.max()) for w in self.words), default=0)
        self.members: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def member(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word number among the item's distinct words (the last for others), and how often it has these; few items' tables are held at once."""
        found = self.members.get(item)
        if found is None:
            if len(self.members) >= 512:
                self.members.clear()
            own, times = np.unique(self.words[item], return_counts=True)
            table_ = np.full(self.most + 1, len(own), np.int16 if len(own) < 1 << 15 else np.int32)
            table_[own] = np.arange(len(own))
            found = self.members[item] = table_, times
        return found

    def check(self, item: int, codes: np.ndarray, at: int) -> tuple[float, float]:
        """Shares of the item's words and of its last part's that stand in order near word `at` of a text; (0, 0) if that is no leak."""
        words, m = self.words[item], len(self.words[item])
        near = codes[max(0, at - m - HALF) : at + 2 * HALF + m + HALF]
        masks = self.masks[item]
        table_, times = self.member(item)
        local = table_[near]
        # A common subsequence has each word as often as both have it, at most.
        if np.minimum(np.bincount(local, minlength=len(times))[: len(times)], times).sum() < LCS_PARAPHRASE * m:
            return 0.0, 0.0
        places = np.flatnonzero(local < len(times))
        near = near[places].tolist()
        most = common_length(masks, m, near)
        if most < LCS_PARAPHRASE * m:
            return 0.0, 0.0
        # The words have to stand together: in one stretch of one and a half times the item's length. Every stretch counts; one that begins
        # between two of the item's words or ends where the one before does has no more of them than its neighbour.
        ends = np.searchsorted(places, places + m + m // 2 + 4).tolist()
        best, before = 0, 0
        for a, z in enumerate(ends):
            if z > before and z - a > best:
                best = max(best, common_length(masks, m, near[a:z]))
                if best == most:
                    break
            before = z
        share = best / m
        last = self.last[item]
        answer = common_length(self.last_masks[item], len(last), near) / len(last)
        return (share, answer) if share >= LCS_SURE or share >= LCS_PARAPHRASE and answer >= ANSWER else (0.0, 0.0)


class Phrases:
    """Short items, found wherever all their words stand one after another."""

    def __init__(self, items: list[np.ndarray]):
        self.at: dict[int, tuple[np.ndarray, dict[tuple, list[int]]]] = {}
        for m in range(1, SHORT_ITEM):
            wanted: dict[tuple, list[int]] = {}
            for i, words in enumerate(items):
                if len(words) == m:
                    wanted.setdefault(tuple(words.tolist()), []).append(i)
            if wanted:
                first = np.zeros(max(w[0] for w in wanted) + 2, bool)
                first[[w[0] for w in wanted]] = True
                last = np.zeros(max(w[-1] for w in wanted) + 2, bool)
                last[[w[-1] for w in wanted]] = True
                self.at[m] = first, last, wanted

    def __call__(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, item and first word of each place."""
        for m, (first, last, wanted) in self.at.items():
            if len(codes) < m:
                continue
            a, z = codes[: len(codes) - m + 1], codes[m - 1 :]
            places = np.flatnonzero(first[np.minimum(a, len(first) - 1)] & last[np.minimum(z, len(last) - 1)])
            text = np.searchsorted(bounds, places, "right") - 1
            whole = places + m <= bounds[text + 1]
            for p, d in zip(places[whole].tolist(), text[whole].tolist(), strict=True):
                for i in wanted.get(tuple(codes[p : p + m].tolist()), ()):
                    yield d, i, p - int(bounds[d])


def search(encoded: DataFrame, items: Items, basis: np.ndarray, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer and first word of the best leak for each pair, over all passages of all texts."""
    owner, passages = items.passages()
    sizes = np.fromiter(map(len, passages), np.int64, len(passages))
    weight = np.abs(basis).sum(axis=1)
    own = weighted(np.concatenate([np.zeros(0, np.int64), *passages]), np.repeat(np.arange(len(passages)), sizes), weight)
    targets = unit(sums_of_rows(*own, len(passages), basis))
    kind, ids = items.kind, items.ids
    # Bounded by a round's items: their words, the basis over these words and one vector a passage.
    shared = encoded.sparkSession.sparkContext.broadcast((items.words, basis, targets, owner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rows, near, of = shared.value
        own = Items([])
        own.words = words
        verify, phrases = Verifier(own), Phrases(words)
        for batch in batches:
            codes, half, first, bounds = halves(column(batch, "codes"), kind)
            n = int(first[-1])
            sums = sums_of_rows(*weighted(codes, half, weight), n, rows)
            ends = np.zeros(n + 1, bool)
            ends[first[1:] - 1] = True
            both = sums.copy()
            both[:-1] += np.where(ends[: n - 1, None], 0, sums[1:])
            both = unit(both)
            text = np.searchsorted(first, np.arange(n), "right") - 1
            found: dict[tuple[int, int], tuple] = {}
            for d, i, at in phrases(codes, bounds):
                found.setdefault((d, i), (1.0, 1.0, 1.0, at))
            for a in range(0, n if len(near) else 0, 4096):
                cos = both[a : a + 4096] @ near.T
                for p, j in np.argwhere(cos >= cosine).tolist():
                    h, i = a + p, int(of[j])
                    d = int(text[h])
                    at = (h - int(first[d])) * HALF
                    lcs, answer = verify.check(i, codes[bounds[d] : bounds[d + 1]], at)
                    if lcs and (lcs, cos[p, j]) > found.get((d, i), (0.0, 0.0))[:2]:
                        found[d, i] = (lcs, float(cos[p, j]), answer, at)
            doc_ids = column(batch, "doc_id").to_pylist()
            out = [{"doc_id": doc_ids[d], "item_id": ids[i], "cosine": c, "lcs": l, "answer": s, "first_word": at} for (d, i), (l, c, s, at) in found.items()]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("first_word", pa.int64())])
    return encoded.mapInArrow(tidied(run), "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long")


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Pairs of a document and a benchmark item that it repeats or paraphrases; docs: doc_id, text; benchmark: item_id, text.

    Words are compared in lower case without signs or digits at their ends (words that are nothing else don't count; first_word counts the others).
    A document leaks an item if at least LCS_SURE of
    the item's words stand in it in order and together, or LCS_PARAPHRASE of them and at least ANSWER of the item's last
    quarter. Candidates are passages whose latent cosine with a passage of the item is `cosine` or more, however many; at -1 every passage
    is a candidate for every item, and the search is exhaustive. Items of fewer than SHORT_ITEM words leak only as a whole, and are looked up exactly.

    Edge cases: null or empty texts and items give nothing; long texts are searched whole; repeated rows give repeated pairs; a null
    doc_id or item_id is found like any other; an empty table on either side gives no rows; further columns, of whatever names, aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch, out, block, words = Scratch(spark, "leaks"), None, [], 0

    def round_of(rows: list) -> DataFrame | None:
        items = Items(rows)
        if not items.words:
            return None
        encoded = scratch.write(encode(docs, items), "codes")
        basis = latent_basis(encoded, items)
        found = scratch.write(search(encoded, items, basis, cosine), "pairs")
        scratch.drop(encoded)
        return found

    def add(found: DataFrame | None) -> DataFrame | None:
        return found if out is None else out if found is None else out.unionByName(found)

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        block.append((r.item_id, r.text))
        words += len(r.text or "") // 6
        if len(block) == ITEMS_A_ROUND or words >= WORDS_A_ROUND:
            out, block, words = add(round_of(block)), [], 0
    out = add(round_of(block)) if block else out
    return spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs double, answer double, first_word long") if out is None else out


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
