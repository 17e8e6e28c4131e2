"""Toxic passages as maximum-scoring segments of token log-odds (operator 5)."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, column, map_arrow, small_batches, table, tidied

#: Labelled rows that are learnt from at most (those with the least hashes of their ids); the documented bound of the sample.
TRAIN_ROWS = 20_000
#: Toxic training documents that a feature needs, the prior's least weight in documents and its share of the sample, and the log-odds that evidence
#: has even two standard errors lower: words of a language or of long texts lean by less.
LEAST_TOXIC, PRIOR_DOCS, PRIOR_SHARE, EVIDENCE = 3, 40.0, 0.02, 1.0
#: What a token without evidence adds at most (less where evidence is frequent in clean texts); the most that one with evidence adds.
DRIFT, MOST = -0.1, 8.0
PREFIXES, EDGES = (4, 5, 6), string.punctuation + string.digits
PSEUDO_TOKENS, THRESHOLD = 50, 0.3
#: For the rates of evidence among clean tokens: what an unseen feature counts, and the tokens of a document.
UNSEEN, CLEAN_TOKENS = 0.05, 300


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word number of each occurrence, and the texts' offsets. Empty strings at the ends stay as words without features."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    encoded = lists.flatten().dictionary_encode()
    return encoded.dictionary, np.asarray(encoded.indices, dtype=np.int64), bounds - bounds[0]


def normal(words: pa.Array) -> pa.Array:
    """Words in lower case without signs or digits at their ends."""
    return pc.utf8_lower(pc.utf8_trim(words, characters=EDGES))


def features(words: pa.Array) -> list[pa.Array]:
    """The words in normal form, and their first 4, 5 and 6 letters where they are longer (else null)."""
    core = normal(words).cast(pa.string())
    size = pc.utf8_length(core)
    none = pa.scalar(None, pa.string())
    begins = [pc.if_else(pc.greater(size, n), pc.binary_join_element_wise(pc.utf8_slice_codeunits(core, 0, n), "*", ""), none) for n in PREFIXES]
    return [pc.if_else(pc.greater(size, 0), core, none), *begins]


def numbered(words: pa.Array, wanted: pa.Array | None) -> tuple[pa.Array, np.ndarray]:
    """Feature names, and for each word the numbers of its features (-1 for none)."""
    kinds = features(words)
    if wanted is None:
        encoded = pa.concat_arrays(kinds).dictionary_encode()
        return encoded.dictionary, np.asarray(pc.fill_null(encoded.indices, -1), dtype=np.int64).reshape(len(kinds), -1).T
    found = [pc.fill_null(pc.index_in(k, value_set=wanted, skip_nulls=True), -1) for k in kinds]
    return wanted, np.stack([np.asarray(f, dtype=np.int64) for f in found], axis=1)


def documents_with(texts: pa.Array, wanted: pa.Array | None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Feature names, and pairs of text number and feature number, each pair once."""
    words, codes, bounds = tokens(texts)
    names, own = numbered(words, wanted)
    if not len(codes) or not len(names):
        return names, np.zeros(0, np.int64), np.zeros(0, np.int64)
    some = np.flatnonzero((own >= 0).any(axis=1)[codes])
    text = np.searchsorted(bounds, some, "right") - 1
    pairs = np.unique(text * len(words) + codes[some])
    number = own[pairs % len(words)]
    text = np.repeat(pairs // len(words), (number >= 0).sum(axis=1))
    both = np.unique(text * len(names) + number[number >= 0])
    return names, both // len(names), both % len(names)


def count_features(docs: DataFrame, wanted: list[str] | None) -> DataFrame:
    """feature, toxic and clean documents that have it; with `wanted`, only those and without regard to labels (as clean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if wanted is None else pa.array(wanted, pa.string())
        total = np.zeros((2, len(wanted)), np.int64) if wanted is not None else None
        for batch in batches:
            label = np.asarray(column(batch, "toxic"), dtype=np.int64)
            names, text, number = documents_with(column(batch, "text"), only)
            toxic = label[text] == 1
            counts = np.stack([np.bincount(number[toxic], minlength=len(names)), np.bincount(number[~toxic], minlength=len(names))])
            if total is not None:
                total += counts
                continue
            yield pa.RecordBatch.from_arrays([names, pa.array(counts[0]), pa.array(counts[1])], names=["feature", "toxic", "clean"])
        if total is not None and total.any():
            some = np.flatnonzero(total.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array([wanted[i] for i in some], pa.string()), pa.array(total[0][some]), pa.array(total[1][some])], names=["feature", "toxic", "clean"])

    rows = docs.select("text", "toxic").mapInArrow(tidied(run), "feature string, toxic long, clean long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, share: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds ratio of having a feature, toxic over clean, under a Dirichlet prior with the corpus' own shares; and its standard error."""
    prior = weight * np.clip(share, 1e-9, 1 - 1e-9)
    t, c = toxic + prior, clean + prior
    ratio = np.log(t / (n_toxic + weight - t)) - np.log(c / (n_clean + weight - c))
    return ratio, np.sqrt(1 / t + 1 / c)


def possible(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, weight: float) -> np.ndarray:
    """Which features can be evidence at any share in the corpus: only these need to be counted there."""
    found = np.zeros(len(toxic), bool)
    for share in np.geomspace(1e-9, 1, 200):
        ratio, error = log_odds(toxic, clean, n_toxic, n_clean, np.full(len(toxic), share), weight)
        found |= ratio - 2 * error >= EVIDENCE - 0.1
    return found


def decay(scores: np.ndarray, rates: np.ndarray, drift: float) -> float:
    """Lambda of the extreme-value law: the positive root of E[exp(lambda * score)] = 1 over clean tokens."""
    rest = max(1e-6, 1 - rates.sum())
    f = lambda x: float(rest * math.exp(x * drift) + (rates * np.exp(x * scores)).sum() - 1)
    low, high = 1e-6, 8.0
    if f(high) < 0:
        return high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def maximal_segments(at: np.ndarray, score: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text, in one pass over its tokens with evidence.

    Words between them add `drift` each. A candidate is merged with the earlier ones as far as its right sum exceeds theirs (Ruzzo and Tompa).
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, sum left of it, sum up to its end
    total, previous = 0.0, -1
    for p, s in zip(at.tolist(), score.tolist(), strict=True):
        total += drift * (p - previous - 1)
        first, left, right = p, total, total + s
        total, previous = right, p
        while True:
            j = next((j for j in range(len(found) - 1, -1, -1) if found[j][2] < left), None)
            if j is None or found[j][3] >= right:
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
        found.append((first, p, left, right))
    return [(a, z, right - left) for a, z, left, right in found]


class Model:
    """Word scores and the calibration; small enough to go with each task."""

    def __init__(self, evidence: dict[str, float], lam: float, drift: float = DRIFT, weights: tuple[float, float] = (0.0, 0.0)):
        self.evidence, self.lam, self.drift, self.weights = evidence, lam, drift, weights

    def scores(self, words: pa.Array) -> np.ndarray:
        """Each word's largest evidence, 0 if it has none."""
        names, own = numbered(words, pa.array(list(self.evidence), pa.string()))
        return np.concatenate([np.fromiter(self.evidence.values(), np.float64, len(names)), [0.0]])[own].max(axis=1, initial=0.0)

    def measure(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Of each text: how unlikely its segments are in a clean text, and the significant ones.

        A segment's level is lambda * score - log(tokens), minus the log of its expected number up to a constant. The text's is that of
        its best segment and those of all other significant segments (with a level over 0) together.
        """
        words, codes, bounds = tokens(texts)
        own = self.scores(words)
        score = own[codes] if len(codes) else np.zeros(0)
        size = np.log(np.diff(bounds) + PSEUDO_TOKENS)
        total, spans = -size, [[] for _ in range(len(size))]
        hits = np.flatnonzero(score > 0)
        owner = np.searchsorted(bounds, hits, "right") - 1
        for a, z in zip(*runs(owner), strict=True):
            i = int(owner[a])
            segments = maximal_segments(hits[a:z] - bounds[i], score[hits[a:z]], self.drift)
            levels = [(first, last, self.lam * s - float(size[i])) for first, last, s in segments]
            spans[i] = [x for x in levels if x[2] > 0]
            best = max(x for _, _, x in levels)
            total[i] = best + sum(x for _, _, x in spans[i]) - max(0.0, best)
        return total, spans

    def score(self, total: np.ndarray) -> np.ndarray:
        a, b = self.weights
        return 1 / (1 + np.exp(-np.clip(a + b * total, -500, 500)))


def runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of runs of equal values."""
    if not len(values):
        return [], []
    cuts = np.flatnonzero(np.diff(values)) + 1
    return [0, *cuts.tolist()], [*cuts.tolist(), len(values)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method; the ridge keeps the weights finite where classes separate."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from a bounded sample of labelled rows that aren't held out, and from the whole corpus for the prior.

    docs: doc_id, text; labels: doc_id, toxic. Where ids repeat in labels, any toxic row makes the id toxic. Rows of a repeated id with
    different texts are documents of their own with the id's label; rows with equal id and text count once in the sample.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    sample = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    sample = sample.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # TRAIN_ROWS ids at most, on the driver and in the broadcast.
    drawn = [(int(r.doc_id), int(r.toxic)) for r in sample.collect()]
    sample = spark.createDataFrame(drawn, "doc_id long, toxic int")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).join(F.broadcast(sample), "doc_id")
    # Different texts of an id are different documents, equal ones are one; an id may have any number of either.
    few = keyed.groupBy("doc_id", "key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(TRAIN_ROWS).collect()
    if not few:
        return Model({}, 1.0, weights=(-3.0, 0.0))
    picked = spark.createDataFrame([(r.doc_id, r.key) for r in few], "doc_id long, key long")
    train = scratch.write(keyed.join(F.broadcast(picked), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("text", "toxic"), "train")
    n_toxic = sum(int(r.toxic) for r in few)
    n_clean = len(few) - n_toxic
    weight = max(PRIOR_DOCS, PRIOR_SHARE * len(few))
    rows = count_features(train, None).where(F.col("toxic") >= LEAST_TOXIC).orderBy("feature").toArrow()  # bounded by the sample's words
    toxic, clean = (np.asarray(rows[k].combine_chunks(), dtype=np.float64) for k in ("toxic", "clean"))
    some = np.flatnonzero(possible(toxic, clean, n_toxic, n_clean, weight))
    toxic, clean = toxic[some], clean[some]
    names = rows["feature"].take(pa.array(some)).to_pylist()
    everywhere = docs.select(text.alias("text"), F.lit(0).alias("toxic"))
    n_docs = max(1, docs.count())
    place, seen = {f: i for i, f in enumerate(names)}, np.zeros(len(names))
    for r in count_features(everywhere, names).collect() if names else ():  # one row a feature at most
        seen[place[r.feature]] = r.clean
    ratio, error = log_odds(toxic, clean, n_toxic, n_clean, seen / n_docs, weight)
    strong = np.flatnonzero(ratio - 2 * error >= EVIDENCE)
    gain = np.minimum(MOST, (ratio - error)[strong])
    evidence = {names[i]: float(g) for i, g in zip(strong, gain, strict=True)}
    rates = (clean[strong] + UNSEEN) / (n_clean + 1) / CLEAN_TOKENS
    rates *= min(1.0, 0.5 / max(1e-9, rates.sum()))
    drift = min(DRIFT, -2 * float((rates * gain).sum()))
    lam = decay(gain, rates, drift)
    model = Model(evidence, lam, drift)
    measured = measure(train, model).collect()  # TRAIN_ROWS rows of two numbers
    weights = logistic(np.array([[r.level] for r in measured]), np.array([r.toxic for r in measured], float))
    scratch.drop(train)
    return Model(evidence, lam, drift, weights)


def measure(train: DataFrame, model: Model) -> DataFrame:
    def make():
        own = Model(model.evidence, model.lam, model.drift)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column(batch, "toxic"), pa.array(own.measure(column(batch, "text"))[0])], names=["toxic", "level"])

        return step

    return map_arrow(train.select("text", "toxic"), make, "toxic int, level double")


def toxic_segments(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row, and its significant passages (first and last word, from 0, and calibrated score).

    Edge cases: a null or empty text has no passage and the score of a text without evidence; long texts are scanned
    whole; repeated rows stay; a null id stays null; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("level", pa.float64())]))

    def make():
        own = Model(model.evidence, model.lam, model.drift, model.weights)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            level, spans = own.measure(column(batch, "text"))
            score = own.score(level)
            passages = pa.array([[{"first": a, "last": z, "level": x} for a, z, x in s] for s in spans], span)
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), passages], names=["doc_id", "score", "predicted", "passages"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, make, f"doc_id {kind}, score double, predicted int, passages array<struct<first:int,last:int,level:double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text isn't predicted toxic, with all their columns; nothing is joined or shuffled."""
    small_batches(docs.sparkSession)

    def make():
        own = Model(model.evidence, model.lam, model.drift, model.weights)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(own.score(own.measure(column(batch, text_col))[0]) < THRESHOLD))

        return step

    return map_arrow(docs, make, docs.schema)


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    return toxic_segments(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
