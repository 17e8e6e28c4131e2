"""Language identification by a bidirectional gated recurrent network over bytes (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebase.llm.common import column, null_safe_text, small_batches, strings, table, tidied

#: Training documents at most (those with the least hashes of their ids, as many of each language), and bytes of a document that training draws from; the
#: documented bound of the sample.
TRAIN_ROWS, TRAIN_BYTES = 2_000, 4_096
#: Bytes of a segment: states begin anew in each, so that long texts fill a batch like many short ones.
SEGMENT = 256
#: Hidden units a direction; segments that run side by side when texts are labelled.
UNITS, SIDE_BY_SIDE = 8, 2_048
TRAIN_SEGMENT, BATCH, STEPS, RATE, CLIP = 96, 128, 400, 0.02, 1.0
#: The largest weight of the last layer: sums stay under 4 * (2 * UNITS + 1).
MOST_WEIGHT = 4.0
UNKNOWN = "und"


class Network:
    """A gated recurrent unit for each direction; every position's label comes from both states there.

    For a byte x and a state h: z = sigmoid(Wz[x] + Uz h), r = sigmoid(Wr[x] + Ur h), n = tanh(Wn[x] + r * (Un h + c)), h' = n + z * (h - n). The input is
    one-hot, so its product with W is the row of W for the byte. Arrays are segments x units, one for each gate, so that all of them are contiguous.
    """

    GATES = "zrn"

    def __init__(self, classes: list[str], units: int = UNITS, seed: int = 0, dtype=np.float32):
        rng = np.random.default_rng(seed)
        self.classes, self.units, self.dtype = classes, units, dtype
        self.weights: dict[str, np.ndarray] = {"b": np.zeros((len(classes), 1))}
        for side in "fb":
            for gate in self.GATES:
                self.weights[f"w{gate}{side}"] = rng.normal(0, 0.3, (256, units))
                self.weights[f"u{gate}{side}"] = rng.normal(0, units**-0.5, (units, units))
            self.weights[f"c{side}"] = np.zeros(units)
            self.weights[f"v{side}"] = rng.normal(0, units**-0.5, (len(classes), units))
        self.weights = {k: w.astype(dtype) for k, w in self.weights.items()}

    def step(self, side: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state; and the gates, U h + c of the candidate, and the candidate, for the way back. x: bytes as indices."""
        w = self.weights
        gates = np.empty((2, len(x), self.units), self.dtype)
        for k, gate in enumerate("zr"):
            w[f"w{gate}{side}"].take(x, axis=0, out=gates[k], mode="clip")
            gates[k] += h @ w[f"u{gate}{side}"]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        inner = h @ w[f"un{side}"]
        inner += w[f"c{side}"]
        n = w[f"wn{side}"].take(x, axis=0, mode="clip")
        n += gates[1] * inner
        np.tanh(n, out=n)
        new = h - n
        new *= gates[0]
        new += n
        return new, gates[0], gates[1], inner, n

    def pool(self, x: np.ndarray, active: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Sums over its positions of every segment's class probabilities (classes x segments); into `labels` goes each position's likeliest class.

        x: positions x segments; segments are ordered by length, longest first, and active[t] of them reach position t.
        """
        width, logits = x.shape[1], np.empty((len(x), len(self.classes), x.shape[1]), self.dtype)
        sums = np.zeros((len(self.classes), width), self.dtype)
        h = np.zeros((width, self.units), self.dtype)
        for t, m in enumerate(active.tolist()):
            h = self.step("f", x[t, :m], h[:m])[0]
            np.matmul(self.weights["vf"], h.T, out=logits[t, :, :m])
        h = np.zeros((0, self.units), self.dtype)
        for t in range(len(x) - 1, -1, -1):
            m = int(active[t])
            if m > len(h):  # segments that end here begin with an empty state
                h = np.concatenate([h, np.zeros((m - len(h), self.units), self.dtype)])
            h = self.step("b", x[t, :m], h)[0]
            here = self.weights["vb"] @ h.T
            here += logits[t, :, :m]
            here += self.weights["b"]
            if labels is not None:
                labels[t, :m] = here.argmax(axis=0)
            np.exp(here, out=here)  # states are within -1 and 1, so no sum gets large
            here /= here.sum(axis=0)
            sums[:, :m] += here
        return sums

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions of full segments and its gradients, by backpropagation through time. y: a class for each segment."""
        w, (length, m) = self.weights, x.shape
        tapes, total = {}, np.zeros((length, len(self.classes), m), self.dtype) + w["b"]
        for side, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            h, tape = np.zeros((m, self.units), self.dtype), []
            for t in order:
                new, *kept = self.step(side, x[t], h)
                tape.append((t, h, new, *kept))
                total[t] += w[f"v{side}"] @ new.T
                h = new
            tapes[side] = tape
        p = softmax(total)
        loss = float(-np.log(np.maximum(p[:, y, np.arange(m)], 1e-30)).mean())
        p[:, y, np.arange(m)] -= 1
        d = p / self.dtype(length * m)
        grads = {name: np.zeros_like(value) for name, value in w.items()}
        grads["b"][:, 0] = d.sum(axis=(0, 2))
        by_byte = np.argsort(x, axis=None, kind="stable")
        byte, first = np.unique(x.ravel()[by_byte], return_index=True)
        for side in "fb":
            back = np.zeros((m, self.units), self.dtype)
            inputs = np.empty((3, length, m, self.units), self.dtype)
            for t, h, new, z, r, inner, n in reversed(tapes[side]):
                grads[f"v{side}"] += d[t] @ new
                back = back + d[t].T @ w[f"v{side}"]
                dn = back * (1 - z) * (1 - n * n)
                dz, dr = back * (h - n) * z * (1 - z), dn * inner * r * (1 - r)
                di = dn * r
                grads[f"c{side}"] += di.sum(axis=0)
                back = back * z
                for gate, g in (("z", dz), ("r", dr), ("n", di)):
                    grads[f"u{gate}{side}"] += h.T @ g
                    back += g @ w[f"u{gate}{side}"].T
                inputs[0, t], inputs[1, t], inputs[2, t] = dz, dr, dn
            for k, gate in enumerate(self.GATES):
                grads[f"w{gate}{side}"][byte] = np.add.reduceat(inputs[k].reshape(-1, self.units)[by_byte], first, axis=0)
        return loss, grads


def softmax(logits: np.ndarray) -> np.ndarray:
    """Over the last but one axis."""
    out = np.exp(logits - logits.max(axis=-2, keepdims=True))
    out /= out.sum(axis=-2, keepdims=True)
    return out


def trained(texts: list[bytes], labels: list[str], seed: int = 0, steps: int = STEPS) -> Network:
    """A network fitted by Adam to stretches of the texts; each language gives as many."""
    classes = sorted(set(labels))
    net = Network(classes, seed=seed)
    usable = [[np.frombuffer(t, np.uint8) for t, y in zip(texts, labels, strict=True) if y == c and t] for c in classes]
    if len(classes) < 2 or not all(usable):
        return net
    rng = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(w) for k, w in net.weights.items()}
    second = {k: np.zeros_like(w) for k, w in net.weights.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(classes), BATCH)
        x = np.empty((TRAIN_SEGMENT, BATCH), np.intp)
        for i, c in enumerate(y.tolist()):
            t = usable[c][rng.integers(len(usable[c]))]
            a = int(rng.integers(max(1, len(t) - TRAIN_SEGMENT + 1)))
            x[:, i] = np.resize(t[a : a + TRAIN_SEGMENT], TRAIN_SEGMENT)
        _, grads = net.gradients(x, y)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, CLIP / max(norm, 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            if k in ("b", "vf", "vb"):  # so that exp of a sum of them stays finite
                np.clip(net.weights[k], -MOST_WEIGHT, MOST_WEIGHT, out=net.weights[k])
    return net


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Mean probabilities over all bytes of each text (texts x classes; zeros for an empty one); into `labels` goes each byte's class.

    Texts are cut into segments, which run side by side; memory follows the batch, not the longest text.
    """
    sizes = np.diff(offsets)
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    length = np.minimum(SEGMENT, offsets[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    sums = np.zeros((len(sizes), len(net.classes)))
    width = max(256, 4 * SIDE_BY_SIDE // max(4, len(net.classes)))
    for a in range(0, len(order), width):
        own = order[a : a + width]
        place = np.arange(int(length[own[0]]))[:, None]
        inside = place < length[own]
        at = np.where(inside, start[own] + place, start[own])
        found = np.empty(at.shape, np.uint16) if labels is not None else None
        np.add.at(sums, owner[own], net.pool(data[at].astype(np.intp), inside.sum(axis=1), found).T)
        if labels is not None:
            labels[at[inside]] = found[inside]
    return sums / np.maximum(sizes, 1)[:, None]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network from documents that have a language and aren't held out.

    Of every language it draws TRAIN_ROWS / languages documents with small hashes of id and text (equal rows count once); texts beyond TRAIN_BYTES give
    their beginning to the training, and to nothing else.
    """
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "") & ~held_out(F.col(id_col)))
    named = named.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    counts = [(r.lang, int(r["count"])) for r in named.groupBy("lang").count().collect()]  # one row a language
    if not counts:
        return Network([])
    each = max(1, TRAIN_ROWS // len(counts))
    # Twice as many as wanted pass the hash, so few are too few; what is ordered then is that small.
    share = docs.sparkSession.createDataFrame([(lang, min(1.0, 2 * each / n)) for lang, n in counts], "lang string, share double")
    some = named.join(F.broadcast(share), "lang").where((F.col("key").bitwiseAND(0x7FFFFFFF) / F.lit(float(1 << 31))) < F.col("share"))
    some = some.select("lang", "key", F.encode(F.substring("text", 1, TRAIN_BYTES), "utf-8").alias("text")).dropDuplicates(["lang", "key"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    drawn = some.withColumn("place", place).where(F.col("place") <= each).orderBy("lang", "place").collect()  # TRAIN_ROWS short texts
    return trained([bytes(r.text) for r in drawn], [r.lang for r in drawn])


def languages(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row; with `spans` also the runs of bytes that the network labels alike (first and last byte, language).

    The score is the language's mean probability over all bytes of the text, rounded to six digits; ties go to the first language in
    the order of code points.

    Edge cases: a text that is null, empty or without a letter is `und` with score 0 and no spans, and so is every text if nothing was learnt;
    long texts are read whole; repeated rows stay; a null id stays null; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*net.classes, UNKNOWN], dtype=object)
        for batch in batches:
            texts = column(batch, "text")
            off, data = strings(texts)
            told = np.asarray(pc.match_substring_regex(texts, r"\p{L}")) & bool(net.classes)
            labels = np.zeros(len(data), np.uint16) if spans else None
            found, score = np.full(len(texts), len(net.classes)), np.zeros(len(texts))
            if told.any() and net.classes:
                mean = pooled(net, data, off, labels)
                found[told] = mean.argmax(axis=1)[told]
                score[told] = np.minimum(1.0, mean.max(axis=1)[told]).round(6)
            out = [column(batch, "doc_id"), pa.array(names[found].tolist(), pa.string()), pa.array(score)]
            if spans:
                out.append(pa.array([alike(labels[a:z], names) if t else [] for a, z, t in zip(off[:-1].tolist(), off[1:].tolist(), told, strict=True)], span))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", *["spans"] * spans])

    rows = docs.select(F.col(id_col).alias("doc_id"), null_safe_text(text_col).alias("text"))
    more = ", spans array<struct<first:bigint,last:bigint,lang:string>>" if spans else ""
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, lang_pred string, score double{more}")


def alike(labels: np.ndarray, names: np.ndarray) -> list[dict]:
    cuts = np.flatnonzero(np.diff(labels)) + 1
    return [{"first": a, "last": z - 1, "lang": names[labels[a]]} for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(labels)], strict=True)]


def op12_byte_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
