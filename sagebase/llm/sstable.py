"""Token ids in sorted-string-table shards (operator 7).

A shard file is, in order:
  blocks   zstd frames of entries in key order. An entry is varint(shared), varint(own), varint(value bytes),
           the own bytes of the key, the value; `shared` bytes come from the previous key, 0 at a block's start.
  index    for each block: varint(key bytes), its first key, varint(offset), varint(length).
  filter   Bloom filter over the keys' first 8 bytes: 10 bits a key, 7 probes of xxh3_128.
  footer   FOOTER: offsets and lengths of index and filter, entries, tokens, task and number of the shard, magic.
The writer adds one line feed behind the footer. A key is the id as 8 bytes in order-preserving form, then 4 bytes
that number the rows of a repeated id (within a task). A value is the document's ids, little-endian, 2 bytes each if the vocabulary
allows it, else 4.
"""

from __future__ import annotations

import bisect
import itertools
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, column, parts_for, ragged, scan_bytes, small_batches, table, tidied
from sagebase.llm.pieces import Store, joinable, joined, units
from sagebase.llm.tokencount import public_vocabulary

FOOTER, MAGIC = struct.Struct(">QQQQQQIIB7s"), b"SSTTOK1"
BLOCK_BYTES, SHARD_BYTES, END_ID = 64 << 10, 8 << 20, 0
#: Bytes of the input's files that a writing task gets, about; rows of the sample that its ranges come from, about.
RANGE_BYTES, SAMPLE_ROWS = 32 << 20, 50_000
NULL_KEY = b"\x00" * 8


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def unvarint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    """Byte order is id order; null comes first and shares its 8 bytes with the least 64-bit integer only."""
    return (NULL_KEY if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")) + nth.to_bytes(4, "big")


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key[:8])
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(7)]


class ShardWriter:
    def __init__(self, width: int):
        self.width, self.packer = width, zstandard.ZstdCompressor(level=1)
        self.reset()

    def reset(self) -> None:
        self.out, self.index, self.keys = bytearray(), bytearray(), []
        self.block, self.first, self.previous = bytearray(), b"", b""
        self.tokens = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.previous[shared]:
                shared += 1
        else:
            self.first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.previous = key
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.close_block()

    def close_block(self) -> None:
        if self.block:
            packed = self.packer.compress(bytes(self.block))
            self.index += varint(len(self.first)) + self.first + varint(len(self.out)) + varint(len(packed))
            self.out += packed
            self.block = bytearray()

    def finish(self, task: int, nth: int) -> bytes:
        self.close_block()
        bits = max(64, 10 * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at = len(self.out)
        footer = FOOTER.pack(at, len(self.index), at + len(self.index), len(bloom), len(self.keys), self.tokens, task, nth, self.width, MAGIC)
        data = bytes(self.out + self.index + bloom) + footer
        self.reset()
        return data


class Shard:
    """A shard's bytes, as read from its file."""

    def __init__(self, data: bytes):
        self.data = data = data[:-1] if data[-1:] == b"\n" and data[-8:-1] == MAGIC else data
        at, size, self.bloom_at, self.bloom_size, self.entries, self.tokens, self.task, self.nth, self.width, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.index, end = [], at + size
        while at < end:
            n, at = unvarint(data, at)
            key = data[at : at + n]
            offset, at = unvarint(data, at + n)
            length, at = unvarint(data, at)
            self.index.append((key, offset, length))

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length = self.index[i]
        raw, at, key = zstandard.ZstdDecompressor().decompress(self.data[offset : offset + length]), 0, b""
        while at < len(raw):
            shared, at = unvarint(raw, at)
            own, at = unvarint(raw, at)
            size, at = unvarint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, np.frombuffer(raw, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of an identifier's documents: Bloom filter, binary search of the index, then one block (more if the id repeats)."""
        low = key_of(doc_id)
        bits = self.bloom_size * 8
        if not all(self.data[self.bloom_at + (p >> 3)] >> (p & 7) & 1 for p in probes(low, bits)):
            return []
        a, z = 0, len(self.index)
        while a < z:
            mid = (a + z) // 2
            a, z = (mid + 1, z) if self.index[mid][0] <= low else (a, mid)
        found = []
        for i in range(max(0, a - 1), len(self.index)):
            if self.index[i][0][:8] > low[:8]:
                break
            found += [ids for key, ids in self.block(i) if key[:8] == low[:8]]
        return found


class Encoder:
    """The library's ids of texts, each distinct unit encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if self.n_ids <= 1 << 16 else 4
        # The bytes of each id: a character of the vocabulary is a byte, but added tokens are text.
        self.size = np.zeros(self.n_ids, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.size[i] = len(token)
        for i, token in self.library.get_added_tokens_decoder().items():
            self.size[i] = len(token.content.encode())
        self.store = Store(self.encode, np.uint16 if self.width == 2 else np.uint32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [], []
        for batch in itertools.batched(texts, 1024 if len(texts) > 4096 else 32):  # an encoding is many times its text
            found = [e.ids for e in self.library.encode_batch_fast(list(batch), add_special_tokens=False)]
            parts.append(np.array(array("I", itertools.chain.from_iterable(found)), np.uint32))
            counts += map(len, found)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array(counts, np.int64)

    def encode(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units one after another and how many each has. Units that no token crosses are encoded together and told apart by the bytes of their ids."""
        along = joinable(names)
        lengths, parts = np.zeros(len(names), np.int64), []
        raw, number, end = joined(names.filter(pa.array(along)))
        if raw:
            flat, count = self.ids(raw)
            done = np.cumsum(self.size[flat])
            first = np.cumsum(count) - count
            text_end = done[first + count - 1]
            base = np.concatenate([[0], text_end[:-1]])
            at = np.searchsorted(done, base[number] + end)
            if not (done[np.minimum(at, len(done) - 1)] == base[number] + end).all():
                along[:] = False  # a vocabulary that changes texts: each unit by itself
            else:
                lengths[along] = np.diff(at + 1, prepend=0)
                parts.append(flat)
        alone = np.flatnonzero(~along)
        if len(alone):
            flat, lengths[alone] = self.ids(names.take(pa.array(alone)).to_pylist())
            parts.append(flat)
        if not parts:
            return np.zeros(0, np.uint32), lengths
        # Both kinds lie one after another: bring them into the order of the names.
        order = np.concatenate([np.flatnonzero(along), alone])
        start = np.empty(len(names), np.int64)
        start[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(parts)[ragged(start, lengths)], lengths

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the texts' offsets."""
        names, codes, bounds = units(texts)
        flat, lengths = self.store.gather(self.store(names)[codes])
        return flat, np.concatenate([[0], np.cumsum(lengths)])[bounds]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def range_bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """Upper ends (has_id, doc_id, text_key) of all but the last of `parts` ranges of about equal bytes, from a random sample of rows.

    They decide what a task gets, never a result. A frequent id spans ranges, as its texts have different keys; a frequent row
    has several equal bounds, among which its repeats are dealt.
    """
    keys = rows.where(F.rand(7) < SAMPLE_ROWS / max(1, rows.count()))
    drawn = keys.select("doc_id", F.xxhash64("text").alias("text_key"), F.octet_length("text").alias("size")).collect()  # about SAMPLE_ROWS rows of three numbers
    drawn = sorted((r.doc_id is not None, r.doc_id or 0, r.text_key, r.size + 64) for r in drawn)
    if not drawn:
        return []
    total = np.cumsum([r[3] for r in drawn])
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return [drawn[i][:3] for i in at.tolist()]


def write_shards(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode whole texts and write them in ascending id order as shard files of about `shard_bytes`.

    Texts are encoded where they are read; only their ids move, dealt by ranges of id and text hash and sorted within each range; each
    task cuts its range into shards. A text larger than a shard makes one shard of its own size. Spark's output commit makes reruns of lost
    tasks safe.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts_for(spark, scan_bytes(docs), RANGE_BYTES, 3 * spark.sparkContext.defaultParallelism)
    bounds = range_bounds(rows, parts)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(vocabulary)
        kind = np.dtype(f"<u{encode.width}")
        end = np.array([END_ID], kind).tobytes()
        for batch in batches:
            flat, at = encode(column(batch, "text"))
            raw, at = flat.astype(kind, copy=False).tobytes(), at * encode.width
            ids, keys = column(batch, "doc_id").to_pylist(), column(batch, "text_key").to_pylist()
            part = []
            for row, (i, k) in enumerate(zip(ids, keys, strict=True)):
                low, high = bisect.bisect_left(bounds, own := (i is not None, i or 0, k)), bisect.bisect_right(bounds, own)
                part.append(low + row % max(1, high - low))
            values = [raw[a:z] + end for a, z in itertools.pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), column(batch, "doc_id"), column(batch, "text_key"), pa.array(values, pa.binary())], names=["part", "doc_id", "text_key", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth, again, previous = TaskContext.get().partitionId(), 0, 0, ()
        writer = ShardWriter(width)

        def shard() -> pa.RecordBatch:
            nonlocal nth
            nth += 1
            return pa.RecordBatch.from_arrays([pa.array([writer.finish(task, nth - 1)], pa.binary())], names=["shard"])

        for batch in batches:
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), column(batch, "ids"), strict=True):
                again = again + 1 if previous == (doc_id,) else 0
                previous = (doc_id,)
                writer.add(key_of(doc_id, again), ids.as_buffer().to_pybytes())
                if len(writer.out) >= shard_bytes:
                    yield shard()
        if writer.keys:
            yield shard()

    width = encoder(vocabulary).width
    moved = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(tidied(encoded), "part int, doc_id long, text_key long, ids binary")
    # Equal texts of an id have equal ids, so this order is a fixed one.
    moved = moved.repartitionById(parts, F.col("part")).select("doc_id", "text_key", "ids").sortWithinPartitions("doc_id", "text_key", "ids").select("doc_id", "ids")
    # The text writer stores a string's bytes as they are, and one record a file makes each row a file.
    moved.mapInArrow(tidied(shards), "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the shard files: doc_id, task, shard, nth (in its shard), before (tokens of its shard before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in column(batch, "content"):
                data = content.as_py()
                if len(data) <= 1:
                    continue
                shard, rows, before = Shard(data), [], 0
                for key, ids in shard:
                    doc_id = None if key[:8] == NULL_KEY else int.from_bytes(key[:8], "big") - (1 << 63)
                    rows.append((doc_id, shard.task, shard.nth, len(rows), before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("task", pa.int32()), ("shard", pa.int32()), ("nth", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(tidied(run), "doc_id long, task int, shard int, nth long, before long, n_tokens long, ids_crc32 long")


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32, from the shard files.

    Starts come from three levels of prefix sums: within a shard, over a task's shards, over tasks; only
    the last window has no key, and it runs over one row for each writing task.
    """
    rows = Scratch(spark, "tokens").write(read_shards(spark, path), "read")
    shards = rows.groupBy("task", "shard").agg(F.sum("n_tokens").alias("tokens"))
    tasks = shards.groupBy("task").agg(F.sum("tokens").alias("tokens"))
    tasks = tasks.select("task", F.coalesce(F.sum("tokens").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("task_start"))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("task", "shard", within.alias("shard_start")).join(tasks, "task")
    return rows.join(shards, ["task", "shard"]).select("doc_id", (F.col("task_start") + F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_to_shards(docs: DataFrame, vocabulary: str, **columns: str) -> DataFrame:
    """Write the shards of a table to the shared folder and return what reading them back gives, with their folder.

    Edge cases: a null or empty text is the end id alone; null ids come first; rows of a repeated id stay, one after
    another, by their texts' hashes (equal texts are interchangeable), and may span tasks; an empty table writes no shard and gives no rows; only the named columns are read.
    """
    spark = docs.sparkSession
    path = Scratch(spark, "sstables").path("shards")
    write_shards(docs, path, vocabulary, **columns)
    return token_positions(spark, path).withColumn("path", F.lit(path))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_to_shards(table(spark, sf_dir, "documents"), public_vocabulary()).drop("path")
