"""Removal of repeated 50-byte strings by prefix-free parsing (operator 6).

Two levels of rolling-hash triggers. The outer ones deal the corpus out: the outer trigger of a 50-byte string is its TRIGGER-byte substring of
least hash, so it depends on the string alone, and successive strings with the same trigger make a stretch. Stretches overlap by 49 bytes: each
50-byte string lies in exactly one stretch of a text, and equal strings always have equal triggers, hence the same task. Only stretches whose trigger
occurs in several documents move.

Inside a task the distinct stretches of some triggers are a small, highly repetitive corpus, which is parsed prefix-free (`corpus_order`): inner triggers
cut it into phrases, the suffixes of the dictionary of distinct phrases and the suffixes of the parse are sorted, and both ranks together give the
order of all places in that corpus. Equal strings are neighbours in it, and the least document of each run of equal strings is their first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, column, mix64, parts_for, ragged, scan_bytes, small_batches, strings, table

LENGTH, TRIGGER = 50, 24
#: Bytes of an inner trigger, and the share of places that are one (1 in so many).
INNER, EVERY = 8, 32
#: Bytes that are hashed at once; longer texts go in pieces that overlap by 49 bytes. Triggers of one task, and the tasks for
#: stretches that take the place of one for triggers: a stretch is ten times as large. Strings that are sorted at once, about.
PIECE_BYTES, TRIGGERS_A_TASK, STRETCH_TASKS, STRINGS_A_STEP = 2 << 20, 6 << 20, 12, 1 << 18
U = np.uint64
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def trigger_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the TRIGGER bytes from each position on (by doubling: 1, 2, 4, 8, 16, then 16 + 8)."""
    h = BYTE_HASH[data]
    at = {1: h}
    for n in (1, 2, 4, 8):
        h = h[:-n] * U(0xD6E8FEB86659FD93) + h[n:]
        h ^= h >> U(29)
        at[2 * n] = h
    wide, half = at[16], at[8]
    n = len(data) - TRIGGER + 1
    return mix64(wide[:n] * U(0xA0761D6478BD642F) + half[16 : 16 + n])


def inner_triggers(data: np.ndarray) -> np.ndarray:
    """Which places begin an inner trigger: a matter of their INNER bytes alone."""
    h = BYTE_HASH[data]
    for n in (1, 2, 4):
        h = h[:-n] * U(0x9FB21C651E98DF25) + h[n:]
        h ^= h >> U(31)
    return mix64(h) % U(EVERY) == 0


def corpus_order(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all 50-byte strings of the texts data[start:start + size], in the order of the strings, and which are equal to the one before.

    Phrases run from a trigger to the end of the next, so neighbours overlap by INNER bytes. A place belongs to the phrase that goes on for more than
    INNER bytes from it; what follows it is a suffix of that phrase and then a suffix of the parse. No such suffix that a trigger ends begins
    another, and the end of a text comes before every byte, so sorting by both ranks sorts by content, as far as LENGTH bytes decide.
    """
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    flat = data[ragged(start, size)]
    first = np.cumsum(size) - size
    text = np.repeat(np.arange(len(size)), size)
    cut = np.zeros(len(flat), bool)
    if len(flat) >= INNER:
        cut[: len(flat) - INNER + 1] = inner_triggers(flat)
    cut &= np.arange(len(flat)) + INNER < (first + size)[text]  # the next phrase has more than the trigger
    cut[first] = True
    begin = np.flatnonzero(cut)
    last = np.append(text[begin[1:]] != text[begin[:-1]], True)
    end = np.where(last, (first + size)[text[begin]], np.append(begin[1:], 0) + INNER)
    # The dictionary.
    raw, numbers = flat.tobytes(), {}
    word = np.array([numbers.setdefault(raw[a:z], len(numbers)) for a, z in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    words = np.frombuffer(b"".join(numbers) + b"\0" * LENGTH, np.uint8)
    at = np.cumsum(lengths) - lengths
    n = np.maximum(lengths - INNER, 1)
    base = np.cumsum(n) - n  # where each phrase's suffixes begin
    # Both ranks are for the places that begin a string; phrases as a whole are needed for the parse.
    some = np.flatnonzero(np.arange(len(flat)) + LENGTH <= (first + size)[text])
    phrase = np.searchsorted(begin, some, "right") - 1
    suffix = base[word[phrase]] + some - begin[phrase]
    need = np.zeros(int(n.sum()), bool)
    need[base] = True
    need[suffix] = True
    needed = np.flatnonzero(need)
    # Its suffix array, to LENGTH bytes: rows of bytes, 0 behind a phrase's end, and the length where these tie.
    own = np.searchsorted(base, needed, "right") - 1
    place = at[own] + needed - base[own]
    left = np.minimum((at + lengths)[own] - place, LENGTH)
    rows = np.empty((len(place), LENGTH + 1), np.uint8)
    rows[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(words, LENGTH)[place]
    short = np.flatnonzero(left < LENGTH)
    rows[short, :LENGTH] *= np.arange(LENGTH) < left[short, None]
    rows[:, LENGTH] = left  # never 0, so no row ends in zeros
    rank = np.zeros(len(need), np.int64)
    _, rank[needed] = np.unique(rows.view(f"S{LENGTH + 1}").ravel(), return_inverse=True)
    # The parse's suffix array by doubling, until it covers LENGTH bytes everywhere; the end of a text ranks lowest.
    parse = rank[base[word]] + 1
    depth = 1
    fresh = np.where(last, LENGTH, lengths[word] - INNER)
    covered = fresh.copy()
    while True:
        follows = np.zeros(len(parse), np.int64)
        ok = np.arange(len(parse)) + depth < len(parse)
        ok[ok] = text[begin[:-depth]] == text[begin[depth:]]
        if not ok.any() or (covered >= LENGTH).all():
            break
        follows[ok] = parse[np.flatnonzero(ok) + depth]
        _, parse = np.unique(parse * (int(parse.max()) + 1) + follows, return_inverse=True)
        parse += 1
        covered[ok] += covered[np.flatnonzero(ok) + depth]
        covered[~ok] = LENGTH
        depth *= 2
    after = np.append(parse[1:], 0)
    after[last] = 0
    order = some[np.lexsort((after[phrase], rank[suffix]))]
    same = np.zeros(len(order), bool)
    table_ = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)
    for a in range(1, len(order), 1 << 16):
        z = min(len(order), a + (1 << 16))
        same[a:z] = (table_[order[a:z]] == table_[order[a - 1 : z - 1]]).all(axis=1)
    return (start[text] + np.arange(len(flat)) - first[text])[order], same


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first 50-byte string, number of strings, and trigger hash of each stretch of some texts.

    Texts are data[bounds[i]:bounds[i + 1]], less than 2 ** 24 bytes together; strings never cross texts.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    h = trigger_hashes(data)
    # The leftmost of the least hashes: the position breaks ties.
    low = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    n = len(data) - LENGTH + 1
    span = LENGTH - TRIGGER + 1  # 27 triggers in a string: 16 and 16, overlapping
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[:n], low[span - 16 : span - 16 + n])
    size = np.diff(bounds)
    text = np.repeat(np.arange(len(size)), size)[:n]
    ok = np.arange(n) + LENGTH <= bounds[text + 1]
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    trigger = (low[at] & U(0xFFFFFF)).astype(np.int64)
    owner = text[at]
    new = np.ones(len(at), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], at[first], np.diff(np.append(first, len(at))), h[trigger[first]]


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds, text numbers and starts in their texts, of about PIECE_BYTES at once."""
    off, data = strings(texts)
    group, size = [], 0
    for i, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        for s in range(a, max(a + 1, z - LENGTH + 1), PIECE_BYTES):
            e = min(z, s + PIECE_BYTES + LENGTH - 1)
            if size and size + e - s > 2 * PIECE_BYTES:
                yield joined(data, group)
                group, size = [], 0
            group.append((i, s, e, s - a))
            size += e - s
    if group:
        yield joined(data, group)


def joined(data: np.ndarray, group: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    number, start, end, inside = (np.array(x, np.int64) for x in zip(*group, strict=True))
    return data[ragged(start, end - start)], np.concatenate([[0], np.cumsum(end - start)]), number, inside


def packed(*arrays: np.ndarray | bytes, level: int = 1) -> list[bytes]:
    """Each array's bytes as a zstd frame; what is shuffled and written is mostly these."""
    packer = zstandard.ZstdCompressor(level=level)
    return [packer.compress(a if isinstance(a, bytes) else a.tobytes()) for a in arrays]


def unpacked(blob: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob.as_buffer())


def slot(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Task and 32 bits of a trigger, as one number. Collisions only make more candidates."""
    return (hashes % U(parts)) << U(32) | (hashes // U(parts)) & U(0xFFFFFFFF)


def ask(parts: int):
    """Triggers of each batch for the tasks that count them; those that several texts of the batch share are known at once."""
    schema = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("triggers", pa.binary()), ("docs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(column(batch, "doc_id"), dtype=np.int64)
            for data, bounds, number, _ in pieces(column(batch, "text")):
                owner, _, _, trigger = stretches(data, bounds)
                if not len(owner):
                    continue
                value, doc = slot(trigger, parts), ids[number[owner]]
                order = np.lexsort((doc, value))
                value, doc = value[order], doc[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                value, doc = value[new], doc[new]
                head = np.ones(len(value), bool)
                head[1:] = value[1:] != value[:-1]
                run_ = np.cumsum(head) - 1
                shared = np.bincount(run_)[run_] > 1
                out = {"part": [], "base": [], "triggers": [], "docs": []}
                # One text asks for all: a frequent trigger moves once for each piece.
                v, d = value[head], doc[head]
                base = int(d.min())
                wide = int(d.max()) - base >= 1 << 32
                cuts = np.searchsorted(v >> U(32), np.arange(parts + 1, dtype=np.uint64))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    x = slice(cuts[p], cuts[p + 1])
                    out["part"].append(p)
                    out["base"].append(base)
                    step = np.diff(v[x].astype(np.uint32), prepend=np.uint32(0))
                    triggers, docs = packed(step, (d[x] - base).astype(np.uint64 if wide else np.uint32))
                    out["triggers"].append(triggers)
                    out["docs"].append(docs)
                d, v = doc[shared], value[shared]
                order = np.argsort(d, kind="stable")
                d, v = d[order], v[order]
                cuts = np.append(np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else [], len(d)).astype(np.int64)
                for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out["part"].append(-1 - int(d[a] % parts))
                    out["base"].append(int(d[a]))
                    out["triggers"].append(v[a:z].tobytes())
                    out["docs"].append(b"")
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def answer(group: pa.Table) -> pa.Table:
    """For each document of a task its triggers that more than one text or batch has."""
    part = group["part"][0].as_py()
    if part < 0:  # known at once
        return pa.table({"doc_id": group["base"], "triggers": group["triggers"]})
    triggers, docs = [], []
    for base, t, d in zip(group["base"].to_pylist(), group["triggers"], group["docs"], strict=True):
        triggers.append(np.cumsum(np.frombuffer(unpacked(t), np.uint32), dtype=np.uint32))
        raw = unpacked(d)
        docs.append(np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(triggers[-1]) else np.uint64).astype(np.int64) + base)
    trigger, doc = np.concatenate(triggers), np.concatenate(docs)
    order = np.argsort(trigger, kind="stable")
    trigger, doc = trigger[order], doc[order]
    same = trigger[1:] == trigger[:-1]
    again = np.zeros(len(trigger), bool)
    again[1:] |= same
    again[:-1] |= same
    value, doc = trigger[again].astype(np.uint64) | U(part) << U(32), doc[again]
    order = np.argsort(doc, kind="stable")
    value, doc = value[order], doc[order]
    cuts = np.append(np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else [], len(doc)).astype(np.int64)
    return pa.table({"doc_id": pa.array(doc[cuts[:-1]]), "triggers": pa.array([value[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


STRETCHES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("part", pa.int32()), ("ints", pa.binary()), ("bytes", pa.binary())])
RANGES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("ranges", pa.binary())])


def range_rows(doc: np.ndarray, key: np.ndarray, first: np.ndarray, count: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One row for each text: pairs of first string and number of strings, as 64-bit integers."""
    order = np.lexsort((first, key, doc))
    doc, key = doc[order], key[order]
    pairs = np.stack([first[order], count[order]], axis=1).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    cuts = np.append(np.flatnonzero(new), len(doc))
    return [(int(doc[a]), int(key[a]), pairs[a:z].tobytes()) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def dictionary(parts: int, tasks: int):
    """Candidate stretches of the texts for the tasks of their triggers. Of equal stretches in a batch only the least document's go; the others are covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(column(batch, "doc_id"), dtype=np.int64)
            keys = np.asarray(column(batch, "text_key"), dtype=np.int64)
            known = [np.unique(np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in row.values])) for row in column(batch, "triggers")]
            for data, bounds, number, inside in pieces(column(batch, "text")):
                owner, first, count, trigger = stretches(data, bounds)
                value = slot(trigger, parts)
                keep = np.zeros(len(owner), bool)
                cuts = np.searchsorted(owner, np.arange(len(bounds)))
                for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if a < z:
                        own = known[number[i]]
                        at = np.minimum(np.searchsorted(own, value[a:z]), len(own) - 1)
                        keep[a:z] = own[at] == value[a:z]
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                owner, first, count, trigger = owner[at], first[at], count[at], trigger[at]
                raw = data.tobytes()
                body = [raw[a : a + c + LENGTH - 1] for a, c in zip(first.tolist(), count.tolist(), strict=True)]
                row = number[owner]
                doc, key, start = ids[row], keys[row], first - bounds[owner] + inside[owner]
                least: dict[bytes, int] = {}
                for b, d in zip(body, doc.tolist(), strict=True):
                    if least.setdefault(b, d) > d:
                        least[b] = d
                low = np.array([least[b] for b in body], np.int64)
                part = (trigger % U(tasks)).astype(np.int64)
                out = []
                late = low < doc
                out += [(d, k, -1 - d % tasks, r, None) for d, k, r in range_rows(doc[late], key[late], start[late], count[late])]
                go = np.flatnonzero(~late)
                go = go[np.argsort(part[go], kind="stable")]
                edges = np.searchsorted(part[go], np.arange(tasks + 1))
                for p in np.flatnonzero(np.diff(edges)).tolist():
                    some = go[edges[p] : edges[p + 1]]
                    # 32 bits of a trigger are enough: stretches of two triggers that share them are compared in vain, by content.
                    short = (trigger[some] // U(tasks)).astype(np.uint32)
                    ints = np.stack([doc[some], key[some], start[some], count[some]])
                    out.append((None, None, p, *packed(short.tobytes() + ints.tobytes(), b"".join(body[k] for k in some.tolist()), level=6)))
                yield pa.RecordBatch.from_pylist([dict(zip(STRETCHES.names, r, strict=True)) for r in out], schema=STRETCHES)

    return run


def cover(group: pa.Table) -> pa.Table:
    """The strings of each document that a document with a smaller id has, among the stretches of some triggers."""
    if group["part"][0].as_py() < 0:
        return pa.table({"doc_id": group["doc_id"], "text_key": group["text_key"], "ranges": group["ints"]})
    raw = [unpacked(b) for b in group["ints"]]
    trigger = np.concatenate([np.frombuffer(b, np.uint32, len(b) // 36) for b in raw])  # 4 bytes, then four numbers of 8
    doc, key, start, count = np.concatenate([np.frombuffer(b, np.int64, offset=len(b) // 9).reshape(4, -1) for b in raw], axis=1)
    data = b"".join(map(unpacked, group["bytes"]))
    size = count + LENGTH - 1
    at = np.cumsum(size) - size
    # Stretches by number, and the first document of each.
    numbers: dict[bytes, int] = {}
    stretch = np.array([numbers.setdefault(data[a : a + s], len(numbers)) for a, s in zip(at.tolist(), size.tolist(), strict=True)], np.int64)
    first = np.full(len(numbers), np.iinfo(np.int64).max)
    np.minimum.at(first, stretch, doc)
    late = doc > first[stretch]
    rows = range_rows(doc[late], key[late], start[late], count[late])
    # A first document's stretch is compared string by string if its trigger has other stretches: in the order of their corpus.
    _, example = np.unique(stretch, return_index=True)
    _, kind, many = np.unique(trigger[example], return_inverse=True, return_counts=True)
    mixed = many[kind] > 1
    some = np.flatnonzero(mixed)
    if len(some):
        some = some[np.argsort(kind[some], kind="stable")]
        n = count[example[some]]
        begin = np.cumsum(n) - n
        own, least = np.repeat(first[some], n), np.empty(int(n.sum()), np.int64)
        raw = np.frombuffer(data, np.uint8)
        # About STRINGS_A_STEP strings at once, with all stretches of their triggers.
        edge = np.append(np.flatnonzero(np.diff(kind[some], prepend=-1)), len(some))
        step = np.searchsorted(np.append(begin, int(n.sum()))[edge[:-1]], np.arange(0, int(n.sum()), STRINGS_A_STEP))
        bounds = np.unique(np.append(edge[step], len(some)))
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            start_ = at[example[some[a:z]]]
            places, same = corpus_order(raw, start_, n[a:z] + LENGTH - 1)
            # Stretches lie one after another in `raw` in the order of their numbers, not of their triggers.
            by = np.argsort(start_)
            which = by[np.searchsorted(start_[by], places, "right") - 1]
            index = begin[a:z][which] + places - start_[which]
            equal = np.cumsum(~same) - 1
            low = np.full(int(equal[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, equal, own[index])
            least[index] = low[equal]
        hit = least < own
        place = np.full(len(numbers), -1, np.int64)
        place[some] = np.arange(len(some))
        lone = np.flatnonzero(~late & (place[stretch] >= 0))
        d, k, s, c = [], [], [], []
        for i in lone.tolist():
            p = place[stretch[i]]
            flags = hit[begin[p] : begin[p] + n[p]]
            if flags.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    d.append(doc[i])
                    k.append(key[i])
                    s.append(start[i] + x)
                    c.append(y - x)
        if d:
            rows += range_rows(np.array(d), np.array(k), np.array(s), np.array(c))
    return pa.Table.from_pylist([dict(zip(RANGES.names, r, strict=True)) for r in rows], schema=RANGES)


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the covered bytes out of each text."""
    for batch in batches:
        removed, spans, digests, kept_texts = [], [], [], []
        for text, ranges in zip(column(batch, "text"), column(batch, "ranges"), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_buffer()) else np.zeros(0, np.uint8)
            pairs = np.concatenate([np.frombuffer(r.as_buffer(), np.int64).reshape(-1, 2) for r in ranges.values])
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, pairs[:, 0], 1)
            np.add.at(change, pairs[:, 0] + pairs[:, 1] + LENGTH - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
            kept = data[~gone].tobytes()
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text_key"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.binary())], names=["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256", "kept"])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """Bytes of each text without those in a 50-byte string that also starts in a document with a smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `keep_bytes`, kept (the bytes left, null where nothing went).
    Texts are UTF-8 bytes; strings are judged on the input; cuts can fall inside a character.

    Steps: triggers of all stretches are counted by tasks that get 8 bytes for each; texts with triggers found elsewhere send these stretches, one
    document of each batch for each stretch, to the tasks of the triggers; what these find covered goes back to the texts.

    Edge cases: a null text is empty; texts of fewer than 50 bytes lose nothing; a null id neither gives nor loses; rows of a repeated
    id don't take from each other; very long texts go in pieces, all of them; an empty table gives no rows; only the named columns are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "substrings")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null")
    # A stretch for every 14 bytes, about; texts take twice their files' bytes.
    parts = parts_for(spark, scan_bytes(docs) / 7, TRIGGERS_A_TASK)
    asked = source.mapInArrow(ask(parts), "part int, base long, triggers binary, docs binary").groupBy("part").applyInArrow(answer, "doc_id long, triggers binary")
    asked = scratch.write(asked.groupBy("doc_id").agg(F.collect_list("triggers").alias("triggers")), "triggers")

    # Texts are joined by sort and merge at every size: what they are joined with grows with them.
    keyed = source.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = keyed.join(asked.hint("merge"), "doc_id").select("doc_id", "text_key", "text", "triggers")
    found = found.mapInArrow(dictionary(parts, STRETCH_TASKS * parts), "doc_id long, text_key long, part int, ints binary, bytes binary")
    covered = found.groupBy("part").applyInArrow(cover, "doc_id long, text_key long, ranges binary")
    covered = scratch.write(covered.groupBy("doc_id", "text_key").agg(F.collect_list("ranges").alias("ranges")), "ranges")
    scratch.drop(asked)

    cut = keyed.join(covered.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "ranges").mapInArrow(remove, "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    # Equal rows of a repeated id give equal cuts; one is joined back to all of them.
    cut = scratch.write((cut if keep_bytes else cut.drop("kept")).dropDuplicates(["doc_id", "text_key"]), "cut")
    scratch.drop(covered)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    rows = rows.join(cut, ["doc_id", "text_key"], "left")
    out = ["doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")]
    return rows.select(*out, *(["kept"] if keep_bytes else []))


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
