"""Byte-level BPE texts cut where no token can cross, so that each distinct unit is encoded once.

The pre-tokenizer never puts a space behind a non-space character into the same piece as that character. So
a text may be cut before every single space that stands between two non-space characters; units such as
" word" repeat, and a batch is encoded by encoding its distinct units. Where white space of other kinds or
runs of it stand at a cut, the cut is left out: a unit may be longer, the ids are the same. For the same reason units that
begin and end so can be put one after another and encoded as one text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sagebase.llm.common import ragged, strings

#: Units and bytes that a worker keeps, besides those of one batch; bytes of units that are encoded as one text.
CACHE_UNITS, CACHE_BYTES, JOINED_BYTES = 600_000, 40 << 20, 16 << 10


def ends(start: np.ndarray, stop: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the first and the last character of each non-empty segment are surely no white space."""
    full = stop > start
    first, last = np.zeros(len(full), bool), np.zeros(len(full), bool)
    if not full.any():
        return first, last
    a, z = start[full], stop[full] - 1
    lead = data[a]
    first[full] = (lead > 0x20) & (lead != 0xC2) & ~((lead >= 0xE1) & (lead <= 0xE3))  # the leads of all wider white space
    tail, two, three = data[z], data[np.maximum(z - 1, 0)], data[np.maximum(z - 2, 0)]
    wide = ((z - a >= 1) & (two == 0xC2)) | ((z - a >= 2) & (three >= 0xE1) & (three <= 0xE3))
    last[full] = (tail > 0x20) & ~((tail >= 0x80) & wide)
    return first, last


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units, the unit number of each occurrence, and the offsets of the texts' occurrences."""
    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    bounds, flat = bounds - bounds[0], lists.flatten()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    off, data = strings(flat)
    first, last = ends(off[:-1], off[1:], data)
    starts = np.zeros(len(flat), bool)
    starts[bounds[:-1]] = True
    head = starts.copy()  # the first unit of a text has no space before it
    head[1:] |= last[:-1] & first[1:]
    at = np.flatnonzero(head)
    stop = np.append(at[1:], len(flat))
    lead, odd = starts[at], stop - at > 1
    encoded = flat.dictionary_encode()
    word = np.asarray(encoded.indices, dtype=np.int64)[at]
    codes = np.empty(len(at), np.int64)
    found, total = [], 0
    for some, before in ((~lead & ~odd, " "), (lead & ~odd, "")):  # a word with its space; a text's first word
        seen = np.zeros(len(encoded.dictionary), bool)
        seen[word[some]] = True
        codes[some] = (np.cumsum(seen) - 1 + total)[word[some]]
        names = encoded.dictionary.take(pa.array(np.flatnonzero(seen)))
        found.append(pc.binary_join_element_wise(pa.scalar("", names.type), names, pa.scalar(before, names.type)) if before else names)
        total += len(names)
    if odd.any():
        whole: dict[str, int] = {}
        numbers = []
        for k in np.flatnonzero(odd).tolist():
            text = ("" if lead[k] else " ") + " ".join(flat[at[k] : stop[k]].to_pylist())
            numbers.append(whole.setdefault(text, total + len(whole)))
        codes[odd] = numbers
        found.append(pa.array(list(whole), pa.large_string()))
    return pa.concat_arrays([x.cast(pa.large_string()) for x in found]), codes, np.searchsorted(at, bounds)


def joinable(names: pa.Array) -> np.ndarray:
    """Which units begin with a space before a non-space and end in a non-space, so that no token crosses from one to the next."""
    off, data = strings(names)
    size = np.diff(off)
    first, last = ends(np.minimum(off[:-1] + 1, off[1:]), off[1:], data)
    space = np.zeros(len(size), bool)
    space[size > 1] = data[off[:-1][size > 1]] == 0x20
    return space & first & last


def joined(names: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Joinable units one after another in texts of about JOINED_BYTES, the number of each unit's text, and its last byte's end there."""
    off, data = strings(names)
    text = (off[1:] - 1 - off[0]) // JOINED_BYTES if len(names) else np.zeros(0, np.int64)
    cuts = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(names))
    raw = [data[off[a] : off[z]].tobytes().decode() for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    number = np.repeat(np.arange(len(raw)), np.diff(cuts))
    return raw, number, off[1:] - off[cuts[:-1]][number]


class Store:
    """Values of units, each unit's worked out once and kept in flat arrays.

    Beyond CACHE_UNITS or CACHE_BYTES the next batch starts with an empty store; results don't depend on what is kept.
    """

    def __init__(self, compute: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], kind: type):
        self.compute, self.kind = compute, kind
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.large_string())
        self.flat, self.starts, self.lengths = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, names: pa.Array) -> np.ndarray:
        """The place of each unit; `starts` and `lengths` there give its values in `flat`, until the next call."""
        if len(self.keys) > CACHE_UNITS or self.keys.nbytes + self.flat.nbytes + 16 * len(self.keys) > CACHE_BYTES:
            self.clear()
        place = np.asarray(pc.fill_null(pc.index_in(names, value_set=self.keys), -1), dtype=np.int64)
        lost = place < 0
        if lost.any():
            new = names.filter(pa.array(lost))
            flat, lengths = self.compute(new)
            place[lost] = len(self.keys) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat.astype(self.kind)])
            self.keys = pa.concat_arrays([self.keys, new])
        return place

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the occurrences one after another, and how many each has."""
        lengths = self.lengths[places]
        return self.flat[ragged(self.starts[places], lengths)], lengths
