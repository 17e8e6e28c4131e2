"""Exact Jaccard join of word shingles in metric space (operator 9).

Two texts link within a radius r of the Jaccard distance 1 - |x & y| / |x | y|. Unrelated texts are at distance 1 of nearly all others, so texts alone
can't cut space at first; the first pivots are classes of shingles by hash, and the part of a text in each class is its position towards that pivot. Sets within the
radius differ in d shingles at most (by the triangle inequality for set differences). Of more than d / 2 classes one has a single difference at most, and of its
three parts two agree exactly: the contents of two parts are a key. Texts that agree on a key go to the same region, boundary sizes to two bands. A text
with two parts filled in more than d / 2 classes surely has such a key with its partners; texts without have their first shingles in hash order as keys
too: of the shingles that two sets within the radius share, the first is among the first n - ceil(t * n) + 1 of both (t = 1 - r). So no link is lost, and
none by chance. Regions that share texts are joined to one.

Every region of more than a few texts is then cut by texts as pivots, recursively: a text lives in the Voronoi region of its nearest pivot (or with the rest, if
none is near), windows of the triangle inequality replicate it to the regions where it may have partners, and texts within the radius of a pivot are
linked by it and not compared with each other again. A task does that for regions that fit it (`linked`), Spark for larger ones (`verified`).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, column, join_groups, mix64, parts_for, ragged, scan_bytes, small_batches, table, tidied
from sagebase.llm.graph import components, roots

#: Words of a shingle and least similarity in hundredths, as operator 9 has them; both are parameters of near_duplicate_components.
#: A link needs 100 * intersection >= link * union; then two sets differ by at most (|x| + |y|) * (100 - link) / (100 + link) shingles.
WORDS, LINK = 3, 90
#: Sizes of a band grow by about this factor, below LINK by 100 / link, the least that holds; each band has its own classes.
BAND = 1.5
#: Keys of one task (a text gives one link at most for each task that has some of its keys), shingles that one task compares, and of a pair of blocks.
KEYS_A_TASK, SHINGLES_A_TASK, BLOCK_SHINGLES = 2 << 20, 1 << 19, 1 << 20
#: Turns of cutting by pivots, pivots of one region in a turn (about, and further apart than so many radii) and their bytes in all, and the distance up to
#: which a pivot is near.
ROUNDS, PIVOTS, APART, PIVOT_BYTES, NEAR = 3, 16, 4, 32 << 20, 0.7
#: Pivots cut a region if their regions hold so many times its shingles at most.
REPLICAS = 1.5
#: What would be on disk at once goes in turns: of so many shingles each, but TURNS of all that is there at most.
TURN_SHINGLES, TURNS = 16 << 20, 8
#: Sets that a task compares one by one; the part of a region that its largest Voronoi region may hold, else it isn't cut.
FEW, CUT = 16, 0.7
U = np.uint64


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, A-Z in lower case, and the texts' offsets."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    encoded = lists.flatten().dictionary_encode()
    words = encoded.dictionary.cast(pa.binary() if pa.types.is_string(encoded.dictionary.type) else pa.large_binary()).to_pylist()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    full = np.fromiter((bool(w) for w in words), bool, len(words))
    codes = np.asarray(encoded.indices, dtype=np.int64)
    real = full[codes] if len(codes) else np.zeros(0, bool)  # splitting leaves empty strings at the ends
    kept = np.concatenate([[0], np.cumsum(real)])
    return (own[codes[real]] if len(codes) else np.zeros(0, np.uint64)), kept[bounds - bounds[0]]


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the texts' offsets."""
    words, bounds = hashed_words(texts)
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    at = ragged(bounds[:-1], count)
    size = np.minimum(n, k)[text]
    value = np.zeros(len(at), np.uint64)
    for i in range(k):
        use = size > i
        value[use] = mix64(value[use] * U(0x9E3779B97F4A7C15) + words[at[use] + i])
    value = mix64(value + size.astype(np.uint64))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(n) + 1))


def bands(most: int, link: int = LINK) -> np.ndarray:
    """Least sizes of the bands, from the least set that links with a smaller one (10 at 90), to two bands above most. A set of a band's least size has partners in the band below at most."""
    out, grow = [-(-100 // (100 - link))], BAND if link >= LINK else 100 / link
    while len(out) < 3 or out[-3] <= most:
        out.append(int(out[-1] * grow) + 2)
    return np.array(out)


def first_shingles(values: np.ndarray, offsets: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(link / 100 * n) + 1 shingles of each set by hash, and their sets. Sets ascend by hash."""
    n = np.diff(offsets)
    want = np.where(n > 0, n + link * n // -100 + 1, 0)
    return values[ragged(offsets[:-1], want)], np.repeat(np.arange(len(n)), want)


def keys_of(values: np.ndarray, offsets: np.ndarray, link: int = LINK, parts: int = 3, agree: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Region keys of each set, and the number of the set that each belongs to: the contents of `agree` of a class' `parts` parts, for its own band and for the
    next one if a set of that can be within the radius.

    With `agree` parts, a class may have parts - agree differences. So there are more classes than the differences divided by one more, and a set is sure of a
    key with each partner if that many of its classes have a filled part in every choice.

    Sets too small to link with a smaller or larger one get none (fewer than 9 shingles at 90): they link with equal ones only. Where only one shingle may
    differ, the keys are the set and the set without each shingle.
    """
    n = np.diff(offsets)
    edge = bands(int(n.max(initial=0)), link)
    own = np.searchsorted(edge, n, "right") - 1
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for up in (0, 1):
        b = own + up
        ok = (b >= 0) & (n > 0)
        b = np.where(ok, b, 0)
        if up:  # as the smaller one of a pair
            ok &= 100 * n >= link * edge[b]
        differ = 2 * (edge[b + 1] - 1) * (100 - link) // (100 + link)
        some = np.flatnonzero(ok)
        if not len(some):
            continue
        size, most = n[some], differ[some]
        value = values[ragged(offsets[:-1][some], size)]
        place = np.repeat(np.arange(len(some)), size)
        seed = mix64(b[some].astype(np.uint64) + U(17))
        add = mix64(value ^ U(0x5851F42D4C957F2D))
        single = most <= 1
        one = single[place]
        total = np.add.reduceat(add, np.cumsum(size) - size)
        keys += [mix64(total[single] + seed[single]), mix64(total[place[one]] - add[one] + seed[place[one]])]
        owners += [some[single], some[place[one]]]
        many = np.flatnonzero(~one)
        if not len(many):
            continue
        worst = most // (parts - agree + 1)  # classes that can have too many differences
        m = np.where(single, 0, worst + 3 + worst // 8)  # and some that may be nearly empty
        start = np.cumsum(m) - m
        v, who = value[many], place[many]
        slot = (start[who] + ((v >> U(33)) % m[who].astype(np.uint64)).astype(np.int64)) * parts + ((v >> U(12)) % U(parts)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        content = np.zeros(parts * int(m.sum()), np.uint64)
        full = np.zeros(len(content), bool)
        content[slot[first]] = np.add.reduceat(add[many][order], first)
        full[slot[first]] = True
        content = mix64(content + np.tile(np.arange(parts, dtype=np.uint64), len(content) // parts) * U(0xD6E8FEB86659FD93)).reshape(-1, parts)
        full = full.reshape(-1, parts)
        of = np.repeat(np.arange(len(some)), m)
        tag = mix64((np.arange(len(of)) - start[of]).astype(np.uint64) + seed[of])
        for choice in itertools.combinations(range(parts), agree):
            has = full[:, choice].any(axis=1)
            keys.append(mix64(content[has][:, choice].sum(axis=1, dtype=np.uint64) + tag[has]))
            owners.append(some[of[has]])
        few = np.flatnonzero(~single & (np.bincount(of, full.sum(axis=1) > parts - agree, len(some)) <= worst))
        head, of = first_shingles(values[ragged(offsets[:-1][some[few]], size[few])], np.concatenate([[0], np.cumsum(size[few])]), link)
        keys.append(mix64(head ^ mix64(seed[few][of] + U(1))))
        owners.append(some[few][of])
    return np.concatenate(keys), np.concatenate(owners)


def set_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, by sums."""
    a = np.concatenate([[U(0)], np.cumsum(mix64(values ^ U(0xA0761D6478BD642F)), dtype=np.uint64)])
    b = np.concatenate([[U(0)], np.cumsum(mix64(values ^ U(0xE7037ED1A0B428DB)), dtype=np.uint64)])
    return a[offsets[1:]] - a[offsets[:-1]], b[offsets[1:]] - b[offsets[:-1]]


def first_of_equal(one: np.ndarray, two: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set, the first set of the batch that equals it; itself for empty sets."""
    _, first, group = np.unique(np.stack([one, two, n.astype(np.uint64)], axis=1), axis=0, return_index=True, return_inverse=True)
    return np.where(n > 0, first[group.ravel()], np.arange(len(n)))


def linked(sets: list[np.ndarray], link: int = LINK, anchors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the sets' links connect, exactly: place of a set, and place of another.

    Sets as pivots, each as far from those before as any, cut the sets into Voronoi regions, recursively: a set lives with its nearest pivot (with the rest, if
    none is near) and visits each pivot that is within the radius of where its partners can live, by the triangle inequality. A pivot links all sets
    within the radius, and sets that are connected are not compared. Few sets, or sets that pivots don't cut, are compared one by one. Sets
    with the same anchor (-1: none) are connected from the start.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    label = np.arange(len(sets))
    if anchors is not None:
        held = anchors >= 0
        _, first, group = np.unique(anchors[held], return_index=True, return_inverse=True)
        label[held] = np.flatnonzero(held)[first][group]
    out: list[tuple[int, int]] = []
    if len(sets) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    _, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by = np.empty(len(times), np.int64)
    by[np.argsort(times, kind="stable")] = np.arange(len(times))  # seldom shingles first
    flat = by[flat]
    flat = flat[np.lexsort((flat, owner))]
    bounds = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(len(times), bool)
    radius = 1 - link / 100 + 1e-9

    def shared(x: int, at: np.ndarray) -> np.ndarray:
        """Shingles that sets have in common with set x."""
        own = flat[bounds[x] : bounds[x + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[flat[ragged(bounds[:-1][at], n[at])]], np.cumsum(n[at]) - n[at], dtype=np.int64)
        mark[own] = False
        return both

    def join(x: int, some: np.ndarray) -> None:
        for y in some.tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]

    def compared(at: np.ndarray) -> None:
        """Each set with those behind it that share one of its first shingles, aren't connected with it yet and are of a size that allows a link."""
        most = n + link * n // -100 + 1
        heads, of = flat[ragged(bounds[:-1][at], most[at])], np.repeat(np.arange(len(at)), most[at])
        order = np.argsort(heads, kind="stable")
        token, of = heads[order], of[order]
        for k, x in enumerate(at.tolist()):
            own = flat[bounds[x] : bounds[x] + most[x]]
            low, high = np.searchsorted(token, own, "left"), np.searchsorted(token, own, "right")
            some = of[ragged(low, high - low)]
            some = at[np.unique(some[some > k])]
            some = some[(label[some] != label[x]) & (100 * np.minimum(n[some], n[x]) >= link * np.maximum(n[some], n[x]))]
            if len(some):
                both = shared(x, some)
                join(x, some[100 * both >= link * (n[some] + n[x] - both)])

    todo = [np.flatnonzero(n > 0)]
    while todo:
        at = todo.pop()
        if len(at) < 2 or (label[at] == label[at[0]]).all():
            continue
        if len(at) <= FEW:
            compared(at)
            continue
        far, pivot = np.full((PIVOTS, len(at)), 2.0), 0
        for k in range(PIVOTS):
            both = shared(int(at[pivot]), at)
            union = n[at] + n[at[pivot]] - both
            far[k] = 1 - both / union
            join(int(at[pivot]), at[100 * both >= link * union])
            nearest = far.min(axis=0)
            pivot = int(nearest.argmax())
            if nearest[pivot] <= radius:
                break
        home, rest = far.argmin(axis=0), nearest > NEAR
        visits = far <= np.minimum(NEAR + radius, nearest + 2 * radius)
        cells = [at[rest], *(at[visits[k]] for k in range(PIVOTS) if (~rest & (home == k)).any())]
        if max(map(len, cells)) > CUT * len(at):
            compared(at)
        else:
            todo += cells
    links = np.array(out, np.int64).reshape(-1, 2)
    return links[:, 0], links[:, 1]


def region_links(members: DataFrame, keys: list[str], link: int = LINK) -> DataFrame:
    def join(group: pa.Table) -> pa.Table:
        ids = np.asarray(group["doc_id"].combine_chunks(), dtype=np.int64)
        anchors = np.asarray(group["anchor"].combine_chunks().fill_null(-1), dtype=np.int64) if "anchor" in group.column_names else None
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["shingles"]]
        a, b = linked(sets, link, anchors)
        x, y = roots(ids[a], ids[b]) if len(a) else (ids[:0], ids[:0])
        return pa.table({"a": pa.array(x), "b": pa.array(y)})

    return members.select(*keys, "doc_id", "shingles", *(c for c in ("anchor",) if c in members.columns)).groupBy(*keys).applyInArrow(join, "a long, b long")


def in_turns(rows: DataFrame, keys: list[str], shingles: int, whole: int) -> Iterator[DataFrame]:
    """The rows in parts, dealt by their keys: `shingles` is what they move, `whole` what all texts hold. The last turn of many is no larger than the first."""
    turns = -(-shingles // max(TURN_SHINGLES, whole // TURNS)) if shingles else 1
    for k in range(turns):
        yield rows if turns == 1 else rows.where(F.pmod(F.xxhash64(*keys, F.lit("turn")), F.lit(turns)) == k)


KEY_BITS = 40


def packed_keys(key: np.ndarray, parts: int) -> bytes:
    """Keys of one task, 40 bits each: bits that differ beyond only make more candidates."""
    rest = (key // U(parts)) & U((1 << KEY_BITS) - 1)
    return (rest & U(255)).astype(np.uint8).tobytes() + (rest >> U(8)).astype("<u4").tobytes()


def unpacked_keys(blob: pa.Scalar) -> np.ndarray:
    raw = blob.as_buffer()
    n = len(raw) // 5
    return np.frombuffer(raw, np.uint8, n).astype(np.uint64) | np.frombuffer(raw, "<u4", n, n).astype(np.uint64) << U(8)


def packed_docs(doc: np.ndarray) -> bytes:
    """Numbers of ascending documents, one for each key, as steps of a byte; longer steps stand behind (8 bytes each), so what a key takes doesn't grow with the tasks."""
    step = np.diff(doc, prepend=0)
    return np.minimum(step, 255).astype(np.uint8).tobytes() + step[step >= 255].astype("<i8").tobytes()


def unpacked_docs(blob: pa.Scalar, n: int) -> np.ndarray:
    raw = blob.as_buffer()
    step = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    step[step == 255] = np.frombuffer(raw, "<i8", offset=n)
    return np.cumsum(step)


def candidates(rows: DataFrame, keyed: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], parts: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """Links (a, b) between documents that share a key, as stars around the least of each task; `keyed` gives a batch's keys and their documents.

    Keys are dealt to `parts` tasks; they move, packed, and aren't written. Of several turns each moves the keys of some of these tasks.
    """

    def dissect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt() -> pa.RecordBatch:
            key, doc = np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held])
            held.clear()
            part = (key % U(parts)).astype(np.int64)
            order = np.lexsort((doc, part))
            key, doc, part = key[order], doc[order], part[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(cuts)).tolist()
            base = int(doc.min())
            blobs = [packed_keys(key[cuts[p] : cuts[p + 1]], parts) for p in some], [packed_docs(doc[cuts[p] : cuts[p + 1]] - base) for p in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([base] * len(some), pa.int64()), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())], names=["part", "base", "keys", "docs"])

        for batch in batches:
            key, doc = keyed(batch)
            if turns > 1:
                mine = key % U(parts) % U(turns) == U(turn)
                key, doc = key[mine], doc[mine]
            if len(key):
                held.append((key, doc))
            if sum(len(k) for k, _ in held) >= 1 << 20:
                yield dealt()
        if held:
            yield dealt()

    def stars(group: pa.Table) -> pa.Table:
        key = np.concatenate([unpacked_keys(b) for b in group["keys"]])
        doc = np.concatenate([unpacked_docs(d, len(k.as_buffer()) // 5) + base for base, k, d in zip(group["base"].to_pylist(), group["keys"], group["docs"], strict=True)])
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(doc, run), np.diff(np.append(run, len(key))))
        other = doc != least
        a, b = roots(doc[other], least[other])
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return rows.mapInArrow(tidied(dissect), "part int, base long, keys binary, docs binary").groupBy("part").applyInArrow(stars, "a long, b long")


def refined(members: DataFrame, scratch: Scratch, link: int, whole: int) -> tuple[DataFrame, list[DataFrame]]:
    """The members with large regions keyed once more, by four of six parts: what only a common passage joined falls apart. Links keep their ends in one region.
    Only these are written anew; also the tables that hold the members."""
    sizes = members.groupBy("region").agg(F.sum("n").alias("total")).where(F.col("total") > SHINGLES_A_TASK)
    large = scratch.write(sizes, "large")
    total = large.agg(F.sum("total")).first()[0]
    if not total:
        return members, [members]
    big = members.join(large.select("region"), "region")

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        n = np.asarray(column(batch, "n"), dtype=np.int64)
        values = np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in column(batch, "shingles")])
        key, owner = keys_of(values, np.concatenate([[0], np.cumsum(n)]), link, 6, 4)
        region = mix64(np.asarray(column(batch, "region"), dtype=np.int64).view(np.uint64))
        return mix64(key + region[owner]), np.asarray(column(batch, "doc_id"), dtype=np.int64)[owner]

    parts = parts_for(members.sparkSession, total * 10 * (100 - link) / (100 + link), KEYS_A_TASK)
    # Some 22 bytes of keys for a shingle (15 choices of parts): in a turn half of what all sets hold. A turn finds all keys again, so they are few.
    turns = -(-22 * total // max(8 * TURN_SHINGLES, 4 * whole))
    found = scratch.write_in_turns((candidates(big.select("region", "doc_id", "n", "shingles"), keyed, parts, k, turns) for k in range(turns)), "candidates")
    finer = components(found, scratch, reduced=True).select(F.col("node").alias("doc_id"), F.col("root").alias("finer"))
    small = scratch.write_in_turns((some.join(finer, "doc_id").select(F.col("finer").alias("region"), "doc_id", "n", "shingles") for some in in_turns(big, ["doc_id"], total, whole)), "refined")
    return members.join(large.select("region"), "region", "left_anti").select("region", "doc_id", "n", "shingles").unionByName(small), [members, small]


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles and component_id of every text under links of Jaccard similarity link / 100 or more (link below 100).

    A text's set holds its distinct shingles of so many words (A-Z in lower case); a text of fewer words has its whole
    sequence as one shingle. Components are exact: no link between different texts is left out that would connect two of them.

    Edge cases: texts without words (null, empty or blank) have size 0 and are their own components, as have rows with a null id
    (null component); rows of a repeated id are one node; very long texts are processed whole; an empty table gives no
    rows; only the named columns are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "shingles")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = shingle_sets(column(batch, "text"), words)
            one, two = set_hashes(values, offsets)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(offsets)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["doc_id", "n_shingles", "k1", "k2"])

    slim = scratch.write(source.mapInArrow(tidied(measured), "doc_id long, n_shingles long, k1 long, k2 long"), "slim")

    # A word for every four bytes of the files, about; three keys for two shingles that may differ, in two bands. Keys are many, so they move and aren't written.
    parts = parts_for(spark, scan_bytes(docs) * 1.5 * (100 - link) / (100 + link), KEYS_A_TASK)

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        values, offsets = shingle_sets(column(batch, "text"), words)
        n = np.diff(offsets)
        one, two = set_hashes(values, offsets)
        # Of equal sets in a batch the first gets keys; equal sets elsewhere have the same ones.
        known = np.flatnonzero(n > 0)
        rep = known[np.unique(first_of_equal(one[known], two[known], n[known]))] if len(known) else known
        key, owner = keys_of(values[ragged(offsets[:-1][rep], n[rep])], np.concatenate([[0], np.cumsum(n[rep])]), link)
        return key, np.asarray(column(batch, "doc_id"), dtype=np.int64)[rep][owner]

    regions = components(candidates(source.where("doc_id is not null"), keyed, parts), scratch, reduced=True)

    # Of equal sets the one with the least id stands for all.
    keys = ["k1", "k2", "n_shingles"]
    real = slim.where("n_shingles > 0 and doc_id is not null").select(*keys, F.col("doc_id").alias("a"))
    least = real.groupBy(*keys).agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1")
    copies = join_groups(real, least, keys).where("a <> b").select("a", "b")
    copies = scratch.write(copies.distinct(), "copies")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = shingle_sets(column(batch, "text"), words)
            sets = [values[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "region"), column(batch, "doc_id"), pa.array(np.diff(offsets)), pa.array(sets, pa.binary())], names=["region", "doc_id", "n", "shingles"])

    # By sort and merge at every size: the candidates grow with the texts.
    kept = regions.select(F.col("node").alias("doc_id"), F.col("root").alias("region")).join(copies.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    several = kept.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    kept = scratch.write(kept.join(several, "region"), "kept")
    # Texts move in turns, so that they and the sets that are written aren't on disk at once.
    whole = slim.agg(F.sum("n_shingles")).first()[0] or 0
    members = (some.join(kept.hint("merge"), "doc_id").select("region", "doc_id", "text").mapInArrow(tidied(shingled), "region long, doc_id long, n long, shingles binary").where("n > 0") for some in in_turns(source, ["doc_id"], whole, whole))
    members = scratch.write_in_turns(members, "members")
    links = verified(*refined(members, scratch, link, whole), scratch, link)
    tree = components(links.unionByName(copies), scratch, reduced=True)
    out = slim.select("doc_id", "n_shingles").join(tree, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


class Pivots:
    """The pivots of some regions: which regions a text belongs to."""

    def __init__(self, link: int, pivots: dict[int, list[tuple[int, np.ndarray]]] | None = None):
        self.pivots, self.link, self.radius = pivots or {}, link, 1 - link / 100 + 1e-9

    def add(self, cell: int, pivot: int, own: np.ndarray) -> None:
        """One more pivot, if it is far enough from the region's others: else most texts would lie in the windows of both."""
        if not self.pivots.setdefault(cell, []) or self.distances(cell, own)[0].min() > APART * self.radius:
            self.pivots[cell].append((pivot, own))

    def distances(self, cell: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of a set to the pivots of a region, and whether it is within the radius of each."""
        both = np.array([int((c[np.minimum(np.searchsorted(c, own), len(c) - 1)] == own).sum()) for _, c in self.pivots[cell]])
        union = np.array([len(c) for _, c in self.pivots[cell]]) + len(own) - both
        return 1 - both / union, 100 * both >= self.link * union

    def place(self, cell: int, own: np.ndarray) -> Iterator[tuple[int, bool, float | None]]:
        """The pivots (-1: the rest) to whose regions a set goes, whether it is within the radius of each, and its distance."""
        ids = [p for p, _ in self.pivots[cell]]
        far, near = self.distances(cell, own)
        least = far.min(initial=2.0)
        if least > NEAR:
            yield -1, False, None
        # Whoever lives at a pivot (the nearest, within NEAR) has all partners within these windows; two that live with the rest meet there.
        for k in np.flatnonzero(far <= min(NEAR + self.radius, least + 2 * self.radius)).tolist():
            yield ids[k], bool(near[k]), float(far[k])


def in_blocks(active: DataFrame, link: int, scratch: Scratch, whole: int) -> DataFrame:
    """Exact links of regions that no pivot cuts: every pair of blocks is a task. A text moves once for each block, so pairs go in turns."""
    blocks = active.withColumn("blocks", F.ceil(2 * F.col("total") / BLOCK_SHINGLES).cast("int"))
    blocks = blocks.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    blocks = blocks.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    moved = blocks.agg(F.sum("n")).first()[0] or 0
    return scratch.write_in_turns((region_links(some, ["cell", "i", "j"], link) for some in in_turns(blocks, ["cell", "i", "j"], moved, whole)), "links")


def verified(members: DataFrame, held: list[DataFrame], scratch: Scratch, link: int = LINK) -> DataFrame:
    """Exact links inside regions, as many as connect what belongs together: small regions in a task each, larger ones cut by pivots turn by turn; what pivots
    don't cut (texts about as far from all of them lie in all windows) goes by blocks. held: the tables that the members lie in; they are dropped once large regions are cut."""
    found, before = [], held
    columns = ["cell", "doc_id", "n", "shingles", "anchor"]
    active = members.select(F.col("region").alias("cell"), "doc_id", "n", "shingles", F.lit(None).cast("long").alias("anchor"))
    whole = members.agg(F.sum("n")).first()[0] or 0
    for turn in range(ROUNDS + 1):
        # Texts that one pivot links need no comparison with each other.
        sizes = active.groupBy("cell").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.sum(F.col("anchor").isNull().cast("long")).alias("loose")).where("rows > 1 and loose > 0")
        sizes = scratch.write(sizes, "sizes")
        small = sizes.where(F.col("total") <= SHINGLES_A_TASK).select("cell", "total")
        moved = small.agg(F.sum("total")).first()[0] or 0
        found.append(scratch.write_in_turns((region_links(some.join(small.select("cell"), "cell"), ["cell"], link) for some in in_turns(active, ["cell"], moved, whole)), "links"))
        large = sizes.where(F.col("total") > SHINGLES_A_TASK)
        if not large.limit(1).count():
            break
        active = active.join(large.select("cell", "total", "loose"), "cell")
        if turn == ROUNDS:
            found.append(in_blocks(active, link, scratch, whole))
            break
        rows, near, drawn = with_pivots(active, columns, turn, link, scratch)
        placed = rows.mapInArrow(tidied(place_sizes(near)), "cell long, placed long").groupBy("cell").agg(F.sum("placed").alias("placed"))
        verdicts = scratch.write(large.join(placed, "cell").select("cell", (F.col("placed") <= REPLICAS * F.col("total")).alias("cut")), "verdicts")
        if verdicts.where("not cut").limit(1).count():
            found.append(in_blocks(active.join(verdicts.where("not cut").select("cell"), "cell"), link, scratch, whole))
        measured = rows.join(verdicts.where("cut").select("cell"), "cell").mapInArrow(tidied(place_rows(near)), "cell long, doc_id long, n long, shingles binary, anchor long, now boolean, far double")
        measured = scratch.write(measured, "measured")
        found.append(scratch.write(measured.where("now and anchor <> doc_id").select(F.col("doc_id").alias("a"), F.col("anchor").alias("b")), "links"))
        # What a pivot links goes on only where a loose text of its region can be within the radius.
        nearest = measured.where("anchor is null").groupBy("cell").agg(F.min("far").alias("nearest"))
        reach = ~F.col("now") | (F.col("far") >= F.col("nearest") - (1 - link / 100 + 1e-9))
        left = scratch.write(measured.join(nearest, "cell").where(reach).select(*columns), "active")
        scratch.drop(measured, drawn, *before)
        active, before = left, [left]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_pivots(active: DataFrame, columns: list[str], turn: int, link: int, scratch: Scratch):
    """The rows of large regions, a function from a batch of them to their Pivots, and the table of the texts drawn.

    Pivots are loose texts drawn by hash, and always the one with the least. They go by broadcast if they are few, else each region's one by a join.
    """
    spark = active.sparkSession
    loose = active.where("anchor is null").withColumn("draw", F.xxhash64("doc_id", F.lit(turn)))
    always = loose.groupBy("cell").agg(F.min("draw").alias("least"))
    drawn = loose.join(always, "cell").where((F.col("draw") == F.col("least")) | (F.pmod("draw", F.ceil(F.col("loose") / PIVOTS).cast("long")) == 0))
    drawn = scratch.write(drawn.select("cell", "doc_id", "shingles", "n", (F.col("draw") == F.col("least")).alias("always")), "pivots")
    chosen, room = drawn, drawn.agg(F.sum("n")).first()[0] * 8
    if room > PIVOT_BYTES:
        chosen = drawn.where("always")
        room = chosen.agg(F.sum("n")).first()[0] * 8
    if room <= PIVOT_BYTES:
        own = Pivots(link)
        for r in chosen.orderBy("cell", F.desc("always"), "doc_id").collect():  # PIVOT_BYTES at most
            own.add(r.cell, r.doc_id, np.frombuffer(bytes(r.shingles), np.uint64))
        shared = spark.sparkContext.broadcast(own.pivots)
        return active.select(*columns), lambda batch: Pivots(link, shared.value), drawn
    center = chosen.groupBy("cell").agg(F.first(F.struct("doc_id", "shingles")).alias("pivot"))
    rows = active.select(*columns).join(center.hint("merge"), "cell").select(*columns, F.col("pivot.doc_id").alias("pivot"), F.col("pivot.shingles").alias("center"))

    def near(batch: pa.RecordBatch) -> Pivots:
        triples = zip(column(batch, "cell").to_pylist(), column(batch, "pivot").to_pylist(), column(batch, "center"), strict=True)
        return Pivots(link, {c: [(p, np.frombuffer(s.as_buffer(), np.uint64))] for c, p, s in triples})

    return rows, near, drawn


def place_sizes(near):
    """Of each region, the shingles that its pivots' regions would hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivots, total = near(batch), {}
            for cell, n, blob in zip(column(batch, "cell").to_pylist(), column(batch, "n").to_pylist(), column(batch, "shingles"), strict=True):
                total[cell] = total.get(cell, 0) + n * sum(1 for _ in pivots.place(cell, np.frombuffer(blob.as_buffer(), np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "placed"])

    return run


def place_rows(near):
    """The rows in their pivots' regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivots, take, cells, anchors, now, far = near(batch), [], [], [], [], []
            for i, (cell, anchor, blob) in enumerate(zip(column(batch, "cell").to_pylist(), column(batch, "anchor").to_pylist(), column(batch, "shingles"), strict=True)):
                for pivot, linked_, distance in pivots.place(cell, np.frombuffer(blob.as_buffer(), np.uint64)):
                    take.append(i)
                    cells.append((cell * 0x9E3779B97F4A7C15 + pivot + 1) & (1 << 64) - 1)
                    anchors.append(pivot if linked_ else anchor)  # what an earlier pivot links stays connected
                    now.append(linked_)
                    far.append(distance)
            rows = [column(batch, c).take(pa.array(take, pa.int64())) for c in ("doc_id", "n", "shingles")]
            cells = mix64(np.array(cells, np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), *rows, pa.array(anchors, pa.int64()), pa.array(now, pa.bool_()), pa.array(far, pa.float64())], names=["cell", "doc_id", "n", "shingles", "anchor", "now", "far"])

    return run


def op9_shingle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))
