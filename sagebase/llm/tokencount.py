"""Token counts by prefix dynamic programming (operator 10)."""

from __future__ import annotations

import itertools
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebase.llm.common import Scratch, column, map_arrow, ragged, small_batches, strings, table
from sagebase.llm.pieces import Store, joinable, joined, units

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: Pieces of the pre-tokenizer, and pairs of tokens, whose tables a worker keeps.
KEPT_PIECES, KEPT_PAIRS = 250_000, 300_000


def public_vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """The token count at every prefix of a text, for a byte-level BPE vocabulary file.

    For a piece of the pre-tokenizer, `last[k]` is the last token of the encoding of its first k bytes: the one
    vocabulary entry t ending there for which the pair (last token before t, t) survives merging unchanged.
    That pair rule makes every prefix's encoding the encoding of a shorter prefix and one token more, so
    count[k] = count[k - len(t)] + 1. Whether a pair survives is worked out once for each pair.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.library, self.pre = library, library.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.special = [x["content"] for x in spec["added_tokens"]]
        # The rule that makes each token of more than a byte, and when it applies.
        self.parts = {a + b: (a, b) for a, b in pairs}
        self.made = {t: self.rank[p] for t, p in self.parts.items()}
        self.vocab: set[str] = set()
        for t in sorted(model["vocab"], key=lambda t: (self.made.get(t, -1), t)):
            if len(t) == 1 or t in self.parts and self.vocab.issuperset(self.parts[t]) and self.apart(*self.parts[t], self.made[t]):
                self.vocab.add(t)
        self.longest = max(map(len, self.vocab))
        self.pair_ok: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, bytes | list[int]] = {}
        self.store = Store(self.tables, np.int32)

    def apart(self, a: str, b: str, until: int) -> bool:
        """Whether no rule before `until` joins the end of token a with the beginning of token b.

        Goes back in time: the later made of the two parts at the border is taken apart, and what then stands at the border must not
        have a rule that applied while both stood there. Where one rule applies twice, the left place comes first.
        """
        end_a = end_b = until
        while True:
            rule = self.rank.get((a, b))
            if rule is not None and rule < end_a and rule <= end_b and rule < until:
                return False
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a > made_b:
                end_a, a = made_a, self.parts[a][1]
            elif made_b >= 0:
                end_b, b = made_b, self.parts[b][0]
            else:
                return True

    def survives(self, pair: tuple[str, str]) -> bool:
        if len(self.pair_ok) > KEPT_PAIRS:
            self.pair_ok.clear()
        ok = self.pair_ok[pair] = self.apart(*pair, 1 << 60)
        return ok

    def piece(self, word: str) -> bytes | list[int]:
        found = self.pieces.get(word)
        if found is None:
            if len(self.pieces) > KEPT_PIECES:
                self.pieces.clear()
            found = self.fill(word)
            if len(word) <= 64:
                self.pieces[word] = found
        return found

    def fill(self, word: str) -> bytes | list[int]:
        """Counts at the prefixes of 1, 2, … bytes of one piece, in the vocabulary's byte characters; as bytes if they are that small."""
        n, longest, vocab, known = len(word), self.longest, self.vocab, self.pair_ok
        last, count = [""] * (n + 1), [0] * (n + 1)
        for k in range(1, n + 1):
            # Only one start is right, so the likeliest come first: the last token goes on, or a new one begins.
            likely = k - 1 - len(last[k - 1])
            for start in (likely, k - 1, *range(k - longest if k > longest else 0, likely), *range(likely + 1, k - 1)):
                t = word[start:k]
                if t in vocab:
                    if start:
                        pair = (last[start], t)
                        ok = known.get(pair)
                        if not (self.survives(pair) if ok is None else ok):
                            continue
                    last[k], count[k] = t, count[start] + 1
                    break
        return bytes(count[1:]) if n < 256 else count[1:]

    def tables(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts at the prefixes of 1, 2, … characters of units, one unit after another, and the units' characters.

        Units without white space behind their space and without quotes need none of what `table` puts right: the tables of their
        pieces, each on top of the pieces before it, are theirs, read at the characters' last bytes.
        """
        off, data = strings(names)
        size = np.diff(off)
        # Leads of wider white space count as it: 0xC2 and 0xE1 to 0xE3.
        odd = np.concatenate([[0], np.cumsum((data <= 0x20) | (data == 0x27) | (data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))]) if len(names) else np.zeros(1, np.int64)
        plain = joinable(names)
        plain &= odd[off[1:]] - odd[off[:-1]] == 1  # the space
        for name in self.special:
            plain &= ~np.asarray(pc.match_substring(names, name))
        plain &= size < 1 << 14
        values, lengths = [], np.zeros(len(names), np.int64)
        raw, number, end = joined(names.filter(pa.array(plain)))
        cuts = np.searchsorted(number, np.arange(len(raw) + 1))
        for text, a, z in zip(raw, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            steps = [self.piece(mapped) for mapped, _ in self.pre.pre_tokenize_str(text)]
            stop = np.cumsum(np.fromiter(map(len, steps), np.int64, len(steps)))
            last = np.fromiter((x[-1] for x in steps), np.int64, len(steps))
            unit = np.searchsorted(end[a:z], stop, "left")  # the unit of each piece
            before = np.cumsum(last) - last
            head = np.flatnonzero(np.diff(unit, prepend=-1))
            before -= before[head][unit]
            small = all(type(x) is bytes for x in steps)
            counts = np.frombuffer(b"".join(steps), np.uint8) if small else np.array(list(itertools.chain.from_iterable(steps)))
            counts = (counts + np.repeat(before, np.diff(stop, prepend=0))).astype(np.int32)
            whole = np.ones(len(counts), bool)  # a character's last byte
            whole[:-1] = np.frombuffer(text.encode(), np.uint8)[1:] & 0xC0 != 0x80
            values.append(counts[whole])
        lengths[plain] = np.asarray(pc.utf8_length(names), dtype=np.int64)[plain]
        rest = np.flatnonzero(~plain)
        for k, text in zip(rest.tolist(), names.take(pa.array(rest)).to_pylist(), strict=True):
            own = self.table(text)[1:]
            values.append(own)
            lengths[k] = len(own)
        order = np.concatenate([np.flatnonzero(plain), rest])
        start = np.empty(len(names), np.int64)
        start[order] = np.cumsum(lengths[order]) - lengths[order]
        return (np.concatenate(values) if values else np.zeros(0, np.int64))[ragged(start, lengths)], lengths

    def table(self, text: str) -> np.ndarray:
        """Counts at the prefixes of 0, 1, … characters of a text.

        A prefix that ends in white space has that white space as one piece of its own, and one that ends inside a
        contraction has its letters apart; both are put right below. A prefix that ends inside a special
        token's string has its characters as ordinary text.
        """
        counts = [0]
        total = 0
        rest = text
        while rest:
            at, name = min(((i, s) for s in self.special if (i := rest.find(s)) >= 0), default=(len(rest), ""))
            here = len(counts) - 1 + at
            total = self.ordinary(rest[: at + len(name)], total, counts)
            if name:
                total = counts[-1] = counts[here] + 1
            rest = rest[at + len(name) :]
        return np.array(counts, np.int64)

    def ordinary(self, text: str, total: int, counts: list[int]) -> int:
        """Append the counts of a text that stands after `total` tokens; the tokens after it."""
        if not text:
            return total
        run = -1  # where a run of white space began
        for mapped, (a, z) in self.pre.pre_tokenize_str(text):
            steps = self.piece(mapped)
            chars, byte, before = text[a:z], 0, int(total)
            for i, c in enumerate(chars):
                byte += len(c.encode())
                value = before + int(steps[byte - 1])
                if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
                    if run < 0:
                        run, run_total = a + i, before + (int(steps[byte - len(c.encode()) - 1]) if i else 0)
                    if a + i > run:
                        value = run_total + int(self.piece(self.mapped(text[run : a + i + 1]))[-1])
                else:
                    run = -1
                    if chars[0] == "'" and 1 <= i < len(chars) - 1 and chars[1].isalpha():
                        value = before + 2
                counts.append(value)
            total += int(steps[-1])
        return total

    @lru_cache(maxsize=4096)  # noqa: B019  one counter lives as long as its worker
    def mapped(self, blank: str) -> str:
        return "".join(m for m, _ in self.pre.pre_tokenize_str(blank))


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_tables(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The exact token count at every prefix of every whole text: doc_id, n_bytes, n_chars, n_tokens and steps.

    `steps` holds the change of the count with each character, as signed bytes (as 32-bit integers where a text has a wider one):
    sums of it are the counts at the prefixes. Each worker cuts its texts into units that no token crosses, fills the table of each distinct
    unit once, and puts the units' tables one after another; nothing is shuffled.

    Edge cases: a null text is an empty one (0 bytes, 0 tokens, no steps); texts of any length have whole tables; repeated rows stay; a null
    id stays null; an empty table gives no rows; other columns aren't read.
    """
    small_batches(docs.sparkSession)

    def make():
        tables = counter(vocabulary)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, codes, bounds = units(column(batch, "text"))
            counts, lengths = tables.store.gather(tables.store(names)[codes])
            stop = np.cumsum(lengths)
            change = np.diff(counts, prepend=0)
            inner = stop[:-1][(lengths[1:] > 0) & (stop[:-1] > 0)]
            change[inner] = counts[inner]  # a unit's table starts from 0
            at = np.concatenate([[0], stop])[bounds]
            narrow = change.astype(np.int8)
            wide = np.flatnonzero(narrow != change)
            raw = narrow.tobytes()
            steps = [raw[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            for i in set((np.searchsorted(at, wide, "right") - 1).tolist()):
                steps[i] = change[at[i] : at[i + 1]].astype("<i4").tobytes()
            total = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
            n = total[at[1:]] - total[at[:-1]]
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(np.diff(at)), pa.array(n), pa.array(steps, pa.binary())], names=["doc_id", "n_bytes", "n_chars", "n_tokens", "steps"])

        return step

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(rows, make, f"doc_id {kind}, n_bytes long, n_chars long, n_tokens long, steps binary")


def counts_of(steps: bytes, n_chars: int) -> np.ndarray:
    """The counts at the prefixes of 0, 1, … characters."""
    change = np.frombuffer(steps, np.int8 if len(steps) == n_chars else "<i4")
    return np.concatenate([[0], np.cumsum(change, dtype=np.int64)])


def token_counts(tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit`) from the stored tables of `prefix_tables`."""
    return tables.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fit_budget(tables: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of each text within a budget of tokens, from the stored tables alone: doc_id, n_chars, n_tokens.

    Counts of prefixes can fall by a token where a longer token closes, so the longest prefix is the last
    position whose count is within the budget, not the first that exceeds it.
    """
    small_batches(tables.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            chars, tokens = [], []
            for n, steps in zip(column(batch, "n_chars").to_pylist(), column(batch, "steps"), strict=True):
                counts = counts_of(steps.as_buffer(), n)
                best = int(np.flatnonzero(counts <= budget)[-1])
                chars.append(best)
                tokens.append(int(counts[best]))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

        return step

    kind = tables.schema["doc_id"].dataType.simpleString()
    return map_arrow(tables.select("doc_id", "n_chars", "steps"), make, f"doc_id {kind}, n_chars long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Scratch(spark, "prefixes").write(prefix_tables(table(spark, sf_dir, "documents"), public_vocabulary()), "tables")
    return token_counts(tables)
