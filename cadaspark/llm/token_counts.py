"""Token counts by a compiled finite-state tokenizer.

Splitting into pre-tokens is the small machine of :mod:`cadaspark.llm.pretokens`, whose chunk state
maps are composed by a parallel prefix scan.  Within a pre-token, byte-level BPE is compiled to a
deterministic transducer over bytes.  The tokens of a BPE encoding are valid exactly when each
neighbouring pair is, so the last token of a prefix is the one suffix token that forms a valid pair
with the last token of what stands before it.  A state therefore holds the longest suffix that may
still grow to a token, with the last token and the relative count at each cut inside it; a
transition is annotated with the number of tokens that it adds (which may be negative, when a byte
joins tokens).  States and transitions are determinised when a text first needs them and kept by
the Python worker in arrays, and a group's distinct pre-tokens walk through them side by side; the
machine is the same whatever the order of texts.
"""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadaspark.llm import pretokens
from cadaspark.llm.common import clear_text, freed, groups, small_batches

LIMIT = 1024
#: Transitions that a worker keeps before a walk; beyond it the machine is emptied and compiled anew.
KEPT, KEPT_SINGLE = 600_000, 50_000
#: Words that are walked side by side at most; fewer than ``FEW`` are walked one by one.
WORDS, FEW = 200_000, 12
#: Order and result of a pair that no merge joins.
NO_MERGE = (1 << 60, -1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(token: int, count: int) -> int:
    """A cut of a state: the last token before it (-1: none) and its count relative to the end."""
    return token + 1 << 12 | count + 2048


def sealed(suffix: bytes, cuts: list[int] | tuple[int, ...]) -> bytes:
    """A state as one byte string, a fraction of what its objects take: the cuts, the suffix, and the number of cuts."""
    return struct.pack(f"<{len(cuts)}q", *cuts) + suffix + struct.pack("<H", len(cuts))


def opened(state: bytes) -> tuple[bytes, tuple[int, ...]]:
    """The suffix and the cuts of a state."""
    n = struct.unpack_from("<H", state, len(state) - 2)[0]
    return state[8 * n : -2], struct.unpack_from(f"<{n}q", state)


class Transitions:
    """Transitions by number, ``state << 8 | byte``, in arrays that many words are looked up in at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for a key that is not held."""
        at = self.places(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not held."""
        if 2 * (self.size + len(keys)) > 1 << self.bits:
            held = self.keys >= 0
            keys, values = np.append(self.keys[held], keys), np.append(self.values[held], values)
            self.__init__(max(self.bits + 1, int(2 * len(keys)).bit_length()))
        self.size += len(keys)
        at = self.places(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.values[slots] = keys[free[first]], values[free[first]]
            left = np.ones(len(keys), bool)
            left[free[first]] = False
            keys, values, at = keys[left], values[left], at[left] + 1 & (1 << self.bits) - 1


class Transducer:
    """Counts the BPE tokens of byte strings; state 0 is the initial one."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = tuple(t["content"] for t in spec.get("added_tokens", ()))
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left token, right token) -> (order of the merge, token that it makes)
        self.merges = {(self.ids[x], self.ids[y]): (r, self.ids[x + y]) for r, (x, y) in enumerate((as_bytes(a), as_bytes(b)) for a, b in pairs)}
        self.prefixes = {t[:k] for t in self.ids for k in range(len(t) + 1)}
        self.edges: dict[int, tuple] = {}
        self.clear()

    def clear(self) -> None:
        self.pairs: dict[int, bool] = {}  # left + 1 << 32 | right -> whether the pair is valid
        self.states: list[bytes] = [sealed(b"", (packed(-1, 0),))]
        self.numbers = {self.states[0]: 0}
        self.steps = Transitions()  # state << 8 | byte -> next state << 10 | added + 512
        self.single: dict[int, int] = {}  # those of them that long words went through

    def growth(self, token: int) -> tuple:
        """How BPE makes a token of its bytes: (order, first part, last part) after each merge, the bytes first."""
        known = self.edges.get(token)
        if known is None:
            parts = [self.ids[bytes((b,))] for b in self.bytes_of[token]]
            steps = [(-1, parts[0], parts[-1])]
            while len(parts) > 1:
                (order, made), i = min((self.merges.get(pair, NO_MERGE), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
                if made < 0:
                    break
                parts[i : i + 2] = [made]
                steps.append((order, parts[0], parts[-1]))
            known = self.edges[token] = (tuple(steps), parts == [token])
        return known

    def valid(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when written side by side (left -1: none).

        Both grow side by side, the lesser merge first; they stay apart if the merge over the border
        is never the least of all.
        """
        pair = left + 1 << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            (b, known) = self.growth(right)
            if known and left >= 0:
                a, known = self.growth(left)
                i = j = 0
                while known:
                    next_a = a[i + 1][0] if i + 1 < len(a) else NO_MERGE[0]
                    next_b = b[j + 1][0] if j + 1 < len(b) else NO_MERGE[0]
                    over = self.merges.get((a[i][2], b[j][1]), NO_MERGE)[0]
                    if over < next_a and over <= next_b and over < NO_MERGE[0]:
                        known = False
                    elif next_a <= next_b and next_a < NO_MERGE[0]:
                        i += 1
                    elif next_b < NO_MERGE[0]:
                        j += 1
                    else:
                        break
            self.pairs[pair] = known
        return known

    def compile(self, number: int, byte: int) -> int:
        """The transition of a state on a byte."""
        suffix, cuts = opened(self.states[number])
        grown = suffix + bytes((byte,))
        while grown not in self.prefixes:
            grown = grown[1:]
        size = len(grown)
        for k in range(size):
            token = self.ids.get(grown[k:])
            if token is not None and size - k <= len(cuts) and self.valid((cuts[k - size] >> 12) - 1, token):
                break
        else:
            raise ValueError("the vocabulary has no token for a byte")
        added = (cuts[k - size] & 4095) - 2048 + 1
        state = sealed(grown, [c - added for c in cuts[-size:]] + [packed(token, 0)])
        to = self.numbers.setdefault(state, len(self.states))
        if to == len(self.states):
            self.states.append(state)
        return to << 10 | added + 512

    def step(self, key: int) -> int:
        """One transition, compiled if it is new."""
        found = int(self.steps.get(np.array([key]))[0])
        if found < 0:
            found = self.compile(key >> 8, key & 255)
            self.steps.put(np.array([key]), np.array([found]))
        if len(self.single) > KEPT_SINGLE:
            self.single = {}
        self.single[key] = found
        return found

    def walk(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each word, all of them read side by side a byte at a time."""
        if self.steps.size > KEPT:
            self.clear()
        order = np.argsort(-sizes, kind="stable")
        at, lengths = first[order], sizes[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        longer = len(order) - np.cumsum(np.bincount(sizes, minlength=1))  # words of more than k bytes
        k = 0
        while longer[k] > FEW:
            n = longer[k]
            keys = state[:n] << 8 | data[at[:n] + k]
            steps = self.steps.get(keys)
            new = np.flatnonzero(steps < 0)
            if len(new):
                distinct, where = np.unique(keys[new], return_inverse=True)
                made = np.array([self.compile(x >> 8, x & 255) for x in distinct.tolist()], np.int64)
                self.steps.put(distinct, made)
                steps[new] = made[where]
            state[:n] = steps >> 10
            total[:n] += (steps & 1023) - 512
            k += 1
        for i in range(longer[k]):  # the few longest words, one by one
            s, n, single = int(state[i]), 0, self.single
            for byte in data[at[i] + k : at[i] + lengths[i]].tobytes():
                step = single.get(s << 8 | byte)
                if step is None:
                    step, single = self.step(s << 8 | byte), self.single
                s = step >> 10
                n += (step & 1023) - 512
            total[i] += n
        out = np.empty_like(total)
        out[order] = total
        return out

    def count(self, words: pa.Array) -> np.ndarray:
        """Tokens of each pre-token (a binary array without nulls)."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data, first, sizes = np.frombuffer(words.buffers()[2], np.uint8), offsets[:-1], np.diff(offsets)
        parts = [self.walk(data, first[i : i + WORDS], sizes[i : i + WORDS]) for i in range(0, len(words), WORDS)]
        out = np.concatenate([np.zeros(0, np.int64), *parts])
        for text in self.special:
            whole = np.frombuffer(text.encode(), np.uint8)
            alike = np.flatnonzero(sizes == len(whole))
            out[alike[(data[first[alike][:, None] + np.arange(len(whole))] == whole).all(axis=1)]] = 1
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if not texts:
            return np.zeros(0, np.int64)
        words, first = pretokens.split(texts, self.special)
        coded = words.dictionary_encode()
        per_word = self.count(coded.dictionary)[coded.indices.to_numpy()]
        per_word[first] = 0
        return np.add.reduceat(per_word, first)


@functools.cache
def transducer(path: str) -> Transducer:
    """One machine a Python worker and vocabulary file."""
    return Transducer(path)


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row of ``df``.

    ``tokenizer`` is the path of a byte-level BPE file that every executor has.  Special strings in
    a text count as one token each, as the file's library does by default; no begin, end or padding
    tokens are counted.  Null and empty texts have 0 bytes and 0 tokens.  Columns of ``df`` stay,
    whatever their names; those named like a new one are replaced; repeated rows stay repeated; an empty table gives an
    empty result.  Rows stay where they are (no shuffle) and texts are read whole, in groups of
    bounded size.
    """
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in df.columns if c not in (*new, text)] + ([text] if text not in new else [])
    inner = {c: f"c{i}" for i, c in enumerate(kept)}
    source = df.select(*[df[c].alias(i) for c, i in inner.items()], F.coalesce(df[text], F.lit("")).alias("__text"))

    small_batches(df.sparkSession)
    runs = pretokens.kind_runs()

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens.give(runs)
        machine = transducer(tokenizer)
        for batch in batches:
            for part in groups(batch, "__text"):
                texts = part.column("__text").to_pylist()
                n = machine.counts(texts)
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                names = [c for c in part.schema.names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], sizes, pa.array(n, pa.int64()), pa.array(n > limit)], names=[*names, *new])

    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "n_bytes bigint, n_tokens bigint, over_limit boolean"])
    return source.mapInArrow(run, schema).toDF(*kept, *new)


def op6(spark, sf_dir: str, tokenizer: str) -> DataFrame:
    from cadaspark.llm.common import documents

    docs = documents(spark, sf_dir).select("doc_id", clear_text().alias("text"))
    return token_counts(docs, tokenizer).select("doc_id", "n_bytes", "n_tokens", "over_limit")
