"""A finite-state splitter of texts into the pre-tokens of a byte-level BPE tokenizer.

The splitting pattern is

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Its look-ahead is bounded (two characters after an apostrophe, one after white space), so each
code point together with its look-ahead becomes one of twelve symbols, and a machine of eight
states reads the symbols and marks where pre-tokens begin.  A buffer is cut into chunks; each
chunk's map from entry state to exit state is found for all chunks at once, a parallel prefix scan
composes the maps, and a second sweep with known entry states writes the marks.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from tokenizers import Regex, pre_tokenizers

# symbols
L, N, O, APOS, APOS1, APOS2, SPACE_LAST, SPACE_MORE, WHITE_LAST, EDGE, INSIDE = range(11)
# states
FREE, LETTERS, NUMBERS, OTHERS, LED, ONE_LEFT, TWO_LEFT, WHITES = range(8)
N_STATES, N_SYMBOLS = 8, 11
CHUNK, TAIL = 512, 64

# character kinds before the look-ahead is known
_LETTER, _STMD, _R, _V, _LL, _E, _NUMBER, _SPACE, _WHITE, _QUOTE, _OTHER, _EDGE, _IN = range(13)


#: No letter or number is, in any version of Unicode, beyond this code point.
_LAST = 0x40000
_given: list[np.ndarray] = []


@functools.cache
def kind_runs() -> tuple[np.ndarray, np.ndarray]:
    """The first code point of each run of one kind, and the kind, by the tokenizers library's own Unicode tables.

    Drivers find the runs once and ship them (some kilobytes) to the workers, which call :func:`give`.
    """
    table = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(_LAST))
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        pieces = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
        for _, (first, end) in pieces:
            table[first:end] = kind
    for c in [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = _WHITE
    table[32] = _SPACE
    table[ord("'")] = _QUOTE
    for c in "stmd":
        table[ord(c)] = _STMD
    for c, k in (("r", _R), ("v", _V), ("l", _LL), ("e", _E)):
        table[ord(c)] = k
    first = np.flatnonzero(np.append(True, table[1:] != table[:-1]))
    return first.astype(np.uint32), table[first]


def give(runs: tuple[np.ndarray, np.ndarray]) -> None:
    """Sets the kinds of this process to the runs that the driver found."""
    if not _given:
        first, kind = runs
        _given.append(np.repeat(kind, np.diff(first.astype(np.int64), append=0x110000)))


def kinds() -> np.ndarray:
    """The kind of each code point."""
    if not _given:
        give(kind_runs())
    return _given[0]


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, start mark), indexed by ``state * N_SYMBOLS + symbol``."""
    after = np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    starts = np.zeros((N_STATES, N_SYMBOLS), np.uint8)
    for s in range(N_STATES):
        for x in range(N_SYMBOLS):
            begin, to = True, FREE
            if x == L:
                begin, to = s not in (LETTERS, LED, ONE_LEFT, TWO_LEFT), {ONE_LEFT: FREE, TWO_LEFT: ONE_LEFT}.get(s, LETTERS)
            elif x == N:
                begin, to = s not in (NUMBERS, LED), NUMBERS
            elif x in (O, APOS, APOS1, APOS2):
                begin = s not in (OTHERS, LED)
                to = {APOS1: ONE_LEFT, APOS2: TWO_LEFT}.get(x, OTHERS) if begin else OTHERS
            elif x == SPACE_LAST:
                to = LED
            elif x == SPACE_MORE:
                begin, to = s != WHITES, WHITES
            elif x == INSIDE:
                begin = False
            after[s, x], starts[s, x] = to, begin
    return after.ravel(), starts.ravel()


def symbols(kind: np.ndarray) -> np.ndarray:
    """Symbols of code points whose kinds are given; the array must end with an edge."""
    first, second = np.append(kind[1:], _EDGE), np.append(kind[2:], [_EDGE, _EDGE])[: len(kind)]
    out = np.array([L, L, L, L, L, L, N, SPACE_MORE, SPACE_MORE, APOS, O, EDGE, INSIDE], np.uint8)[kind]
    ended = (first == _SPACE) | (first == _WHITE) | (first == _EDGE)
    out[(kind == _SPACE) & ~ended] = SPACE_LAST
    out[(kind == _WHITE) & ~ended] = WHITE_LAST
    at = np.flatnonzero(kind == _QUOTE)
    a, b = first[at], second[at]
    out[at[a == _STMD]] = APOS1
    out[at[((a == _R) | (a == _V)) & (b == _E) | (a == _LL) & (b == _LL)]] = APOS2
    return out


def chunk_maps(table: np.ndarray) -> np.ndarray:
    """Exit state of each chunk (row of ``table``) for each entry state: (chunks, states)."""
    after, _ = machine()
    settled = np.isin(table[:, -TAIL:], (SPACE_LAST, WHITE_LAST, EDGE)).any(axis=1)  # those symbols lead every state to one

    def sweep(part: np.ndarray) -> np.ndarray:
        state = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], len(part), axis=1)
        for row in np.ascontiguousarray(part.T):
            state = after[state * np.uint8(N_SYMBOLS) + row]
        return state.T

    maps = np.empty((len(table), N_STATES), np.uint8)
    maps[settled] = sweep(table[settled, -TAIL:])
    if not settled.all():
        maps[~settled] = sweep(table[~settled])
    return maps


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix composition of the chunks' maps (doubling steps)."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return maps


def marks(symbol: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; the machine enters the first chunk in state FREE."""
    n = len(symbol)
    table = np.full(-(-n // CHUNK) * CHUNK, EDGE, np.uint8)
    table[:n] = symbol
    table = table.reshape(-1, CHUNK)
    after, starts = machine()
    exits = scan(chunk_maps(table))[:, FREE]
    state = np.concatenate([[np.uint8(FREE)], exits[:-1]]).astype(np.uint8)
    out = np.empty((CHUNK, len(table)), np.uint8)
    for i, row in enumerate(np.ascontiguousarray(table.T)):
        at = state * np.uint8(N_SYMBOLS) + row
        out[i] = starts[at]
        state = after[at]
    return np.ascontiguousarray(out.T).ravel()[:n].astype(bool)


def split(texts: list[str], special: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts in order, as one binary array, and each text's first index in it.

    Each text is led by a separating pre-token, ``b"\\x00"``, at the index given for it; the rest
    up to the next text's index are its own.  Strings in ``special`` are pre-tokens of their own.
    """
    whole = "\0" + "\0".join(texts) if texts else ""
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    data = whole.encode()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    edges = np.cumsum(lengths) - lengths
    kind = kinds()[points]
    kind[edges] = _EDGE
    if special and any(x in whole for x in special):
        for m in re.finditer("|".join(map(re.escape, special)), whole):
            kind[m.start()] = _EDGE
            kind[m.start() + 1 : m.end()] = _IN
    begins = np.flatnonzero(marks(symbols(kind)))
    size = (1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
    place = np.cumsum(size) - size
    offsets = np.append(place[begins], len(data)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words, np.searchsorted(begins, edges)
